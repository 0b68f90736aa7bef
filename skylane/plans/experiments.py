"""Registered A/B queries over the ``fx_ab`` adapter view, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import np_round, zcrit
from ..operators.common import attach
from ..operators import experiment as ab
from ..sources.fixtures import fx_ab, with_views
from . import sqlfrag as S

G, Y = "ab_group", "converted"
SEGMENTS = ["fare_class", "device"]
P_DIGITS = 9  # p-values come from different series in the two engines


def q_ab_summary(spark, sf):
    return ab.ab_summary(fx_ab(spark, sf), G, Y)


def messy(spark, sf):
    """The experiment as landed: arm labels in any case, outcomes as text, some of them no numbers."""
    raw = F.when(F.col("visitor_id") % 17 == 0, F.lit("n/a")).when(F.col("visitor_id") % 5 == 0, F.concat(F.col("converted").cast("string"), F.lit(".9"))) \
        .otherwise(F.col("converted").cast("string"))
    arm = F.when(F.col("visitor_id") % 3 == 0, F.upper(G)).when(F.col("visitor_id") % 3 == 1, F.initcap(G)).otherwise(F.col(G))
    return fx_ab(spark, sf).withColumns({G: arm, Y: raw})


def q_ab_sanitized(spark, sf):
    return ab.sanitize_ab(messy(spark, sf), G, Y).select("visitor_id", G, Y)


def q_ab_summary_sanitized(spark, sf):
    return ab.ab_summary(ab.sanitize_ab(messy(spark, sf), G, Y), G, Y)


def q_ab_price_histogram(spark, sf):
    return ab.histogram(fx_ab(spark, sf), "display_price", 80, [G])


def q_ab_ztest(spark, sf):
    r = ab.ab_ztest(fx_ab(spark, sf), G, Y)
    return r.withColumn("p_value", np_round("p_value", P_DIGITS))


def q_ab_srm(spark, sf):
    return ab.ab_srm(fx_ab(spark, sf), G).withColumn("SRM_PVALUE", np_round("SRM_PVALUE", P_DIGITS))


def q_ab_segments(spark, sf):
    r = ab.segment_ab(fx_ab(spark, sf), "device", G, Y, min_n_per_arm=50)
    return ab.order_segments(r.withColumn("P_VALUE", np_round("P_VALUE", P_DIGITS)))


def q_ab_segments_all(spark, sf):
    r = ab.segment_ab_all(fx_ab(spark, sf), SEGMENTS, G, Y, min_n_per_arm=50)
    return r.withColumn("P_VALUE", np_round("P_VALUE", P_DIGITS))


def q_ab_sequential(spark, sf):
    r = ab.sequential_monitoring(fx_ab(spark, sf), "event_time", G, Y, checkpoints=10, tie_col="visitor_id")
    return r.withColumn("P_VALUE", np_round("P_VALUE", P_DIGITS))


def _money(df, cols):
    return df.withColumns({c: np_round(c, 2) for c in cols if c in ("REVENUE",)} |
                          {c: np_round(c, 6) for c in cols if c not in ("REVENUE",)})


def q_ab_revenue(spark, sf):
    r = ab.revenue_lens(fx_ab(spark, sf), [], G, Y, "display_price")
    return _money(r, ["REVENUE", "RPV", "AOV"])


def q_ab_revenue_by_fare(spark, sf):
    r = ab.revenue_lens(fx_ab(spark, sf), ["fare_class"], G, Y, "display_price")
    return _money(r, ["REVENUE", "RPV", "AOV"])


def q_ab_revenue_pivot(spark, sf):
    r = ab.revenue_pivot(fx_ab(spark, sf), "fare_class", G, Y, "display_price")
    return r.withColumns({c: np_round(c, 6) for c in r.columns if c.startswith("RPV_")})


def q_ab_bootstrap(spark, sf):
    return ab.bootstrap_conversion_diff(fx_ab(spark, sf), G, Y, n_bootstrap=10000, seed=42)


def q_ab_revenue_missing_fare(spark, sf):
    """Visitors without a fare class belong to no fare class."""
    x = fx_ab(spark, sf).withColumn("fare_class", F.when(F.col("visitor_id") % 10 != 0, F.col("fare_class")))
    return _money(ab.revenue_lens(x, ["fare_class"], G, Y, "display_price"), ["REVENUE", "RPV", "AOV"])


def q_ab_bootstrap_check(spark, sf):
    """The bootstrap against the exact difference and the normal interval."""
    x = fx_ab(spark, sf)
    boot = attach(ab.bootstrap_conversion_diff(x, G, Y, n_bootstrap=10000, seed=42),
                  ab.arm_counts(x, G, Y, "control", "treatment"))
    p = {a: F.col(f"x_{a}") / F.col(f"n_{a}") for a in "ct"}
    se = F.sqrt(sum((p[a] * (1 - p[a]) / F.col(f"n_{a}") for a in "ct"), F.lit(0.0)))
    width = (F.col("ci_upper") - F.col("ci_lower")) / (F.lit(2 * zcrit(0.05)) * se)
    return boot.select((F.abs(F.col("mean_diff") - (p["t"] - p["c"])) <= 4 * se / F.sqrt(F.col("n_bootstrap"))).alias("MEAN_OK"),
                       (F.abs(width - 1) <= 0.03).alias("WIDTH_OK"),
                       (F.col("significant") == ((F.col("ci_lower") > 0) | (F.col("ci_upper") < 0))).alias("SIGNIFICANCE_OK"), "n_bootstrap")


QUERIES = {
    "ab_revenue_missing_fare": q_ab_revenue_missing_fare,
    "ab_bootstrap_check": q_ab_bootstrap_check,
    "ab_summary": q_ab_summary,
    "ab_sanitized": q_ab_sanitized,
    "ab_summary_sanitized": q_ab_summary_sanitized,
    "ab_price_histogram": q_ab_price_histogram,
    "ab_ztest": q_ab_ztest,
    "ab_srm": q_ab_srm,
    "ab_segments": q_ab_segments,
    "ab_segments_all": q_ab_segments_all,
    "ab_sequential": q_ab_sequential,
    "ab_revenue": q_ab_revenue,
    "ab_revenue_by_fare": q_ab_revenue_by_fare,
    "ab_revenue_pivot": q_ab_revenue_pivot,
    "ab_bootstrap": q_ab_bootstrap,
}

# ----------------------------------------------------------------------------- oracle

_Y = "coalesce(converted, 0)"


def _ztest_select(nc, xc, nt, xt, src, extra="", alpha=0.05):
    """SQL that turns n/x columns of ``src`` into z-test columns (pooled SE)."""
    return f"""
select {extra} p1 as cvr_control, p2 as cvr_treatment, diff as abs_diff,
  case when p1 > 0 then diff / p1 * 100 end as rel_lift_pct,
  case when se <= 0 then 0e0 else diff / se end as z_stat,
  {S.rnd(f"case when se <= 0 then 1e0 else {S.norm_sf2('diff / se')} end", P_DIGITS)} as p_value,
  diff - {S.zcrit(alpha)} * se as ci_low, diff + {S.zcrit(alpha)} * se as ci_high,
  (case when se <= 0 then 1e0 else {S.norm_sf2('diff / se')} end) < {alpha!r} as significant
from (select *, p2 - p1 as diff,
        sqrt(pooled * (1 - pooled) * (1e0 / greatest({nc}, 1) + 1e0 / greatest({nt}, 1))) as se
      from (select *, {xc} / greatest({nc}, 1) as p1, {xt} / greatest({nt}, 1) as p2,
                   ({xc} + {xt}) / greatest({nc} + {nt}, 1) as pooled from {src}) s0) s1"""


_COUNTS = f"""select count(case when ab_group = 'control' then 1 end) as n_c,
  coalesce(sum(case when ab_group = 'control' then {_Y} end), 0) as x_c,
  count(case when ab_group = 'treatment' then 1 end) as n_t,
  coalesce(sum(case when ab_group = 'treatment' then {_Y} end), 0) as x_t"""

_SEG_SELECT = f"""
select {{keep}} seg as SEGMENT_VALUE, n_c as N_CONTROL, n_t as N_TREATMENT,
  x_c / greatest(n_c, 1) as CVR_CONTROL, x_t / greatest(n_t, 1) as CVR_TREATMENT,
  case when small then null else abs_diff end as ABS_DIFF,
  case when small then null else rel_lift_pct end as RELATIVE_LIFT_PCT,
  case when small then null else p_value end as P_VALUE,
  case when small then false else significant end as SIGNIFICANT,
  case when small then 'min_n_per_arm<50' else '' end as SKIP_REASON
from ({_ztest_select('n_c', 'x_c', 'n_t', 'x_t', 'segc', extra='*, n_c < 50 or n_t < 50 as small,')}) z"""

_MESSY = """messy as (select visitor_id,
  case visitor_id % 3 when 0 then upper(ab_group) when 1 then upper(ab_group[1]) || ab_group[2:] else ab_group end as ab_group,
  case when visitor_id % 17 = 0 then 'n/a' when visitor_id % 5 = 0 then cast(converted as varchar) || '.9' else cast(converted as varchar) end as converted from fx_ab),
clean as (select visitor_id, lower(ab_group) as ab_group, cast(trunc(coalesce(try_cast(converted as double), 0e0)) as bigint) as converted from messy)"""

ORACLE = {
    "ab_sanitized": with_views(", " + _MESSY + " select visitor_id, ab_group, converted from clean", "fx_ab"),
    "ab_summary_sanitized": with_views(", " + _MESSY + """ select ab_group, count(*) as N, cast(sum(converted) as bigint) as CONVERSIONS,
  sum(converted) / greatest(count(*), 1) as CVR from clean group by ab_group""", "fx_ab"),
    "ab_price_histogram": with_views(f""",
s as (select ab_group, min(display_price) as lo, max(display_price) as hi from fx_ab group by ab_group),
x as (select s.ab_group, display_price as v, lo, hi, (hi - lo) / 80e0 as step, least(cast(trunc((display_price - lo) / (hi - lo) * 80e0) as int), 79) as i0
      from fx_ab p join s on s.ab_group = p.ab_group),
x1 as (select *, case when v < i0 * step + lo then i0 - 1 else i0 end as i1 from x),
x2 as (select *, case when i1 <> 79 and v >= (i1 + 1) * step + lo then i1 + 1 else i1 end as BIN from x1)
select c.ab_group, c.BIN, c.BIN * ((s.hi - s.lo) / 80e0) + s.lo as BIN_LOW,
  case when c.BIN = 79 then s.hi else (c.BIN + 1) * ((s.hi - s.lo) / 80e0) + s.lo end as BIN_HIGH, c.COUNT
from (select ab_group, BIN, count(*) as COUNT from x2 group by ab_group, BIN) c join s on s.ab_group = c.ab_group""", "fx_ab"),
    "ab_summary": with_views(f"""
select ab_group, count(*) as N, cast(sum({_Y}) as bigint) as CONVERSIONS, sum({_Y}) / greatest(count(*), 1) as CVR
from fx_ab where ab_group is not null group by ab_group""", "fx_ab"),

    "ab_ztest": with_views(_ztest_select("n_c", "x_c", "n_t", "x_t", f"({_COUNTS} from fx_ab) c"), "fx_ab"),

    "ab_srm": with_views(f"""
select N_CONTROL, N_TREATMENT, {S.rnd('p', P_DIGITS)} as SRM_PVALUE, p < 0.05e0 as SRM_FLAG from (
  select *, case when e > 0 then {S.chi2_sf('chi2', '1')} end as p from (
    select *, case when e > 0 then (N_CONTROL - e) * (N_CONTROL - e) / e + (N_TREATMENT - e) * (N_TREATMENT - e) / e end as chi2
    from (select *, (N_CONTROL + N_TREATMENT) / 2e0 as e from (
      select count(case when ab_group = 'control' then 1 end) as N_CONTROL,
             count(case when ab_group = 'treatment' then 1 end) as N_TREATMENT from fx_ab) a) b) c) d""", "fx_ab"),

    "ab_segments": with_views(
        "select * from (" + _SEG_SELECT.format(keep="") .replace(
            "from segc", f"from ({_COUNTS}, cast(device as varchar) as seg from fx_ab where device is not null group by device) segc")
        + ") q order by RELATIVE_LIFT_PCT desc nulls last, SEGMENT_VALUE", "fx_ab"),

    "ab_segments_all": with_views(
        _SEG_SELECT.format(keep="SEGMENT_TYPE,").replace(
            "from segc", f"""from ({_COUNTS}, t as SEGMENT_TYPE, seg from (
                select ab_group, converted, 'fare_class' as t, cast(fare_class as varchar) as seg from fx_ab
                union all select ab_group, converted, 'device', cast(device as varchar) from fx_ab) u
              where seg is not null group by t, seg) segc"""), "fx_ab"),

    "ab_sequential": with_views(f"""
, b as (select ab_group as g, {_Y} as y, row_number() over (order by event_time, visitor_id) as pos
        from fx_ab where event_time is not null),
nn as (select count(*) as n, trunc(count(*) / 10e0) as a from b),
cuts as (select j, case when j = 9 then n else cast(trunc(j * ((n - a) / 9e0) + a) as bigint) end as cut
         from nn, range(0, 10) r(j) where n > 0),
pc as (select c.j, c.cut, b.g, count(*) as n, sum(b.y) as x from cuts c join b on b.pos <= c.cut
       where b.g is not null group by c.j, c.cut, b.g),
ranked as (select *, count(*) over (partition by j) as n_arms, row_number() over (partition by j order by g) as rk from pc),
per as (select j, cut,
   max(case when lower(g) = 'control' then 1 else 0 end) = 1 and max(case when lower(g) = 'treatment' then 1 else 0 end) = 1 as lab,
   arg_min(case when lower(g) = 'control' then n end, case when lower(g) = 'control' then rk end) as nc_l,
   arg_min(case when lower(g) = 'control' then x end, case when lower(g) = 'control' then rk end) as xc_l,
   arg_min(case when lower(g) = 'treatment' then n end, case when lower(g) = 'treatment' then rk end) as nt_l,
   arg_min(case when lower(g) = 'treatment' then x end, case when lower(g) = 'treatment' then rk end) as xt_l,
   max(case when rk = 1 then n end) as n1, max(case when rk = 1 then x end) as x1,
   max(case when rk = 2 then n end) as n2, max(case when rk = 2 then x end) as x2
 from ranked where n_arms >= 2 group by j, cut),
fin as (select cut, case when lab then nc_l else n1 end as nc, case when lab then xc_l else x1 end as xc,
               case when lab then nt_l else n2 end as nt, case when lab then xt_l else x2 end as xt from per)
select CHECKPOINT_N, CVR_CONTROL, CVR_TREATMENT, ABS_DIFF, P_VALUE, SIGNIFICANT,
  'Monitoring only; adjust for sequential testing if making stop/go decisions.' as NOTE from (
  select cut as CHECKPOINT_N, cvr_control as CVR_CONTROL, cvr_treatment as CVR_TREATMENT, abs_diff as ABS_DIFF,
         p_value as P_VALUE, significant as SIGNIFICANT
  from ({_ztest_select('nc', 'xc', 'nt', 'xt', 'fin', extra='cut,')}) z) q""", "fx_ab"),

    "ab_revenue": with_views(f"""
select ab_group, VISITORS, BOOKINGS, {S.rnd('REVENUE', 2)} as REVENUE, BOOKINGS / VISITORS as CVR,
  {S.rnd('REVENUE / VISITORS', 6)} as RPV, {S.rnd('case when BOOKINGS > 0 then REVENUE / BOOKINGS end', 6)} as AOV
from (select ab_group, count(*) as VISITORS, cast(sum({_Y}) as bigint) as BOOKINGS,
        sum(case when {_Y} = 1 then coalesce(display_price, 0e0) else 0e0 end) as REVENUE
      from fx_ab where ab_group is not null group by ab_group) r""", "fx_ab"),

    "ab_revenue_by_fare": with_views(f"""
select fare_class, ab_group, VISITORS, BOOKINGS, {S.rnd('REVENUE', 2)} as REVENUE, BOOKINGS / VISITORS as CVR,
  {S.rnd('REVENUE / VISITORS', 6)} as RPV, {S.rnd('case when BOOKINGS > 0 then REVENUE / BOOKINGS end', 6)} as AOV
from (select fare_class, ab_group, count(*) as VISITORS, cast(sum({_Y}) as bigint) as BOOKINGS,
        sum(case when {_Y} = 1 then coalesce(display_price, 0e0) else 0e0 end) as REVENUE
      from fx_ab where ab_group is not null group by fare_class, ab_group) r""", "fx_ab"),

    "ab_revenue_pivot": with_views(f"""
select fare_class,
  sum(case when ab_group = 'control' then {_Y} end) / nullif(count(case when ab_group = 'control' then 1 end), 0) as CVR_control,
  {S.rnd(f"sum(case when ab_group = 'control' then (case when {_Y} = 1 then coalesce(display_price, 0e0) else 0e0 end) end) / nullif(count(case when ab_group = 'control' then 1 end), 0)", 6)} as RPV_control,
  sum(case when ab_group = 'treatment' then {_Y} end) / nullif(count(case when ab_group = 'treatment' then 1 end), 0) as CVR_treatment,
  {S.rnd(f"sum(case when ab_group = 'treatment' then (case when {_Y} = 1 then coalesce(display_price, 0e0) else 0e0 end) end) / nullif(count(case when ab_group = 'treatment' then 1 end), 0)", 6)} as RPV_treatment
from fx_ab group by fare_class""", "fx_ab"),
}

ORACLE["ab_revenue_missing_fare"] = "select * from (" + ORACLE["ab_revenue_by_fare"].replace(
    "o_orderpriority as fare_class", "case when o_orderkey % 10 <> 0 then o_orderpriority end as fare_class") + ") q where fare_class is not null"
ORACLE["ab_bootstrap_check"] = "select true as MEAN_OK, true as WIDTH_OK, true as SIGNIFICANCE_OK, cast(10000 as bigint) as n_bootstrap"
