"""Registered listing / funnel queries over ``fx_hotels`` and ``events``, with DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import np_round
from ..operators import funnel as fn
from ..operators import listing as ls
from ..operators.common import attach
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import FIXTURE_SQL, fx_events, fx_hotels, table, with_views
from ..sources.io import enrich_if_missing, rename_if_present
from ..streaming.funnel import EventFunnelStream

# schema normalisation (A6): adapter names -> the analysis names
HOTEL_NAMES = {"place_id": "PLACE_ID", "name": "NAME", "market": "MARKET", "rating": "RATING",
               "total_ratings": "TOTAL_RATINGS", "price_level": "PRICE_LEVEL", "num_photos": "NUM_PHOTOS",
               "business_status": "BUSINESS_STATUS"}
MARKET_A, MARKET_B = "Dubai", "NYC"
R6 = 9  # digits kept for derived percentages compared across engines


def hotels(spark, sf):
    return rename_if_present(fx_hotels(spark, sf), HOTEL_NAMES)


def prepared(spark, sf):
    return ls.prepare_listings(hotels(spark, sf))


def q_schema_normalize(spark, sf):
    return hotels(spark, sf)


def q_listing_enrich(spark, sf):
    return prepared(spark, sf)


def q_market_compare(spark, sf):
    return ls.compare_markets(prepared(spark, sf))


def q_price_tier_mix(spark, sf):
    return ls.price_tier_mix(prepared(spark, sf))


def q_trust_quadrant(spark, sf):
    return ls.trust_quadrant(prepared(spark, sf)).select("PLACE_ID", "MARKET", "RATING", "TOTAL_RATINGS", "TRUST_QUADRANT")


def q_trust_quadrant_summary(spark, sf):
    return ls.quadrant_summary(ls.trust_quadrant(prepared(spark, sf)))


def q_category_counts(spark, sf):
    return ls.category_counts(prepared(spark, sf))


def q_score_histogram(spark, sf):
    return ls.score_histogram(prepared(spark, sf), bins=20)


def _events(spark, sf):
    return fx_events(spark, sf).withColumnRenamed("market", "MARKET")


def q_funnel_summary(spark, sf):
    return fn.event_funnel_by_market(_events(spark, sf)).withColumns({
        "DROP_OFF_PCT": np_round("DROP_OFF_PCT", R6), "OVERALL_CONVERSION_PCT": np_round("OVERALL_CONVERSION_PCT", R6)})


def q_dropoff_diagnosis(spark, sf):
    return fn.dropoff_diagnosis(fn.event_funnel_by_market(_events(spark, sf)), MARKET_A, MARKET_B) \
        .withColumns({c: np_round(c, R6) for c in [f"DROP_OFF_PCT_{MARKET_A.upper()}", f"DROP_OFF_PCT_{MARKET_B.upper()}", "DROPOFF_GAP"]})


def q_enrich_if_missing(spark, sf):
    once = enrich_if_missing(hotels(spark, sf), ls.ENRICHED_COLUMNS, ls.prepare_listings)
    return enrich_if_missing(once, ls.ENRICHED_COLUMNS, ls.prepare_listings)


def q_listing_missing_text(spark, sf):
    """Landed numbers as text, the missing ones as "NaN"."""
    raw = hotels(spark, sf)
    return ls.prepare_listings(raw.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in ("RATING", "PRICE_LEVEL")}))


def q_event_funnel(spark, sf):
    r = fn.event_funnel(table(spark, sf, "events"))
    return r.withColumns({"DROP_OFF_PCT": np_round("DROP_OFF_PCT", R6),
                          "OVERALL_CONVERSION_PCT": np_round("OVERALL_CONVERSION_PCT", R6)})


#: How the streamed log lands: in so many files by arrival, up to two days after the event; some users' events come last.
LANDINGS, SLOW_USERS = 4, 50


def arrivals(events):
    """The event log with the number of the landing that brings each event."""
    at = F.unix_micros(F.col("ts").cast("timestamp") + F.make_interval(hours=(F.col("user_id") * 7 % 48).cast("int")))
    one = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("lo"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("hi"))
    x = attach(events.withColumn("at", at), one)
    slot = F.least(F.expr(f"({LANDINGS} * (at - lo)) div greatest(hi - lo, 1)"), F.lit(LANDINGS - 1))
    return x.withColumn("landing", F.when(F.col("user_id") % SLOW_USERS == 0, LANDINGS - 1).otherwise(slot).cast("int")).select(*events.columns, "landing")


def q_event_funnel_stream(spark, sf):
    """The event log lands file by file and out of order; the stream goes on after each landing."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/event-funnel-{uuid.uuid4().hex}"
    landed = arrivals(table(spark, sf, "events").select("user_id", "ts", "event_type"))
    funnel = EventFunnelStream(spark, f"{root}/state")
    for i in range(LANDINGS):
        landed.where(F.col("landing") == i).drop("landing").write.mode("append").parquet(f"{root}/landed")
        funnel.start(spark.readStream.schema(landed.drop("landing").schema).parquet(f"{root}/landed")).awaitTermination()
    funnel.finish()
    late = funnel.late().select(F.lit(None).cast("int").alias("STAGE_NO"), F.lit("late").alias("STAGE"), F.col("LATE_EVENTS").alias("ENTITY_DAYS"),
                                F.lit(None).cast("double").alias("DROP_OFF_PCT"), F.lit(None).cast("double").alias("OVERALL_CONVERSION_PCT"))
    return funnel.funnel().withColumns({c: np_round(c, R6) for c in ("DROP_OFF_PCT", "OVERALL_CONVERSION_PCT")}).unionByName(late)


QUERIES = {
    "event_funnel_stream": q_event_funnel_stream,
    "schema_normalize": q_schema_normalize,
    "listing_enrich": q_listing_enrich,
    "market_compare": q_market_compare,
    "price_tier_mix": q_price_tier_mix,
    "trust_quadrant": q_trust_quadrant,
    "trust_quadrant_summary": q_trust_quadrant_summary,
    "category_counts": q_category_counts,
    "score_histogram": q_score_histogram,
    "funnel_summary": q_funnel_summary,
    "dropoff_diagnosis": q_dropoff_diagnosis,
    "event_funnel": q_event_funnel,
    "enrich_if_missing": q_enrich_if_missing,
    "listing_missing_text": q_listing_missing_text,
}

# ----------------------------------------------------------------------------- oracle

_H = """h as (select place_id as PLACE_ID, name as NAME, market as MARKET, rating as RATING,
  total_ratings as TOTAL_RATINGS, price_level as PRICE_LEVEL, num_photos as NUM_PHOTOS,
  business_status as BUSINESS_STATUS from fx_hotels)"""

_HP = _H + """,
hc as (select PLACE_ID, NAME, MARKET, cast(RATING as double) as RATING,
  cast(coalesce(cast(TOTAL_RATINGS as double), 0e0) as bigint) as TOTAL_RATINGS, cast(PRICE_LEVEL as double) as PRICE_LEVEL,
  cast(coalesce(cast(NUM_PHOTOS as double), 0e0) as bigint) as NUM_PHOTOS, BUSINESS_STATUS from h),
hm as (select MARKET, quantile_cont(TOTAL_RATINGS, 0.99) as p99, max(NUM_PHOTOS) as mp from hc where MARKET is not null group by MARKET),
hp as (select hc.MARKET, hc.PLACE_ID, hc.NAME, hc.RATING, hc.TOTAL_RATINGS, hc.PRICE_LEVEL, hc.NUM_PHOTOS, hc.BUSINESS_STATUS,
  case when hc.PRICE_LEVEL = 1 then 'Budget' when hc.PRICE_LEVEL = 2 then 'Mid-Range' when hc.PRICE_LEVEL = 3 then 'Upscale'
       when hc.PRICE_LEVEL = 4 then 'Luxury' else 'Unknown' end as PRICE_TIER,
  case when hc.RATING is null then 'Unrated' when hc.RATING >= 4.5e0 then 'Excellent' when hc.RATING >= 4e0 then 'Good'
       when hc.RATING >= 3.5e0 then 'Average' else 'Low' end as RATING_TIER,
  case when hc.MARKET is null then 0e0 else round_even((0.5e0 * least(greatest(hc.TOTAL_RATINGS / coalesce(nullif(hm.p99, 0e0), 1e0), 0e0), 1e0)
       + 0.35e0 * (coalesce(hc.RATING, 0e0) / 5e0)
       + 0.15e0 * least(greatest(hc.NUM_PHOTOS / coalesce(nullif(cast(hm.mp as double), 0e0), 1e0), 0e0), 1e0)) * 100e0, 1) end as VISIBILITY_SCORE,
  coalesce(hc.RATING is not null and hc.TOTAL_RATINGS >= 10 and hc.BUSINESS_STATUS in ('OPERATIONAL', ''), false) as IS_BOOKABLE
from hc left join hm on hm.MARKET = hc.MARKET)"""


def _grid_mean(c, d=1):
    s = 10 ** d
    return f"(sum(cast(round_even({c} * {s}e0, 0) as bigint)) / ({s}e0 * count({c})))"


_TQ = """tq as (select hp.*, case
  when RATING >= rm and TOTAL_RATINGS >= vm then '⭐ Star Performer'
  when RATING >= rm and TOTAL_RATINGS < vm then '🔍 Hidden Gem'
  when RATING < rm and TOTAL_RATINGS >= vm then '⚠️ Known but Risky' else '❌ Low Signal' end as TRUST_QUADRANT
  from hp left join (select MARKET, median(RATING) as rm, median(TOTAL_RATINGS) as vm from hp
                     where MARKET is not null group by MARKET) md on md.MARKET = hp.MARKET)"""

def _stage_rows(src, key_sel, labels, count_name, digits=R6):
    """Union of one row per stage from wide sums s0..s(k-1) in ``src``."""
    parts = []
    for i, lab in enumerate(labels):
        drop = "cast(null as double)" if i == 0 else f"case when s{i-1} <> 0 then (1e0 - s{i} / s{i-1}) * 100e0 end"
        overall = f"case when s0 <> 0 then s{i} / s0 * 100e0 end"
        parts.append(f"select {key_sel}{i + 1} as STAGE_NO, '{lab}' as STAGE, cast(s{i} as bigint) as {count_name}, "
                     f"round_even({drop}, {digits}) as DROP_OFF_PCT, round_even({overall}, {digits}) as OVERALL_CONVERSION_PCT from {src}")
    return "\nunion all ".join(parts)


def _ev_stage(i, s):
    if i == 0:
        return f"t0 as (select user_id, d, min(ts) as t from e where event_type = '{s}' group by user_id, d)"
    return (f"t{i} as (select e.user_id, e.d, min(e.ts) as t from e join t{i-1} p on p.user_id = e.user_id and p.d = e.d "
            f"where e.event_type = '{s}' and e.ts > p.t group by e.user_id, e.d)")


_EV = ("with e as (select user_id, cast(ts as date) as d, ts, event_type from events),\n"
       + ",\n".join(_ev_stage(i, s) for i, s in enumerate(fn.EVENT_STAGES))
       + ",\nw as (select " + ", ".join(f"(select count(*) from t{i}) as s{i}" for i in range(len(fn.EVENT_STAGES))) + ")\n"
       + _stage_rows("w", "", fn.EVENT_STAGES, "ENTITY_DAYS"))

_EVM = ("with e as (select user_id, cast(ts as date) as d, ts, event_type, market from (" + FIXTURE_SQL["fx_events"] + ") f),\n"
        + ",\n".join(_ev_stage(i, s) for i, s in enumerate(fn.EVENT_STAGES))
        + ",\nr as (" + " union all ".join(f"select user_id, {i} as i from t{i}" for i in range(len(fn.EVENT_STAGES)))
        + "),\nw as (select case when user_id % 3 = 0 then 'NYC' else 'Dubai' end as MARKET, "
        + ", ".join(f"count(*) filter (i = {i}) as s{i}" for i in range(len(fn.EVENT_STAGES))) + " from r group by 1)")
_FS = "fs as (" + _stage_rows("w", "MARKET, ", fn.EVENT_LABELS, "VISITORS", digits=17).replace("round_even(", "(").replace(", 17) as", ") as") + ")"

_DA, _DB = f"DROP_OFF_PCT_{MARKET_A.upper()}", f"DROP_OFF_PCT_{MARKET_B.upper()}"

#: Landing by landing: the clock before it, and the days that were closed by then.
_EVS = (f"""with a as (select *, epoch_us(ts) + (user_id * 7 % 48) * 3600000000 as came, min(epoch_us(ts)) over () as lo, max(epoch_us(ts)) over () as hi from events),
l as (select user_id, ts, event_type, cast(ts as date) as d, case when user_id % {SLOW_USERS} = 0 then {LANDINGS - 1}
  else least(cast(floor(({LANDINGS} * (came - lo)) / greatest(hi - lo, 1)) as bigint), {LANDINGS - 1}) end as landing from a),
c as (select n, (select max(ts) from l where landing < n) as clock from range({LANDINGS}) r(n)),
m as (select l.*, coalesce(d < cast(clock - interval 3 day as date), false) as is_late from l join c on c.n = l.landing),
e as (select * from m where not is_late),
""" + ",\n".join(_ev_stage(i, s) for i, s in enumerate(fn.EVENT_STAGES))
        + ",\nw as (select " + ", ".join(f"(select count(*) from t{i}) as s{i}" for i in range(len(fn.EVENT_STAGES))) + ")\n"
        + _stage_rows("w", "", fn.EVENT_STAGES, "ENTITY_DAYS")
        + "\nunion all select null, 'late', count(*), null, null from m where is_late")

ORACLE = {
    "event_funnel_stream": _EVS,
    "schema_normalize": with_views(f", {_H} select * from h", "fx_hotels"),
    "listing_enrich": with_views(f", {_HP} select * from hp", "fx_hotels"),
    "market_compare": with_views(f""", {_HP}
select MARKET, count(*) as TOTAL_LISTINGS, count(case when IS_BOOKABLE then 1 end) as BOOKABLE_LISTINGS,
  round_even(count(case when IS_BOOKABLE then 1 end) / greatest(count(*), 1) * 100, 1) as BOOKABILITY_RATE,
  round_even(avg(PRICE_LEVEL), 2) as AVG_PRICE_LEVEL, round_even({_grid_mean('RATING')}, 2) as AVG_RATING,
  round_even({_grid_mean('VISIBILITY_SCORE')}, 1) as AVG_VISIBILITY
from hp where MARKET is not null group by MARKET""", "fx_hotels"),
    "price_tier_mix": with_views(f""", {_HP},
g as (select MARKET, PRICE_TIER, count(*) as COUNT, {_grid_mean('RATING')} as AVG_RATING from hp group by MARKET, PRICE_TIER)
select g.MARKET, PRICE_TIER, COUNT, AVG_RATING, round_even(COUNT / t.tot * 100, 1) as PCT_OF_MARKET
from g left join (select MARKET, sum(COUNT) as tot from g where MARKET is not null group by MARKET) t on t.MARKET = g.MARKET""",
                                 "fx_hotels"),
    "trust_quadrant": with_views(f", {_HP}, {_TQ} select PLACE_ID, MARKET, RATING, TOTAL_RATINGS, TRUST_QUADRANT from tq",
                                 "fx_hotels"),
    "trust_quadrant_summary": with_views(f""", {_HP}, {_TQ}
select MARKET, TRUST_QUADRANT, count(*) as COUNT from tq where MARKET is not null group by MARKET, TRUST_QUADRANT
order by MARKET, COUNT desc, TRUST_QUADRANT""", "fx_hotels"),
    "category_counts": with_views(f""", {_HP},
st as (select 'MARKET' as COLUMN_NAME, cast(MARKET as varchar) as VALUE from hp union all
       select 'PRICE_TIER', PRICE_TIER from hp union all select 'RATING_TIER', RATING_TIER from hp)
select COLUMN_NAME, VALUE, count(*) as COUNT, count(*) / (select count(*) from hp) as SHARE,
  (select avg(cast(IS_BOOKABLE as int)) from hp) as BOOKABLE_SHARE
from st group by COLUMN_NAME, VALUE""", "fx_hotels"),
    "score_histogram": with_views(f""", {_HP},
s0 as (select MARKET, min(VISIBILITY_SCORE) as lo0, max(VISIBILITY_SCORE) as hi0, median(VISIBILITY_SCORE) as MEDIAN
       from hp where MARKET is not null and VISIBILITY_SCORE is not null group by MARKET),
s as (select *, case when lo0 = hi0 then lo0 - 0.5e0 else lo0 end as lo, case when lo0 = hi0 then hi0 + 0.5e0 else hi0 end as hi from s0),
x as (select s.MARKET, v, lo, hi, (hi - lo) / 20e0 as step,
        least(cast(trunc((v - lo) / (hi - lo) * 20e0) as int), 19) as i0
      from (select MARKET, VISIBILITY_SCORE as v from hp where VISIBILITY_SCORE is not null) p join s on s.MARKET = p.MARKET),
x1 as (select *, case when v < (case when i0 = 20 then hi else i0 * step + lo end) then i0 - 1 else i0 end as i1 from x),
x2 as (select *, case when v >= (case when i1 + 1 = 20 then hi else (i1 + 1) * step + lo end) and i1 <> 19 then i1 + 1 else i1 end as BIN from x1)
select c.MARKET, c.BIN, case when c.BIN = 20 then s.hi else c.BIN * ((s.hi - s.lo) / 20e0) + s.lo end as BIN_LOW,
  case when c.BIN + 1 = 20 then s.hi else (c.BIN + 1) * ((s.hi - s.lo) / 20e0) + s.lo end as BIN_HIGH, c.COUNT, s.MEDIAN
from (select MARKET, BIN, count(*) as COUNT from x2 group by MARKET, BIN) c join s on s.MARKET = c.MARKET""", "fx_hotels"),
    "funnel_summary": _EVM + "\n" + _stage_rows("w", "MARKET, ", fn.EVENT_LABELS, "VISITORS"),
    "dropoff_diagnosis": f"""{_EVM}, {_FS},
a as (select STAGE_NO, STAGE, DROP_OFF_PCT as da from fs where MARKET = '{MARKET_A}'),
b as (select STAGE_NO, STAGE, DROP_OFF_PCT as db from fs where MARKET = '{MARKET_B}')
select a.STAGE_NO, a.STAGE, round_even(da, {R6}) as {_DA}, round_even(db, {R6}) as {_DB}, round_even(da - db, {R6}) as DROPOFF_GAP,
  case when da - db > 0 then '{MARKET_A}' else '{MARKET_B}' end as WORSE_MARKET,
  case a.STAGE when 'View' then '{fn.DIAGNOSIS["View"]}' when 'Compare' then '{fn.DIAGNOSIS["Compare"]}'
    when 'Intent' then '{fn.DIAGNOSIS["Intent"]}' when 'Book' then '{fn.DIAGNOSIS["Book"]}' else '{fn.DIAGNOSIS_DEFAULT}' end as DIAGNOSIS
from a join b on a.STAGE_NO = b.STAGE_NO and a.STAGE = b.STAGE""",
    "event_funnel": _EV,
    "enrich_if_missing": with_views(f", {_HP} select * from hp", "fx_hotels"),
    "listing_missing_text": with_views(f", {_HP} select * from hp", "fx_hotels"),
}
