"""Registered cleaning / demand queries over ``fx_trends`` and ``fx_capacity``, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import np_round
from ..operators import cleaning as cl
from ..operators import demand as dm
from ..sources.fixtures import FIXTURE_SQL, fx_capacity, fx_trends, table
from ..sources.io import rename_if_present
from ..sources.landing import trend_rows

KW = ["kw_urgent", "kw_low", "kw_sparse"]
TEST_PERIODS = 6
# regime dates inside the fixture's 1995-2001 span (the analysis takes them as parameters)
REGIME = ("1997-03-01", "1997-03-01", "1997-12-31", "1999-01-01")
P4 = 4
Z9 = 9


def trends(spark, sf):
    return rename_if_present(fx_trends(spark, sf), {"ds": "DATE"})


def capacity(spark, sf):
    return rename_if_present(fx_capacity(spark, sf), {"ds": "DATE", "monthly_flights": "MONTHLY_FLIGHTS",
                                                      "est_passengers": "EST_PASSENGERS"})


def forecast_ready(spark, sf):
    return cl.prepare_forecast_data(capacity(spark, sf), cl.clean_series(trends(spark, sf), "DATE", KW, limit=2))


def predictions(spark, sf):
    return dm.forecast_predictions(forecast_ready(spark, sf), TEST_PERIODS)


def band(spark, sf):
    p = predictions(spark, sf)
    return dm.forecast_band(p, dm.best_model(dm.forecast_metrics(p)))


def q_coerce_clean(spark, sf):
    # landed text columns: dates and counts as strings, coerced back
    raw = trends(spark, sf).select(F.date_format("DATE", "yyyy-MM-dd").alias("DATE"),
                                   *[F.col(c).cast("string").alias(c) for c in KW])
    out = cl.coerce_clean(raw, "DATE", KW)
    return out.withColumn("DATE", F.to_date("DATE"))


def q_ffill_limited(spark, sf):
    return cl.clean_series(trends(spark, sf), "DATE", KW, limit=2)


def q_resample_monthly(spark, sf):
    return cl.resample_trends_monthly(trends(spark, sf), "DATE", KW, limit=2)


def q_forecast_ready(spark, sf):
    return forecast_ready(spark, sf)


def q_forecast_predictions(spark, sf):
    p = predictions(spark, sf)
    return p.withColumns({"pred": np_round("pred", P4), "residual": np_round("residual", P4)})


def q_forecast_metrics(spark, sf):
    return dm.forecast_metrics(predictions(spark, sf))


def q_forecast_best_model(spark, sf):
    return dm.best_model(dm.forecast_metrics(predictions(spark, sf)))


def q_forecast_band(spark, sf):
    return band(spark, sf).withColumns({c: np_round(c, P4) for c in ("yhat", "residual", "resid_std", "lower", "upper")})


def q_seasonal_index(spark, sf):
    return dm.seasonal_index(forecast_ready(spark, sf)).withColumn("MEAN_OF_MONTHS", np_round("MEAN_OF_MONTHS", Z9))


def _spikes(spark, sf):
    s = dm.detect_spikes(trends(spark, sf), "kw_sparse", "DATE", threshold=1.5, window=6)
    return s.withColumn("SPIKE_MAGNITUDE", np_round("SPIKE_MAGNITUDE", Z9))


def q_spikes(spark, sf):
    return _spikes(spark, sf)


def q_spikes_top(spark, sf):
    return dm.top_spikes(_spikes(spark, sf), 5, "DATE")


def q_regime_impact(spark, sf):
    r = dm.regime_impact(forecast_ready(spark, sf), *REGIME)
    return r.withColumns({c: np_round(c, Z9) for c in r.columns})


def q_yoy_growth(spark, sf):
    return dm.yoy_growth(forecast_ready(spark, sf)).withColumn("YOY_PCT", np_round("YOY_PCT", Z9))


def q_lag_correlation(spark, sf):
    r = dm.lag_correlation(forecast_ready(spark, sf), "trend_kw_urgent", "y", max_lag=6)
    return r.withColumn("correlation", np_round("correlation", Z9))


def q_push_timing(spark, sf):
    b = band(spark, sf)
    return dm.push_timing(b, lead_months=3).withColumn("FORECAST_PAX", np_round("FORECAST_PAX", P4))


def q_trends_monthly(spark, sf):
    """The published monthly table: cleaned, then cleaned again by the resampling, so gaps of up to four weeks fill."""
    return cl.resample_trends_monthly(cl.clean_series(trends(spark, sf), "DATE", KW, limit=2), "DATE", KW, limit=2)


def q_trend_landing(spark, sf):
    raw = fx_trends(spark, sf).withColumnRenamed("ds", "date").withColumn("isPartial", F.lit(False))
    return trend_rows(raw)


def q_lag_constant(spark, sf):
    """A constant signal has no correlation at any lag."""
    return dm.lag_correlation(forecast_ready(spark, sf).withColumn("flat", F.lit(5.0)), "flat", "y", max_lag=6)


#: Rows of one date in the long series of order lines.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lines(spark, sf):
    """All order lines as one series in the order of shipping, with prices and discounts missing in places."""
    x = table(spark, sf, "lineitem").select("l_shipdate", *LINE, "l_quantity", "l_extendedprice", "l_discount")
    return x.withColumns({"PRICE": F.when(F.col("l_partkey") % 5 > 1, F.col("l_extendedprice").cast("double")),
                          "DISCOUNT": F.when(F.col("l_suppkey") % 10 == 0, F.col("l_discount").cast("double"))})


def q_lineitem_filled(spark, sf):
    x = cl.ffill(lines(spark, sf).select("l_shipdate", *LINE, "PRICE", "DISCOUNT"), "l_shipdate", ["PRICE"], 2, long=True, ties=LINE)
    return cl.ffill_bfill(x, "l_shipdate", ["DISCOUNT"], long=True, ties=LINE)


def q_lineitem_spikes(spark, sf):
    x = dm.detect_spikes(lines(spark, sf), "PRICE", "l_shipdate", threshold=1.9, long=True, ties=LINE)
    return x.withColumn("SPIKE_MAGNITUDE", np_round("SPIKE_MAGNITUDE", 6))


def q_lineitem_lags(spark, sf):
    x = lines(spark, sf).select("l_shipdate", *LINE, F.col("l_quantity").cast("double").alias("q"), "PRICE")
    return dm.lag_correlation(x, "q", "PRICE", "l_shipdate", long=True, ties=LINE).withColumn("correlation", np_round("correlation", Z9))


QUERIES = {
    "lineitem_filled": q_lineitem_filled,
    "lineitem_spikes": q_lineitem_spikes,
    "lineitem_lags": q_lineitem_lags,
    "trends_monthly": q_trends_monthly,
    "trend_landing": q_trend_landing,
    "lag_constant": q_lag_constant,
    "coerce_clean": q_coerce_clean,
    "ffill_limited": q_ffill_limited,
    "resample_monthly": q_resample_monthly,
    "forecast_ready": q_forecast_ready,
    "forecast_predictions": q_forecast_predictions,
    "forecast_metrics": q_forecast_metrics,
    "forecast_best_model": q_forecast_best_model,
    "forecast_band": q_forecast_band,
    "seasonal_index": q_seasonal_index,
    "spikes": q_spikes,
    "spikes_top": q_spikes_top,
    "regime_impact": q_regime_impact,
    "yoy_growth": q_yoy_growth,
    "lag_correlation": q_lag_correlation,
    "push_timing": q_push_timing,
}

# ----------------------------------------------------------------------------- oracle

_NOT_ALL_NULL = " or ".join(f"{c} is not null" for c in KW)

_BASE = f"""with fx_trends as ({FIXTURE_SQL['fx_trends']}),
fx_capacity as ({FIXTURE_SQL['fx_capacity']}),
tr as (select ds as DATE, cast(kw_urgent as double) as kw_urgent, cast(kw_low as double) as kw_low,
              cast(kw_sparse as double) as kw_sparse from fx_trends),
tc as (select * from tr where {_NOT_ALL_NULL}),
tf as (select DATE, {", ".join(f"last_value({c} ignore nulls) over w2 as {c}" for c in KW)}
       from tc window w2 as (order by DATE rows between 2 preceding and current row)),
tm0 as (select cast(date_trunc('month', DATE) as date) as ds, {", ".join(f"avg({c}) as trend_{c}" for c in KW)}
        from tf where {_NOT_ALL_NULL} group by 1),
sp as (select cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as ds
       from (select cast(min(ds) as timestamp) as lo, cast(max(ds) as timestamp) as hi from tm0) b),
tm as (select sp.ds, {", ".join(f"tm0.trend_{c}" for c in KW)} from sp left join tm0 on tm0.ds = sp.ds),
fr0 as (select cast(c.ds as date) as ds, cast(c.est_passengers as double) as y, cast(c.monthly_flights as double) as supply_flights,
        {", ".join(f"tm.trend_{c}" for c in KW)} from fx_capacity c left join tm on tm.ds = cast(c.ds as date)),
fr as (select ds, y, supply_flights, {", ".join(
    f"coalesce(last_value(trend_{c} ignore nulls) over (order by ds rows between unbounded preceding and current row), "
    f"first_value(trend_{c} ignore nulls) over (order by ds rows between current row and unbounded following)) as trend_{c}"
    for c in KW)} from fr0 where ds is not null and y is not null),
ix as (select ds, y, row_number() over (order by ds) - 1 as idx, count(*) over () as n from fr),
trn as (select * from ix where idx < n - {TEST_PERIODS}),
tst as (select * from ix where idx >= n - {TEST_PERIODS}),
fit as (select count(*) as n_train, arg_max(y, idx) as last_y, regr_slope(y, cast(idx as double)) as slope,
               regr_intercept(y, cast(idx as double)) as intercept, max(ds) as train_end from trn),
span as (select min(ds) as test_start, max(ds) as test_end from tst),
tj as (select tst.*, fit.*, span.*, case when n_train >= 12 then n_train - 12 + (idx - n_train) % 12 end as src_idx
       from tst, fit, span),
tj2 as (select tj.*, s.y as season_y from tj left join trn s on s.idx = tj.src_idx),
pr as (select 'naive' as model, ds, y, last_y as pred, train_end, test_start, test_end from tj2
       union all select 'seasonal_naive', ds, y, coalesce(season_y, last_y), train_end, test_start, test_end from tj2
       union all select 'linear_trend', ds, y, intercept + slope * cast(idx as double), train_end, test_start, test_end from tj2),
mt as (select model as MODEL, round_even(avg(abs(y - pred)), 4) as MAE, round_even(sqrt(avg((y - pred) * (y - pred))), 4) as RMSE,
              round_even(avg(abs((y - pred) / case when abs(y) < 1e-9 then 1e0 else abs(y) end)) * 100, 4) as MAPE
       from pr group by model),
best as (select * from mt order by RMSE, MODEL limit 1),
bp as (select pr.* from pr join best on best.MODEL = pr.model),
bd as (select bp.model, ds, y, pred as yhat, y - pred as residual, s.resid_std,
              pred - 1.96e0 * s.resid_std as lower, pred + 1.96e0 * s.resid_std as upper
       from bp, (select coalesce(stddev_samp(y - pred), 0e0) as resid_std from bp) s)
"""

_SPK = f""", sx as (select DATE, cast(kw_sparse as bigint) as kw_sparse from tr where kw_sparse is not null and DATE is not null),
sw as (select DATE, kw_sparse, count(kw_sparse) over w6 as c, avg(kw_sparse) over w6 as m, stddev_samp(kw_sparse) over w6 as s
       from sx window w6 as (order by DATE rows between 5 preceding and current row)),
sk as (select DATE, kw_sparse, (kw_sparse - case when c >= 3 then m end) / case when c >= 3 then nullif(s, 0e0) end as z from sw)
"""

_SEAS = """, x as (select * from fr where y is not null and ds is not null),
prof as (select count(*) as N_ROWS, min(ds) as FIRST_DATE, max(ds) as LAST_DATE from x),
mm as (select month(ds) as MONTH, avg(y) as AVG_VALUE from x group by 1),
sj as (select prof.*, r.MONTH, mm.AVG_VALUE from prof, (select unnest(range(1, 13)) as MONTH) r left join mm on mm.MONTH = r.MONTH),
sm as (select *, avg(AVG_VALUE) over () as mom from sj)
"""

_LINE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
_LINES = f"""with li as (select {_LINE_ORDER}, cast(l_quantity as double) as q,
  case when l_partkey % 5 > 1 then cast(l_extendedprice as double) end as PRICE,
  case when l_suppkey % 10 = 0 then cast(l_discount as double) end as DISCOUNT from lineitem)"""

ORACLE = {
    "trends_monthly": f"""{_BASE}, tg as (select DATE, {", ".join(f"last_value({c} ignore nulls) over w2 as {c}" for c in KW)}
  from (select * from tf where {_NOT_ALL_NULL}) t window w2 as (order by DATE rows between 2 preceding and current row)),
rm0 as (select cast(date_trunc('month', DATE) as date) as DATE, {", ".join(f"avg({c}) as {c}" for c in KW)} from tg group by 1),
rsp as (select cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as DATE
        from (select cast(min(DATE) as timestamp) as lo, cast(max(DATE) as timestamp) as hi from rm0) b)
select rsp.DATE, {", ".join(f"round_even(rm0.{c}, 1) as {c}" for c in KW)} from rsp left join rm0 on rm0.DATE = rsp.DATE""",
    "trend_landing": f"{_BASE} select ds as DATE, {", ".join(f"cast({c} as bigint) as {c}" for c in KW)} from fx_trends",
    "lag_constant": f"""{_BASE} select cast(k as integer) as lag_months, cast(null as double) as correlation, false as significant,
  (select count(*) from fr) - k as n from range(0, 7) r(k)""",
    "coerce_clean": f"""{_BASE} select cast(DATE as date) as DATE, kw_urgent, kw_low, kw_sparse from tr""",
    "ffill_limited": f"{_BASE} select * from tf",
    "lineitem_filled": f"""{_LINES} select {_LINE_ORDER},
  last_value(PRICE ignore nulls) over (order by {_LINE_ORDER} rows between 2 preceding and current row) as PRICE,
  coalesce(last_value(DISCOUNT ignore nulls) over (order by {_LINE_ORDER} rows between unbounded preceding and current row),
    first_value(DISCOUNT ignore nulls) over (order by {_LINE_ORDER} rows between current row and unbounded following)) as DISCOUNT from li""",
    "lineitem_spikes": f"""{_LINES}, z as (select {_LINE_ORDER}, PRICE, count(*) over w as n, avg(PRICE) over w as m, stddev_samp(PRICE) over w as s
  from li where PRICE is not null and l_shipdate is not null window w as (order by {_LINE_ORDER} rows between 5 preceding and current row))
select {_LINE_ORDER}, PRICE, round_even((PRICE - m) / s, 6) as SPIKE_MAGNITUDE from z where n >= 3 and s <> 0 and (PRICE - m) / s >= 1.9e0""",
    "lineitem_lags": f"""{_LINES}, x as (select q, PRICE, {", ".join(f"lag(q, {k}) over (order by {_LINE_ORDER}) as s{k}" for k in range(7))}
  from li where PRICE is not null and l_shipdate is not null and q is not null)
select * from (""" + " union all ".join(f"""select {k} as lag_months, round_even(corr(s{k}, PRICE), {Z9}) as correlation,
  abs(corr(s{k}, PRICE)) >= 0.5 as significant, count(s{k}) as n from x""" for k in range(7)) + ")",
    "resample_monthly": f"""{_BASE}, rm0 as (select cast(date_trunc('month', DATE) as date) as DATE,
  {", ".join(f"avg({c}) as {c}" for c in KW)} from tf group by 1),
rsp as (select cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as DATE
        from (select cast(min(DATE) as timestamp) as lo, cast(max(DATE) as timestamp) as hi from rm0) b)
select rsp.DATE, {", ".join(f"round_even(rm0.{c}, 1) as {c}" for c in KW)} from rsp left join rm0 on rm0.DATE = rsp.DATE""",
    "forecast_ready": f"{_BASE} select * from fr",
    "forecast_predictions": f"""{_BASE} select model, ds, y, round_even(pred, {P4}) as pred, train_end, test_start, test_end,
  round_even(y - pred, {P4}) as residual from pr""",
    "forecast_metrics": f"{_BASE} select * from mt",
    "forecast_best_model": f"{_BASE} select * from best",
    "forecast_band": f"""{_BASE} select model, ds, y, round_even(yhat, {P4}) as yhat, round_even(residual, {P4}) as residual,
  round_even(resid_std, {P4}) as resid_std, round_even(lower, {P4}) as lower, round_even(upper, {P4}) as upper from bd""",
    "seasonal_index": f"""{_BASE}{_SEAS} select N_ROWS, FIRST_DATE, LAST_DATE, cast(MONTH as integer) as MONTH, AVG_VALUE, round_even(mom, {Z9}) as MEAN_OF_MONTHS,
  case when AVG_VALUE > mom then 'peak' when AVG_VALUE <= mom then 'trough' end as SEASON from sm""",
    "spikes": f"{_BASE}{_SPK} select DATE, kw_sparse, round_even(z, {Z9}) as SPIKE_MAGNITUDE from sk where z >= 1.5",
    "spikes_top": f"{_BASE}{_SPK} select DATE, kw_sparse, round_even(z, {Z9}) as SPIKE_MAGNITUDE from sk where z >= 1.5 order by round_even(z, {Z9}) desc, DATE limit 5",
    "regime_impact": f"""{_BASE}, rg as (select avg(case when ds < date '{REGIME[0]}' then y end) as PRE_MEAN,
  avg(case when ds >= date '{REGIME[1]}' and ds <= date '{REGIME[2]}' then y end) as TROUGH_MEAN,
  avg(case when ds >= date '{REGIME[3]}' then y end) as POST_MEAN from fr)
select round_even(PRE_MEAN, {Z9}) as PRE_MEAN, round_even(TROUGH_MEAN, {Z9}) as TROUGH_MEAN, round_even(POST_MEAN, {Z9}) as POST_MEAN,
  round_even((TROUGH_MEAN - PRE_MEAN) / nullif(PRE_MEAN, 0) * 100, {Z9}) as TROUGH_VS_PRE_PCT,
  round_even((POST_MEAN - PRE_MEAN) / nullif(PRE_MEAN, 0) * 100, {Z9}) as POST_VS_PRE_PCT from rg""",
    "yoy_growth": f"""{_BASE}, yr as (select year(ds) as YEAR, sum(y) as TOTAL from fr group by 1)
select cast(YEAR as integer) as YEAR, TOTAL, round_even((TOTAL / nullif(lag(TOTAL) over (order by YEAR), 0) - 1) * 100, {Z9}) as YOY_PCT from yr""",
    "lag_correlation": f"""{_BASE}, lx as (select ds, y, trend_kw_urgent as s from fr where ds is not null and trend_kw_urgent is not null and y is not null),
ll as (select l.k as lag_months, lag(s, l.k) over (partition by l.k order by ds) as sl, y from lx, (select unnest(range(0, 7)) as k) l),
lc as (select lag_months, count(*) as n, corr(sl, y) as r from ll where sl is not null group by 1)
select cast(k.lag_months as integer) as lag_months, round_even(case when coalesce(n, 0) >= 6 then r end, {Z9}) as correlation,
  coalesce(abs(case when coalesce(n, 0) >= 6 then r end) >= 0.5, false) as significant, coalesce(n, 0) as n
from (select unnest(range(0, 7)) as lag_months) k left join lc on lc.lag_months = k.lag_months""",
    "push_timing": f"""{_BASE}, pk as (select bd.*, q.thr from bd, (select quantile_cont(yhat, 0.75) as thr from bd) q
  where ds is not null and yhat is not null)
select ds as PEAK_MONTH, round_even(yhat, {P4}) as FORECAST_PAX, strftime(ds - interval 3 month, '%Y-%m') as PUSH_START,
  strftime(ds - interval 1 month, '%Y-%m') as PUSH_END,
  case when month(ds) in (11, 12, 1, 2) then 'Peak Winter' when month(ds) in (6, 7, 8) then 'Summer Low' else 'Transition' end as SEASON,
  'Start push in ' || strftime(ds - interval 3 month, '%Y-%m') || ' and sustain until ' || strftime(ds - interval 1 month, '%Y-%m')
  || ' for peak month ' || strftime(ds, '%Y-%m') as RECOMMENDATION
from pk where yhat >= thr order by yhat desc""",
}
