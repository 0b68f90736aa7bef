"""Registered traveler-segmentation queries over ``fx_travelers``, with DuckDB oracles.

Aggregation steps use the table's given ``cluster`` labels (oracle-checked);
the model steps (PCA, K-Means, K search, full pipeline) are rows-only checks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numeric import np_round
from ..operators import kmeans as km
from ..operators import segment as sg
from ..operators.silhouette import euclidean_silhouette
from ..sources.fixtures import fx_travelers, with_views
from ..sources.io import rename_if_present
from . import sqlfrag as S

TRAVELER_COLS = ["traveler_id", "age", "group_size", "trip_purpose", "stay_nights", "lead_time_days", "fare_class",
                 "flight_spend", "preferred_price_tier", "hotel_spend_per_night", "total_hotel_spend",
                 "total_trip_spend", "preferred_market", "device", "booking_channel", "loyalty_member",
                 "repeat_visitor", "cluster"]
Z9 = 9
N_INIT = 15


def travelers(spark, sf):
    return rename_if_present(fx_travelers(spark, sf), {c: c.upper() for c in TRAVELER_COLS})


def features(spark, sf):
    return sg.engineer_features(travelers(spark, sf))


def labels(spark, sf):
    return sg.label_clusters(sg.profile_clusters(travelers(spark, sf)))


def q_traveler_features(spark, sf):
    return features(spark, sf).select("TRAVELER_ID", *sg.FEATURES, "TOTAL_SPEND_PP", "IS_REPEAT", "IS_MOBILE")


def q_standardized(spark, sf):
    z = sg.standardize(features(spark, sf))
    return z.select("TRAVELER_ID", *[np_round(f + "_Z", Z9).alias(f + "_Z") for f in sg.FEATURES])


def q_ch_index(spark, sf):
    z = sg.standardize(features(spark, sf))
    r = sg.calinski_harabasz(z, [f + "_Z" for f in sg.FEATURES])
    return r.select("n", "k", np_round("BETWEEN_SS", 4).alias("BETWEEN_SS"), np_round("WITHIN_SS", 4).alias("WITHIN_SS"),
                    np_round("CALINSKI_HARABASZ", 1).alias("CALINSKI_HARABASZ"))


def q_silhouette_euclid(spark, sf):
    z = sg.standardize(features(spark, sf))
    r = euclidean_silhouette(z, [f + "_Z" for f in sg.FEATURES])
    return r.select("N", "K", np_round("SILHOUETTE", 4).alias("SILHOUETTE"))


def q_cluster_profile(spark, sf):
    return sg.profile_clusters(travelers(spark, sf))


def q_cluster_labels(spark, sf):
    return labels(spark, sf).select("CLUSTER", "SIZE", "TOP_PURPOSE", "AVG_TOTAL_SPEND", "AVG_STAY_NIGHTS",
                                    "PCT_BUSINESS_CLASS", "TOP_PRICE_TIER", "AVG_GROUP_SIZE", "ARCHETYPE")


def q_segment_crosstab(spark, sf):
    return sg.segment_market_crosstab(travelers(spark, sf), labels(spark, sf))


def many_markets(spark, sf):
    """Travelers with one of two thousand markets each: more than a pivot takes."""
    return travelers(spark, sf).withColumn("PREFERRED_MARKET", F.concat(F.lit("m"), (F.col("TRAVELER_ID") % 2003).cast("string")))


def q_segment_market_shares(spark, sf):
    return sg.segment_market_shares(many_markets(spark, sf), labels(spark, sf))


def q_segment_recommendations(spark, sf):
    return sg.segment_recommendations(labels(spark, sf))


def q_kruskal_wallis(spark, sf):
    return sg.kruskal_wallis(travelers(spark, sf))


def q_pca_components(spark, sf):
    return sg.pca_components(features(spark, sf))


def q_kmeans_clusters(spark, sf):
    out = sg.run_kmeans(features(spark, sf), k=4, n_init=N_INIT)
    return out.select("TRAVELER_ID", "CLUSTER", "PCA_1", "PCA_2")


def q_k_evaluation(spark, sf):
    return sg.k_evaluation(features(spark, sf), range(2, 9), n_init=N_INIT)


def q_segmentation_pipeline(spark, sf):
    res = sg.run_full_segmentation(travelers(spark, sf), k=None, n_init=N_INIT)
    return res["profiles"]


def with_gaps(spark, sf):
    """Travelers of whom some values are missing."""
    gap = lambda c, n, r: F.when(F.col("TRAVELER_ID") % n != r, F.col(c))
    return travelers(spark, sf).withColumns({"TRIP_PURPOSE": gap("TRIP_PURPOSE", 3, 0), "FARE_CLASS": gap("FARE_CLASS", 4, 1),
                                             "PREFERRED_MARKET": gap("PREFERRED_MARKET", 5, 2)})


def q_profile_missing(spark, sf):
    return sg.profile_clusters(with_gaps(spark, sf))


def q_pca_check(spark, sf):
    """What any principal components must satisfy: shares add up, the trace is kept, the components are eigenvectors."""
    z = sg.standardize(features(spark, sf))
    cols = [f + "_Z" for f in sg.FEATURES]
    ratios, vecs = sg.fit_pca(z, cols)
    cov = z.agg(*[F.covar_samp(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]).first()
    d = len(cols)
    m = np.array([[cov[f"{i}_{j}"] for j in range(d)] for i in range(d)])
    values = np.diag(vecs.T @ m @ vecs)
    ok = (abs(ratios.sum() - 1) < 1e-9, abs(values.sum() - np.trace(m)) < 1e-9, float(np.abs(m @ vecs - vecs * values).max()) < 1e-9,
          float(np.abs(values / values.sum() - ratios).max()) < 1e-9)
    return spark.createDataFrame([tuple(map(bool, ok))], "SHARES_ADD_UP boolean, TRACE_KEPT boolean, EIGENVECTORS boolean, SHARES_MATCH boolean")


def q_kmeans_check(spark, sf):
    """What any converged fit must satisfy: every row labelled, no empty cluster, no center far from its cluster's mean."""
    x, cols, _ = sg.feature_vectors(features(spark, sf).drop("CLUSTER"))
    coords = sg._fit_frame(x, cols, sg.FEATURES)
    best = km.best_per_k(km.fit_batched(coords, cols, [4], n_init=3, id_col=sg.ROW_ID))[4]
    labelled = coords.withColumn("c", km.assign(cols, best.centers))
    per = labelled.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                                    F.sum(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))).alias("q")).collect()
    within = sum(r["q"] - r["n"] * sum(r[f"m{i}"] ** 2 for i in range(len(cols))) for r in per)
    far = max(abs(r[f"m{i}"] - best.centers[r["c"], i]) for r in per for i in range(len(cols)))
    coords.unpersist()
    return spark.createDataFrame([(sum(r["n"] for r in per), len(per), bool(abs(within - best.inertia) <= 1e-3 * best.inertia), bool(far < 0.05))],
                                 "N_ROWS long, N_CLUSTERS int, INERTIA_IS_WITHIN_SS boolean, CENTERS_ARE_MEANS boolean")


QUERIES = {
    "profile_missing": q_profile_missing,
    "pca_check": q_pca_check,
    "kmeans_check": q_kmeans_check,
    "traveler_features": q_traveler_features,
    "standardized": q_standardized,
    "ch_index": q_ch_index,
    "silhouette_euclid": q_silhouette_euclid,
    "cluster_profile": q_cluster_profile,
    "cluster_labels": q_cluster_labels,
    "segment_crosstab": q_segment_crosstab,
    "segment_market_shares": q_segment_market_shares,
    "segment_recommendations": q_segment_recommendations,
    "kruskal_wallis": q_kruskal_wallis,
    "pca_components": q_pca_components,
    "kmeans_clusters": q_kmeans_clusters,
    "k_evaluation": q_k_evaluation,
    "segmentation_pipeline": q_segmentation_pipeline,
}

# ----------------------------------------------------------------------------- oracle

_TR = ", tr as (select " + ", ".join(f"{c} as {c.upper()}" for c in TRAVELER_COLS) + " from fx_travelers)"

_FE = _TR + """, fe as (select *,
  round_even(TOTAL_HOTEL_SPEND / greatest(FLIGHT_SPEND, 1e0), 3) as HOTEL_FLIGHT_RATIO,
  round_even(HOTEL_SPEND_PER_NIGHT / GROUP_SIZE, 2) as SPEND_PER_NIGHT_PP,
  round_even(TOTAL_TRIP_SPEND / GROUP_SIZE, 2) as TOTAL_SPEND_PP,
  case when LEAD_TIME_DAYS > 0 and LEAD_TIME_DAYS <= 7 then 1e0 when LEAD_TIME_DAYS > 7 and LEAD_TIME_DAYS <= 21 then 2e0
       when LEAD_TIME_DAYS > 21 and LEAD_TIME_DAYS <= 45 then 3e0 when LEAD_TIME_DAYS > 45 and LEAD_TIME_DAYS <= 90 then 4e0
       when LEAD_TIME_DAYS > 90 and LEAD_TIME_DAYS <= 365 then 5e0 end as LEAD_TIME_BUCKET,
  cast(LOYALTY_MEMBER as integer) as IS_LOYALTY, cast(REPEAT_VISITOR as integer) as IS_REPEAT,
  cast(DEVICE = 'mobile' as integer) as IS_MOBILE, cast(PREFERRED_MARKET = 'Dubai' as integer) as IS_DUBAI_PREF,
  case PREFERRED_PRICE_TIER when 'Budget' then 1e0 when 'Mid-Range' then 2e0 when 'Upscale' then 3e0
       when 'Luxury' then 4e0 else 2e0 end as PRICE_TIER_NUM
  from tr)"""

_Z = _FE + ", zf as (select TRAVELER_ID, CLUSTER, " + ", ".join(
    f"coalesce(cast({f} as double), 0e0) as {f}" for f in sg.FEATURES) + " from fe), zs as (select " + ", ".join(
    f"avg({f}) as m_{f}, stddev_pop({f}) as s_{f}" for f in sg.FEATURES) + " from zf), z as (select TRAVELER_ID, CLUSTER, " + ", ".join(
    f"({f} - m_{f}) / case when s_{f} = 0 then 1e0 else s_{f} end as {f}_Z" for f in sg.FEATURES) + " from zf, zs)"

_SQ = " + ".join(f"{f}_Z * {f}_Z" for f in sg.FEATURES)
_CH = _Z + f""", per as (select CLUSTER, count(*) as n_c, sum({_SQ}) as ss_c, {", ".join(f"sum({f}_Z) as s_{i}" for i, f in enumerate(sg.FEATURES))}
  from z group by CLUSTER),
tot as (select sum(n_c) as n, count(*) as k, sum(ss_c) as ss,
  sum(({" + ".join(f"s_{i} * s_{i}" for i in range(len(sg.FEATURES)))}) / n_c) as sb,
  {", ".join(f"sum(s_{i}) as t_{i}" for i in range(len(sg.FEATURES)))} from per),
chv as (select n, k, sb - ({" + ".join(f"t_{i} * t_{i}" for i in range(len(sg.FEATURES)))}) / n as b, ss - sb as w from tot)"""

#: All pairs.
_SIL = _Z + ", far as (select a.TRAVELER_ID as id, a.CLUSTER as own, b.CLUSTER as other, avg(sqrt(" + " + ".join(
    f"(a.{f}_Z - b.{f}_Z) * (a.{f}_Z - b.{f}_Z)" for f in sg.FEATURES) + """)) as d
  from z a join z b on a.TRAVELER_ID <> b.TRAVELER_ID where a.CLUSTER is not null and b.CLUSTER is not null group by 1, 2, 3),
ab as (select id, own, min(d) filter (own = other) as a, min(d) filter (own <> other) as b from far group by id, own)
select count(*) as N, cast(count(distinct own) as integer) as K,
  round_even(avg(case when a is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 4) as SILHOUETTE from ab"""


def _mode(col):
    return f"""m_{col} as (select CLUSTER, v as mv_{col}, c / tot as share_{col} from (
  select CLUSTER, {col} as v, count(*) as c, sum(count(*)) over (partition by CLUSTER) as tot,
    row_number() over (partition by CLUSTER order by count(*) desc, {col}) as rn from tr where {col} is not null group by CLUSTER, {col}) q where rn = 1)"""


_MODES = ["TRIP_PURPOSE", "PREFERRED_PRICE_TIER", "BOOKING_CHANNEL", "DEVICE", "FARE_CLASS"]
_PROF = _TR + ", " + ",\n".join(_mode(c) for c in _MODES) + """,
g as (select CLUSTER, count(*) as SIZE, round_even(avg(AGE), 1) as AVG_AGE, round_even(avg(GROUP_SIZE), 1) as AVG_GROUP_SIZE,
  round_even(avg(STAY_NIGHTS), 1) as AVG_STAY_NIGHTS, round_even(avg(LEAD_TIME_DAYS), 1) as AVG_LEAD_TIME,
  round_even(avg(FLIGHT_SPEND), 0) as AVG_FLIGHT_SPEND, round_even(avg(HOTEL_SPEND_PER_NIGHT), 0) as AVG_HOTEL_PER_NIGHT,
  round_even(avg(TOTAL_TRIP_SPEND), 0) as AVG_TOTAL_SPEND, round_even(median(TOTAL_TRIP_SPEND), 0) as MEDIAN_TOTAL_SPEND,
  round_even(avg(cast(coalesce(PREFERRED_MARKET = 'Dubai', false) as double)) * 100, 1) as PCT_DUBAI_PREF,
  round_even(avg(cast(LOYALTY_MEMBER as double)) * 100, 1) as PCT_LOYALTY,
  round_even(avg(cast(REPEAT_VISITOR as double)) * 100, 1) as PCT_REPEAT,
  round_even(avg(cast(coalesce(FARE_CLASS = 'business', false) as double)) * 100, 1) as PCT_BUSINESS_CLASS
  from tr group by CLUSTER),
prof as (select g.CLUSTER, SIZE, round_even(SIZE / (select count(*) from tr) * 100, 1) as PCT_OF_TOTAL, AVG_AGE, AVG_GROUP_SIZE,
  AVG_STAY_NIGHTS, AVG_LEAD_TIME, mv_TRIP_PURPOSE as TOP_PURPOSE, round_even(share_TRIP_PURPOSE * 100, 1) as PURPOSE_CONCENTRATION,
  AVG_FLIGHT_SPEND, AVG_HOTEL_PER_NIGHT, AVG_TOTAL_SPEND, MEDIAN_TOTAL_SPEND, mv_PREFERRED_PRICE_TIER as TOP_PRICE_TIER,
  PCT_DUBAI_PREF, mv_BOOKING_CHANNEL as TOP_CHANNEL, mv_DEVICE as TOP_DEVICE, PCT_LOYALTY, PCT_REPEAT,
  mv_FARE_CLASS as TOP_FARE_CLASS, PCT_BUSINESS_CLASS
  from g left join m_TRIP_PURPOSE using (CLUSTER) left join m_PREFERRED_PRICE_TIER using (CLUSTER)
  left join m_BOOKING_CHANNEL using (CLUSTER) left join m_DEVICE using (CLUSTER) left join m_FARE_CLASS using (CLUSTER)),
lab as (select *, case
  when coalesce(TOP_PURPOSE = 'business' or PCT_BUSINESS_CLASS > 40, false) then
    case when coalesce(AVG_TOTAL_SPEND > 8000, false) then 'Premium Business' else 'Corporate Traveler' end
  when coalesce(TOP_PURPOSE = 'honeymoon' or (TOP_PRICE_TIER = 'Luxury' and AVG_STAY_NIGHTS >= 5), false) then 'Honeymoon/Luxury'
  when coalesce(TOP_PURPOSE = 'family_vacation' or AVG_GROUP_SIZE >= 3, false) then 'Family Explorer'
  when coalesce(TOP_PURPOSE = 'transit' or AVG_STAY_NIGHTS <= 2, false) then 'Transit/Stopover'
  when coalesce(TOP_PURPOSE = 'leisure' and AVG_TOTAL_SPEND < 3000, false) then 'Budget Explorer'
  when coalesce(TOP_PURPOSE = 'leisure' and AVG_TOTAL_SPEND >= 3000, false) then 'Comfort Leisure'
  else 'Segment ' || cast(CLUSTER as varchar) end as ARCHETYPE from prof)"""


def _rec_case(j):
    parts = []
    for pats, texts in sg.RECOMMENDATIONS:
        cond = " or ".join(f"contains(ARCHETYPE, '{p}')" for p in pats)
        parts.append(f"when {cond} then '{texts[j]}'")
    return "case " + " ".join(parts) + f" else '{sg.DEFAULT_RECOMMENDATION[j]}' end"


_KW = _TR + """, lng as (""" + " union all ".join(
    f"select CLUSTER, '{m}' as METRIC, cast({m} as double) as v from tr" for m in sg.KW_METRICS) + """),
lv as (select * from lng where v is not null),
pv as (select METRIC, v, count(*) as t from lv group by METRIC, v),
rk as (select METRIC, v, t, coalesce(sum(t) over (partition by METRIC order by v rows between unbounded preceding and 1 preceding), 0)
  + (t + 1) / 2e0 as rnk from pv),
pg as (select l.METRIC, l.CLUSTER, count(*) as n_c, sum(r.rnk) as R_c from lv l join rk r on r.METRIC = l.METRIC and r.v = l.v
  group by l.METRIC, l.CLUSTER),
hh as (select METRIC, cast(sum(n_c) as double) as N, sum(R_c * R_c / n_c) as sr, min(n_c) as min_n, count(*) as k from pg group by METRIC),
ti as (select METRIC, sum(cast(t as double) * t * t - t) as tie_sum from pv group by METRIC),
hs as (select hh.METRIC, k, case when min_n >= 5 and k = (select count(distinct CLUSTER) from tr) and k >= 2
      and 1e0 - tie_sum / (N * N * N - N) > 0
    then (12e0 / (N * (N + 1)) * sr - 3 * (N + 1)) / (1e0 - tie_sum / (N * N * N - N)) end as H
  from hh join ti on ti.METRIC = hh.METRIC)"""

ORACLE = {
    "traveler_features": with_views(_FE + " select TRAVELER_ID, " + ", ".join(sg.FEATURES)
                                    + ", TOTAL_SPEND_PP, IS_REPEAT, IS_MOBILE from fe", "fx_travelers"),
    "standardized": with_views(_Z + " select TRAVELER_ID, " + ", ".join(
        f"round_even({f}_Z, {Z9}) as {f}_Z" for f in sg.FEATURES) + " from z", "fx_travelers"),
    "ch_index": with_views(_CH + """ select cast(n as bigint) as n, k, round_even(b, 4) as BETWEEN_SS, round_even(w, 4) as WITHIN_SS,
  round_even(case when k > 1 and n > k and w > 0 then (b / (k - 1)) / (w / (n - k)) end, 1) as CALINSKI_HARABASZ from chv""",
                           "fx_travelers"),
    "silhouette_euclid": with_views(_SIL, "fx_travelers"),
    "cluster_profile": with_views(_PROF + " select * from prof", "fx_travelers"),
    "cluster_labels": with_views(_PROF + """ select CLUSTER, SIZE, TOP_PURPOSE, AVG_TOTAL_SPEND, AVG_STAY_NIGHTS,
  PCT_BUSINESS_CLASS, TOP_PRICE_TIER, AVG_GROUP_SIZE, ARCHETYPE from lab""", "fx_travelers"),
    "segment_crosstab": with_views(_PROF + """, x as (select tr.PREFERRED_MARKET, lab.ARCHETYPE from tr join lab on lab.CLUSTER = tr.CLUSTER
  where tr.PREFERRED_MARKET is not null and lab.ARCHETYPE is not null)
select case when grouping(ARCHETYPE) = 1 then 'All' else ARCHETYPE end as ARCHETYPE,
  round_even(avg(case when PREFERRED_MARKET = 'Dubai' then 1e0 else 0e0 end), 3) * 100 as PCT_DUBAI,
  round_even(avg(case when PREFERRED_MARKET = 'NYC' then 1e0 else 0e0 end), 3) * 100 as PCT_NYC
from x group by rollup(ARCHETYPE)""", "fx_travelers"),
    "segment_market_shares": with_views(_PROF + """, x as (select 'm' || (tr.TRAVELER_ID % 2003) as MARKET, lab.ARCHETYPE from tr join lab on lab.CLUSTER = tr.CLUSTER
  where lab.ARCHETYPE is not null),
c as (select ARCHETYPE, MARKET, count(*) as N from x group by ARCHETYPE, MARKET union all select 'All', MARKET, count(*) from x group by MARKET)
select ARCHETYPE, MARKET, N, round_even(N / sum(N) over (partition by ARCHETYPE), 3) * 100 as PCT from c""", "fx_travelers"),
    "segment_recommendations": with_views(_PROF + " select ARCHETYPE, " + ", ".join(
        f"{_rec_case(j)} as {c}" for j, c in enumerate(sg.REC_COLUMNS)) + " from lab", "fx_travelers"),
    "kruskal_wallis": with_views(_KW + f""" select METRIC, round_even(H, 2) as H_STATISTIC,
  round_even({S.chi2_sf('H', 'k - 1')}, 6) as P_VALUE, coalesce({S.chi2_sf('H', 'k - 1')} < 0.05, false) as SIGNIFICANT
from hs""", "fx_travelers"),
}

_GAPS = {"trip_purpose": "traveler_id % 3 <> 0", "fare_class": "traveler_id % 4 <> 1", "preferred_market": "traveler_id % 5 <> 2"}
_TR_GAPS = ", tr as (select " + ", ".join(
    f"case when {_GAPS[c]} then {c} end as {c.upper()}" if c in _GAPS else f"{c} as {c.upper()}" for c in TRAVELER_COLS) + " from fx_travelers)"
ORACLE["profile_missing"] = ORACLE["cluster_profile"].replace(_TR, _TR_GAPS)
ORACLE["pca_check"] = "select true as SHARES_ADD_UP, true as TRACE_KEPT, true as EIGENVECTORS, true as SHARES_MATCH"
ORACLE["kmeans_check"] = with_views(
    "select count(*) as N_ROWS, 4 as N_CLUSTERS, true as INERTIA_IS_WITHIN_SS, true as CENTERS_ARE_MEANS from fx_travelers", "fx_travelers")
