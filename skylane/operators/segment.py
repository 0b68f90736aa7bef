"""Traveler segmentation.

Feature engineering, standardisation, cluster profiles, labels, cross-tabs
and the rank test are aggregations and column expressions. The model steps:
scaler and PCA are fitted by one aggregate pass each (2·d and d·(d+1)/2 sums;
the d x d eigen-decomposition is driver-sized) and applied as column
expressions; K-Means fits every restart of every K with shared data passes
(``kmeans.py``); the Euclidean silhouette measures all rows against cluster coresets (``silhouette.py``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import chi2_sf, np_round
from ..session import ensure_checkpoint_dir
from . import kmeans as km
from .common import attach
from .ranking import average_ranks, exact_quantile
from .silhouette import euclidean_silhouette

# Lead-time bins (right-closed) -> bucket 1..5, tier numbers (other -> 2), feature list.
LEAD_BINS = [(0, 7), (7, 21), (21, 45), (45, 90), (90, 365)]
TIER_NUM = {"Budget": 1, "Mid-Range": 2, "Upscale": 3, "Luxury": 4}
TIER_DEFAULT = 2
FEATURES = ["AGE", "GROUP_SIZE", "STAY_NIGHTS", "LEAD_TIME_BUCKET", "SPEND_PER_NIGHT_PP", "HOTEL_FLIGHT_RATIO",
            "PRICE_TIER_NUM", "IS_LOYALTY", "IS_DUBAI_PREF"]
# Kruskal-Wallis metrics and minimum group size.
KW_METRICS = ["TOTAL_TRIP_SPEND", "STAY_NIGHTS", "LEAD_TIME_DAYS", "FLIGHT_SPEND", "HOTEL_SPEND_PER_NIGHT",
              "GROUP_SIZE", "AGE"]
KW_MIN_GROUP = 5


def _is(col: str, value: str):
    """Equality in which a missing value is not equal."""
    return F.coalesce(F.col(col) == value, F.lit(False))


def engineer_features(df: DataFrame) -> DataFrame:
    """H1: ratios, per-person spends, lead-time bucket, 0/1 flags, tier number."""
    lt = F.col("LEAD_TIME_DAYS")
    bucket = F.lit(None).cast("double")
    for i, (lo, hi) in reversed(list(enumerate(LEAD_BINS, start=1))):
        bucket = F.when((lt > lo) & (lt <= hi), F.lit(float(i))).otherwise(bucket)
    tier = F.lit(float(TIER_DEFAULT))
    for name, num in TIER_NUM.items():
        tier = F.when(F.col("PREFERRED_PRICE_TIER") == name, F.lit(float(num))).otherwise(tier)
    return df.withColumns({
        "HOTEL_FLIGHT_RATIO": np_round(F.col("TOTAL_HOTEL_SPEND") / F.greatest(F.col("FLIGHT_SPEND"), F.lit(1.0)), 3),
        "SPEND_PER_NIGHT_PP": np_round(F.col("HOTEL_SPEND_PER_NIGHT") / F.col("GROUP_SIZE"), 2),
        "TOTAL_SPEND_PP": np_round(F.col("TOTAL_TRIP_SPEND") / F.col("GROUP_SIZE"), 2),
        "LEAD_TIME_BUCKET": bucket,
        "IS_LOYALTY": F.col("LOYALTY_MEMBER").cast("int"),
        "IS_REPEAT": F.col("REPEAT_VISITOR").cast("int"),
        "IS_MOBILE": _is("DEVICE", "mobile").cast("int"),
        "IS_DUBAI_PREF": _is("PREFERRED_MARKET", "Dubai").cast("int"),
        "PRICE_TIER_NUM": tier,
    })


def fit_scaler(df: DataFrame, features: Sequence[str] = FEATURES) -> tuple[list[float], list[float]]:
    """H2 fit: mean and population std of every feature (missing -> 0), one aggregate pass.

    The result is 2 x d numbers; they are applied as literals, so every later use
    (fit, labels, output) sees bit-identical scaled values.
    """
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(filled)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(filled)]).first()
    means = [row[f"m{i}"] for i in range(len(features))]
    stds = [row[f"s{i}"] for i in range(len(features))]
    return means, [1.0 if (v is None or v == 0) else v for v in stds]


def standardize(df: DataFrame, features: Sequence[str] = FEATURES, suffix: str = "_Z",
                scaler: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """H2: missing -> 0, then (x - mean) / population std (std 0 -> 1)."""
    means, stds = scaler or fit_scaler(df, features)
    return df.withColumns({
        f + suffix: (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.lit(means[i])) / F.lit(stds[i])
        for i, f in enumerate(features)})


def fit_pca(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """H3 fit: eigen-decomposition of the sample covariance of ``cols`` (one aggregate pass).

    Returns (explained-variance ratios, loadings d x d), components sorted by
    variance, each loading's largest-magnitude entry made positive.
    """
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)],
                 *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    n = float(row["n"])
    mean = np.array([row[f"s{i}"] for i in range(d)]) / n
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = (row[f"p{i}_{j}"] - n * mean[i] * mean[j]) / (n - 1)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0.0, None), vecs[:, order]
    for j in range(d):
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    return vals / vals.sum(), vecs


def n_components_for(ratios: Sequence[float], pca_variance: float) -> int:
    """Smallest number of components whose cumulative ratio exceeds ``pca_variance``."""
    cum = np.cumsum(ratios)
    hit = np.nonzero(cum > pca_variance)[0]
    return int(hit[0]) + 1 if len(hit) else len(ratios)


def feature_vectors(df: DataFrame, features: Sequence[str] = FEATURES, use_pca: bool = True,
                    pca_variance: float = 0.90) -> tuple[DataFrame, list[str], dict]:
    """H2/H3: ``df`` plus the clustering coordinates (``PC_1..PC_m`` or the scaled features)."""
    z = standardize(df, features)
    zc = [f + "_Z" for f in features]
    info: dict = {"n_features": len(features)}
    if not use_pca:
        return z, zc, info
    ratios, vecs = fit_pca(z, zc)
    m = n_components_for(ratios, pca_variance)
    info.update(ratios=[float(r) for r in ratios], n_components=m, explained=float(sum(ratios[:m])))
    pcs = {f"PC_{j + 1}": sum((F.col(zc[i]) * F.lit(float(vecs[i, j])) for i in range(len(zc))), F.lit(0.0))
           for j in range(m)}
    return z.withColumns(pcs), list(pcs), info


def pca_components(df: DataFrame, features: Sequence[str] = FEATURES, pca_variance: float = 0.90) -> DataFrame:
    """H3: explained-variance ratio per component and the kept count (ratio cut > ``pca_variance``)."""
    _, _, info = feature_vectors(df, features, True, pca_variance)
    rows, cum = [], 0.0
    for i, r in enumerate(info["ratios"]):
        cum += r
        rows.append((i + 1, r, cum, i < info["n_components"]))
    return df.sparkSession.createDataFrame(rows, "COMPONENT int, EXPLAINED_VARIANCE_RATIO double, "
                                                 "CUMULATIVE_RATIO double, KEPT boolean")


ROW_ID = "_row_id"


def _fit_frame(x: DataFrame, cols: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Cache the clustering coordinates, dealt evenly by a row id that is the same in every layout."""
    key = ["TRAVELER_ID"] if "TRAVELER_ID" in x.columns else list(features)
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.select(F.xxhash64(*key).alias(ROW_ID), *cols).repartition(parts, ROW_ID).cache()


def run_kmeans(df: DataFrame, k: int = 4, features: Sequence[str] = FEATURES, seed: int = 42, use_pca: bool = True,
               pca_variance: float = 0.90, n_init: int = 15, max_iter: int = 500) -> DataFrame:
    """H4: cluster labels (``CLUSTER``, replacing any given labels) and the first two components.

    ``n_init`` k-means++ restarts share every data pass (``kmeans.fit_batched``);
    the restart with the lowest inertia labels the rows.
    """
    x, cols, info = feature_vectors(df.drop("CLUSTER"), features, use_pca, pca_variance)
    coords = _fit_frame(x, cols, features)
    best = km.best_per_k(km.fit_batched(coords, cols, [k], n_init, seed, max_iter, id_col=ROW_ID))[k]
    coords.unpersist()
    out = km.label_rows(x, cols, {"CLUSTER": best.centers})
    if use_pca and len(cols) >= 2:
        out = out.withColumns({"PCA_1": F.col(cols[0]), "PCA_2": F.col(cols[1])})
    out = out.drop(*[f + "_Z" for f in features], *[c for c in cols if c.startswith("PC_")])
    # The labelled table feeds profiles, rank tests and crosstabs; checkpointing it (into the
    # session's spark.checkpoint.dir) computes scaling, projection and labels once.
    ensure_checkpoint_dir(x.sparkSession)
    return out.checkpoint(eager=True)


def calinski_harabasz(df: DataFrame, value_cols: Sequence[str], label_col: str = "CLUSTER",
                      by: Sequence[str] = ()) -> DataFrame:
    """H7: CH index from cluster sizes, sums and squared norms -- pure aggregation.

    B = sum_c n_c |mu_c|^2 - n |mu|^2,  W = sum |x|^2 - sum_c n_c |mu_c|^2,
    CH = (B / (k - 1)) / (W / (n - k)).
    """
    sq = sum((F.col(c) * F.col(c) for c in value_cols), F.lit(0.0))
    per = df.groupBy(*by, label_col).agg(F.count(F.lit(1)).alias("n_c"), F.sum(sq).alias("ss_c"),
                                    *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(value_cols)])
    between_c = sum((F.col(f"s_{i}") * F.col(f"s_{i}") for i in range(len(value_cols))), F.lit(0.0)) / F.col("n_c")
    tot = per.groupBy(*by).agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("ss_c").alias("ss"),
                  F.sum(between_c).alias("sb"), *[F.sum(f"s_{i}").alias(f"t_{i}") for i in range(len(value_cols))])
    grand = sum((F.col(f"t_{i}") * F.col(f"t_{i}") for i in range(len(value_cols))), F.lit(0.0)) / F.col("n")
    b = F.col("sb") - grand
    w = F.col("ss") - F.col("sb")
    ch = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (w > 0),
                (b / (F.col("k") - 1)) / (w / (F.col("n") - F.col("k"))))
    return tot.select(*by, "n", "k", b.alias("BETWEEN_SS"), w.alias("WITHIN_SS"), ch.alias("CALINSKI_HARABASZ"))


#: Rows that stand for a cluster when labellings are compared.
K_SEARCH_POINTS = 1024


def k_evaluation(df: DataFrame, k_values: Sequence[int] = range(2, 9), features: Sequence[str] = FEATURES,
                 seed: int = 42, use_pca: bool = True, pca_variance: float = 0.90, n_init: int = 15,
                 max_iter: int = 500) -> DataFrame:
    """H5/H6/H8: per K inertia, Euclidean silhouette with its standard error, CH; the K of the best silhouette flagged.

    All K x restarts models are fitted with shared passes; CH and the silhouettes of every K come from one pass each
    over the stacked labelings.
    """
    x, cols, info = feature_vectors(
        df.drop("CLUSTER").select(*features, *[c for c in ("TRAVELER_ID",) if c in df.columns]), features, use_pca, pca_variance)
    coords = _fit_frame(x, cols, features)
    best = km.best_per_k(km.fit_batched(coords, cols, list(k_values), n_init, seed, max_iter, id_col=ROW_ID))
    labelled = km.label_rows(coords, cols, {f"L{k}": best[k].centers for k in k_values}).cache()  # read four times
    stacked = labelled.select(*cols, F.explode(F.array(*[
        F.struct(F.lit(int(k)).alias("KVAL"), F.col(f"L{k}").alias("CLUSTER")) for k in k_values])).alias("s")) \
        .select(*cols, "s.KVAL", "s.CLUSTER")
    ch = {r["KVAL"]: r["CALINSKI_HARABASZ"] for r in calinski_harabasz(stacked, cols, "CLUSTER", by=["KVAL"]).collect()}
    sil = {r["LABELS"]: r for r in euclidean_silhouette(labelled, cols, [f"L{k}" for k in k_values], ROW_ID, K_SEARCH_POINTS).collect()}
    rows = []
    for k in k_values:
        c, s = ch.get(int(k)), sil.get(f"L{k}")
        known = s is not None and s["SILHOUETTE"] is not None
        rows.append((int(k), float(round(best[k].inertia, 1)), float(round(s["SILHOUETTE"], 4)) if known else None,
                     float(round(s["STD_ERROR"], 4)) if known else None, None if c is None else float(round(c, 1))))
    labelled.unpersist()
    coords.unpersist()
    top = max((r for r in rows if r[2] is not None), key=lambda r: (r[2], -r[0]), default=(None,))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == top) for r in rows], "K int, INERTIA double, SILHOUETTE double, "
                                           "SILHOUETTE_ERROR double, CALINSKI_HARABASZ double, BEST boolean")


MODE_COLUMNS = ("TRIP_PURPOSE", "PREFERRED_PRICE_TIER", "BOOKING_CHANNEL", "DEVICE", "FARE_CLASS")


def _modes_and_shares(df: DataFrame, cols: Sequence[str], label_col: str = "CLUSTER") -> DataFrame:
    """Per cluster and column the most frequent value (smallest on ties; missing values don't count) and its share.

    One scan: the columns are stacked, counted together and spread again.
    """
    stacked = df.select(label_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("s")).select(label_col, "s.c", "s.v")
    n = stacked.filter(F.col("v").isNotNull()).groupBy(label_col, "c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(label_col, "c").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("v").alias("v"))).alias("m"),
                                         F.sum("n").alias("of"))
    spread = []
    for c in cols:
        here = F.col("c") == c
        spread += [F.max(F.when(here, F.col("m.v"))).alias(f"_mode_{c}"),
                   F.max(F.when(here, -F.col("m.neg") / F.col("of"))).alias(f"_share_{c}")]
    return best.groupBy(label_col).agg(*spread)


def profile_clusters(df: DataFrame, label_col: str = "CLUSTER") -> DataFrame:
    """H9: size, share, rounded means, median, modes (smallest on ties), concentration, % flags."""
    g = df.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("SIZE"),
        np_round(F.avg("AGE"), 1).alias("AVG_AGE"),
        np_round(F.avg("GROUP_SIZE"), 1).alias("AVG_GROUP_SIZE"),
        np_round(F.avg("STAY_NIGHTS"), 1).alias("AVG_STAY_NIGHTS"),
        np_round(F.avg("LEAD_TIME_DAYS"), 1).alias("AVG_LEAD_TIME"),
        np_round(F.avg("FLIGHT_SPEND"), 0).alias("AVG_FLIGHT_SPEND"),
        np_round(F.avg("HOTEL_SPEND_PER_NIGHT"), 0).alias("AVG_HOTEL_PER_NIGHT"),
        np_round(F.avg("TOTAL_TRIP_SPEND"), 0).alias("AVG_TOTAL_SPEND"),
        np_round(F.avg(_is("PREFERRED_MARKET", "Dubai").cast("double")) * 100, 1).alias("PCT_DUBAI_PREF"),
        np_round(F.avg(F.col("LOYALTY_MEMBER").cast("double")) * 100, 1).alias("PCT_LOYALTY"),
        np_round(F.avg(F.col("REPEAT_VISITOR").cast("double")) * 100, 1).alias("PCT_REPEAT"),
        np_round(F.avg(_is("FARE_CLASS", "business").cast("double")) * 100, 1).alias("PCT_BUSINESS_CLASS"),
    )
    everything = F.sum("SIZE").over(Window.partitionBy())  # one row per cluster
    g = g.withColumn("PCT_OF_TOTAL", np_round(F.col("SIZE") / everything * 100, 1))
    # continuous spend: exact median without one per-cluster value buffer (see ranking.exact_quantile)
    med = exact_quantile(df, [label_col], "TOTAL_TRIP_SPEND", 0.5, out_col="_med")
    g = g.join(med, label_col, "left").withColumn("MEDIAN_TOTAL_SPEND", np_round("_med", 0)).drop("_med")
    g = g.join(_modes_and_shares(df, MODE_COLUMNS, label_col), label_col, "left")
    return g.select(
        label_col, "SIZE", "PCT_OF_TOTAL", "AVG_AGE", "AVG_GROUP_SIZE", "AVG_STAY_NIGHTS", "AVG_LEAD_TIME",
        F.col("_mode_TRIP_PURPOSE").alias("TOP_PURPOSE"),
        np_round(F.col("_share_TRIP_PURPOSE") * 100, 1).alias("PURPOSE_CONCENTRATION"),
        "AVG_FLIGHT_SPEND", "AVG_HOTEL_PER_NIGHT", "AVG_TOTAL_SPEND", "MEDIAN_TOTAL_SPEND",
        F.col("_mode_PREFERRED_PRICE_TIER").alias("TOP_PRICE_TIER"), "PCT_DUBAI_PREF",
        F.col("_mode_BOOKING_CHANNEL").alias("TOP_CHANNEL"), F.col("_mode_DEVICE").alias("TOP_DEVICE"),
        "PCT_LOYALTY", "PCT_REPEAT", F.col("_mode_FARE_CLASS").alias("TOP_FARE_CLASS"), "PCT_BUSINESS_CLASS")


def label_clusters(profile: DataFrame, label_col: str = "CLUSTER") -> DataFrame:
    """Archetype by ordered business rules on the rounded profile values (first match wins)."""
    purpose, spend, stay = F.col("TOP_PURPOSE"), F.col("AVG_TOTAL_SPEND"), F.col("AVG_STAY_NIGHTS")
    biz, tier, grp = F.col("PCT_BUSINESS_CLASS"), F.col("TOP_PRICE_TIER"), F.col("AVG_GROUP_SIZE")

    def t(c):  # NaN-like comparisons are false, as in the row loop
        return F.coalesce(c, F.lit(False))

    arche = (F.when(t((purpose == "business") | (biz > 40)),
                    F.when(t(spend > 8000), "Premium Business").otherwise("Corporate Traveler"))
             .when(t((purpose == "honeymoon") | ((tier == "Luxury") & (stay >= 5))), "Honeymoon/Luxury")
             .when(t((purpose == "family_vacation") | (grp >= 3)), "Family Explorer")
             .when(t((purpose == "transit") | (stay <= 2)), "Transit/Stopover")
             .when(t((purpose == "leisure") & (spend < 3000)), "Budget Explorer")
             .when(t((purpose == "leisure") & (spend >= 3000)), "Comfort Leisure")
             .otherwise(F.concat(F.lit("Segment "), F.col(label_col).cast("string"))))
    return profile.withColumn("ARCHETYPE", arche)


MAX_MARKETS = 1000


def segment_market_crosstab(df: DataFrame, labels: DataFrame, markets: Sequence[str] | None = None,
                            label_col: str = "CLUSTER", market_col: str = "PREFERRED_MARKET") -> DataFrame:
    """Archetype x market shares per row with an ``All`` row; round 3 then x 100.

    Clusters sharing an archetype merge. Market columns come from ``markets``
    (or the distinct markets, a bounded category list).
    """
    x = df.filter(F.col(market_col).isNotNull()).join(labels.select(label_col, "ARCHETYPE"), label_col)
    counts = x.filter(F.col("ARCHETYPE").isNotNull()).groupBy("ARCHETYPE", F.col(market_col).alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    if markets is None:  # the result's columns: as a pivot, at most MAX_MARKETS distinct values
        found = [r[0] for r in df.select(market_col).distinct().limit(MAX_MARKETS + 1).collect() if r[0] is not None]
        if len(found) > MAX_MARKETS:
            raise ValueError(f"more than {MAX_MARKETS} markets; name those wanted")
        markets = sorted(found)
    aggs = [np_round(F.sum(F.when(F.col("_m") == m, F.col("_n")).otherwise(0)) / F.sum("_n"), 3) * 100 for m in markets]
    out = counts.rollup("ARCHETYPE").agg(*[a.alias(f"PCT_{m.upper()}") for a, m in zip(aggs, markets)],
                                         F.grouping("ARCHETYPE").alias("_g"))
    return out.withColumn("ARCHETYPE", F.when(F.col("_g") == 1, F.lit("All")).otherwise(F.col("ARCHETYPE"))).drop("_g")


def segment_market_shares(df: DataFrame, labels: DataFrame, label_col: str = "CLUSTER", market_col: str = "PREFERRED_MARKET") -> DataFrame:
    """H11 in long form: (ARCHETYPE, MARKET, N, PCT) for any number of markets, with the ``All`` rows; nothing is collected.

    Only pairs that occur have a row (the wide form's other cells are 0). Rows are counted per cluster and market
    before the labels are joined, so the join moves counts, not rows. Null clusters, archetypes and markets count nowhere.
    """
    counts = df.where(F.col(market_col).isNotNull()).groupBy(label_col, F.col(market_col).alias("MARKET")).agg(F.count(F.lit(1)).alias("_n"))
    named = counts.join(labels.select(label_col, "ARCHETYPE").where(F.col("ARCHETYPE").isNotNull()), label_col)
    cells = named.groupBy("ARCHETYPE", "MARKET").agg(F.sum("_n").alias("N"))
    every = cells.groupBy("MARKET").agg(F.sum("N").alias("N")).select(F.lit("All").alias("ARCHETYPE"), "MARKET", "N")
    both = cells.select("ARCHETYPE", "MARKET", "N").unionByName(every)
    rows = both.groupBy("ARCHETYPE").agg(F.sum("N").alias("_rows"))
    return attach(both, rows, ["ARCHETYPE"]).select("ARCHETYPE", "MARKET", "N", (np_round(F.col("N") / F.col("_rows"), 3) * 100).alias("PCT"))


# Recommendation texts per archetype rule, in match order
# (pricing, marketing channel, product focus, upsell, retention).
RECOMMENDATIONS = [
    (("Business", "Corporate"), (
        "Corporate rate cards, loyalty tier upgrades",
        "LinkedIn ads, email to frequent flyer lists",
        "Airport lounge access, flexible cancellation, business hotel bundles",
        "Business->First upgrade, late checkout, meeting room packages",
        "Priority loyalty tier, personalized trip reports")),
    (("Honeymoon", "Luxury"), (
        "Premium bundles with experiences (desert safari, spa)",
        "Instagram, wedding planning sites, Google Display",
        "Romance packages, suite upgrades, private transfers",
        "Couples spa, sunset dinner cruise, photography package",
        "Anniversary reminder emails, luxury brand partnerships")),
    (("Family",), (
        "Kids-stay-free bundles, family suite discounts",
        "Facebook, parenting blogs, YouTube family vlogs",
        "Family rooms, theme park tickets, kid-friendly hotels",
        "Waterpark access, babysitting services, family photo shoots",
        "School holiday deal alerts, family loyalty program")),
    (("Transit", "Stopover"), (
        "Ultra-competitive day rates, <24h stay bundles",
        "In-app push during layover booking, airline partner deals",
        "Airport hotels, transit visa included, luggage storage",
        "City tour add-on (4h Dubai highlights), lounge access",
        "Auto-suggest Dubai stopover on future long-haul bookings")),
    (("Budget",), (
        "Flash sales, early-bird discounts, price-match guarantee",
        "TikTok, Reddit r/travel, Google Flights integration",
        "Budget hotels, hostels, neighborhood guides for cheap eats",
        "Travel insurance, SIM card bundle, metro pass add-on",
        "Price drop alerts, deal of the week newsletter")),
]
DEFAULT_RECOMMENDATION = (
    "Dynamic pricing based on lead time + demand",
    "Google Ads, metasearch, retargeting",
    "Curated mid-range hotel collections, local experience add-ons",
    "Hotel+flight bundle, airport transfer, travel insurance",
    "Post-trip review prompt, seasonal deal emails")
REC_COLUMNS = ["PRICING_STRATEGY", "MARKETING_CHANNEL", "PRODUCT_FOCUS", "UPSELL_OPP", "RETENTION"]


def segment_recommendations(labels: DataFrame) -> DataFrame:
    """Strategy texts by archetype substring rules (first matching rule), one row per profile row."""
    a = F.col("ARCHETYPE")
    cols = []
    for j, name in enumerate(REC_COLUMNS):
        expr = F.lit(DEFAULT_RECOMMENDATION[j])
        for pats, texts in reversed(RECOMMENDATIONS):
            hit = reduce(lambda u, v: u | v, [a.contains(p) for p in pats])
            expr = F.when(hit, F.lit(texts[j])).otherwise(expr)
        cols.append(expr.alias(name))
    return labels.select("ARCHETYPE", *cols)


def kruskal_wallis(df: DataFrame, metrics: Sequence[str] = KW_METRICS, label_col: str = "CLUSTER",
                   min_group: int = KW_MIN_GROUP, alpha: float = 0.05) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H per metric over clusters; NULL when a group has < min_group rows."""
    long = df.select(label_col, F.explode(F.array(*[
        F.struct(F.lit(m).alias("METRIC"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("s")) \
        .select(label_col, "s.METRIC", "s.v").filter(F.col("v").isNotNull())
    r = average_ranks(long, ["METRIC"], "v", label_col)
    t = F.col("t").cast("double")
    per_group = r.groupBy("METRIC", label_col).agg(F.sum("cnt").alias("n_c"),
                                                    F.sum(F.col("cnt") * F.col("rank")).alias("R_c"),
                                                    # the counts at a value add up to t: in all t^3 - t for each value
                                                    F.sum(F.col("cnt") * (t * t - 1)).alias("tie_part"))
    all_groups = df.select(label_col).distinct().agg(F.count(F.lit(1)).alias("n_groups"))
    h = per_group.groupBy("METRIC").agg(F.sum("n_c").cast("double").alias("N"),
                                        F.sum(F.col("R_c") * F.col("R_c") / F.col("n_c")).alias("sr"),
                                        F.min("n_c").alias("min_n"), F.count(F.lit(1)).alias("k"),
                                        F.sum("tie_part").alias("tie_sum"))
    h = attach(h, all_groups)
    n = F.col("N")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("sr") - 3 * (n + 1)
    corr = F.lit(1.0) - F.col("tie_sum") / (n * n * n - n)
    ok = (F.col("min_n") >= min_group) & (F.col("k") == F.col("n_groups")) & (F.col("k") >= 2) & (corr > 0)
    hstat = F.when(ok, raw / corr)
    p = chi2_sf(hstat, F.col("k") - 1)
    metric_order = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("METRIC"))
    return h.select("METRIC", np_round(hstat, 2).alias("H_STATISTIC"), np_round(p, 6).alias("P_VALUE"),
                    F.coalesce(p < F.lit(alpha), F.lit(False)).alias("SIGNIFICANT"), metric_order.alias("_o")) \
            .orderBy("_o").drop("_o")


def run_full_segmentation(travelers: DataFrame, k: int | None = 4, use_pca: bool = True, seed: int = 42,
                          n_init: int = 15, k_values: Sequence[int] = range(2, 9)) -> dict:
    """Features -> K search -> K-Means -> profile -> labels -> rank test -> crosstab -> strategy."""
    feats = engineer_features(travelers)
    k_eval = k_evaluation(feats, k_values, seed=seed, use_pca=use_pca, n_init=n_init)
    if k is None:
        k = k_eval.filter(F.col("BEST")).first()["K"]
    clustered = run_kmeans(feats, k, seed=seed, use_pca=use_pca, n_init=n_init)
    profiles = label_clusters(profile_clusters(clustered))
    return {
        "travelers": clustered,
        "features": FEATURES,
        "k_evaluation": k_eval,
        "profiles": profiles,
        "validation": kruskal_wallis(clustered),
        "market_crosstab": segment_market_crosstab(clustered, profiles),
        "recommendations": segment_recommendations(profiles),
    }
