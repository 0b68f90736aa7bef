"""Segmentation: features, rules, rank test and CH against brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skylane.operators import segment as sg


def _kruskal_brute(groups):
    allv = np.concatenate(groups)
    s = pd.Series(allv).rank(method="average").to_numpy()
    n = len(allv)
    idx, h = 0, 0.0
    for g in groups:
        r = s[idx: idx + len(g)]
        idx += len(g)
        h += r.sum() ** 2 / len(g)
    h = 12.0 / (n * (n + 1)) * h - 3 * (n + 1)
    _, counts = np.unique(allv, return_counts=True)
    corr = 1 - (counts ** 3 - counts).sum() / (n ** 3 - n)
    return h / corr


def test_kruskal_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    groups = {c: rng.integers(0, 20, 40 + 10 * c).astype(float) for c in range(3)}
    for c, vals in groups.items():
        rows += [(c, float(v), 1.0, 1.0 * (c + 1)) for v in vals]
    df = spark.createDataFrame(rows, "CLUSTER int, M1 double, SAME double, M3 double")
    out = {r["METRIC"]: r for r in sg.kruskal_wallis(df, ["M1", "SAME"]).collect()}
    want = _kruskal_brute(list(groups.values()))
    assert out["M1"]["H_STATISTIC"] == round(want, 2)
    assert abs(out["M1"]["P_VALUE"] - round(float(np.exp(-want / 2)), 6)) <= 1e-6   # df 2: closed form
    assert out["SAME"]["H_STATISTIC"] is None and out["SAME"]["SIGNIFICANT"] is False  # all values equal


def test_kruskal_small_group_is_null(spark):
    rows = [(0, float(i)) for i in range(10)] + [(1, float(i)) for i in range(4)]
    r = sg.kruskal_wallis(spark.createDataFrame(rows, "CLUSTER int, M double"), ["M"]).first()
    assert r["H_STATISTIC"] is None and r["P_VALUE"] is None


def test_ranks_with_many_buckets_match_pandas(spark):
    rng = np.random.default_rng(2)
    vals = rng.integers(0, 50, 500).astype(float)
    df = spark.createDataFrame([("k", float(v), int(i % 3)) for i, v in enumerate(vals)], "key string, v double, g int")
    from skylane.operators.ranking import average_ranks
    got = {r["v"]: r["rank"] for r in average_ranks(df, ["key"], "v", "g", buckets=7).collect()}
    want = dict(zip(vals, pd.Series(vals).rank(method="average")))
    assert all(got[v] == want[v] for v in got)


def test_global_position_is_row_number(spark):
    from pyspark.sql import functions as F
    from skylane.operators.ranking import global_position
    df = spark.range(0, 1000).select((F.col("id") % 37).alias("t"), F.col("id").alias("tie"))
    pos, n = global_position(df, ["t", "tie"], "pos", num_partitions=5)
    rows = sorted((r["t"], r["tie"], r["pos"]) for r in pos.collect())
    assert n == 1000 and [r[2] for r in rows] == list(range(1, 1001))


def test_features_edges(spark):
    rows = [(lt, 0.0, "Other") for lt in (0, 7, 8, 365, 366)]
    df = spark.createDataFrame([(lt, 2, 100.0, fs, 200, 300.0, t, True, False, "mobile", "Dubai")
                                for lt, fs, t in rows],
                               "LEAD_TIME_DAYS long, GROUP_SIZE long, HOTEL_SPEND_PER_NIGHT double, FLIGHT_SPEND double, "
                               "TOTAL_HOTEL_SPEND long, TOTAL_TRIP_SPEND double, PREFERRED_PRICE_TIER string, "
                               "LOYALTY_MEMBER boolean, REPEAT_VISITOR boolean, DEVICE string, PREFERRED_MARKET string")
    out = sg.engineer_features(df).collect()
    assert [r["LEAD_TIME_BUCKET"] for r in out] == [None, 1.0, 2.0, 5.0, None]
    assert out[0]["HOTEL_FLIGHT_RATIO"] == 200.0 and out[0]["PRICE_TIER_NUM"] == 2.0


def test_label_rules_in_order(spark):
    cols = "CLUSTER int, TOP_PURPOSE string, AVG_TOTAL_SPEND double, AVG_STAY_NIGHTS double, PCT_BUSINESS_CLASS double, TOP_PRICE_TIER string, AVG_GROUP_SIZE double"
    rows = [(0, "business", 8000.0, 3.0, 0.0, "Budget", 1.0), (1, "leisure", 9000.0, 3.0, 41.0, "Budget", 1.0),
            (2, "leisure", 100.0, 5.0, 0.0, "Luxury", 1.0), (3, "family_vacation", 1.0, 3.0, 0.0, "Budget", 1.0),
            (4, "x", 1.0, 2.0, 0.0, "Budget", 1.0), (5, "leisure", 2999.0, 3.0, 0.0, "Budget", 1.0),
            (6, "leisure", 3000.0, 3.0, 0.0, "Budget", 1.0), (7, "x", 1.0, 3.0, 0.0, "Budget", 2.0)]
    out = [r["ARCHETYPE"] for r in sg.label_clusters(spark.createDataFrame(rows, cols)).orderBy("CLUSTER").collect()]
    assert out == ["Corporate Traveler", "Premium Business", "Honeymoon/Luxury", "Family Explorer", "Transit/Stopover",
                   "Budget Explorer", "Comfort Leisure", "Segment 7"]
    recs = sg.segment_recommendations(sg.label_clusters(spark.createDataFrame(rows, cols))).collect()
    assert recs[0]["PRICING_STRATEGY"] == "Corporate rate cards, loyalty tier upgrades"
    assert recs[7]["RETENTION"] == "Post-trip review prompt, seasonal deal emails"


def test_profile_mode_ties_take_smallest(spark):
    base = dict(AGE=30, GROUP_SIZE=2, STAY_NIGHTS=3, LEAD_TIME_DAYS=10, FLIGHT_SPEND=1.0, HOTEL_SPEND_PER_NIGHT=1.0,
                TOTAL_TRIP_SPEND=1.0, PREFERRED_MARKET="NYC", LOYALTY_MEMBER=True, REPEAT_VISITOR=False,
                FARE_CLASS="business", PREFERRED_PRICE_TIER="Luxury", BOOKING_CHANNEL="web", DEVICE="mobile")
    rows = [dict(base, CLUSTER=0, TRIP_PURPOSE=p) for p in ["b", "a", "b", "a", "c"]]
    df = spark.createDataFrame(pd.DataFrame(rows))
    r = sg.profile_clusters(df).first()
    assert r["TOP_PURPOSE"] == "a" and r["PURPOSE_CONCENTRATION"] == 40.0 and r["PCT_BUSINESS_CLASS"] == 100.0


def test_calinski_harabasz_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    lab = rng.integers(0, 4, 300)
    df = spark.createDataFrame([(int(l), *map(float, v)) for l, v in zip(lab, x)], "CLUSTER int, a double, b double, c double")
    got = sg.calinski_harabasz(df, ["a", "b", "c"]).first()["CALINSKI_HARABASZ"]
    mu = x.mean(0)
    b = sum((lab == k).sum() * ((x[lab == k].mean(0) - mu) ** 2).sum() for k in range(4))
    w = sum(((x[lab == k] - x[lab == k].mean(0)) ** 2).sum() for k in range(4))
    assert abs(got - (b / 3) / (w / (300 - 4))) < 1e-9


def test_batched_kmeans_recovers_blobs_and_invariants(spark):
    from skylane.operators import kmeans as km
    rng = np.random.default_rng(9)
    centers = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])
    pts = np.vstack([c + rng.normal(scale=0.5, size=(200, 2)) for c in centers])
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "a double, b double").repartition(4).cache()
    fits = km.fit_batched(df, ["a", "b"], [2, 3, 4], n_init=5, seed=1)
    best = km.best_per_k(fits)
    assert len(fits) == 15
    assert best[2].inertia >= best[3].inertia >= best[4].inertia
    got = sorted(map(tuple, np.round(best[3].centers)))
    assert got == sorted(map(tuple, np.round(centers)))
    labels = df.select(km.assign(["a", "b"], best[3].centers).alias("c")).groupBy("c").count().collect()
    assert sorted(r["count"] for r in labels) == [200, 200, 200]
    # inertia reported by the passes equals the sum of squared distances to the assigned centers
    lab = np.argmin(((pts[:, None, :] - best[3].centers[None]) ** 2).sum(-1), 1)
    assert abs(best[3].inertia - ((pts - best[3].centers[lab]) ** 2).sum()) < 1e-6


def test_pca_cut_and_ratios_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) @ np.array([[3, 0, 0, 0], [1, 1, 0, 0], [0, 0, 0.3, 0], [0, 0, 0, 0.1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    ratios, _ = sg.fit_pca(df, ["a", "b", "c", "d"])
    xc = x - x.mean(0)
    sv = np.linalg.svd(xc, compute_uv=False) ** 2
    assert np.allclose(ratios, sv / sv.sum(), atol=1e-10)
    m = sg.n_components_for(ratios, 0.90)
    assert np.cumsum(ratios)[m - 1] > 0.90 and (m == 1 or np.cumsum(ratios)[m - 2] <= 0.90)


def test_exact_quantile_matches_numpy(spark):
    from skylane.operators.ranking import exact_quantile
    rng = np.random.default_rng(12)
    rows = [(int(g), float(v)) for g in range(3) for v in rng.normal(size=101 + 50 * g)] + [(3, 7.0), (3, 7.0), (4, 1.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    for q in (0.5, 0.99, 0.0, 0.25):
        got = {r["g"]: r["QUANTILE"] for r in exact_quantile(df, ["g"], "v", q, buckets=6).collect()}
        for g in range(5):
            vals = np.array([v for gg, v in rows if gg == g])
            want = np.median(vals) if q == 0.5 else np.quantile(vals, q)
            assert abs(got[g] - want) < 1e-12, (q, g)


def test_full_segmentation_invariants(spark, sf_small):
    from skylane.plans import segment as P
    travelers = P.travelers(spark, sf_small)
    n = travelers.count()
    res = sg.run_full_segmentation(travelers, k=None, n_init=3, k_values=range(2, 5))
    k_eval = res["k_evaluation"].orderBy("K").collect()
    best_k = [r["K"] for r in k_eval if r["BEST"]]
    assert len(best_k) == 1 and best_k[0] == max(k_eval, key=lambda r: (r["SILHOUETTE"], -r["K"]))["K"]
    inertia = [r["INERTIA"] for r in k_eval]
    assert inertia == sorted(inertia, reverse=True)
    prof = res["profiles"].collect()
    assert len(prof) == best_k[0] and sum(r["SIZE"] for r in prof) == n
    assert all(r["ARCHETYPE"] for r in prof)
    assert res["validation"].count() == len(sg.KW_METRICS)
    assert {r["ARCHETYPE"] for r in res["market_crosstab"].collect()} >= {"All"}
    assert res["recommendations"].count() == len(prof)


def test_kmeans_is_the_same_in_every_layout(spark):
    from skylane.operators import kmeans as km
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(400, 3)))], "id long, a double, b double, c double")
    fits = [km.fit_batched(df.repartition(n), ["a", "b", "c"], [4], n_init=2, seed=5, id_col="id") for n in (1, 4, 7)]
    for other in fits[1:]:
        for x, y in zip(fits[0], other):
            assert np.allclose(x.centers, y.centers, atol=1e-9) and abs(x.inertia - y.inertia) < 1e-6


def test_lexicon_of_any_size(spark):
    from skylane.operators import text as tx
    df = spark.createDataFrame([(1, 0, "p1 p2 n1 other"), (1, 1, "n3")], "PLACE_ID int, REVIEW_INDEX int, REVIEW_TEXT string").withColumn("MARKET", F.lit("m"))
    scored = tx.score_lexicon(df, [f"p{i}" for i in range(5000)], [f"n{i}" for i in range(5000)])
    got = tx.aggregate_sentiment(scored, "MARKET").first()
    assert got["AVG_COMPOUND"] == round((1 / 3 - 1) / 2, 3)


def _silhouette_by_pairs(x, label):
    far = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(label):
        mean = {c: far[i, label == c].sum() / ((label == c).sum() - (c == own) or 1) for c in np.unique(label)}
        b = min(v for c, v in mean.items() if c != own)
        out.append(0.0 if (label == own).sum() == 1 or max(mean[own], b) == 0 else (b - mean[own]) / max(mean[own], b))
    return float(np.mean(out))


def test_euclidean_silhouette(spark):
    from skylane.operators.silhouette import euclidean_silhouette
    rng = np.random.default_rng(5)
    n = 2400
    label = np.where(rng.random(n) < 0.5, 0, rng.integers(0, 3, n))  # one cluster holds two thirds
    x = rng.normal(size=(n, 3)) + label[:, None] * np.array([1.5, 0.5, 0.0])
    other = (x[:, 0] > 1).astype(int)
    other[7] = 9  # a cluster of one row
    rows = [(i, *map(float, v), int(a), int(b)) for i, (v, a, b) in enumerate(zip(x, label, other))]
    rows += [(n, 0.0, None, 0.0, 0, 0), (n + 1, 0.0, 0.0, 0.0, None, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, A int, B int").repartition(5)
    got = {r["LABELS"]: r for r in euclidean_silhouette(df, ["x", "y", "z"], ["A", "B"], "id").collect()}
    for c, want in (("A", _silhouette_by_pairs(x, label)), ("B", _silhouette_by_pairs(x, other))):
        assert got[c]["EXACT"] and got[c]["STD_ERROR"] == 0 and got[c]["N"] == n and abs(got[c]["SILHOUETTE"] - want) < 1e-12
    part = [tuple(r) for r in euclidean_silhouette(df, ["x", "y", "z"], ["A"], "id", 256).collect()]
    assert part[0][5] is False and 0 < part[0][4] < 0.02 and abs(part[0][3] - got["A"]["SILHOUETTE"]) < 4 * part[0][4] + 0.005
    assert abs(part[0][3] - euclidean_silhouette(df.repartition(2), ["x", "y", "z"], ["A"], "id", 256).first()["SILHOUETTE"]) < 1e-12
    assert euclidean_silhouette(df.withColumn("C", F.lit(1)), ["x", "y", "z"], ["C"], "id").first()["SILHOUETTE"] is None
    assert euclidean_silhouette(df.limit(0), ["x", "y", "z"], ["A"], "id").count() == 0


def test_silhouette_measures_every_pair(spark, monkeypatch):
    """No sample by default: clusters above any coreset's size are exact, also over several chunks of points and with missing labels."""
    from skylane.operators import silhouette as si
    rng = np.random.default_rng(15)
    n = 1500
    label, other = rng.integers(0, 2, n), np.where(rng.random(n) < 0.1, -1, rng.integers(0, 4, n))
    x = rng.normal(size=(n, 2)) + label[:, None]
    df = spark.createDataFrame([(i, *map(float, v), int(a), None if b < 0 else int(b)) for i, (v, a, b) in enumerate(zip(x, label, other))], "id long, x double, y double, A int, B int")
    for name, value in (("MOST_POINTS", 64), ("PER_CLUSTER", 64), ("CHUNK", 200), ("TASK_ROWS", 100)):
        monkeypatch.setattr(si, name, value, raising=False)
    got = {r["LABELS"]: r for r in si.euclidean_silhouette(df, ["x", "y"], ["A", "B"], "id").collect()}
    for c, at, want in (("A", np.ones(n, dtype=bool), label), ("B", other >= 0, other)):
        assert got[c]["EXACT"] and got[c]["N"] == at.sum() and abs(got[c]["SILHOUETTE"] - _silhouette_by_pairs(x[at], want[at])) < 1e-12


def test_silhouette_work_is_dealt_to_all_tasks(spark):
    """One file's rows must not be measured by one task; far from the origin, distances keep their digits."""
    from skylane.operators.silhouette import euclidean_silhouette
    rng = np.random.default_rng(8)
    label = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 2)) + label[:, None] + np.where(np.arange(300) % 2 == 0, 1e6, 0.0)[:, None]
    x[10:14] = x[9]  # copies
    df = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, label))], "id long, x double, y double, A int").coalesce(1)
    got = euclidean_silhouette(df, ["x", "y"], ["A"], "id")
    assert abs(got.first()["SILHOUETTE"] - _silhouette_by_pairs(x, label)) < 1e-9
    assert f"Repartition {spark.conf.get('spark.sql.shuffle.partitions')}, true" in got._jdf.queryExecution().optimizedPlan().toString()


def test_kmeans_passes_run_over_blocks(spark):
    """The frame is read for its variance and for packing, not once per center and iteration."""
    from skylane.operators import kmeans as km
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([tuple(map(float, p)) for p in rng.normal(size=(300, 2))], "a double, b double").repartition(2)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b
    fits = km.fit_batched(df.mapInPandas(counted, df.schema), ["a", "b"], [3], n_init=2, seed=1)
    assert fits[0].iterations > 2 and read.value == 600


def test_labels_of_several_models_in_one_pass(spark):
    from skylane.operators import kmeans as km
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([tuple(map(float, p)) for p in [*rng.normal(size=(200, 2)), (0, 0), (0, 0)]], "a double, b double")
    models = {"X": np.array([[1.0, 0.0], [-1.0, 0.0]]), "Y": rng.normal(size=(5, 2))}  # (0, 0) is as near to both of X
    got = km.label_rows(df, ["a", "b"], models)
    assert got.columns == ["a", "b", "X", "Y"]
    assert got.where((F.col("X") != km.assign(["a", "b"], models["X"])) | (F.col("Y") != km.assign(["a", "b"], models["Y"]))).isEmpty()


class _Local:
    """Blocks as an RDD has them, in this process."""

    def __init__(self, parts):
        self.parts = parts

    def mapPartitions(self, f):
        return _Local([list(f(iter(p))) for p in self.parts])

    def collect(self):
        return [x for p in self.parts for x in p]


def test_labels_leave_other_columns_as_they_are(spark):
    """Missing and very large whole numbers, texts and flags go through a labelling pass unchanged."""
    from skylane.operators import kmeans as km
    rows = [((1 << 60) + 1, None, "a", True, 0.0, [1, None]), (None, 7, None, None, 3.0, None), (-5, 8, "", False, 1.4, [])]
    df = spark.createDataFrame(rows, "id long, n int, s string, f boolean, x double, l array<int>")
    got = km.label_rows(df, ["x"], {"C": np.array([[0.0], [3.0]])}).collect()
    assert [tuple(r) for r in got] == [(*r, c) for r, c in zip(rows, (0, 1, 0))]


def test_kmeans_labels_are_no_column_expression(spark):
    """The labels of ``run_kmeans`` are computed in arrays, not by a fold over literal centers for every row; rows keep their columns."""
    from skylane.operators import kmeans as km
    rng = np.random.default_rng(23)
    df = spark.createDataFrame([(i if i % 5 else None, *map(float, v)) for i, v in enumerate(rng.normal(size=(120, 2)))], "GIVEN long, A double, B double")
    real, used = km.assign, []
    km.assign = lambda *a: used.append(1) or real(*a)
    try:
        out = sg.run_kmeans(df, 2, ["A", "B"], n_init=2)
    finally:
        km.assign = real
    assert not used and out.columns == ["GIVEN", "A", "B", "CLUSTER", "PCA_1", "PCA_2"]
    assert sorted((r["A"], r["GIVEN"]) for r in out.collect()) == sorted((r["A"], r["GIVEN"]) for r in df.collect())


def _local_blocks(ids, x):
    third = len(ids) // 3
    return _Local([[(ids[:100], x[:, :100]), (ids[100:third], x[:, 100:third])], [(ids[third:], x[:, third:])], []])


def test_seeding_equals_the_plain_keys_and_takes_few_logarithms(monkeypatch):
    from skylane.operators import kmeans as km
    rng = np.random.default_rng(21)
    n, word = 3000, (1 << 64) - 1
    ids = rng.integers(0, 1 << 63, n).astype(np.uint64)
    x = rng.normal(size=(3, n)) + 50.0
    x[:, 500:1500] = x[:, :1000]  # copies of rows: a chosen one must not come again

    def mixed(v):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            v = (v ^ (v >> shift)) * factor & word
        return v

    def plain(mid, centers, step):
        salt = mixed(mixed(mixed(8) + mid + 1 & word) + step + 1 & word)
        u = np.array([((mixed(mixed(int(i)) ^ salt) >> 11) + 0.5) * 2.0 ** -53 for i in ids])
        if not len(centers):
            return x[:, np.log(u).argmax()]
        d2 = np.min([((x - c[:, None]) ** 2).sum(axis=0) for c in centers], axis=0)
        with np.errstate(divide="ignore"):
            return x[:, np.where(d2 > 0, np.log(u) / d2, -np.inf).argmax()]

    blocks, real, taken = _local_blocks(ids, x), np.log, []
    models = {m: np.zeros((0, 3)) for m in (0, 3, 4)}
    for step in range(4):
        want = {m: plain(m, c, step) for m, c in models.items()}
        with monkeypatch.context() as here:
            here.setattr(np, "log", lambda v, *a, **k: taken.append(np.size(v)) or real(v, *a, **k))
            got = km._seed_pass(blocks, list(models.items()), step, 7)
        assert all(np.array_equal(got[m], want[m]) for m in models)
        models = {m: np.vstack([c, want[m][None]]) for m, c in models.items()}
    assert sum(taken) < 0.6 * 4 * 3 * n


def test_lloyd_sums_with_ties_go_to_the_first_center():
    from skylane.operators import kmeans as km
    rng = np.random.default_rng(22)
    x = rng.integers(-2, 3, size=(2, 1500)).astype(float)  # many rows as near to several centers
    models = [(0, np.array([[1.0, 0.0], [-1.0, 0.0]])), (1, np.array([[0.0, 1.0], [0.0, 1.0]])), (2, rng.normal(size=(3, 2))), (5, np.array([[0.0, 0.0], [2.0, 0.0], [0.0, 2.0]]))]
    got = km._lloyd_pass(_local_blocks(np.arange(1500).astype(np.uint64), x), models)
    for mid, centers in models:
        d2 = ((x[None] - centers[:, :, None]) ** 2).sum(axis=1)
        label = d2.argmin(axis=0)
        count, sums, cost = got[mid]
        assert list(count) == [(label == k).sum() for k in range(len(centers))] and abs(cost - d2.min(axis=0).sum()) < 1e-8
        assert np.allclose(sums, [x[:, label == k].sum(axis=1) for k in range(len(centers))])
