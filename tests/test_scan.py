"""Scans of long series in parts against pandas, with a hot key, null keys and gaps longer than a part."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylane.operators import cleaning as cl
from skylane.operators import demand as dm
from skylane.operators import scan

SCHEMA = "k string, t long, id long, v double, w double"


def series(n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.choice(["a"] * 6 + ["b", "c", None, ""])  # one series holds most rows
        v = rng.gauss(0, 1) if rng.random() < 0.15 else None
        rows.append((k, rng.randrange(n // 3), i, v, rng.gauss(0, 1)))
    return [(k, t, i, None if 250 < t < 290 else v, w) for k, t, i, v, w in rows]  # a gap longer than a part


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("parts", [1, 8, 60])
def test_fills_agree_with_pandas(spark, keys, parts):
    rows = series()
    want = pd.DataFrame(rows, columns=["k", "t", "id", "v", "w"]).sort_values(["t", "id"])
    g = want.assign(k=want["k"].fillna("none")).groupby("k")["v"] if keys else want["v"]
    limited, full = g.ffill(limit=2), g.ffill()
    both = full.groupby(want["k"].fillna("none")).bfill() if keys else full.bfill()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)

    def by_id(frame):
        got = {r["id"]: r["v"] for r in frame.collect()}
        return [got[i] for i in want["id"]]

    def same(got, expected):
        assert [None if pd.isna(x) else x for x in expected] == got
    same(by_id(scan.windowed(df, ["t", "id"], 2, lambda w: {"v": F.last("v", ignorenulls=True).over(w.rowsBetween(-2, 0))}, keys, parts)), limited)
    same(by_id(scan.filled(df, ["t", "id"], ["v"], keys, False, parts)), full)
    filled = scan.filled(df, ["t", "id"], ["v"], keys, True, parts)
    assert filled.columns == df.columns
    same(by_id(filled), both)


def test_long_operators_equal_the_short_ones(spark):
    df = spark.createDataFrame(series(), SCHEMA).where("k is not null").withColumn("t", F.col("t") * 1000 + F.col("id"))  # no ties
    for keys in ([], ["k"]):
        def rows(frame):
            return sorted((tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.collect()), key=repr)
        for make in (lambda long: cl.ffill(df, "t", ["v"], 3, keys, long), lambda long: cl.ffill(df, "t", ["v"], None, keys, long),
                     lambda long: cl.ffill_bfill(df, "t", ["v", "w"], keys, long), lambda long: dm.detect_spikes(df, "w", "t", 1.2, keys=keys, long=long),
                     lambda long: dm.lag_correlation(df, "w", "w", "t", 4, keys=keys, long=long)):
            assert rows(make(True)) == rows(make(False))
    empty = df.limit(0)
    assert cl.ffill_bfill(empty, "t", ["v"], long=True).count() == 0 and dm.detect_spikes(empty, "w", "t", long=True).count() == 0


def test_no_task_holds_a_series(spark):
    """The rows of one series lie in windows of at most a part and the rows carried into it."""
    df = spark.range(8000).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.lit(1.0).alias("v"))
    seen = scan.windowed(df, ["t"], 5, lambda w: {"n": F.count(F.lit(1)).over(w.rowsBetween(-(1 << 30), 1 << 30))}, ["k"], 8)
    assert seen.agg(F.max("n")).first()[0] == 1005


def test_fills_look_ahead_in_one_pass(spark):
    """A frame up to the last row is read to its end for every row: the fills must not use one."""
    df = spark.createDataFrame(series(), SCHEMA)
    for frame in (cl.ffill_bfill(df, "t", ["v"], ["k"]), cl.ffill_bfill(df, "t", ["v"], long=True, ties=["id"]), cl.ffill_bfill(df, "t", ["v"], ["k"], True, ["id"])):
        plan = frame._jdf.queryExecution().toString().lower()
        assert "windowframe" in plan and "unboundedfollowing" not in plan
