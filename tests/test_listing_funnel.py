"""Listing enrichment and funnel edges."""

from pyspark.sql import functions as F

from skylane.operators import funnel as fn
from skylane.operators import listing as ls

SCHEMA = "PLACE_ID long, MARKET string, RATING double, TOTAL_RATINGS long, PRICE_LEVEL double, NUM_PHOTOS long, BUSINESS_STATUS string"


def test_prepare_listings_edges(spark):
    rows = [(1, None, 4.0, 20, 2.0, 3, "OPERATIONAL"),      # null market -> visibility 0
            (2, "A", 4.5, 10, 1.0, 0, None),               # null status -> not bookable
            (3, "A", 3.5, 9, 4.0, 2, ""),                  # '' status bookable only with >= 10 ratings
            (4, "A", None, 100, 2.5, 4, "OPERATIONAL"),    # unrated, unknown tier
            (5, "B", 4.0, 0, None, 0, "OPERATIONAL"),      # market with all-zero ratings and photos
            (6, "B", 3.4, 0, 3.0, 0, "OPERATIONAL")]
    out = {r["PLACE_ID"]: r for r in ls.prepare_listings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1]["VISIBILITY_SCORE"] == 0.0
    assert out[2]["IS_BOOKABLE"] is False and out[3]["IS_BOOKABLE"] is False
    assert [out[i]["RATING_TIER"] for i in (2, 3, 4, 5, 6)] == ["Excellent", "Average", "Unrated", "Good", "Low"]
    assert [out[i]["PRICE_TIER"] for i in (2, 3, 4, 5)] == ["Budget", "Luxury", "Unknown", "Unknown"]
    assert out[5]["VISIBILITY_SCORE"] == 28.0  # 0.35 * 4/5 * 100 with p99 and max replaced by 1
    import numpy as np
    a = np.array([10, 9, 100], dtype=float)
    p99 = np.quantile(a, 0.99)
    want = round((0.5 * min(10 / p99, 1) + 0.35 * 4.5 / 5 + 0.15 * 0) * 100, 1)
    assert out[2]["VISIBILITY_SCORE"] == want


def test_trust_quadrant_missing_rating_is_low_signal(spark):
    rows = [(1, "A", 4.0, 10, 1.0, 0, ""), (2, "A", 5.0, 30, 1.0, 0, ""), (3, "A", None, 50, 1.0, 0, ""),
            (4, "A", 3.0, 5, 1.0, 0, "")]
    out = {r["PLACE_ID"]: r["TRUST_QUADRANT"] for r in ls.trust_quadrant(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: "🔍 Hidden Gem", 2: "⭐ Star Performer", 3: "❌ Low Signal", 4: "❌ Low Signal"}


def test_funnel_zero_stage_dropoff_is_missing(spark):
    sums = spark.createDataFrame([("M", 10, 0, 0, 0, 0)], "MARKET string, _s0 long, _s1 long, _s2 long, _s3 long, _s4 long")
    rows = fn._stage_table(sums, "MARKET", fn.STAGE_LABELS, "VISITORS").orderBy("STAGE_NO").collect()
    assert rows[0]["DROP_OFF_PCT"] is None and rows[1]["DROP_OFF_PCT"] == 100.0
    assert rows[2]["DROP_OFF_PCT"] is None and rows[4]["OVERALL_CONVERSION_PCT"] == 0.0


def test_event_funnel_requires_time_order(spark):
    ev = spark.createDataFrame([
        (1, "2020-01-01 10:00:00", "view"), (1, "2020-01-01 10:01:00", "click"), (1, "2020-01-01 10:02:00", "signup"),
        (2, "2020-01-01 10:05:00", "click"), (2, "2020-01-01 10:06:00", "view"),   # click before view: not counted
        (3, "2020-01-01 23:59:00", "view"), (3, "2020-01-02 00:01:00", "click"),  # next day: separate entity-day
    ], "user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    rows = {r["STAGE"]: r["ENTITY_DAYS"] for r in fn.event_funnel(ev).collect()}
    assert rows == {"view": 3, "click": 1, "signup": 1, "purchase": 0}


def test_event_funnel_by_market_and_diagnosis(spark):
    ev = spark.createDataFrame([
        (1, "2020-01-01 10:00:00", "view", "Dubai"), (1, "2020-01-01 10:01:00", "click", "Dubai"), (2, "2020-01-01 10:05:00", "view", "Dubai"),
        (3, "2020-01-01 09:00:00", "view", "NYC"), (3, "2020-01-01 09:01:00", "click", "NYC"), (3, "2020-01-01 09:02:00", "signup", "NYC"),
    ], "user_id long, ts string, event_type string, MARKET string").withColumn("ts", F.to_timestamp("ts"))
    summary = fn.event_funnel_by_market(ev)
    rows = {(r["MARKET"], r["STAGE"]): (r["VISITORS"], r["DROP_OFF_PCT"]) for r in summary.collect()}
    assert rows["Dubai", "Search"] == (2, None) and rows["Dubai", "View"] == (1, 50.0) and rows["NYC", "Intent"] == (1, 0.0)
    diag = {r["STAGE"]: r["WORSE_MARKET"] for r in fn.dropoff_diagnosis(summary, "Dubai", "NYC").collect()}
    assert diag["View"] == "Dubai" and diag["Search"] == "NYC"  # missing gap -> second market


def test_attach_salted_beyond_the_broadcast_size(spark, monkeypatch):
    from skylane.operators import common
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(50)], "k int, v int")
    out = common.attach(df, df.groupBy("k").agg(F.sum("v").alias("s")), ["k"], "left").collect()
    want = {k: sum(i for i in range(50) if i % 7 and i % 3 == k) for k in range(3)}
    assert len(out) == 50 and all(r["s"] == want.get(r["k"]) for r in out)
