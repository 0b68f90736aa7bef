"""Sources and sinks: format order, candidate paths, schema guards, rename-if-present, payload parsing."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from skylane.sources import io
from skylane.sources import landing as ld


def test_load_prefers_parquet_then_csv(spark):
    base = tempfile.mkdtemp(prefix="skylane-io-")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    io.write_table(df, os.path.join(base, "t.csv"), fmt="csv")
    assert sorted(r["v"] for r in io.load_table(spark, base, "t").collect()) == ["a", "b"]   # CSV only
    io.write_table(df.withColumn("v", F.upper("v")), os.path.join(base, "t.parquet"))
    assert sorted(r["v"] for r in io.load_table(spark, base, "t").collect()) == ["A", "B"]   # parquet wins
    with pytest.raises(io.MissingInputError, match="missing.parquet.*missing.csv"):
        io.load_table(spark, base, "missing")


def test_partitioned_sink_prunes(spark):
    base = tempfile.mkdtemp(prefix="skylane-io-")
    df = spark.createDataFrame([(1, "Dubai"), (2, "NYC"), (3, "NYC")], "id long, MARKET string")
    io.write_table(df, os.path.join(base, "p"), partition_by=["MARKET"])
    back = spark.read.parquet(os.path.join(base, "p")).filter(F.col("MARKET") == "NYC")
    assert back.count() == 2
    assert "PartitionFilters: [isnotnull(MARKET" in back._jdf.queryExecution().executedPlan().toString()


def test_guards_and_renames(spark):
    df = spark.createDataFrame([(1, 2)], "DATE int, y int")
    with pytest.raises(io.SchemaError, match="EST_PASSENGERS"):
        io.require_columns(df, ["DATE", "EST_PASSENGERS"])
    out = io.rename_if_present(df, {"DATE": "ds", "y": "DATE", "missing": "z"})
    assert out.columns == ["ds", "y"]   # 'y' not renamed: its target name 'DATE' existed before
    with pytest.raises(io.SchemaError):
        io.require_nonempty(df.filter(F.lit(False)))
    assert io.first_present(df, ["x", "y", "DATE"]) == "y"


def test_place_payload_defaults_and_first_seen(spark):
    rows = [(1, 5, '{"place_id": "a", "name": "A", "types": ["x", "y"], "geometry": {"location": {"lat": 1.5, "lng": 2.5}}}'),
            (0, 9, '{"place_id": "a", "name": "A-late"}'),
            (0, 3, '{"place_id": "b"}'),
            (0, 1, '{"name": "no id"}')]
    df = spark.createDataFrame(rows, "QUERY_IDX int, POS long, payload string")
    parsed = ld.parse(df, "payload", ld.PLACE_SCHEMA).withColumn("K", F.col("p.place_id"))
    first = ld.dedup_first_seen(parsed, "K", ["QUERY_IDX", "POS"])
    flat = {r["PLACE_ID"]: r for r in ld.flatten_places(first, "Dubai").collect()}
    assert set(flat) == {"a", "b"}
    assert flat["a"]["NAME"] == "A-late" and flat["a"]["LAT"] is None and flat["a"]["TYPES"] == ""
    assert flat["b"]["NAME"] == "" and flat["b"]["TOTAL_RATINGS"] == 0 and flat["b"]["BUSINESS_STATUS"] == ""
    assert len(flat["a"]) == len(ld.LISTING_COLUMNS)


def test_detail_rollup_and_routes(spark):
    details = spark.createDataFrame([
        ('{"place_id": "a", "reviews": [{"rating": 4, "text": "ok"}, {"text": "x"}, {"rating": 5, "text": ""}], "photos": [{}, {}]}',),
        ('{"place_id": "b", "opening_hours": {"open_now": true}}',)], "payload string")
    r = {x["PLACE_ID"]: x for x in ld.detail_rollup(ld.parse(details, "payload", ld.DETAIL_SCHEMA, "d")).collect()}
    assert r["a"]["AVG_REVIEW_RATING"] == 3.0 and r["a"]["REVIEW_TEXTS"] == "ok ||| x" and r["a"]["NUM_PHOTOS"] == 2
    assert r["b"]["NUM_REVIEWS_FETCHED"] == 0 and r["b"]["OPEN_NOW"] is True and r["b"]["AVG_REVIEW_RATING"] is None
    routes = spark.createDataFrame([("JFK", "DXB"), ("EWR", "DXB"), ("JFK", "LHR")], "`from` string, `to` string")
    assert ld.filter_routes(routes, ["JFK"], "DXB").count() == 1
    assert ld.filter_routes(routes.toDF("a", "b"), ["JFK"], "DXB").count() == 3   # no known columns: unfiltered


def test_landed_csv_with_timestamp_format(spark):
    base = tempfile.mkdtemp(prefix="skylane-io-")
    with open(os.path.join(base, "trends.csv"), "w") as fh:
        fh.write("DATE,kw\n03/01/2024 10:00,5\n04/01/2024 11:30,7\n")
    df = io.load_table(spark, base, "trends", formats=("csv",), schema="DATE timestamp, kw int",
                       options={"timestampFormat": "dd/MM/yyyy HH:mm"})
    rows = df.orderBy("DATE").collect()
    assert [(r["DATE"].day, r["DATE"].month, r["kw"]) for r in rows] == [(3, 1, 5), (4, 1, 7)]


def test_unreadable_candidate_falls_back_and_is_listed(spark):
    base = tempfile.mkdtemp(prefix="skylane-io-")
    with open(os.path.join(base, "t.parquet"), "wb") as fh:
        fh.write(b"not parquet at all")
    with pytest.raises(io.MissingInputError, match="t.parquet.*t.csv"):
        io.load_table(spark, base, "t")
    spark.createDataFrame([(1, "a")], "id long, v string").write.option("header", True).csv(os.path.join(base, "t.csv"))
    assert io.load_table(spark, base, "t").collect()[0]["v"] == "a"


def test_landed_csv_pair_and_trend_rows(spark):
    base = tempfile.mkdtemp(prefix="skylane-io-")
    df = spark.createDataFrame([("2024-01-07 00:00:00", 5, False), ("2024-01-14 00:00:00", None, True)], "date string, kw int, isPartial boolean") \
        .withColumn("date", F.to_timestamp("date"))
    io.save_landed_csv(df, os.path.join(base, "c"))
    back = io.load_landed_csv(spark, os.path.join(base, "c"), "date timestamp, kw int, isPartial boolean")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert ld.trend_rows(back).columns == ["DATE", "kw"]


def test_enrich_if_missing(spark):
    df = spark.range(2)
    grown = io.enrich_if_missing(df, ["x"], lambda d: d.withColumn("x", F.lit(1)))
    assert grown.columns == ["id", "x"] and io.enrich_if_missing(grown, ["x"], lambda d: d.drop("id")).columns == ["id", "x"]
