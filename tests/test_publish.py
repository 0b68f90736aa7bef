"""Published tables (hot partitions split, read back, former run kept) and candidates that are read before they are used."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from skylane.sources import io
from skylane.sources import publish as pb

SCHEMA = StructType([StructField("id", LongType()), StructField("v", DoubleType()), StructField("name", StringType())])


def _new():
    return tempfile.mkdtemp(prefix="skylane-publish-")


def test_hot_partition_becomes_several_files_and_comes_back_whole(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("m"), F.col("id") % 40)).alias("market"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    path = _new()
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100KB")
    try:
        run = pb.publish_table(df, path, ["market"], rows_per_file=4_000)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(glob.glob(f"{path}/data/{run}/market=hot/*.parquet")) >= 3
    cold = [len(glob.glob(f"{path}/data/{run}/market=m{i}/*.parquet")) for i in range(40)]
    assert sorted(cold)[20] <= 2                                       # those beside the hot value are split with it
    back = pb.read_published(spark, path, df.schema)
    assert back.exceptAll(df).count() == 0 and back.count() == 30_000
    assert back.where("market is null").count() == df.where("market is null").count() > 0
    assert "PartitionFilters: [isnotnull(market" in back.where("market = 'hot'")._jdf.queryExecution().executedPlan().toString()


def test_a_run_that_fails_leaves_the_former_one(spark, monkeypatch):
    path, df = _new(), spark.range(100).withColumn("k", F.col("id") % 3)
    with pytest.raises(Exception):
        pb.read_published(spark, path, df.schema)
    pb.publish_table(df, path, ["k"])
    with monkeypatch.context() as m, pytest.raises(pb.PublishError):
        m.setattr(pb, "_read_run", lambda *a: df.where("id <> 7"))                           # a file was lost
        pb.publish_table(df, path, ["k"])
    broken = df.withColumn("id", F.when(F.col("id") == 50, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        pb.publish_table(broken, path, ["k"])
    assert pb.read_published(spark, path, df.schema).exceptAll(df).count() == 0
    pb.publish_table(df.limit(0), path)
    assert pb.read_published(spark, path, df.schema).count() == 0 and pb.published_runs(spark, path).count() == 2


def test_damaged_page_falls_to_the_next_candidate(spark):
    base = _new()
    df = spark.range(50_000).select("id", F.rand(1).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("name"))
    df.coalesce(1).write.parquet(f"{base}/bad.parquet")
    df.write.parquet(f"{base}/good.parquet")
    part = glob.glob(f"{base}/bad.parquet/part-*.parquet")[0]
    os.remove(os.path.join(base, "bad.parquet", "." + os.path.basename(part) + ".crc"))
    with open(part, "r+b") as f:
        f.seek(os.path.getsize(part) // 2)
        f.write(b"\xff" * 4096)
    assert io.load_first(spark, [f"{base}/bad.parquet"]).columns == ["id", "v", "name"]        # its footer is sound
    got = pb.load_first_checked(spark, [f"{base}/missing.parquet", f"{base}/bad.parquet", f"{base}/good.parquet"], SCHEMA)
    assert got.path.endswith("good.parquet") and got.n_rows == 50_000 and len(got.tried) == 2
    with pytest.raises(io.MissingInputError, match="missing.parquet.*bad.parquet"):
        pb.load_first_checked(spark, [f"{base}/missing.parquet", f"{base}/bad.parquet"], SCHEMA)


def test_broken_rows_are_set_aside(spark):
    base = _new()
    lines = ["id,v,name", "1,2.5,a", "x,2.5,b", "3,,", "4,1.0,\"c,d\"", "5,zz,e"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{base}/t.csv")
    with pytest.raises(io.MissingInputError, match="2 of 5 rows broken"):
        pb.load_first_checked(spark, [f"{base}/t.csv"], SCHEMA)
    got = pb.load_first_checked(spark, [f"{base}/t.csv"], SCHEMA, max_reject_share=0.4)
    assert sorted(map(tuple, got.rows.collect())) == [(1, 2.5, "a"), (3, None, None), (4, 1.0, "c,d")]
    assert sorted(r["LINE"] for r in got.rejects.collect()) == ["5,zz,e", "x,2.5,b"]
    assert got.rows.select("name").count() == 3                                               # pruned columns change nothing
    spark.createDataFrame([('{"id": 1, "v": 1.0}',), ('{"id": "q"',)], "value string").write.text(f"{base}/t.json")
    assert (lambda c: (c.n_rows, c.n_rejects))(pb.load_first_checked(spark, [f"{base}/t.json"], SCHEMA, 0.5)) == (1, 1)
    spark.createDataFrame([], "value string").write.text(f"{base}/empty.csv")
    with pytest.raises(io.MissingInputError):
        pb.load_first_checked(spark, [f"{base}/empty.csv"], SCHEMA)
