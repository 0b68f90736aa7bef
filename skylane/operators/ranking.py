"""Distributed row positions and tie-averaged ranks (used by G6 and H13).

Neither helper uses an unpartitioned window (which would pull every row into
one task):

* ``global_position`` range-partitions on the ordering key, sorts within
  partitions and checkpoints once (fixes the sampled range bounds so the
  per-partition counts and the numbering see the same layout). Offsets are
  one row per partition; the in-partition index comes from
  ``monotonically_increasing_id`` on the checkpointed, sorted partitions.
* ``average_ranks`` never ranks rows: it ranks *distinct values* after a
  ``groupBy(key, value)`` pre-aggregation and a running sum per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import attach

_PART_SHIFT = 1 << 33  # monotonically_increasing_id = partition_index << 33 | row_index


def bucket_of(bounds: str, value: str, n_bounds: int) -> Column:
    """Number of entries of the ascending array ``bounds`` smaller than ``value`` (binary search).

    Folded with ``aggregate`` over ceil(log2(n + 1)) steps, so routing a row to
    one of many quantile buckets costs O(log n), not a scan of the bounds.
    """
    steps = max(1, int(n_bounds).bit_length())
    b, v = F.col(bounds), F.col(value)
    init = F.struct(F.lit(0).alias("lo"), F.size(b).alias("hi"))

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        below = F.element_at(b, mid + 1) < v
        return F.when(lo < hi, F.when(below, F.struct((mid + 1).alias("lo"), hi.alias("hi")))
                      .otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda acc: acc["lo"])


def global_position(df: DataFrame, order_cols: Sequence[str], pos_col: str = "pos",
                    num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Attach a 1-based position in ``order_cols`` order; returns (frame, row count).

    ``order_cols`` should make the order total (add a tie-break column).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(parts, *order_cols)
                .sortWithinPartitions(*order_cols)
                .checkpoint(eager=True))
    tagged = ranged.withColumn("_pid", F.spark_partition_id()) \
                   .withColumn("_local", F.monotonically_increasing_id() - F.spark_partition_id().cast("long") * _PART_SHIFT)
    # one row per partition: a bounded, driver-sized result
    counts = sorted((r["_pid"], r["count"]) for r in tagged.groupBy("_pid").count().collect())
    offsets, running = [], 0
    for pid, c in counts:
        offsets.append((pid, running))
        running += c
    if running == 0:
        return tagged.withColumn(pos_col, F.lit(None).cast("long")).drop("_pid", "_local"), 0
    off = spark.createDataFrame(offsets, "_pid int, _off long")
    out = tagged.join(F.broadcast(off), "_pid") \
                .withColumn(pos_col, F.col("_off") + F.col("_local") + 1) \
                .drop("_pid", "_local", "_off")
    return out, running


def average_ranks(df: DataFrame, keys: Sequence[str], value_col: str, group_col: str,
                  buckets: int | None = None) -> DataFrame:
    """Tie-averaged rank of every (key, value) with per-(key, value, group) counts.

    Output: keys..., value, group, cnt (rows of that group at that value),
    t (rows at that value in the key), rank (average rank of the value).

    Ranks need, per distinct value, the number of rows with smaller values in
    the same key -- a prefix sum. Rather than one window over all distinct
    values of a key (a single task per key), distinct values are split into
    ``buckets`` approximate-quantile ranges: bucket totals get a prefix over at
    most ``buckets`` rows per key, and the exact within-bucket prefix runs on
    one window partition per (key, bucket). Approximate bounds only balance
    the work; the ranks are exact.
    """
    spark = df.sparkSession
    nb = buckets or max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    per_group = df.groupBy(*keys, value_col, group_col).agg(F.count(F.lit(1)).alias("cnt"))
    # a value carries its groups' counts along (one entry per group), so nothing is joined back to them
    per_value = per_group.groupBy(*keys, value_col).agg(
        F.sum("cnt").alias("t"), F.collect_list(F.struct(F.col(group_col).alias("g"), "cnt")).alias("_groups"))
    ensure_checkpoint_dir(spark)
    per_value = per_value.checkpoint()  # read for the bounds, the bucket totals and the ranks
    if nb > 1:
        probs = [i / nb for i in range(1, nb)]
        bounds = per_value.groupBy(*keys).agg(F.percentile_approx(value_col, probs).alias("_bounds"))
        per_value = attach(per_value, bounds, keys)
        per_value = per_value.withColumn("_b", bucket_of("_bounds", value_col, nb - 1)).drop("_bounds")
    else:
        per_value = per_value.withColumn("_b", F.lit(0))
    totals = per_value.groupBy(*keys, "_b").agg(F.sum("t").alias("_bt"))  # at most ``buckets`` rows per key
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_boff", F.coalesce(F.sum("_bt").over(wk), F.lit(0))).drop("_bt")
    wv = Window.partitionBy(*keys, "_b").orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (per_value.join(totals, [*keys, "_b"])
              .withColumn("_before", F.col("_boff") + F.coalesce(F.sum("t").over(wv), F.lit(0)))
              .withColumn("rank", F.col("_before") + (F.col("t") + 1) / F.lit(2.0))
              .drop("_before", "_boff", "_b"))
    return (ranked.withColumn("_g", F.explode("_groups"))
            .select(*keys, value_col, F.col("_g.g").alias(group_col), F.col("_g.cnt").alias("cnt"), "t", "rank"))


def exact_quantile(df: DataFrame, keys: Sequence[str], value_col: str, q: float = 0.5,
                   buckets: int | None = None, out_col: str = "QUANTILE") -> DataFrame:
    """Exact linear-interpolation quantile per key without holding a key's values in one buffer.

    ``percentile``/``median`` keep every distinct value of a group in one
    aggregation buffer -- unbounded for continuous values in a hot group.
    Here distinct values with their counts are routed into approximate-quantile buckets, per-bucket counts
    locate the bucket holding the target ranks, and only the values of those (at
    most two) buckets per key are ordered. With ``q = 0.5`` and an even count
    the result is the mean of the two middle values, as ``numpy.median``.
    """
    spark = df.sparkSession
    nb = buckets or max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = (df.select(*keys, F.col(value_col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
         .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m")))  # one row per value, however many rows hold it
    if nb > 1:
        bounds = x.groupBy(*keys).agg(F.percentile_approx("_v", [i / nb for i in range(1, nb)]).alias("_bounds"))
        x = attach(x, bounds, keys).withColumn("_b", bucket_of("_bounds", "_v", nb - 1)).drop("_bounds")
    else:
        x = x.withColumn("_b", F.lit(0))
    per_b = x.groupBy(*keys, "_b").agg(F.sum("_m").alias("_c"))
    wk = Window.partitionBy(*keys).orderBy("_b")
    per_b = (per_b.withColumn("_start", F.coalesce(F.sum("_c").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                  .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys))))
    pos = F.lit(q) * (F.col("_n") - 1)
    per_b = per_b.withColumns({"_lo": F.floor(pos).cast("long"), "_frac": pos - F.floor(pos)}) \
                 .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
    in_b = lambda r: (F.col(r) >= F.col("_start")) & (F.col(r) < F.col("_start") + F.col("_c"))
    targets = per_b.filter(in_b("_lo") | in_b("_hi")).select(*keys, "_b", "_start", "_lo", "_hi", "_frac")
    rows = x.join(targets, [*keys, "_b"])
    upto = F.col("_start") + F.sum("_m").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_upto", upto)
    holds = lambda r: (F.col("_upto") > F.col(r)) & (F.col("_upto") - F.col("_m") <= F.col(r))
    out = placed.filter(holds("_lo") | holds("_hi")).groupBy(*keys).agg(
        F.max(F.when(holds("_lo"), F.col("_v"))).alias("_a"), F.max(F.when(holds("_hi"), F.col("_v"))).alias("_z"), F.first("_frac").alias("_frac"))
    val = F.when(F.col("_frac") == 0.5, (F.col("_a") + F.col("_z")) / 2) \
           .otherwise(F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_frac"))
    return out.select(*keys, val.alias(out_col))
