"""Sharding: minimax contiguous partition of the corpus (DataFrame functions only).

Equal texts are one atomic group. Groups lie in the order of their SHA-256; the cut into contiguous shards with the
smallest possible largest shard is found by a binary search over the shard capacity, each capacity checked greedily:
from the last cut, the shard takes groups while their sizes fit. A pass over the group table answers one greedy step of
many capacities at once, so several halvings of the search cost one round of passes.

Prefix sums need no global sort: the first bits of the digest name a bucket, bucket totals (a bounded table) are summed
first, groups are summed inside their bucket. A document's slot is counted per (shard, hash of doc_id), so copies of
one text spread over many tasks.

Results in special cases: a null text counts as empty (size 1) and shares the group of the empty texts; repeated rows get
a slot each; fewer groups than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 8
#: Buckets of digests for the prefix sums, cells of ids for the slots, capacities tried in one round of passes.
BUCKETS = 4096
CELLS = 256
PROBES = 31


def _group_sums(rows: DataFrame) -> DataFrame:
    """(digest, size, upto): groups in digest order with the sum of sizes up to and with the group."""
    bucket = F.conv(F.substring(F.hex("digest"), 1, 3), 16, 10).cast("int")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size")).withColumn("bucket", bucket)
    groups = stored(groups, "groups")
    totals = groups.groupBy("bucket").agg(F.sum("size").alias("total"))
    before = totals.select("bucket", (F.sum("total").over(Window.orderBy("bucket")) - F.col("total")).alias("before"))
    inside = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    return (groups.join(F.broadcast(before), "bucket")
            .select("bucket", "digest", "size", (F.col("before") + F.sum("size").over(inside)).alias("upto")))


def _steps(sums: DataFrame, largest: int, starts: list[int], capacities: list[int]) -> list[int]:
    """Per capacity, the end of the shard that starts at ``starts``: the largest prefix sum that still fits."""
    reach = [s + c for s, c in zip(starts, capacities)]
    near = sums.where((F.col("upto") > min(reach) - largest) & (F.col("upto") <= max(reach)))
    row = near.agg(*[F.max(F.when(F.col("upto") <= t, F.col("upto"))).alias(f"e{i}") for i, t in enumerate(reach)]).first()
    return [s if e is None else max(s, e) for s, e in zip(starts, row)]


def _cuts(sums: DataFrame, capacities: list[int], total: int, largest: int, shards: int) -> list[list[int]]:
    """Per capacity, the prefix sums at which its greedy shards end (``shards`` of them)."""
    ends = [[0] for _ in capacities]
    for _ in range(shards):
        step = _steps(sums, largest, [e[-1] for e in ends], capacities)
        for e, x in zip(ends, step):
            e.append(x)
        if all(e[-1] == total for e in ends):
            break
    return [e[1:] + [total if e[-1] == total else -1] * (shards + 1 - len(e)) for e in ends]


def minimax_cuts(sums: DataFrame, shards: int = SHARDS, probes: int = PROBES) -> tuple[list[int], int]:
    """The prefix sums that end the shards of the best contiguous partition, and its capacity."""
    total, largest = sums.agg(F.max("upto"), F.max("size")).first()
    if total is None:
        return [], 0
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest  # high is always feasible
    best = None
    while best is None or low < high:
        step = max(1, (high - low) // (probes + 1))
        tried = sorted({min(high, low + k * step) for k in range(probes + 1)} | {high} if best is None
                       else {low + k * step for k in range(probes + 1) if low + k * step < high})
        found = _cuts(sums, tried, total, largest, shards)
        for c, ends in zip(tried, found):
            if ends[-1] == total:
                best, high = ends, c
                break
            low = c + 1
    return best, high


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``) for every document."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(t) + F.lit(1)).cast("long").alias("size"),
                              F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("digest")), "rows")
    sums = stored(_group_sums(rows).repartitionByRange("bucket").sortWithinPartitions("bucket", "digest"), "sums")
    ends, _ = minimax_cuts(sums, shards)
    inner = sorted(set(ends[:-1]))
    first = {r["upto"]: bytes(r["digest"]) for r in sums.where(F.col("upto").isin(inner)).collect()} if inner else {}
    last = [first[e] for e in ends[:-1] if e in first]  # at most shards - 1 digests
    number = sum(((F.col("digest") > F.lit(d)).cast("int") for d in last), F.lit(0))
    placed = rows.withColumns({"shard": number, "cell": F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))})
    cells = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))  # shards x CELLS rows
    before = cells.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell"))
                                            - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "digest"))
    return (placed.withColumn("rank", rank).join(F.broadcast(before), ["shard", "cell"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
