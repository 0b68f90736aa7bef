"""Exact top-k search: incremental multi-index hashing over binary codes.

A vector's code is the signs of its components, as many words of 64 bits as it needs. A code is cut into segments; if a code lies within
Hamming distance ``segments * (r + 1) - 1`` of a query, at least one of its segments lies within r of the query's. So the search
looks up, per segment, all values at distance 0, then 1, 2 ... and a query leaves as soon as its kth verified distance is covered by
that bound; until then, only codes within its kth distance so far are reported to it.

The index is one posting per code and segment, spread over buckets by the segment's leading bits; there are about as many buckets
as entries / BUCKET, and a bucket that common values overfill is split into pieces. At radius r a query that is still open goes
only to the buckets whose leading bits differ from its own in at most r places, so neither postings nor queries are copied to
all blocks. A code is reported by the first of its nearest segments alone, so no pair comes twice.

Equal codes are one entry with its smallest ids (k + 1 of them answer any query), so a very common vector is one entry.

Results in special cases: rows with a null id or vector have no code: they are neither found nor asked; null, NaN and missing
components count as not positive; a row is not its own neighbour, but a copy with another id is; repeated ids count
once per code; ties in distance go to the smaller id; fewer than k other rows give fewer neighbours; an empty table
gives an empty result; vectors may have any number of components; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

K = 10
WORD = 64
#: Bits of a segment: about log2 of the number of entries, at most WIDEST.
WIDEST = 24
#: Entries of a bucket (of a piece of one, where it is overfull), and queries searched together.
BUCKET = 1 << 14
QUERIES = 1 << 8
SALTS = 64
#: Most probes of a segment at a radius; beyond, all values of the bucket are compared with the query's (same hits).
PROBES = 1 << 12


def code_of(vector: Column) -> Column:
    """The signs of the components as words: bit i of word w is set if component 64 w + i is positive."""
    def word(part: Column) -> Column:
        bit = F.transform(part, lambda x, i: F.when(F.coalesce((x > 0) & ~F.isnan(x), F.lit(False)),
                                                    F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    starts = F.sequence(F.lit(1), F.greatest(F.size(vector), F.lit(1)), F.lit(WORD))
    return F.transform(starts, lambda at: word(F.slice(vector, at, WORD)))


def entries_of(coded: DataFrame, keep: int) -> DataFrame:
    """(code, ids): distinct codes with their ``keep`` smallest ids, in two steps so that a common code is spread."""
    salted = coded.dropDuplicates(["id", "code"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))
    then = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    return (salted.withColumn("n", first).where(F.col("n") <= keep).withColumn("n", then).where(F.col("n") <= keep)
            .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))


def segments(bits: int, entries: int) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of each segment; none crosses a word, and those of a word are nearly equal."""
    width = max(1, min(WIDEST, max(2, entries).bit_length()))
    out = []
    for w in range(-(-bits // WORD)):
        size = min(WORD, bits - WORD * w)
        n = -(-size // width)
        cuts = [size * i // n for i in range(n + 1)]
        out += [(w, a, b - a) for a, b in zip(cuts, cuts[1:])]
    return out


def _values(codes: np.ndarray, segment: tuple[int, int, int]) -> np.ndarray:
    w, at, width = segment
    return ((codes[:, w] >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for c in combinations(range(width), radius)]


def _found(entries: np.ndarray, low: np.ndarray, queries: np.ndarray, width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, entry) of the values (of ``width`` bits) that lie exactly ``radius`` apart; ``low`` sorted by ``entries``."""
    if comb(width, radius) > min(PROBES, max(1, len(low))):
        q, e = np.nonzero(np.bitwise_count(queries[:, None] ^ low[None, :]) == radius)
        return q, entries[e]
    start = np.concatenate([[0], np.cumsum(np.bincount(low, minlength=1 << width))])
    probes = (queries[:, None] ^ np.array(_masks(width, radius), dtype=np.int64)[None, :]).ravel()
    at, n = start[probes], start[probes + 1] - start[probes]
    q = np.repeat(np.arange(len(queries)).repeat(comb(width, radius)), n)
    return q, entries[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())]


def bucket_hits(entries: np.ndarray, queries: np.ndarray, bounds: np.ndarray, cuts: list[tuple[int, int, int]], s: int, lead: int, radius: int):
    """(query, entry, distance) of the entries of one bucket, within the queries' bounds, that segment ``s`` reports at this
    radius: its values differ in exactly ``radius`` bits, those of earlier segments in more, of later ones in no fewer."""
    width = cuts[s][2] - min(lead, cuts[s][2])
    mine, theirs = _values(entries, cuts[s]), _values(queries, cuts[s])
    order = np.argsort(mine, kind="stable")
    low = mine[order] & ((1 << width) - 1)
    away = np.bitwise_count((theirs ^ mine[0]) >> width)  # the bucket's leading bits are common to its entries
    pairs = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for d in np.unique(away[(away <= radius) & (away >= radius - width)]):
        ask = np.flatnonzero(away == d)
        q, e = _found(order, low, theirs[ask] & ((1 << width) - 1), width, radius - int(d))
        pairs.append((ask[q], e))
    q, e = (np.concatenate(x) for x in zip(*pairs))
    distance = np.bitwise_count(entries[e] ^ queries[q]).sum(axis=1, dtype=np.int32)
    near = distance <= bounds[q]
    q, e, distance = q[near], e[near], distance[near]
    for t, cut in enumerate(cuts):
        if t != s:
            apart = np.bitwise_count(_values(entries[e], cut) ^ _values(queries[q], cut))
            keep = apart > radius if t < s else apart >= radius
            q, e, distance = q[keep], e[keep], distance[keep]
    return q, e, distance


_HITS = "code array<long>, entry array<long>, first long, distance int"


def _search(k: int, cuts: list[tuple[int, int, int]], lead: int, radius: int):
    """Per query the ``k`` nearest of the codes that one bucket (or piece of one) reports."""
    def matrix(codes: pd.Series) -> np.ndarray:
        return np.stack(codes.to_numpy()).astype(np.int64).view(np.uint64)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            entries, first = matrix(left["code"]), left["first"].to_numpy()
            for a in range(0, len(right), QUERIES):
                asked, bounds = right["code"].iloc[a:a + QUERIES], right["bound"].iloc[a:a + QUERIES].to_numpy()
                q, e, d = bucket_hits(entries, matrix(asked), bounds, cuts, int(key[0]), lead, radius)
                order = np.lexsort((first[e], d, q))
                q, e, d = q[order], e[order], d[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, e, d = q[place < k], e[place < k], d[place < k]
                out.append(pd.DataFrame({"code": asked.to_numpy()[q], "entry": left["code"].to_numpy()[e], "first": first[e], "distance": d}))
        return pd.concat(out) if out else pd.DataFrame(columns=["code", "entry", "first", "distance"], dtype=object).astype(
            {"first": "int64", "distance": "int32"})
    return run


def _bucket(cut: tuple[int, int, int], lead: int) -> Column:
    """The leading ``lead`` bits of a segment of the column ``code``."""
    w, at, width = cut
    lead = min(lead, width)
    moved = F.shiftrightunsigned(F.get("code", F.lit(w)), at + width - lead)
    return moved.bitwiseAND(F.lit((1 << lead) - 1).cast("long"))


def _placed(codes: DataFrame, cuts: list[tuple[int, int, int]], lead: int) -> DataFrame:
    """``codes`` once per segment, with the segment and its bucket."""
    places = F.array(*[F.struct(F.lit(s).alias("segment"), _bucket(cut, lead).alias("bucket")) for s, cut in enumerate(cuts)])
    return codes.withColumn("at", F.explode(places)).select(*codes.columns, "at.segment", "at.bucket")


def _reached(placed: DataFrame, cuts: list[tuple[int, int, int]], lead: int, radius: int) -> DataFrame:
    """Queries at every bucket whose leading bits are at most ``radius`` places off theirs."""
    by_lead = {}
    for s, cut in enumerate(cuts):
        by_lead.setdefault(min(lead, cut[2]), []).append(s)
    masks = F.coalesce(*[F.when(F.col("segment").isin(ss), F.filter(
        F.sequence(F.lit(0).cast("long"), F.lit((1 << n) - 1).cast("long")), lambda m: F.bit_count(m) <= radius)) for n, ss in by_lead.items()])
    return placed.withColumn("mask", F.explode(masks)).withColumn("bucket", F.col("bucket").bitwiseXOR(F.col("mask"))).drop("mask")


def top_k(vectors: DataFrame, asked: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", bucket: int = BUCKET) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest other rows, by Hamming distance and id, of each asked row."""
    raw = stored(vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull())
                 .select(F.col(id_col).alias("id"), code_of(F.col(vector)).alias("code"), F.size(vector).alias("bits"), asked.alias("asked")), "codes")
    bits = max(1, raw.agg(F.max("bits")).first()[0] or 1)
    words = -(-bits // WORD)
    coded = raw.withColumn("code", F.concat("code", F.array_repeat(F.lit(0).cast("long"), F.lit(words) - F.size("code"))))
    entries = stored(entries_of(coded.select("id", "code"), k + 1), "entries")
    n_entries = entries.count()
    cuts = segments(bits, n_entries)
    lead = max(0, -(-n_entries // bucket) - 1).bit_length()

    postings = stored(_placed(entries.select("code", F.get("ids", F.lit(0)).cast("long").alias("first")), cuts, lead), "postings")
    filled = postings.groupBy("segment", "bucket").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("pieces"))
    filled = stored(filled.where("pieces > 1"), "pieces")
    filled = small(filled)
    piece = F.pmod(F.xxhash64("code"), F.coalesce("pieces", F.lit(1)).cast("long"))
    left = postings.join(filled, ["segment", "bucket"], "left").withColumn("piece", piece).drop("pieces")

    # one more entry than neighbours: the asked row's own code may hold nothing but the row itself
    want = min(k + 1, n_entries)
    open_ = stored(coded.where("asked").select("code").distinct().withColumn("bound", F.lit(bits)), "queries")
    best, done = None, []
    order = Window.partitionBy("code").orderBy("distance", "first")
    for radius in range(max(c[2] for c in cuts) + 1):
        right = _reached(_placed(open_, cuts, lead), cuts, lead, radius).join(filled, ["segment", "bucket"], "left")
        right = right.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)).cast("long") - 1))).drop("pieces")
        keys = ["segment", "bucket", "piece"]
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k + 1, cuts, lead, radius), _HITS)
        found = hits if best is None else hits.unionByName(best)
        best = stored(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"), "best")
        covered = sum(min(radius, c[2]) + 1 for c in cuts) - 1
        kth = best.groupBy("code").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= want).drop("n")
        # farther ones than the kth found can't be among the nearest any more
        judged = stored(open_.join(kth, "code", "left").select("code", F.coalesce("kth", "bound").alias("bound"), F.coalesce(F.col("kth") <= covered, F.lit(False)).alias("closed")),
                        "judged")
        closed = judged.where("closed").select("code")
        done.append(best.join(closed, "code", "left_semi"))
        best = best.join(closed, "code", "left_anti")
        open_ = judged.where("not closed").select("code", "bound")
        if open_.isEmpty():
            break
    nearest = done[0]
    for d in done[1:]:
        nearest = nearest.unionByName(d)
    named = (nearest.select("code", "entry", "distance").join(entries.withColumnRenamed("code", "entry"), "entry")
             .select("code", "distance", F.explode("ids").alias("neighbour_id")))
    n = F.row_number().over(Window.partitionBy("code").orderBy("distance", "neighbour_id"))
    lists = (named.withColumn("n", n).where(F.col("n") <= k + 1).groupBy("code")
             .agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour_id"))).alias("near")))
    mine = coded.where("asked").select("id", "code").distinct().join(lists, "code")
    others = F.slice(F.filter("near", lambda x: x["neighbour_id"] != F.col("id")), 1, k)
    return mine.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "x.neighbour_id", "x.distance")
