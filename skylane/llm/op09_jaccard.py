"""N-gram Jaccard join: PartEnum signatures over the word shingles of whole texts, linked into components.

Two sets of similarity J >= g differ in at most (1 - g) / (1 + g) * (|r| + |s|) shingles. Sizes are cut into bands whose
ends differ by the factor 1 / g, so similar sets lie in one band or in neighbouring ones; a set signs for its own band and
for the next. For a band with the bound k, the shingle domain is partitioned by hash into k + 1 parts and a third more
as spares, and subsets of one part each are enumerated: sets that differ in at most k shingles agree in more parts than
there are spares. Each set leaves out as many of its smallest parts as there are spares (in the order of size and
number). Of the parts in which two sets agree, the largest is left out by neither, so they still share a signature,
and parts with next to nothing in them, which bring strangers together, are gone.

Sets that share a signature are candidates; only the members of a signature are ever compared:

1. every member with the smallest one (linear in the members), verified on the whole sets, linked into components;
2. ROUNDS times (or until that finds nothing), in signatures that still join several components: the members of other components with one of the largest
   component (another one for each signature and round), again linear in the members;
3. signatures that join several components even then: all pairs across components, each verified once. Large signatures of
   near copies hold much the same members, so those that overlap are one group, unless the signatures alone are less work. A
   group's members outside its largest component are compared with all others, in blocks inside tasks, which give
   back no more links than they have members. A block holds BLOCK members and BLOCK_SHINGLES of either side at most (or one set), so a member is sent to as many
   blocks as those that are left outside fill.

So no link between different components is missed, while a large group of near copies costs a few comparisons per member.
Documents with equal sets are one node from the start.

Shingles, sets and signatures are 64-bit hashes. Results in special cases: null and empty texts have no shingles and are
a component of their own; texts shorter than a shingle have the whole sequence as one; repeated rows come out as often
as they come in and share a component; a component's id is its smallest non-null doc_id; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_bytes, fresh, stored

WORDS = 4
#: Similarity in percent.
PERCENT = 85
#: One spare part for so many parts that the bound asks for.
SPARE = 3
#: Signatures with more members are compared in blocks inside tasks, smaller ones as pairs.
PAIR_MEMBERS = 64
BLOCK, BLOCK_SHINGLES = 8192, 1_000_000
#: How often the members of open signatures are compared with one more member of the largest component.
ROUNDS = 1
SKETCH = 256

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        return x ^ (x >> np.uint64(29)) ^ _M1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 400_000:
            self[word] = value
        return value


_WORDS = _Words()


def shingle_sets(texts, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingle hashes in one array, and where each text's begin (one more entry than texts)."""
    hashes, sizes = [], []
    for text in texts:
        tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        hashes += map(_WORDS.__getitem__, tokens)
        sizes.append(len(tokens))
    h, size = np.array(hashes, dtype=np.uint64), np.array(sizes, dtype=np.int64)
    first = np.cumsum(size) - size
    count = np.where(size == 0, 0, np.maximum(size - n + 1, 1))
    doc = np.repeat(np.arange(len(size)), count)
    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(size, n)[doc]
    s = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            inside = length > k
            word = h[np.minimum(at + k, len(h) - 1)] if len(h) else s
            s = np.where(inside, _mix(s * _M1 + word + np.uint64(k + 1)), s)
    ends = np.cumsum(count)
    for a, b in zip(ends - count, ends):
        s[a:b].sort()
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(size)))])


def node_ids(s: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    return np.array([xxhash.xxh3_64_intdigest(s[a:b].tobytes()) for a, b in zip(start[:-1], start[1:])], dtype=np.uint64).view(np.int64)


def bands(largest: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of the size bands, and per band the most shingles by which two linked sets of up to that size differ."""
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, (ends[-1] + 1) * 100 // percent))
    ends.append(max(ends[-1] + 1, (ends[-1] + 1) * 100 // percent))
    e = np.array(ends, dtype=np.int64)
    return e, 2 * e * (100 - percent) // (100 + percent)


def signatures(s: np.ndarray, start: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of all sets."""
    size = np.diff(start)
    if not len(s):
        return np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
    ends, bound = bands(int(size.max()), percent)
    own = np.searchsorted(ends, size)
    doc = np.repeat(np.arange(len(size)), size)
    part_hash, value = _mix(s ^ _M2) >> np.uint64(20), _mix(s)
    low_half, high_half = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
    out_doc, out_sig = [], []
    for step in (0, 1):
        band = own + step
        spare = (bound[band] + 1) // SPARE
        parts = bound[band] + 1 + spare
        first = np.cumsum(parts) - parts
        cell = first[doc] + (part_hash % parts[doc].astype(np.uint64)).astype(np.int64)
        # exact sums modulo 2^64 of the values in each part, from sums of their halves
        held = np.bincount(cell, minlength=parts.sum())
        low = np.bincount(cell, weights=low_half, minlength=parts.sum()).astype(np.uint64)
        high = np.bincount(cell, weights=high_half, minlength=parts.sum()).astype(np.uint64)
        owner = np.repeat(np.arange(len(size)), parts)
        by_size = np.lexsort((held, owner))  # stable: parts of equal size in their order
        cells = by_size[(np.arange(len(owner)) - first[owner] >= spare[owner]) & (size[owner] > 0)]
        owner = owner[cells]
        with np.errstate(over="ignore"):
            sums = low[cells] + (high[cells] << np.uint64(32))
        with np.errstate(over="ignore"):
            tag = band[owner].astype(np.uint64) * _M2 + (cells - first[owner]).astype(np.uint64) * _M1
            out_sig.append(_mix(_mix(sums + tag) + tag))
        out_doc.append(owner)
    return np.concatenate(out_doc), np.concatenate(out_sig)


def _sets_of(batch: pa.RecordBatch):
    return shingle_sets(batch.column("text").to_pylist())


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s, start = _sets_of(b)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(start)), pa.array(node_ids(s, start))],
                                         ["doc_id", "n_shingles", "node"])


def _signed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, start = _sets_of(b)
            nodes = node_ids(s, start)
            owner, sig = signatures(s, start, percent)
            _, once = np.unique(nodes, return_index=True)  # copies within a batch sign once
            keep = np.isin(owner, once)
            owner, sig = owner[keep], sig[keep]
            for a in range(0, len(sig), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(sig[a:a + 200_000].view(np.int64)), pa.array(nodes[owner[a:a + 200_000]])],
                                                 ["sig", "node"])
    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s, start = _sets_of(b)
        nodes = node_ids(s, start)
        asked = b.column("node").to_numpy()
        rows = np.flatnonzero(nodes == asked)
        parts = [s[start[i]:start[i + 1]] for i in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[rows]), pa.array(np.diff(start)[rows]), pa.array([sketch(x) for x in parts], pa.binary()),
             pa.array([x.tobytes() for x in parts], pa.binary())], ["node", "size", "sketch", "shingles"])


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of SKETCH cells (at most 255). Two sets differ in as many shingles, at least, as
    their counts differ in sum."""
    cells = (_mix(shingles + _M2) >> np.uint64(40)) % np.uint64(SKETCH)
    return np.minimum(np.bincount(cells.astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < percent * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _possible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("x", "y"))
            together = b.column("nx").to_numpy() + b.column("ny").to_numpy()
            ok = pa.array((100 + percent) * np.abs(x - y).sum(axis=1) <= (100 - percent) * together)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])
    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [np.frombuffer(x, dtype=np.uint64) for x in b.column("x").to_pylist()]
            right = [np.frombuffer(x, dtype=np.uint64) for x in b.column("y").to_pylist()]
            ok = pa.array([similar(x, y, percent) for x, y in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])
    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar: first the small sketches rule pairs out, then whole sets decide."""
    def both(p: DataFrame, **columns: str) -> DataFrame:
        for side, names in (("a", "x"), ("b", "y")):
            p = p.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{k}{names}") for k, c in columns.items()]), side)
        return p.select("a", "b", *[f"{k}{n}" for k in columns for n in "xy"])
    low = both(pairs, s="sketch", n="size").withColumnsRenamed({"sx": "x", "sy": "y"})
    near = low.where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent).mapInArrow(_possible(percent), "a long, b long")
    return both(near, s="shingles").withColumnsRenamed({"sx": "x", "sy": "y"}).mapInArrow(_verified(percent), "a long, b long")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, label): per node that has a link, the smallest node it reaches; by alternating large and small stars."""
    def smallest(e: DataFrame) -> DataFrame:  # per u, the smallest of u and its neighbours
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def measure(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()

    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = (large.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(own.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = stored(small_star, name)
        now = measure(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _block_links(percent: int):
    """Links of the probing members of a block with its members: a spanning set of those across components."""
    def run(_key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["node", "probe"]).reset_index(drop=True)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in block["shingles"]]
        node, label, probe = block["node"].to_numpy(), block["label"].to_numpy(), block["probe"].to_numpy()
        root = {x: x for x in label.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        # near copies are compared by what sets them apart from the shingles that most members hold
        values, where = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        common = np.bincount(where, minlength=len(values)) > len(sets) / 2
        column = np.cumsum(common) - 1
        lacks = np.ones((len(sets), int(common.sum())), dtype=bool)
        lacks[owner[common[where]], column[where[common[where]]]] = False
        lacking, which = np.nonzero(lacks)
        owner = np.concatenate([owner[~common[where]], lacking])
        where = np.concatenate([where[~common[where]], np.flatnonzero(common)[which]])
        by_owner, by_value = np.argsort(owner, kind="stable"), np.argsort(where, kind="stable")
        apart = np.bincount(owner, minlength=len(sets))
        first = np.concatenate([[0], np.cumsum(apart)])
        start = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(values)))])
        out = []
        for i in np.flatnonzero(probe):
            mine = where[by_owner[first[i]:first[i + 1]]]
            n = start[mine + 1] - start[mine]
            at = np.repeat(start[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(owner[by_value[at]], minlength=len(sets))
            both = (size[i] + size - (apart[i] + apart - 2 * shared)) // 2
            near = np.flatnonzero(100 * both >= percent * (size[i] + size - both))
            for j in near:
                x, y = find(label[i]), find(label[j])
                if x != y:
                    root[x] = y
                    out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def dealt_members(many: DataFrame) -> DataFrame:
    """The members of large groups (as ``still_open`` gives them) in blocks (i, j) of a group: as a member of block j
    once for every block i of probing members, and, outside the main component, as a probing member of its block i once for
    every j."""
    probes, blocks = (F.greatest(F.ceil(F.col(c) / BLOCK_SHINGLES), F.ceil(F.col(k) / BLOCK), F.lit(1)).cast("int")
                      for c, k in (("outside", "n_outside"), ("shingles", "n")))
    i, j = (F.pmod(F.xxhash64("node", F.lit(k)), n).cast("int") for k, n in enumerate((probes, blocks)))
    held = many.select("sig", "node", "label", F.explode(F.sequence(F.lit(0), probes - 1)).alias("i"), j.alias("j"), F.lit(False).alias("probe"))
    probing = many.where("not main").select("sig", "node", "label", i.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"),
                                            F.lit(True).alias("probe"))
    return held.unionByName(probing)


def still_open(members: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """The members (sig, node, size) of signatures that join several components: with the label, the number of members and of their shingles,
    both in all and outside the component that has most members, and whether the member is in that (main)."""
    labelled = members.select("sig", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = labelled.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("size"))
    largest = (held.groupBy("sig").agg(F.sum("c").alias("n"), F.sum("size").alias("shingles"), F.max(F.struct("c", "label", "size")).alias("most"),
                                       F.count(F.lit(1)).alias("labels"))
               .where("labels > 1").select("sig", "n", "shingles", (F.col("shingles") - F.col("most.size")).alias("outside"),
                                           (F.col("n") - F.col("most.c")).alias("n_outside"), F.col("most.label").alias("of")))
    return stored(labelled.join(largest, "sig").select("sig", "node", "size", "label", "n", "shingles", "outside", "n_outside", (F.col("label") == F.col("of")).alias("main")), name)


def overlapping(many: DataFrame, labels: DataFrame) -> DataFrame:
    """Large signatures that share members as one group of their distinct members, where that takes fewer comparisons than
    the signatures one by one."""
    if many.isEmpty():
        return many
    group = stored(components(many.select(F.col("sig").alias("a"), F.col("node").alias("b")), "overlap").withColumnRenamed("label", "group"), "groups")
    named = many.join(group, "node")
    whole = still_open(named.select(F.col("group").alias("sig"), "node", "size").distinct(), labels, "whole")

    def work(x: DataFrame, key: str, name: str) -> DataFrame:
        return x.groupBy(key).agg(F.sum((~F.col("main")).cast("long") * F.col("n")).alias(name))
    cheap = (work(named, "group", "alone").join(work(whole, "sig", "together").withColumnRenamed("sig", "group"), "group")
             .where("together <= alone").select("group"))
    cheap = stored(cheap, "cheap")
    return (whole.join(cheap.withColumnRenamed("group", "sig"), "sig", "left_semi")
            .unionByName(named.join(cheap, "group", "left_anti").select(*whole.columns)))


def linked(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    batch_bytes(docs.sparkSession)
    source = docs.select("doc_id", F.col(text).alias("text"))
    base = stored(source.select(F.col("doc_id").cast("long"), "text").mapInArrow(_ids, "doc_id long, n_shingles long, node long"), "nodes")
    per_sig = source.select("text").mapInArrow(_signed(percent), "sig long, node long")
    by_sig = Window.partitionBy("sig")
    members = stored(per_sig.withColumn("hub", F.min("node").over(by_sig)).withColumn("top", F.max("node").over(by_sig))
                     .where("hub <> top").select("sig", "node", "hub").distinct(), "members")
    asked = members.select("node").distinct()
    one_each = base.groupBy("node").agg(F.min("doc_id").alias("d")).join(asked, "node")
    found = source.join(one_each, F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text")
    sets = stored(found.mapInArrow(_set_rows, "node long, size long, sketch binary, shingles binary").dropDuplicates(["node"]), "sets")
    first = stored(verified(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets, percent), "links")
    labels = components(first, "first")
    rest = still_open(members.join(sets.select("node", "size"), "node"), labels, "rest")
    for k in range(ROUNDS):  # one more member of the largest component with all outside it
        order = F.struct(F.xxhash64("sig", "node", F.lit(k)), "node")
        hub = rest.where("main").groupBy("sig").agg(F.max_by("node", order).alias("a"))
        asked = rest.where("not main").select("sig", F.col("node").alias("b")).join(hub, "sig")
        more = stored(verified(asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, percent), "links")
        if more.isEmpty():
            break
        first = first.unionByName(more)
        labels = components(first, "first")
        rest = still_open(rest, labels, "rest")
    few = rest.where(F.col("n") <= PAIR_MEMBERS)
    x = few.where("not main").select("sig", F.col("node").alias("x"), F.col("label").alias("lx"))
    y = few.select("sig", F.col("node").alias("y"), F.col("label").alias("ly"))
    across = x.join(y, "sig").where("lx <> ly").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    second = first.unionByName(stored(verified(across, sets, percent), "pairs"))
    many = overlapping(rest.where(F.col("n") > PAIR_MEMBERS), labels)
    dealt = (dealt_members(many).join(sets.select("node", "shingles"), "node")
             .groupBy("sig", "i", "j").applyInPandas(_block_links(percent), "a long, b long"))
    second = second.unionByName(stored(dealt, "blocks"))
    final = components(second, "all")
    named = base.select("node", "doc_id").join(final, "node").groupBy("label").agg(F.min("doc_id").alias("of_label"))
    alone = base.groupBy("node").agg(F.min("doc_id").alias("of_node"))
    ids = alone.join(final.join(named, "label").select("node", "of_label"), "node", "left").select(
        "node", F.coalesce("of_label", "of_node").alias("component"))
    out = base.join(ids, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def representatives(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component (that of the smallest doc_id); columns as given.

    Documents without words all stay, as do rows with a null doc_id; of several rows with one doc_id one stays.
    """
    gone = linked(docs, text, percent).where(F.col("doc_id").isNotNull() & (F.col("component_id") != F.col("doc_id"))).select("doc_id").distinct()
    place = fresh(docs, "place_")
    one = docs.where(F.col("doc_id").isNotNull()).withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(text)))
    kept = one.where(F.col(place) == 1).join(gone, "doc_id", "left_anti").select(*docs.columns)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
