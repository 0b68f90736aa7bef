"""Target-distribution importance resampling: documents whose word n-grams look like a target's are likelier to be drawn.

Features are found by overlapped regex scanning. A text is lower-cased (A-Z), every run of separators is collapsed to one
space, and one pattern whose boundaries are lookarounds is run with ``overlapped=True``: it matches at every word, however
long the match before was, and its groups end where the runs of 1, 2, ... words end. The spans are counted by their CRC.

One Python pass over the corpus turns each text into its buckets (two bytes a feature), written to the shared folder. Every
task adds its documents up to one histogram, so what is shuffled and what the driver gets depends on the number of buckets,
not on the documents; the gains of all buckets (BUCKETS longs) go back to the tasks. Scores carry Gumbel noise from a
hash of the id, so the highest of them are a draw without replacement in proportion to the importance weights, and
reruns agree. Places are numbered in range partitions with offsets, never in one task.

Results in special cases: null and empty texts, and texts of separators only, have no features, weigh 0 and are never
drawn; of a very long text all features count; equal scores go by doc_id (null last), then by the further results, so
repeated rows take neighbouring places; a null doc_id draws its noise as the empty string; an empty table gives an empty
result; with an empty target all gains follow from T = 0; further columns are ignored by ``weighed`` and kept by
``resample``, whose working columns avoid their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.operators.ranking import global_position

from .common import batch_bytes, fresh, stored

LONGEST, BUCKETS, PERCENT, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7

#: Every byte that separates words, as a space. Bytes of 128 and more (all of a non-ASCII character's) belong to words.
_SEPARATORS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@lru_cache(maxsize=8)
def scanner(longest: int) -> regex.Pattern:
    """A pattern that matches at each word; group n ends with the n-th word from there, if there are so many."""
    tail = b""
    for _ in range(longest - 1):
        tail = b"(?: ([^ ]++)" + tail + b")?+"
    return regex.compile(b"(?<![^ ])([^ ]++)" + tail + b"(?![^ ])")


def features(text: str | None, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """Number of words, and the CRCs of all runs of 1 to ``longest`` consecutive words."""
    flat = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split())
    crc, groups = zlib.crc32, range(2, longest + 1)

    def spans() -> Iterator[int]:
        for m in scanner(longest).finditer(flat, overlapped=True):
            start = m.start()
            yield crc(flat[start:m.end(1)])
            for n in groups:
                end = m.end(n)
                if end < 0:
                    break
                yield crc(flat[start:end])
    found = np.fromiter(spans(), dtype=np.uint32)
    return flat.count(b" ") + 1 if flat else 0, found


def _bucketed(longest: int, buckets: int):
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t, longest) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([len(f) for _, f in found], pa.int64()),
                 pa.array([(f % np.uint32(buckets)).astype(kind).tobytes() for _, f in found], pa.binary())],
                ["doc_id", "n_words", "n_features", "buckets"])
    return run


def bucketed(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, doc_id: Column | None = None) -> DataFrame:
    """doc_id, n_words, n_features and all features' buckets as bytes, one row per document."""
    batch_bytes(docs.sparkSession)
    given = docs.select((F.col("doc_id") if doc_id is None else doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(_bucketed(longest, buckets), "doc_id long, n_words long, n_features long, buckets binary")


def _histogram(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if buckets <= 1 << 16 else np.uint32
        held = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for x in b.column("buckets"):
                held += np.bincount(np.frombuffer(x.as_buffer() or b"", dtype=kind), minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some])], ["bucket", "n"])
    return run


def counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all documents fall into each bucket: one histogram a task, added up by bucket."""
    rows = found.select("buckets").mapInArrow(_histogram(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        held[r["bucket"]] = r["n"]
    return held


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, 1000 times the smoothed log ratio of its share in the target to its share in the corpus, floored."""
    n = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (corpus.sum() + n) / ((s + 1) * (target.sum() + n)))).astype(np.int64)


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
        for b in batches:
            sums = [int(gain[np.frombuffer(x.as_buffer() or b"", dtype=kind)].sum()) for x in b.column("buckets")]
            weight = [s // n if n else 0 for s, n in zip(sums, b.column("n_features").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight, pa.int64())], [*b.schema.names[:3], "weight"])
    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel draw from a hash of the id, floored."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weighed(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
            percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null: not drawn), n_words."""
    found = stored(bucketed(docs, text, longest, buckets), "features")
    like = bucketed(target, target_text, longest, buckets, F.lit(None))
    gain = gains(counts(found, buckets), counts(like, buckets))
    schema = "doc_id long, n_words long, n_features long, weight long"
    scored = found.mapInArrow(_weights(gain), schema).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored, "scored")
    enough = F.col("n_words") >= least_words
    order = {"_down": -F.col("score"), "_unnamed": F.col("doc_id").isNull()}
    placed, n = global_position(scored.where(enough).withColumns(order), [*order, "doc_id", "n_features", "weight", "n_words"], "rank")
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return (placed.withColumn("rank", drawn).select(columns)
            .unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(columns)))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents of a drawn doc_id, columns as given; rows with a null doc_id are left out."""
    p = fresh(docs, "drawn_")
    ids = weighed(docs, target, text, **how).where(F.col("rank").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(f"{p}id")).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(f"{p}id"), "left_semi")
