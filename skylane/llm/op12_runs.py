"""Periodic runs of words: maximal pairs from the bottom-up LCP-interval tree of each document.

A run of period q and length n is a maximal pair of equal stretches of n - q words, q words apart: the words before the two
differ, and so do the words after them. So runs are read off the maximal pairs, without any extension:

1. Suffixes of all documents of a block are ordered together by prefix doubling (ranks of the first 1, 2, 4, ... words; only
   suffixes that still share their rank are sorted again). A word's number holds its document, so no stretch leaves a
   text. Common prefixes (LCP) of neighbours come from the kept ranks, longest power first.
2. The tree of LCP intervals is walked bottom-up with a stack. Each interval holds its suffixes in order, and lists of
   them by the word on their left (the classes). When a child is merged, suffixes of different classes from different
   children are a maximal pair; the smaller side looks up those of the larger one whose distance fits the length.
3. A stretch with several periods is named by the smallest one: its pair is among those found.

Intervals too shallow for any run are never built, so texts without repeats cost the first ranks only. The enumeration of
pairs is bounded by their distance (a third of the depth at the least exponent 4), never all pairs of an interval.

Results in special cases: null and empty texts have no words, no runs and the hashes of the empty string; a text of one
repeated word is one run; very long texts are taken whole; ties between longest runs go to the smallest start, then period;
repeated rows come out as often as they come in; a null doc_id stays null; an empty table gives an empty result; further
columns are ignored by ``runs`` and kept by ``collapse``.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_bytes, fresh, together

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Words that are ordered together; a longer text is a block of its own.
BLOCK_WORDS = 300_000
#: Words whose numbers are kept from block to block.
KNOWN_WORDS = 500_000


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def split(text: str | None) -> list[bytes]:
    """Words: runs of anything but ASCII white space, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def rank_levels(key: np.ndarray, shared_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words (one more entry: the end), and which share their first words.

    ``shared_words`` is a power of 2.

    A rank is the place of the first suffix of its group, so it stays valid while groups are split. Levels end when all differ.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = np.repeat(first, np.diff(first, append=n))
    rank[n] = n
    shared = np.repeat(np.diff(first, append=n) > 1, np.diff(first, append=n))
    active, levels, words, deep = order[shared], [rank], 1, order[:0]
    while len(active):
        if words == shared_words:
            deep = active
        old, after = rank[active], rank[np.minimum(active + words, n)]
        by = np.argsort(old * (n + 1) + after, kind="stable")
        active, old, after = active[by], old[by], after[by]
        head = np.ones(len(active), dtype=bool)
        head[1:] = old[1:] != old[:-1]
        split_ = head.copy()
        split_[1:] |= after[1:] != after[:-1]
        places = np.arange(len(active))
        group, part = places[head], places[split_]
        group = np.repeat(group, np.diff(group, append=len(active)))
        size = np.diff(part, append=len(active))
        rank = rank.copy()
        rank[active] = old + np.repeat(part, size) - group
        active = active[np.repeat(size > 1, size)]
        words *= 2
        levels.append(rank)
    return levels, deep


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes a[i] and b[i], which differ."""
    length = np.zeros(len(a), dtype=np.int64)
    end = len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        length += (1 << k) * ((levels[k][x] == levels[k][y]) & (x < end) & (y < end))
    return length


@dataclass
class Interval:
    """Suffixes with a common prefix, in order, and the same by the word on their left."""
    at: list[int]
    by_left: dict[int, list[int]] = field(default_factory=dict)


class Pairs:
    """Collects the maximal pairs that are runs, while intervals are merged."""

    def __init__(self, left: np.ndarray, least_words: int, least_exponent: int):
        self.left, self.least, self.times = left, least_words, least_exponent - 1
        self.period: dict[tuple[int, int], int] = {}  # (start, length) -> smallest period

    def found(self, x: int, y: int, depth: int) -> None:
        gap = abs(x - y)
        if gap + depth >= self.least:
            run = (min(x, y), gap + depth)
            self.period[run] = min(self.period.get(run, gap), gap)

    def merge(self, a: Interval, b: Interval, depth: int) -> Interval:
        """One interval of both; reports the pairs across them that differ on the left and are near enough for the depth."""
        if len(a.at) < len(b.at):
            a, b = b, a
        reach = depth // self.times
        for left, places in b.by_left.items():
            same = a.by_left.get(left, ())
            for x in places:
                low, high = bisect_left(a.at, x - reach), bisect_right(a.at, x + reach)
                if high - low == bisect_right(same, x + reach) - bisect_left(same, x - reach):
                    continue  # nothing near, or all of it in the same class
                if high - low <= 4 * len(a.by_left):
                    for y in a.at[low:high]:
                        if self.left[y] != left:
                            self.found(x, y, depth)
                else:
                    for other, held in a.by_left.items():
                        if other != left:
                            for y in held[bisect_left(held, x - reach):bisect_right(held, x + reach)]:
                                self.found(x, y, depth)
        for left, places in b.by_left.items():
            into = a.by_left.setdefault(left, [])
            for x in places:
                insort(into, x)
        for x in b.at:
            insort(a.at, x)
        return a


def maximal_runs(key: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of word numbers, in the order of start and period."""
    if least_exponent < 2 or least_words < 6:
        raise ValueError("runs need an exponent of 2 and 6 words at least")
    # the shallowest interval in which two suffixes can be a run: period q takes max(least_words - q, (least_exponent - 1) q)
    shallow = min(max(least_words - q, (least_exponent - 1) * q) for q in range(1, least_words))
    levels, deep = rank_levels(key, 1 << shallow.bit_length() - 1)
    if not len(deep):
        return []
    order = deep[np.argsort(levels[-1][deep])]
    lcp = common_prefixes(levels, order[:-1], order[1:])
    lcp[lcp < shallow] = 0
    some = np.flatnonzero((np.append(lcp, 0) > 0) | (np.insert(lcp, 0, 0) > 0))
    if not len(some):
        return []
    left = [-1, *key[:-1].tolist()]
    pairs = Pairs(left, least_words, least_exponent)
    stack: list[tuple[int, Interval]] = []

    def leaf(x: int) -> Interval:
        return Interval([x], {left[x]: [x]})

    depths = np.insert(lcp, 0, 0)[some].tolist()  # with the suffix before; 0 for the first of a tree
    current = None
    for x, depth in zip(order[some].tolist(), depths):
        while stack and stack[-1][0] > depth:
            top, held = stack.pop()
            current = pairs.merge(held, current, top)
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1] = depth, pairs.merge(stack[-1][1], current, depth)
            else:
                stack.append((depth, current))
        current = leaf(x)
    while stack:
        top, held = stack.pop()
        current = pairs.merge(held, current, top)
    return sorted(((s, n, q) for (s, n), q in pairs.period.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    keep = bytearray(b"\x01") * len(words)
    for start, length, period in found:
        keep[start + period:start + length] = bytes(length - period)
    return [w for w, k in zip(words, keep) if k]


def runs_of(texts: list[list[bytes]], numbers: dict | None = None, least_words: int = LEAST_WORDS,
            least_exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text."""
    numbers = _Numbers() if numbers is None else numbers
    out: list[list[tuple[int, int, int]]] = []
    for a, z in together([len(t) for t in texts], BLOCK_WORDS):
        if len(numbers) > KNOWN_WORDS:
            numbers.clear()
        size = np.array([len(t) for t in texts[a:z]], dtype=np.int64)
        word = np.fromiter((numbers[w] for t in texts[a:z] for w in t), dtype=np.int64, count=int(size.sum()))
        first = np.cumsum(size) - size
        own: list[list[tuple[int, int, int]]] = [[] for _ in size]
        key = np.repeat(np.arange(len(size)), size) * (len(numbers) + 1) + word
        found = maximal_runs(key, least_words, least_exponent)
        of = np.searchsorted(first + size, [s for s, _, _ in found], side="right")
        for i, (start, length, period) in zip(of.tolist(), found):
            own[i].append((start - int(first[i]), length, period))
        out += own
    return out


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document (by the CRC of its id) with a stretch repeated from some place to the end; others as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


_DIGEST = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string, n_words long")


def runs(docs: DataFrame, text: str = "text", change: Callable[[list[bytes], int | None], list[bytes]] | None = None,
         least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """One row per document: its number of runs, the longest one, and hashes of all runs and of the collapsed text.

    ``change`` gives the words that are searched, from a document's words and its id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            texts = [split(t) for t in b.column("text").to_pylist()]
            if change:
                texts = [change(t, i) for t, i in zip(texts, ids)]
            rows = []
            for i, words, found in zip(ids, texts, runs_of(texts, numbers, least_words, least_exponent)):
                start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                said = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
                rows.append((i, len(found), start, length, period, None if start is None else 1000 * length // period,
                             hashlib.sha256(said).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest(), len(words)))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    batch_bytes(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _DIGEST)


def collapse(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT,
             prefix: str = "run_") -> DataFrame:
    """``docs`` with runs collapsed to their first period in the text (texts without runs stay as they are), and the runs.

    Adds <prefix>spans: an array of (start, length, period) in words.
    """
    batch_bytes(docs.sparkSession)
    new = fresh(docs, prefix) + "spans"
    span = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([*docs.schema.fields, T.StructField(new, span)])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for b in batches:
            given = b.column(text).to_pylist()
            texts = [split(t) for t in given]
            found = runs_of(texts, numbers, least_words, least_exponent)
            kept = [b" ".join(collapsed(w, f)).decode("utf-8", "surrogatepass") if f else t for t, w, f in zip(given, texts, found)]
            columns = [pa.array(kept, b.column(i).type) if n == text else b.column(i) for i, n in enumerate(b.schema.names)]
            spans = pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*columns, spans], [*b.schema.names, new])
    return docs.mapInArrow(run, schema)
