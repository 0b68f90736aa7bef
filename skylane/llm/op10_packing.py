"""Packing: bounded-space online packing of token ids into windows of fixed length.

Every partition keeps OPEN windows open. An item goes to the fullest window that takes it (best fit). If none does, the
fullest window is emitted; if its gap is worth a cut, the item's head tops it up first and the rest goes on as an item of
its own, if not, the gap is padding. Documents longer than a window fill whole windows and leave a rest. What is open at
the end of a partition is merged: FAN partitions' open windows are packed by one task, again with OPEN windows, until one
group is left, so no task sees more than FAN x OPEN windows.

Results in special cases: null and empty texts are documents of one id (the end mark); repeated rows are packed each on
its own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, stored

WINDOW = 2048
OPEN = 64
FAN = 32
#: A gap of at least this many ids is filled by cutting the next item.
MIN_CUT = 32
END = 1

_PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> ids of the byte-level BPE in a tokenizers file, computed by tiktoken from the file's own vocabulary.

    The ids are those of ``tokenizers`` with add_special_tokens=False (its special tokens are found in a text); tiktoken
    takes a quarter of the time. Texts that its splitter can't take are given to ``tokenizers`` itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in printable}
    of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(of[c] for c in k): i for k, i in spec["model"]["vocab"].items() if k not in special}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = None

    def encode(text: str) -> list[int]:
        nonlocal slow
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as e:  # its Rust panics are no Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            slow = slow or Tokenizer.from_file(path)
            return slow.encode(text, add_special_tokens=False).ids
    return encode


#: Fixed value: the splitting pattern of the byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Windows:
    """Open windows of one partition, ordered by fill; emits closed ones as (number, pieces)."""

    def __init__(self, size: int, most_open: int, min_cut: int):
        self.size, self.most_open, self.min_cut = size, most_open, min_cut
        self.by_fill: list[tuple[int, int]] = []  # (fill, number)
        self.held: dict[int, list] = {}
        self.made = 0

    def add(self, length: int, part, cut=None) -> Iterator[tuple[int, list]]:
        """Place ``part`` of ``length`` ids; ``cut(part, n)`` splits it after n ids (None: it can't be cut)."""
        while length:
            at = bisect_left(self.by_fill, (self.size - length + 1, -1)) - 1
            if at >= 0 or len(self.by_fill) < self.most_open:
                fill, number = self.by_fill.pop(at) if at >= 0 else (0, self._new())
                self.held[number].append(part)
                length, fill = 0, fill + length
            else:
                fill, number = self.by_fill.pop()
                if cut and self.size - fill >= self.min_cut:
                    head, part = cut(part, self.size - fill)
                    self.held[number].append(head)
                    length, fill = length - (self.size - fill), self.size
                else:
                    yield number, self.held.pop(number)
                    continue
            if fill == self.size:
                yield number, self.held.pop(number)
            else:
                insort(self.by_fill, (fill, number))

    def _new(self) -> int:
        self.made += 1
        self.held[self.made - 1] = []
        return self.made - 1

    def rest(self) -> Iterator[tuple[int, list]]:
        for _, number in self.by_fill:
            yield number, self.held[number]


def _cut(part, n: int):
    doc, start, ids, total = part
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


def _rows(base: int, number: int, parts: list, is_open: bool) -> list[tuple]:
    out, offset = [], 0
    for doc, start, ids, total in parts:
        out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + number, offset, is_open))
        offset += len(ids)
    return out


_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES)


def _pack_partition(path: str, window: int, most_open: int, min_cut: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        windows = Windows(window, most_open, min_cut)
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*encode(text), END], dtype=np.uint32)
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    rows += _rows(base, windows._new(), [(doc, start, ids[start:start + window], len(ids))], False)
                    windows.held.pop(windows.made - 1)
                if whole < len(ids):
                    for number, parts in windows.add(len(ids) - whole, (doc, whole, ids[whole:], len(ids)), _cut):
                        rows += _rows(base, number, parts, False)
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)
        yield _frame([r for number, parts in windows.rest() for r in _rows(base, number, parts, True)])
    return run


def _merge_group(window: int, most_open: int, level: int):
    """Pack the open windows of one group of tasks; whole windows are the items, cuts are no longer possible."""
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        base = (level << 58) | (int(key[0]) << 32)
        windows = Windows(window, most_open, window)
        out = []

        def close(number: int, items: list, is_open: bool) -> None:
            offset = 0
            for item in items:
                out.append(item.assign(sequence_id=base + number, offset=item["offset"] + offset, open=is_open))
                offset += int(item["length"].sum())

        for _, item in sorted(pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"),
                              key=lambda x: (-x[1]["length"].sum(), x[0])):
            for number, items in windows.add(int(item["length"].sum()), item):
                close(number, items, False)
        for number, items in windows.rest():
            close(number, items, True)
        return pd.concat(out)[_NAMES]
    return run


def pack(docs: DataFrame, path: str, text: str = "text", window: int = WINDOW, most_open: int = OPEN,
         min_cut: int = MIN_CUT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    batch_bytes(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    level, out = 0, None
    part = F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 58) - 1)), 32)
    pieces = stored(source.mapInPandas(_pack_partition(path, window, most_open, min_cut), _PIECE), "pieces")
    while True:
        closed = pieces.where(~F.col("open"))
        out = closed if out is None else out.unionByName(closed)
        if not (pieces.where("open").agg(F.max(part)).first()[0] or 0):
            out = out.unionByName(pieces.where("open"))
            break
        level += 1
        pieces = stored(pieces.where("open").withColumn("part", F.floor(part / FAN).cast("long")).groupBy("part")
                        .applyInPandas(_merge_group(window, most_open, level), _PIECE), f"merged{level}")
    return out.drop("open").withColumn("doc_id", F.col("doc_id").cast("long"))
