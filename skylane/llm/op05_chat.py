"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, then the reply, and only that reply is
trainable. Turns after the last reply (or all, if there is none) close with an example that has no target, so that every
turn can be read back. ``expanded`` writes the examples out, each in parts of at most PART characters, ``rendered``
each as one text; ``digests`` reads turns and replies back from the expanded examples.

A turn is written as ``<|start|>role\\ntext<|end|>\\n``. Control strings inside roles and texts are escaped: one
backslash goes in after their first character, one more where some stand there already; line breaks and backslashes
in roles are escaped as well.

Partitions are sorted by conversation and turn. A task holds the formatted text of one conversation (its examples are prefixes of
it) and one batch of parts; the examples' size, about half the turns times the conversation's size, is only streamed. A
digest of ordered text is sequential, so one conversation is one task's.

Results in special cases: a null text or role counts as empty; a null conv_id is a conversation of its own; repeated
turns are kept, ordered by turn (nulls first), role and text; an empty table gives an empty result; further columns
are ignored; texts of any length are kept whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes

#: The template's own marks, and marks of other templates that must not appear as text.
START, END = "<|start|>", "<|end|>"
CONTROL = (START, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
TRAINED = "assistant"

_PLAIN = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))

#: Most characters of a row of an expanded example, and of a batch of such rows beyond its last.
PART = 1 << 20
BATCH = 1 << 22

_PIECES = "conv_id string, seq long, piece string, end long, target_start long, target_end long, example long"


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The piece of a turn, and where its text starts."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    return head + escape(text) + END + "\n", len(head)


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, rest = piece[len(START):].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(rest[:-len(END) - 1])


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, seq, end, example = object(), 0, 0, 0
    for b in batches:
        out = []
        for c, role, text in zip(b["conv_id"], b["role"], b["text"]):
            if c != conv:
                conv, seq, end, example = c, 0, 0, 0
            piece, at = format_turn(role, text)
            spans = (None, None, None)
            if role == TRAINED:
                spans, example = (end + at, end + len(piece) - len(END) - 1, example), example + 1
            end += len(piece)
            out.append((c, seq, piece, end, *spans))
            seq += 1
        yield _nullable(out)


def _nullable(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_columns(_PIECES))
    return out.astype({c: "Int64" for c in out.columns if c not in ("conv_id", "piece")})


def pieces(turns: DataFrame) -> DataFrame:
    """The running texts: conv_id, seq, piece, end (of the piece), and for replies target_start, target_end, example.

    An example is all pieces up to its own, trainable between target_start and target_end. Comes sorted by conversation.
    """
    batch_bytes(turns.sparkSession)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    plain = turns.select(F.col("conv_id").cast("string"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.repartition("conv_id").sortWithinPartitions(*order).drop("turn").mapInPandas(_stream, _PIECES)


_EXAMPLES = "conv_id string, example long, part long, text string, target_start long, target_end long"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _expand(part: int | None):
    """Writes out each conversation's examples, ``part`` characters a row (None: an example is one row)."""
    def conversation(c, pieces: list[str], spans: list[tuple]) -> Iterator[tuple]:
        text, last = "".join(pieces), 0
        for end, start, stop, example in spans:
            yield from rows(c, example, text, end, start, stop)
            last = end
        if last < len(text):
            yield from rows(c, len(spans), text, len(text), None, None)

    def rows(c, example: int, text: str, end: int, start, stop) -> Iterator[tuple]:
        for n, a in enumerate(range(0, end, part or end)):
            yield c, example, n, text[a:min(end, a + (part or end))], start, stop

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        conv, pieces, spans = None, [], []
        for b in batches:
            for c, piece, end, s, e, example in zip(b["conv_id"], b["piece"], b["end"], b["target_start"], b["target_end"], b["example"]):
                if c != conv:
                    yield from conversation(conv, pieces, spans)
                    conv, pieces, spans = c, [], []
                pieces.append(piece)
                if not pd.isna(s):
                    spans.append((int(end), int(s), int(e), int(example)))
        yield from conversation(conv, pieces, spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for r in examples(batches):
            out.append(r)
            size += len(r[3]) + 64
            if size > BATCH:
                yield _frame(out)
                out, size = [], 0
        yield _frame(out)
    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_columns(_EXAMPLES))
    return out.astype({c: "Int64" for c in out.columns if c not in ("conv_id", "text")})


def _expanded(turns: DataFrame, part: int | None) -> DataFrame:
    return pieces(turns).drop("seq").mapInPandas(_expand(part), _EXAMPLES)


def expanded(turns: DataFrame, part: int = PART) -> DataFrame:
    """The examples in parts: conv_id, example, part (from 0), text (at most ``part`` characters), target_start, target_end.

    The target's offsets count from the example's start; they are null in a closing example without a reply.
    """
    return _expanded(turns, part).withColumn("conv_id", F.col("conv_id").cast("long"))


def rendered(turns: DataFrame) -> DataFrame:
    """Whole examples: conv_id, example, text, target_start, target_end (no target: the rest after the last reply)."""
    return _expanded(turns, None).drop("part").withColumn("conv_id", F.col("conv_id").cast("long"))


_DIGEST = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


class _Reader:
    """Reads a conversation back from its examples, part by part; holds the parts of one example."""

    def __init__(self, conv):
        self.conv, self.example, self.parts, self.target = conv, None, [], []
        self.loss, self.loss_chars, self.formatted, self.examples, self.at = hashlib.sha256(), 0, 0, 0, 0

    def add(self, example: int, text: str, start, end) -> None:
        if example != self.example:
            self._reply()
            self.example, self.parts, self.at = example, [], 0
            self.examples += 1
        if not pd.isna(start):
            self.target.append(text[max(0, int(start) - self.at):max(0, int(end) - self.at)])
        self.parts.append(text)
        self.at += len(text)
        self.formatted += len(text)

    def _reply(self) -> None:
        reply = unescape("".join(self.target))
        self.loss.update(reply.encode())
        self.loss_chars += len(reply)
        self.target = []

    def row(self) -> tuple:
        """The last example holds all turns."""
        self._reply()
        turns, digest = 0, hashlib.sha256()
        for piece in "".join(self.parts).split(END + "\n")[:-1]:
            role, text = read_turn(piece + END + "\n")
            digest.update(f"{role}\n{text}\n".encode())
            turns += 1
        return self.conv, turns, digest.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted, self.examples


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader = None
    for b in batches:
        out = []
        for c, example, text, s, e in zip(b["conv_id"], b["example"], b["text"], b["target_start"], b["target_end"]):
            if reader is None or c != reader.conv:
                if reader:
                    out.append(reader.row())
                reader = _Reader(c)
            reader.add(int(example), text, s, e)
        yield pd.DataFrame(out, columns=_columns(_DIGEST))
    if reader:
        yield pd.DataFrame([reader.row()], columns=_columns(_DIGEST))


def digests(turns: DataFrame, part: int = PART) -> DataFrame:
    """Per conversation, read back from its expanded examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars
    (characters of all its examples), n_examples."""
    return _expanded(turns, part).mapInPandas(_read_back, _DIGEST).withColumn("conv_id", F.col("conv_id").cast("long"))
