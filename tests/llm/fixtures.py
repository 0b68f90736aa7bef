"""Small documents with every special case, and plain-Python readings of the contracts."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that the operators use while they work.
CLASH = ["shard", "size", "q_kept", "q_words", "m_size", "m_copies", "tox_score", "place_", "node", "label", "copies", "rank", "frequent", "line"]


def words(n, seed, pool=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def rows():
    """doc_id, text, lang, source, n_chars."""
    out = []

    def add(text, source="a", lang="en", doc_id=...):
        out.append((len(out) if doc_id is ... else doc_id, text, lang, source, None if text is None else len(text)))

    for i in range(24):
        add(words(60 + 7 * i, i), source=("a", "b", None)[i % 3], lang=("en", "de")[i % 2])
    base = words(120, 99).split()
    for i in range(6):  # near copies in a chain and around a base
        add(" ".join(base[:10 + 2 * i] + [f"x{i}"] + base[11 + 2 * i:]), source="b")
    for i in range(30):  # one boilerplate line
        add("The same old line of this host.\n" + words(30, 500 + i), source="c")
    for i in range(25):
        add(" the  SAME old line of this host.  ", source="c")
    for i in range(5):  # exact copies
        add(words(80, 7777), source="a")
    add(None)
    add("")
    add("", source=None, lang=None)
    add(" \t\n\x0b\f\r ")
    add("one two")
    add("One TWO")
    add("only three words")
    add("Released under the MIT License. mit license\tMIT-license", source="b")
    add("Licensed under CC BY-NC 4.0.", source="b")
    add("a b c d e " * 50, source="b")
    add("line one here\nline one here\n\n \nline two # * $\r\n| <x> & %", source="b")
    add(words(20_000, 5, 100_000), source="long")
    add("x" * 50_000, source="long")
    add("ÄÖÜ straße 日本語 😀   nbsp", source="b")
    add(words(50, 31), doc_id=None)
    add("no id", doc_id=None, source=None)
    add(words(40, 32), doc_id=3)
    out.append(out[5])  # a repeated row
    out.append(out[5])
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS).repartition(3)


def clashing(df):
    from pyspark.sql import functions as F
    for i, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(i))
    return df


def split_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = split_words(ascii_lower(text))
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def by_repr(found):
    return sorted(found, key=repr)
