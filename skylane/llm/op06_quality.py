"""Quality rules: cross-document line frequency (DataFrame functions only).

Lines are normalised (lower case, white space collapsed, digits as 0) and hashed. A line's frequency is the number of
distinct documents of its host that carry it; exact copies of a document count once, so that a group of copies does not
turn its own lines into boilerplate. Lines above the limits are removed, and documents that lose too much are rejected.

Results in special cases: null and empty texts have no words and fail the base rules; a null host is a host of its own;
repeated rows are judged alike and all returned; an empty table gives an empty result; further columns are ignored; texts of any length
are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, fresh, let, small, stored, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]+"

#: A line is boilerplate if more than LINE_DOCS documents of its host, and more than LINE_SHARE of them, carry it. With a share of 0 the
#: count alone decides, so that the limit does not grow with the host.
LINE_DOCS = 20
LINE_SHARE = 0.0
#: Up to so many frequent lines a host, each host's lines are sent to its documents as an array; beyond, lines are joined.
HOST_LINES = 500
#: A document is depleted if boilerplate was removed and less than this share of its words, or than MIN_WORDS, remains.
KEEP_SHARE = 0.3


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.btrim(s, F.lit(SPACES)) != "")


def line_hash(line: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.btrim(line, F.lit(SPACES))), r"[\x20\x09-\x0D]+", " ")
    return F.xxhash64(F.regexp_replace(plain, "[1-9]", "0"))


def _host(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def _repeat_words(word_array: Column) -> Column:
    """Words that lie in a window of WINDOW words found at least twice in the text."""
    hashes = F.transform(word_array, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.when(
        F.size(h) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                    lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>")))

    def covered(found: Column) -> Column:
        in_order = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(in_order, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
                     | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))),
            lambda e: e["i"])))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(
            (p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])

    return let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(covered(x)))


def distinct_lines(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(host, copy, lines): the distinct line hashes of each distinct text of a host; a stored table."""
    by_doc = docs.select(_host(F.col(host)).alias("host"), F.xxhash64(text).alias("copy"),
                         F.array_distinct(F.transform(_lines(F.col(text)), line_hash)).alias("lines"))
    return stored(by_doc.dropDuplicates(["host", "copy"]), "lines")


def frequent_lines(distinct: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(host, line): the hashes of the lines above both limits, of the distinct lines of each text."""
    counts = (distinct.select("host", F.explode("lines").alias("line")).groupBy("host", "line")
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_docs))
    if line_share > 0:
        docs_of = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
        counts = counts.join(docs_of, "host").where(F.col("n") > F.lit(line_share) * F.col("host_docs"))
    return counts.select("host", "line")


def _frequent_of(docs: DataFrame, text: str, host: str, **limits) -> tuple[DataFrame, list[str]]:
    """Arrays of frequent line hashes (column ``frequent``) and the columns that they belong to.

    By host while no host has more than HOST_LINES of them; else by distinct text (host, copy), each with the frequent lines it carries, so that
    no array outgrows a document.
    """
    distinct = distinct_lines(docs, text, host)
    frequent = stored(frequent_lines(distinct, **limits), "frequent")
    n, widest = frequent.groupBy("host").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if n <= BROADCAST_ROWS and widest <= HOST_LINES:
        return F.broadcast(frequent.groupBy("host").agg(F.collect_list("line").alias("frequent"))), ["host"]
    carried = (distinct.select("host", "copy", F.explode("lines").alias("line")).join(small(frequent, n), ["host", "line"])
               .groupBy("host", "copy").agg(F.collect_list("line").alias("frequent")))
    carried = stored(carried, "carried")
    # a row holds an array, so the hashes are counted, not the rows
    return small(carried, carried.agg(F.coalesce(F.sum(F.size("frequent") + 1), F.lit(0))).first()[0]), ["host", "copy"]


def with_quality(docs: DataFrame, text: str = "text", host: str = "source", prefix: str = "q_", **limits) -> DataFrame:
    """``docs`` with the base counts, the verdict ``<prefix>kept`` and ``<prefix>clean_text`` (frequent lines removed)."""
    frequent, keys = _frequent_of(docs, text, host, **limits)
    p = prefix
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumns({f"{p}host": _host(F.col(host)), f"{p}copy": F.xxhash64(text), f"{p}words": words(t), f"{p}all_lines": F.split(t, "\n")})
    joined = base.join(frequent.withColumnsRenamed({c: f"{p}{c}" for c in frequent.columns}), [f"{p}{c}" for c in keys], "left")
    known = F.col(f"{p}frequent")

    def removed(s: Column) -> Column:
        return (F.btrim(s, F.lit(SPACES)) != "") & F.array_contains(known, line_hash(s))

    out = joined.withColumn(f"{p}removed", F.when(known.isNotNull(), F.filter(f"{p}all_lines", removed))
                            .otherwise(F.array().cast("array<string>")))
    lines = _lines(t)
    out = out.withColumns({
        f"{p}n_words": F.size(f"{p}words").cast("long"),
        f"{p}word_chars": F.length(F.array_join(f"{p}words", "")).cast("long"),
        f"{p}n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
        f"{p}n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        f"{p}n_repeat_words": _repeat_words(F.col(f"{p}words")).cast("long"),
        f"{p}removed_words": F.aggregate(f"{p}removed", F.lit(0), lambda a, s: a + F.size(words(s))).cast("long"),
        f"{p}clean_text": F.when(F.size(f"{p}removed") == 0, F.col(text)).otherwise(
            F.array_join(F.filter(f"{p}all_lines", lambda s: ~removed(s)), "\n")),
    })
    left = F.col(f"{p}n_words") - F.col(f"{p}removed_words")
    depleted = (F.col(f"{p}removed_words") > 0) & ((left < MIN_WORDS) | (left < KEEP_SHARE * F.col(f"{p}n_words")))
    failed = (F.col(f"{p}n_words") < MIN_WORDS) | (
        100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{p}n_words"))
    return out.withColumns({f"{p}base_failed": failed, f"{p}kept": ~failed & ~depleted}).drop(
        f"{p}host", f"{p}copy", f"{p}words", f"{p}all_lines", f"{p}frequent", f"{p}removed")


def quality(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, and the words that removed lines held."""
    out = with_quality(docs.select("doc_id", text, host), text, host, "q_", **limits)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
    return out.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in names])


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The accepted documents with their frequent lines removed; columns as given."""
    p = fresh(docs, "q_")
    out = with_quality(docs, text, host, p, **limits).where(f"{p}kept")
    new = {text: F.col(f"{p}clean_text")}
    if "n_chars" in docs.columns:
        changed = F.col(f"{p}removed_words") > 0
        new["n_chars"] = F.when(changed, F.length(f"{p}clean_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*docs.columns)
