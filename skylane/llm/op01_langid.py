"""Language identification: Bayesian fusion of text, declared markup language, address suffix and host priors.

Text: character trigrams, hashed to BUCKETS, counted per language over all training documents; a text's log likelihood per
language is tempered, as neighbouring trigrams aren't independent. Declaration: a page states its own language with
probability DECLARED. Address: the country suffix and a language segment of the path speak for their languages in the
same way. Host prior: the text posteriors of a host's other rows, added up by grouped aggregation and smoothed towards
those of its registered domain, which are smoothed towards those of all rows. A host with a third of all rows is pre-aggregated
and its prior is joined back by broadcast (size-checked) or by a shuffle that splits.

A model covers any number of languages: counts stay a table, and texts are scored by blocks of LANGUAGES languages, of which the
driver and a task hold one at a time. Per row, host and domain there is one number a language, in arrays.

Results in special cases: without any evidence (null or empty text, no declaration, unknown suffix) the host prior decides;
ties go to the language first in code point order; rows of null hosts share one host; with no training rows the language is null;
repeated rows come out as often as they come in; an empty table gives an empty result; further columns are ignored; texts of
any length are scored whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, small, stored

BUCKETS = 1 << 15
#: Languages scored together: a task holds LANGUAGES x BUCKETS numbers, whatever the number of languages.
LANGUAGES = 64
TEMPER = 0.25
DECLARED, ADDRESS = 0.95, 0.8
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
CHUNK = 1 << 20

#: Country suffixes that speak for a language.
SUFFIXES = {"de": "de", "at": "de", "li": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "uk": "en",
            "us": "en", "au": "en", "nz": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru",
            "jp": "ja", "cn": "zh", "kr": "ko"}

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head|nav)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


def visible_text(page: str | None) -> str:
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page))) if page else ""


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' trigrams (of lower-cased characters), and the text of each."""
    points = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    size = np.array([len(p) - 2 if len(p) > 2 else 0 for p in points], dtype=np.int64)
    if not size.sum():
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    out = []
    for p in points:
        if len(p) > 2:
            with np.errstate(over="ignore"):
                h = (p[:-2] * np.uint32(0x9E3779B1)) ^ (p[1:-1] * np.uint32(0x85EBCA77)) ^ (p[2:] * np.uint32(0xC2B2AE3D))
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append((h >> np.uint32(17)).astype(np.int64))
    return np.concatenate(out), np.repeat(np.arange(len(texts)), size)


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= CHUNK or i == len(texts) - 1:
            yield a, texts[a:i + 1]
            a, n = i + 1, 0


class TextModel:
    """log P(trigram | language) per bucket, for a block of languages."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.stack([counts[x] for x in self.languages], axis=1) if counts else np.zeros((BUCKETS, 0))
        self.log = (np.log(table + 0.5) - np.log(table.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)

    def log_likelihood(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for a, part in _chunks(texts):
            bucket, owner = trigrams(part)
            for k in range(len(self.languages)):
                out[a:a + len(part), k] = np.bincount(owner, weights=self.log[bucket, k], minlength=len(part))
        return out


class Counts:
    """Trigram counts: the languages in code point order, and a table (lang, bucket, n)."""

    def __init__(self, languages: list[str], table: DataFrame):
        self.languages, self.table = languages, table

    def blocks(self, size: int | None = None) -> Iterator[TextModel]:
        """The models of ``size`` neighbouring languages at a time; at most size x BUCKETS counts come to the driver."""
        size = size or LANGUAGES
        for a in range(0, len(self.languages), size):
            part = {x: np.zeros(BUCKETS) for x in self.languages[a:a + size]}
            mine = self.table.where(F.col("lang").between(self.languages[a], self.languages[a:a + size][-1]))
            for x, rows in mine.toPandas().groupby("lang"):
                part[x][rows["bucket"].to_numpy()] = rows["n"].to_numpy()
            yield TextModel(part)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Counts:
    """Trigram counts of all rows with a language; the driver gets the languages' names."""
    batch_bytes(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sparse(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for x, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))],
                                                 ["lang", "bucket", "n"])

        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = np.array(b.column("lang").to_pylist(), dtype=object), b.column("text").to_pylist()
            for x in set(langs):
                mine = [texts[i] for i in np.flatnonzero(langs == x)]
                for _, part in _chunks(mine):
                    total[x] = total.get(x, 0) + np.bincount(trigrams(part)[0], minlength=BUCKETS)
                if len(total) >= LANGUAGES:
                    yield from sparse(total)
                    total = {}
        yield from sparse(total)
    counts = (rows.select(F.col(lang).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
              .mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    found = sorted(r["lang"] for r in rows.select(F.col(lang).alias("lang")).distinct().collect())
    return Counts(found, stored(counts, "trigrams"))


def _host_parts(url: Column) -> dict[str, Column]:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]+)$", 1)
    known = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return {"host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), "suffix_lang": F.try_element_at(known, suffix),
            "path_lang": F.lower(F.nullif(F.regexp_extract(url, r"://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]+)?(?:[/?#]|$)", 1), F.lit("")))}


def declared_language(page: Column) -> Column:
    tag = F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", 1)
    return F.lower(F.nullif(tag, F.lit("")))


def _text_scores(rows: DataFrame, counts: Counts, keys: list[str], is_html: str | None) -> DataFrame:
    """``keys`` and ``ll``, the tempered log likelihood per language: one pass over the texts for each block of languages."""
    from pyspark.sql import types as T
    spark = rows.sparkSession
    batch_bytes(spark)
    n_blocks = -(-len(counts.languages) // LANGUAGES)
    out = rows.select(*keys, "text", F.array().cast("array<double>").alias("ll"), *([is_html] if is_html else []))
    schema = T.StructType([*(rows.schema[c] for c in keys), T.StructField("text", T.StringType()), T.StructField("ll", T.ArrayType(T.DoubleType()))])

    def scorer(sent, markup: str | None, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t or "" for t in b.column("text").to_pylist()]
                if markup:
                    texts = [visible_text(t) if m else t for t, m in zip(texts, b.column(markup).to_pylist())]
                ll = sent.value.log_likelihood(texts) * TEMPER
                if len(b) and len(b.column("ll")[0].as_py()):
                    ll = np.concatenate([np.array(b.column("ll").to_pylist(), dtype=np.float64), ll], axis=1)
                kept = pa.nulls(len(b), pa.string()) if last else pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), kept, pa.array(list(ll), pa.list_(pa.float64()))], [*keys, "text", "ll"])
        return run

    for i, model in enumerate(counts.blocks()):
        sent = spark.sparkContext.broadcast(model)  # at most BUCKETS x LANGUAGES numbers
        out = out.mapInArrow(scorer(sent, is_html if i == 0 else None, i == n_blocks - 1), schema)
        if i < n_blocks - 1:
            out = stored(out, "scored_block")  # a task holds one block's model
    return out.drop("text")


def _summed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Element-wise sums of the arrays ``value`` per key, pre-aggregated per element."""
    each = rows.select(*keys, F.posexplode(value).alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias(value)).withColumn(value, F.col(value)["x"])


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)


def identify(rows: DataFrame, counts: Counts, is_html: str | None = None) -> DataFrame:
    """rows: keys ..., text, host, domain, declared, suffix_lang, path_lang (missing evidence: null).

    Adds language, confidence, text_language and host_share (the prior of the language). ``is_html`` names a boolean column
    that tells which texts are markup.
    """
    langs = counts.languages
    keys = [c for c in rows.columns if c not in ("text", is_html)]
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select(*keys, none.alias("language"), F.lit(0.0).alias("confidence"), none.alias("text_language"), F.lit(0.0).alias("host_share"))
    scored = _text_scores(rows, counts, keys, is_html)
    e = F.transform("ll", lambda x: F.exp(x - F.array_max("ll")))
    s = stored(scored.withColumn("e", e).withColumn("e_sum", _total(F.col("e"))).withColumn("p", F.transform("e", lambda x: x / F.col("e_sum")))
               .drop("e", "e_sum"), "text_posteriors")

    hosts = stored(_summed(s, ["host", "domain"], "p").withColumnRenamed("p", "of_host"), "hosts")
    domains = stored(_summed(hosts, ["domain"], "of_host").withColumnRenamed("of_host", "in_domain"), "domains")
    total = domains.select(F.posexplode("in_domain").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # a number per language
    whole = [1.0] * len(langs)
    for r in total:
        whole[r["at"]] += r["x"]
    world = F.lit([x / sum(whole) for x in whole])
    # a row holds a number per language (a prior two), so these are counted, not the rows
    with_domain = hosts.join(small(domains, domains.count() * len(langs)), hosts["domain"].eqNullSafe(domains["domain"])).drop(domains["domain"])

    def others(name: str, all_of: str, own: str) -> tuple[str, Column]:
        return name, F.zip_with(all_of, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def smoothed(own: str, n: str, towards: Column, weight: float) -> Column:
        return F.zip_with(own, towards, lambda x, y: (x + F.lit(weight) * y) / (F.col(n) + F.lit(weight)))
    with_domain = with_domain.withColumn(*others("rest", "in_domain", "of_host")).withColumn("rest_n", _total(F.col("rest")))
    priors = stored(with_domain.select(F.col("host").alias("p_host"), F.col("domain").alias("p_domain"), "of_host",
                                       smoothed("rest", "rest_n", world, DOMAIN_WEIGHT).alias("of_domain")), "priors")
    j = s.join(small(priors, priors.count() * 2 * len(langs)), F.col("host").eqNullSafe(F.col("p_host")) & F.col("domain").eqNullSafe(F.col("p_domain")))
    j = j.withColumn(*others("rest", "of_host", "p")).withColumn("rest_n", _total(F.col("rest")))
    j = j.withColumn("prior", smoothed("rest", "rest_n", F.col("of_domain"), HOST_WEIGHT))

    names = F.lit(langs)
    for c in ("declared", "suffix_lang", "path_lang"):
        j = j.withColumn(f"{c}_at", F.coalesce(F.array_position(names, F.col(c)), F.lit(0)).cast("int") - 1)

    def speaks(evidence: str, i: Column, strength: float) -> Column:
        rest = float(np.log((1 - strength) / max(1, len(langs) - 1)))
        at = F.col(f"{evidence}_at")
        return F.when(at < 0, F.lit(0.0)).when(at == i, F.lit(float(np.log(strength)))).otherwise(F.lit(rest))
    post = F.transform("prior", lambda x, i: F.log(x + 1e-12) + F.get("ll", i) + speaks("declared", i, DECLARED)
                       + speaks("suffix_lang", i, ADDRESS) + speaks("path_lang", i, ADDRESS))
    j = j.withColumn("post", post).withColumn("high", F.array_max("post"))
    j = j.withColumn("best", F.array_position("post", F.col("high")).cast("int"))
    norm = F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("high")))
    return j.select(*keys, F.element_at(names, F.col("best")).alias("language"), F.round(1 / norm, 9).alias("confidence"),
                    F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int")).alias("text_language"),
                    F.round(F.element_at("prior", F.col("best")), 9).alias("host_share"))


def corpus_languages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each document and each page: kind, doc_id, page_id, language, confidence, text_language, host_share, declared.

    The text model learns from documents whose crc32 of the id, mod 5, is not 0. A document's source is its host; its own
    lang is no evidence.
    """
    learn = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = train(learn)
    none, no_id = F.lit(None).cast("string"), F.lit(None).cast("long")
    of_docs = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), no_id.alias("page_id"), F.col("text"), F.lit(False).alias("markup"),
                          F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("host"), F.lit("documents").alias("domain"),
                          none.alias("declared"), none.alias("suffix_lang"), none.alias("path_lang"))
    parts = _host_parts(F.coalesce("url", F.lit("")))
    of_pages = pages.select(F.lit("page").alias("kind"), no_id.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("html").alias("text"), F.lit(True).alias("markup"),
                            parts["host"].alias("host"), parts["domain"].alias("domain"), declared_language(F.coalesce("html", F.lit(""))).alias("declared"),
                            parts["suffix_lang"].alias("suffix_lang"), parts["path_lang"].alias("path_lang"))
    out = identify(of_docs.unionByName(of_pages), model, "markup")
    return out.select("kind", "doc_id", "page_id", "language", "confidence", "text_language", "host_share", "declared")
