"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A document's features are its words, pairs of neighbouring words (one feature for all words that follow themselves) and the character n-grams of its words (between ``<`` and
``>``), all hashed into BUCKETS vectors of DIM numbers. The document is the mean of its features' vectors; a softmax over
the labels stands on that mean. Vectors and output are learnt together by stochastic gradient descent in numpy.

As the output is linear in the mean, the learnt vectors are folded into the output's weights: what the tasks get is one
number per bucket and label, whatever the corpus, and a document's logits are the mean of its features' numbers. A word's
features are added up once and kept, so a text costs a look-up per word.

Only the fit uses a sample: at most DOCS_PER_LABEL labelled documents of each label, of at most LONGEST characters each and
SAMPLE_CHARS together, in the order of a hash of the id, read whole; each label counts by its share of all labelled rows.
It runs as one task over that bound, so a lost executor repeats it. Every document is scored whole.

Results in special cases: null and empty texts have no features and score as the output's own bias; a text of one very long
word has that word's features; with one label only, or none, the score is the smoothed share of label 1 for all; labels
that name no document are ignored, of several labels for one document the highest counts, of several texts the smallest;
rows with the same text score alike, whatever their id; an empty table gives an empty result; further columns are ignored by
``quality`` and kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_bytes, fresh, stored, together

#: Bounds of the sample that the model is fitted on.
DOCS_PER_LABEL, LONGEST, SAMPLE_CHARS = 1500, 40_000, 5_000_000
BUCKETS, DIM = 1 << 17, 16
#: Lengths of the character n-grams.
GRAMS = (2, 3, 4)
EPOCHS, BATCH, RATE = 6, 4, 0.7
#: Few documents are gone through more often, until there were so many steps.
LEAST_STEPS = 2000
SEED = 11
THRESHOLD = 0.3
#: Words whose features are kept by a task, and characters that are scored together.
KNOWN_WORDS, BLOCK_CHARS = 300_000, 2_000_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _M2
    return ((h ^ (h >> np.uint64(29))) % np.uint64(buckets)).astype(np.int32)


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def word_features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word and of its character n-grams, word after word, and how many each word has."""
    marked = "".join(f"<{w}>" for w in words)
    c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    room = np.repeat(first + size, size) - np.arange(len(c))  # characters from here to the word's end
    found = [_bucket(np.array([word_hash(w) for w in words], dtype=np.uint64) + _M1, buckets)]
    whose = [np.arange(len(words))]
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, max(GRAMS) + 1):
            at = np.flatnonzero(room >= n)
            h[at] = h[at] * _M1 + c[at + n - 1] + np.uint64(n)
            if n in GRAMS:
                found.append(_bucket(h[at], buckets))
                whose.append(owner[at])
    found_, whose_ = np.concatenate(found), np.concatenate(whose)
    by = np.argsort(whose_, kind="stable")
    return found_[by], np.bincount(whose_, minlength=len(words))


def pair_features(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of neighbouring words; a word that follows itself is the same feature whatever the word."""
    with np.errstate(over="ignore"):
        pairs = hashes[:-1] * _M2 + hashes[1:] * _M1
    return _bucket(np.where(hashes[:-1] == hashes[1:], _M2, pairs), buckets)


def document_features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and each one's share of all its features."""
    if not words:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    own = sorted(set(words))
    number = {w: i for i, w in enumerate(own)}
    at = np.array([number[w] for w in words])
    found, size = word_features(own, buckets)
    hashes = np.array([word_hash(w) for w in own], dtype=np.uint64)
    pairs = pair_features(hashes[at], buckets)
    weight = np.concatenate([np.repeat(np.bincount(at, minlength=len(own)), size), np.ones(len(pairs), dtype=np.int64)])
    buckets_, place = np.unique(np.concatenate([found, pairs]), return_inverse=True)
    share = np.bincount(place, weights=weight) / weight.sum()
    return buckets_, share.astype(np.float32)


class Embeddings:
    """Vectors of the buckets, output weights and biases of the labels."""

    def __init__(self, labels: int, buckets: int = BUCKETS, dim: int = DIM, seed: int = SEED):
        self.rng = np.random.default_rng(seed)
        self.vectors = self.rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.out = np.zeros((dim, labels), dtype=np.float32)
        self.bias = np.zeros(labels, dtype=np.float32)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS,
            batch: int = BATCH, rate: float = RATE) -> Embeddings:
        """Mini-batches in a random order; the rate falls to zero. A vector's step is scaled by the number of its document's features, as
        each one's share of the mean shrinks with them."""
        epochs = max(epochs, -(-LEAST_STEPS * batch // max(len(docs), 1)))
        step, steps = 0, epochs * -(-len(docs) // batch)
        for _ in range(epochs):
            order = self.rng.permutation(len(docs))
            for a in range(0, len(docs), batch):
                rows = [int(i) for i in order[a:a + batch] if len(docs[i][0])]
                now = rate * (1 - step / steps)
                step += 1
                if not rows:
                    continue
                mean = np.array([docs[i][1] @ self.vectors[docs[i][0]] for i in rows])
                z = mean @ self.out + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), label[rows]] -= 1
                p *= weight[rows][:, None]
                back = p @ self.out.T  # per document, by its mean
                self.out -= now * (mean.T @ p) / len(rows)
                self.bias -= now * p.mean(axis=0)
                for i, g in zip(rows, back):
                    at, part = docs[i]
                    self.vectors[at] -= (now * len(at) * part / len(rows))[:, None] * g
        return self

    def folded(self) -> np.ndarray:
        """Per bucket and label, its vector's part of the label's logit."""
        return self.vectors @ self.out


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Vocabulary:
    """The words a task has met: a number, the hash, how many features, and the sums of their weights."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.hash, self.size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.total = np.zeros((0, self.weights.shape[1]))

    def numbers(self, texts: list[list[str]]) -> np.ndarray:
        """The numbers of all words of the texts, one after another; words not met before are added."""
        if len(self.number) > KNOWN_WORDS:
            self.clear()
        n = len(self.number)
        found = np.fromiter((self.number[w] for t in texts for w in t), dtype=np.int64, count=sum(map(len, texts)))
        new = list(self.number)[n:] if len(self.number) > n else []
        for a in range(0, len(new), 20_000):
            part = new[a:a + 20_000]
            at, size = word_features(part, len(self.weights))
            total = np.add.reduceat(self.weights[at], np.cumsum(size) - size, axis=0)
            self.hash = np.concatenate([self.hash, np.array([word_hash(w) for w in part], dtype=np.uint64)])
            self.size, self.total = np.concatenate([self.size, size]), np.concatenate([self.total, total])
        return found


class Model:
    """Folded weights and biases (None: one label only), and the smoothed share of label 1."""

    def __init__(self, weights: np.ndarray | None, bias: np.ndarray | None, share: float):
        self.weights, self.bias, self.share = weights, bias, share

    def vocabulary(self) -> Vocabulary | None:
        return None if self.weights is None else Vocabulary(self.weights.astype(np.float64))

    def scores(self, texts: list[str], known: Vocabulary | None) -> np.ndarray:
        """P(label 1) of each text; ``known`` carries the words met so far from call to call."""
        if self.weights is None:
            return np.full(len(texts), self.share)
        words = [t.split() for t in texts]
        size = np.array([len(d) for d in words], dtype=np.int64)
        word = known.numbers(words)
        doc = np.repeat(np.arange(len(texts)), size)
        inner = np.flatnonzero(doc[1:] == doc[:-1])  # words that one of the same text follows
        pairs = pair_features(known.hash[word], len(self.weights))[inner] if len(word) else inner
        n = np.bincount(doc, weights=known.size[word], minlength=len(texts)) + np.maximum(size - 1, 0)
        z = [np.bincount(doc, weights=known.total[word, k], minlength=len(texts))
             + np.bincount(doc[inner], weights=known.weights[pairs, k], minlength=len(texts)) for k in (0, 1)]
        logit = (z[1] - z[0]) / np.maximum(n, 1) + float(self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def learn(texts: list[str], label: np.ndarray, weight: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    docs = [document_features(t.split(), buckets) for t in texts]
    model = Embeddings(2, buckets).fit(docs, label, weight.astype(np.float32))
    return model.folded(), model.bias


def in_training(doc_id: Column) -> Column:
    """Whether a document's label may be learnt from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", per_label: int = DOCS_PER_LABEL,
        longest: int = LONGEST, sample_chars: int = SAMPLE_CHARS, buckets: int = BUCKETS) -> Model:
    """Fit on a bounded sample of the labelled documents. labels: doc_id and the label (above 0: 1)."""
    spark = docs.sparkSession
    named = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg((F.max(label) > 0).cast("int").alias("y")))
    given = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    # ids and sizes first: the texts of the chosen ones alone are shuffled
    sized = stored(given.select("doc_id", F.length("text").alias("chars")).join(named, "doc_id").groupBy("doc_id", "y")
                   .agg(F.max("chars").alias("chars")), "labelled")
    all_of = {r["y"]: r["count"] for r in sized.groupBy("y").count().collect()}
    share = (all_of.get(1, 0) + 1) / (sum(all_of.values()) + 2)
    order = F.xxhash64(F.lit(SEED), "doc_id")
    short = sized.where(F.col("chars") <= longest)
    picked = [r for y in (0, 1) for r in short.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_label).collect()]
    by_label = [[r for r in picked if r["y"] == y] for y in (0, 1)]
    rows = []
    for of in by_label:  # half of the characters for each label
        n = 0
        for r in of:
            n += r["chars"]
            if n > sample_chars // 2:
                break
            rows.append((r["doc_id"], r["y"]))
    used = [sum(y == k for _, y in rows) for k in (0, 1)]
    if not all(used):
        return Model(None, None, share)
    weight = [all_of[k] / sum(all_of.values()) * len(rows) / used[k] for k in (0, 1)]
    ids = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("y", T.IntegerType())]))
    chosen = given.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def train(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("doc_id")
        y = sample["y"].to_numpy()
        folded, bias = learn(sample["text"].tolist(), y, np.array(weight)[y], buckets)
        return pd.DataFrame({"weights": [folded.astype(np.float32).tobytes()], "bias": [bias.astype(np.float32).tobytes()]})
    r = chosen.groupBy(F.lit(0).alias("all")).applyInPandas(train, "weights binary, bias binary").first()
    return Model(np.frombuffer(r["weights"], dtype=np.float32).reshape(buckets, 2), np.frombuffer(r["bias"], dtype=np.float32), share)


def with_scores(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score in a new column."""
    batch_bytes(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two numbers a bucket, whatever the corpus
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = model.vocabulary()
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            score = [np.zeros(0)]
            for a, z in together([len(t) for t in texts], BLOCK_CHARS):
                score.append(model.scores(texts[a:z], known))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(score))], [*b.schema.names, column])
    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.where(in_training(F.col("doc_id"))), text)
    scored = with_scores(docs.select("doc_id", F.col(text).alias("text")), model)
    held = F.coalesce(~in_training(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold; columns as given."""
    model = fit(docs, labels.where(in_training(F.col("doc_id"))), text)
    column = fresh(docs, "score_") + "of"
    return with_scores(docs, model, text, column).where(F.col(column) >= threshold).select(*docs.columns)
