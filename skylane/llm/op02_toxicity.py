"""Toxicity: a linear-chain conditional random field tags toxic spans.

Token labels come from labelled documents: in a toxic document a token is toxic if its word, or a beginning of it, is much
more frequent in toxic than in clean documents and occurs in several of them; all other tokens are clean. A chain of two
states (clean, toxic) with hashed features of the word and its beginnings is trained on them by full
gradients. Forward-backward marginals of every token of a text add up to the document's score: the expected number of toxic
tokens, its rate and the highest marginal enter a logistic calibration that is fitted on out-of-fold marginals. Spans
are the tokens with a marginal of a half or more.

Only the fit uses a sample: at most TOXIC_DOCS + CLEAN_DOCS labelled documents of at most LONGEST characters each and
SAMPLE_CHARS together, read whole. Every document is scored whole. Labels are read from the rows the caller gives, and
nothing but the text is an input of a score.

Results in special cases: null and empty texts have no tokens and score as such; with no toxic (or no clean) label the score
is the smoothed share of toxic labels for all; labels that name no document are ignored, of several labels for one
document the highest counts; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import batch_bytes, fresh

#: Bounds of the sample that the model is fitted on: documents of each label, characters of one document and of all.
TOXIC_DOCS, CLEAN_DOCS, LONGEST, SAMPLE_CHARS = 1000, 1500, 60_000, 4_000_000
#: Parts of the sample whose marginals come from a chain trained on the other parts.
PARTS = 4
SEGMENT = 400
FEATURES = 1 << 18
STEPS, RATE, RIDGE = 30, 0.3, 1.5
SEED = 2
#: How many times more frequent a toxic word is in toxic documents than in clean ones.
CONTRAST = 12

_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _beginnings(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in range(3, min(len(word), 9)))]


def _features(word: str) -> list[int]:
    """Hashed features: the word and its beginnings (a fixed number; short words repeat the word)."""
    parts = [word, *(word[:n] + "-" if len(word) > n else word for n in (3, 4, 5, 6, 7))]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & (FEATURES - 1) for p in parts]


def _lae(a, b):
    return np.logaddexp(a, b)


class Chain:
    """Two states; weights of the features that speak for toxic, and the chain's log odds."""

    def __init__(self):
        self.w = np.zeros(FEATURES, dtype=np.float32)
        self.bias = -3.0
        self.t = np.array([-2.0, 0.0, 0.0, 0.0])  # clean-toxic, toxic-clean, toxic-toxic, start; clean-clean is 0

    def emission(self, features: np.ndarray) -> np.ndarray:
        return self.w[features].sum(axis=1) + self.bias

    def forward_backward(self, e: np.ndarray, first: np.ndarray, size: np.ndarray):
        """Log odds of toxic from the left (with the token) and from the right (without it), for sequences in e."""
        t01, t10, t11, start = self.t
        order = np.argsort(-size, kind="stable")
        f, n = first[order], size[order]
        active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")  # sequences longer than each place
        left, right = np.empty_like(e), np.zeros_like(e)
        for place, k in enumerate(active):
            at = f[:k] + place
            if place:
                r = left[at - 1]
                left[at] = e[at] + _lae(t01, t11 + r) - _lae(0.0, t10 + r)
            else:
                left[at] = e[at] + start
        for place in range(len(active) - 1, 0, -1):
            at = f[:active[place]] + place
            x = e[at] + right[at]
            right[at - 1] = _lae(t10, t11 + x) - _lae(0.0, t01 + x)
        return left, right

    def marginals(self, e, first, size) -> np.ndarray:
        left, right = self.forward_backward(e, first, size)
        return 1 / (1 + np.exp(-np.clip(left + right, -60, 60)))

    def fit(self, features: np.ndarray, word: np.ndarray, label: np.ndarray, first: np.ndarray, size: np.ndarray) -> Chain:
        """features: per distinct word; word: per token, its number; label: per token. Adam on the mean log likelihood."""
        place = np.arange(len(word)) - np.repeat(first, size)
        inner = np.flatnonzero(place > 0)  # tokens with a token before them
        seen = np.array([np.sum((label[inner - 1] == a) & (label[inner] == b)) for a, b in ((0, 1), (1, 0), (1, 1))], dtype=float)
        used, columns = np.unique(features, return_inverse=True)
        columns = columns.reshape(features.shape).astype(np.int32)
        w = np.zeros(len(used))
        p = np.concatenate([w, [self.bias], self.t])
        m, v = np.zeros_like(p), np.zeros_like(p)
        k = len(used)
        scale = max(1.0, label.sum())
        for step in range(1, STEPS + 1):
            self.bias, self.t = p[k], p[k + 1:]
            e = (p[:k][columns].sum(axis=1) + self.bias)[word]
            left, right = self.forward_backward(e, first, size)
            marginal = 1 / (1 + np.exp(-np.clip(left + right, -60, 60)))
            g_token = marginal - label
            g_word = np.bincount(word, weights=g_token, minlength=len(features))
            g_w = np.bincount(columns.ravel(), weights=np.repeat(g_word, columns.shape[1]), minlength=k)
            r, x = left[inner - 1], e[inner] + right[inner]
            t01, t10, t11, _ = self.t
            pair = np.stack([np.zeros(len(inner)), t01 + x, t10 + r, t11 + r + x])
            pair = np.exp(pair - pair.max(axis=0))
            pair = (pair[1:] / pair.sum(axis=0)).sum(axis=1)
            grad = np.concatenate([g_w, [g_token.sum()], pair - seen, [(marginal[first] - label[first]).sum()]])
            grad = (grad + RIDGE * p) / scale
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            p = p - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        self.w[used] = p[:k]
        self.bias, self.t = float(p[k]), p[k + 1:].copy()
        return self


def _bounds(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([s for s in sizes if s], dtype=np.int64)
    return np.cumsum(size) - size, size


def token_labels(docs: list[list[str]], toxic: list[int]) -> list[np.ndarray]:
    """Distant labels of all tokens from the documents' labels."""
    rate, support = (Counter(), Counter()), Counter()
    total = [1, 1]
    for words, y in zip(docs, toxic):
        total[y] += len(words)
        for w, n in Counter(words).items():
            for b in _beginnings(w):
                rate[y][b] += n
        if y:
            support.update({b for w in set(words) for b in _beginnings(w)})
    least = max(2, 0.01 * sum(toxic))
    cut = {}

    def is_toxic(word: str) -> bool:
        if word not in cut:
            cut[word] = any(support[b] >= least and (rate[1][b] + 0.1) / total[1] > CONTRAST * (rate[0][b] + 0.5) / total[0] for b in _beginnings(word))
        return cut[word]
    return [np.array([y and is_toxic(w) for w in words], dtype=float) for words, y in zip(docs, toxic)]


def _in_turn(toxic: list[int]) -> list[int]:
    """The part of each document: toxic and clean ones are dealt in turn."""
    seen = Counter()
    out = []
    for y in toxic:
        out.append(seen[y] % PARTS)
        seen[y] += 1
    return out


def train_chain(docs: list[list[str]], toxic: list[int]) -> Chain:
    labels = token_labels(docs, toxic)
    number: dict[str, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for d in docs for w in d), dtype=np.int32)
    label = np.concatenate([*labels, np.zeros(0)])
    sizes = [min(SEGMENT, len(d) - a) for d in docs for a in range(0, len(d), SEGMENT)]
    if not len(word) or not label.any():
        return Chain()
    return Chain().fit(np.array([_features(w) for w in number], dtype=np.int32), word, label, *_bounds(sizes))


class _Emissions(dict):
    """word -> log odds, computed when first met."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.w, self.bias = chain.w, chain.bias

    def __missing__(self, word: str) -> float:
        value = float(self.w[_features(word)].sum()) + self.bias
        if len(self) < 300_000:
            self[word] = value
        return value


def text_marginals(chain: Chain, docs: list[list[str]], known: _Emissions) -> list[np.ndarray]:
    sizes = [len(d) for d in docs]
    e = np.array([x for d in docs for x in map(known.__getitem__, d)], dtype=np.float64)
    if not len(e):
        return [np.zeros(0) for _ in docs]
    m = chain.marginals(e, *_bounds(sizes))
    return np.split(m, np.cumsum(sizes)[:-1])


def summary(m: np.ndarray) -> tuple[float, float, float]:
    total = float(m.sum())
    return math.log(total + 0.02), math.log((total + 0.02) / (len(m) + 20)), float(m.max()) if len(m) else 0.0


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression with a ridge, by Newton's method: mean, deviation and coefficients."""
    mean, dev = np.average(x, axis=0, weights=weight), x.std(axis=0) + 1e-6
    z = np.c_[(x - mean) / dev, np.ones(len(x))]
    b = np.zeros(z.shape[1])
    ridge = np.diag([*[0.1] * x.shape[1], 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge @ b
        h = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge
        b -= np.clip(np.linalg.solve(h, grad), -3, 3)
    return mean, dev, b


class Model:
    """A chain and the calibration of its document sums."""

    def __init__(self, sample: list[tuple[str, int]], n_toxic: int, n_clean: int):
        seen: dict[str, str] = {}  # one string per distinct word
        docs, toxic = [[seen.setdefault(w, w) for w in tokens(t)] for t, _ in sample], [y for _, y in sample]
        self.share = (n_toxic + 1) / (n_toxic + n_clean + 2)
        self.chain = None
        if 0 < sum(toxic) < len(toxic):
            x = np.zeros((len(docs), 3))
            dealt = _in_turn(toxic)
            for part in range(PARTS):  # each part is summed up by the chain of the others
                mine = [i for i in range(len(docs)) if dealt[i] != part]
                chain = train_chain([docs[i] for i in mine], [toxic[i] for i in mine])
                other = [i for i in range(len(docs)) if dealt[i] == part]
                for i, m in zip(other, text_marginals(chain, [docs[i] for i in other], _Emissions(chain))):
                    x[i] = summary(m)
            y = np.array(toxic, dtype=float)
            clean_weight = (n_clean / max(1, n_toxic)) / ((len(y) - y.sum()) / y.sum())
            self.mean, self.dev, self.b = _calibrate(x, y, np.where(y > 0, 1.0, clean_weight))
            self.chain = train_chain(docs, toxic)

    def scores(self, docs: list[list[str]], known: _Emissions | None) -> tuple[np.ndarray, list[np.ndarray]]:
        if self.chain is None:
            return np.full(len(docs), self.share), [np.zeros(len(d)) for d in docs]
        m = text_marginals(self.chain, docs, known)
        x = np.array([summary(v) for v in m]).reshape(-1, 3)
        z = np.c_[(x - self.mean) / self.dev, np.ones(len(x))] @ self.b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), m


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS,
        longest: int = LONGEST, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample, in the order of a hash of the id, of the labelled documents. labels: doc_id, toxic."""
    named = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = F.length(F.coalesce(text, F.lit("")))
    own = named.join(docs.where(size <= longest).select("doc_id"), "doc_id", "left_semi")
    counts = {int(r["toxic"]): r["count"] for r in own.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    order = F.xxhash64(F.lit(SEED), "doc_id")
    picked = (own.where("toxic > 0").orderBy(order, "doc_id").limit(toxic_docs)
              .unionByName(own.where("toxic <= 0").orderBy(order, "doc_id").limit(clean_docs)))
    # at most toxic_docs + clean_docs rows of at most ``longest`` characters, of which ``sample_chars`` come to the driver
    rows = (docs.where(size <= longest).select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
            .join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    upto = F.sum(F.length("text")).over(Window.orderBy(order, "doc_id"))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= sample_chars).orderBy("upto", order, "doc_id").collect()
    return Model([(r["text"], int(r["toxic"] > 0)) for r in rows], counts.get(1, 0), counts.get(0, 0))


def spans(text: str, m: np.ndarray) -> str:
    """Offsets in the given text of the tokens with a marginal of a half or more, neighbours joined: ``start-end,start-end``."""
    out: list[list[int]] = []
    last = -2
    lowered = text.lower()
    # a character may become several in lower case; at[k] is where the k-th of the lowered text stands in the given one
    at = range(len(text)) if len(lowered) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    for i, found in enumerate(_TOKEN.finditer(lowered)):
        if m[i] >= 0.5:
            start, end = at[found.start()], at[found.end() - 1] + 1
            if last == i - 1:
                out[-1][1] = end
            else:
                out.append([start, end])
            last = i
    return ",".join(f"{a}-{b}" for a, b in out)


#: Tokens that are scored together.
TOGETHER = 1_000_000


def with_scores(docs: DataFrame, model: Model, text: str = "text", prefix: str = "tox_") -> DataFrame:
    """``docs`` with <prefix>score, <prefix>spans (offsets in the given text) and <prefix>tokens (expected toxic tokens)."""
    batch_bytes(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights, whatever the corpus
    new = [prefix + c for c in ("score", "spans", "tokens")]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(new, (T.DoubleType(), T.StringType(), T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = _Emissions(model.chain) if model.chain else None
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            a = 0
            while a < len(texts):
                docs_, n, z = [], 0, a
                while z < len(texts) and (n < TOGETHER or z == a):
                    docs_.append(tokens(texts[z]))
                    n += len(docs_[-1])
                    z += 1
                s, m = model.scores(docs_, known)
                marked = [spans(t, v) if len(v) and v.max() >= 0.5 else "" for t, v in zip(texts[a:z], m)]
                expected = pa.array([float(v.sum()) for v in m], pa.float64())
                yield pa.RecordBatch.from_arrays([*b.slice(a, z - a).columns, pa.array(s), pa.array(marked, pa.string()), expected],
                                                 [*b.schema.names, *new])
                a = z
    return docs.mapInArrow(run, schema)


def training_fold(labels: DataFrame) -> DataFrame:
    """The rows that may be learnt from: crc32 of the id as text, mod 5, is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans, toxic_tokens."""
    model = fit(docs, training_fold(labels), text)
    scored = with_scores(docs.select("doc_id", F.col(text).alias("text")), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("tox_score").alias("score"),
                         (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.col("tox_spans").alias("spans"),
                         F.col("tox_tokens").alias("toxic_tokens"))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that score below a half; columns as given."""
    model = fit(docs, training_fold(labels), text)
    p = fresh(docs, "tox_")
    return with_scores(docs, model, text, p).where(F.col(f"{p}score") < 0.5).select(*docs.columns)
