"""Classifier, periodic runs and importance resampling against plain readings of their contracts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from skylane.llm import op07_mixing, op09_jaccard, op11_classifier, op12_runs, op13_importance

from . import fixtures as X


@pytest.fixture(scope="module")
def docs(spark):
    from skylane.session import prepare
    prepare(spark)
    return X.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], X.DOCS)


# --- classifier


def labelled():
    rng = random.Random(4)
    data, labels = [], []
    for i in range(200):
        good = i % 4 > 0
        w = X.words(40, 3000 + i).split()
        if not good:
            w = [[v + "###" for v in w], [v for v in w[:10] for _ in range(5)]][i // 4 % 2]
        data.append((i, " ".join(w), rng.choice("ab"), "s", 1))
        labels.append((i, int(good)))
    return data, labels


def test_classifier(spark, empty):
    data, labels = labelled()
    extra = [(500, None, None, None, None), (501, "", "en", "s", 0), (502, "x" * 30_000, "en", "s", 1), (503, X.words(60_000, 8, 300), "en", "s", 1),
             (None, X.words(30, 9), "en", "s", 1), data[0], data[0], (504, data[1][1], "zz", None, None)]
    table = X.clashing(spark.createDataFrame(data + extra, X.DOCS).repartition(3))
    given = spark.createDataFrame([*labels, (None, 1), (5000, 0), (7, None), (5, 1), (5, 0)], "doc_id long, quality int")
    got = op11_classifier.quality(table, given).collect()
    assert len(got) == len(data) + len(extra)
    by = {r["doc_id"]: r for r in got}
    for i, good in labels:
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert by[i]["predicted"] == good == int(by[i]["score"] >= 0.3)
    assert all(0 <= r["score"] <= 1 for r in got) and by[500]["score"] == by[501]["score"]
    assert by[504]["score"] == pytest.approx(by[1]["score"], abs=1e-12) and len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    assert by[503]["predicted"] == 1 and by[None]["predicted"] == 1 and by[None]["held_out"] is False
    kept = op11_classifier.keep_good(table, given)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id < 500").collect()) == [i for i, good in labels if good]
    assert op11_classifier.quality(empty, given).count() == 0
    assert {r["score"] for r in op11_classifier.quality(table, given.limit(0)).collect()} == {0.5}
    assert {r["predicted"] for r in op11_classifier.quality(table, given.where("quality = 1")).collect()} == {1}


def test_classifier_features_and_folding():
    """Features and scores against a plain reading: grams between < and >, words, pairs; the mean of vectors, a softmax."""
    buckets = 1 << 10
    words = ["ab", "ab", "c"]
    at, share = op11_classifier.document_features(words, buckets)
    want = {}
    for w in words:
        found, _ = op11_classifier.word_features([w], buckets)
        marked = f"<{w}>"
        assert len(found) == 1 + sum(max(0, len(marked) - n + 1) for n in op11_classifier.GRAMS)
        for b in found.tolist():
            want[b] = want.get(b, 0) + 1
    hashes = np.array([op11_classifier.word_hash(w) for w in words], dtype=np.uint64)
    for b in op11_classifier.pair_features(hashes, buckets).tolist():
        want[b] = want.get(b, 0) + 1
    assert dict(zip(at.tolist(), share.tolist())) == pytest.approx({b: n / sum(want.values()) for b, n in want.items()})
    model = op11_classifier.Embeddings(2, buckets)
    model.fit([(at, share), op11_classifier.document_features(["d", "e"], buckets)], np.array([1, 0]), np.ones(2, dtype=np.float32))
    z = (share @ model.vectors[at]) @ model.out + model.bias
    folded = op11_classifier.Model(model.folded(), model.bias, 0.5)
    got = folded.scores(["ab\tab  c", "", "d e"], folded.vocabulary())
    assert got[0] == pytest.approx(1 / (1 + math.exp(z[0] - z[1])), rel=1e-4) and got[0] > 0.9 and got[2] < 0.1


def test_classifier_held_out(spark, sf_small):
    """Held-out documents of the given tables are ranked as their labels say."""
    sf = sf_small.replace("0.001", "0.01")
    given = spark.read.parquet(f"{sf}/labels.parquet")
    got = op11_classifier.quality(spark.read.parquet(f"{sf}/documents.parquet"), given).where("held_out").join(given, "doc_id").collect()
    bad = [r["score"] for r in got if not r["quality"]]
    good = [r["score"] for r in got if r["quality"]]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.98
    assert sum(r["predicted"] for r in got if r["quality"]) >= 0.97 * len(good)


# --- periodic runs


def brute_runs(w, least=6, exponent=4):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, exponent * q) and all(any(w[x] != w[x + d] for x in range(i, i + n - d)) for d in range(1, q)):
                out.add((i, n, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_planted(w, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w and doc_id is not None:
        g, n, w = h // 10, len(w), list(w)
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def runs_want(doc_id, text):
    w = brute_planted(X.split_words(text), doc_id)
    found = brute_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    keep = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(keep))]
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest, len(w))


def test_runs(spark, docs, empty):
    rows = X.rows()
    texts = ["x " * 300, "a b " * 2 + "c", "a a a a a a", "a a a a a", "a b c " * 4, "a b a b a b a c " * 3, "u v " * 50 + "w " * 50, "ab ab " * 9 + "\x1c \x1c " * 8]
    tens = [i for i in range(2000, 4000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    more = [(i, X.words(3 + 11 * k, i, 5 + k), "en", "s", 1) for k, i in enumerate(tens)] + [(5000 + i, t, None, None, None) for i, t in enumerate(texts)]
    more += [(tens[0], None, "en", "s", 0), (tens[1], "", "en", "s", 0), more[0], more[0]]
    table = docs.unionByName(spark.createDataFrame(more, X.DOCS))
    got = [tuple(r) for r in op12_runs.runs(X.clashing(table), change=op12_runs.planted).collect()]
    assert X.by_repr(got) == X.by_repr(runs_want(*r[:2]) for r in rows + more)
    assert sum(r[1] > 0 for r in got) > 20
    assert op12_runs.runs(empty).count() == 0


@pytest.mark.parametrize("exponent", [2, 3, 4, 6])
def test_maximal_pairs_are_the_runs(exponent):
    rng = random.Random(exponent)
    for _ in range(120):
        texts = []
        for _ in range(rng.randrange(1, 7)):
            pool, w, size = rng.choice([1, 2, 2, 3, 5, 40]), [], rng.randrange(120)
            while len(w) < size:
                unit = [b"%d" % rng.randrange(pool) for _ in range(rng.randrange(1, 9))]
                w += (unit * rng.randrange(1, 14))[:rng.randrange(1, 70)] if rng.random() < 0.5 else unit
            texts.append(w)
        assert op12_runs.runs_of(texts, None, 6, exponent) == [brute_runs(w, 6, exponent) for w in texts]


def test_very_long_repetitions_take_little_time():
    assert op12_runs.runs_of([[b"x"] * 200_000, [b"%d" % (i % 97) for i in range(200_000)]]) == [[(0, 200_000, 1)], [(0, 200_000, 97)]]


def test_collapse(spark, empty):
    table = X.clashing(spark.createDataFrame([(1, "a  b\n" + "c d " * 5, "en", "s", 1), (2, "no  runs\there", "en", "s", 1), (3, None, None, None, None)], X.DOCS))
    got = {r["doc_id"]: r for r in op12_runs.collapse(table).collect()}
    assert got[1]["text"] == "a b c d" and [tuple(s) for s in got[1]["run_spans"]] == [(2, 10, 2)]
    assert got[2]["text"] == "no  runs\there" and got[2]["run_spans"] == [] and got[3]["text"] is None
    assert op12_runs.collapse(empty).count() == 0


# --- importance resampling


def crcs(text, longest=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", X.ascii_lower(text))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) for i in range(len(w)) for n in range(1, longest + 1) if i + n <= len(w)]


def resampling_want(rows, target, longest=2, buckets=10_000, percent=25, least=20):
    corpus, like = [0] * buckets, [0] * buckets
    found = [(i, *crcs(t, longest)) for i, t in rows]
    for _, _, f in found:
        for c in f:
            corpus[c % buckets] += 1
    for t in target:
        for c in crcs(t, longest)[1]:
            like[c % buckets] += 1
    s, t = sum(corpus), sum(like)
    gain = [math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(corpus, like)]
    out = []
    for i, n, f in found:
        weight = sum(gain[c % buckets] for c in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2], r[5]))
    for k in range(percent * len(able) // 100):
        able[k][4] = k + 1
    return [tuple(r) for r in out]


def test_resampling(spark, docs, empty):
    rows = [(r[0], r[1]) for r in X.rows()]
    target = ["w1 w2 w3, w4-w5", None, "", "The same OLD line w7 w7 w8", "straße 日本語"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, weight int")
    got = [tuple(r) for r in op13_importance.weighed(X.clashing(docs), bench).collect()]
    assert X.by_repr(got) == X.by_repr(resampling_want(rows, target))
    three = op13_importance.weighed(docs, bench, longest=3, buckets=70_000, percent=60, least_words=3)
    assert X.by_repr(tuple(r) for r in three.collect()) == X.by_repr(resampling_want(rows, target, 3, 70_000, 60, 3))
    drawn = op13_importance.resample(X.clashing(docs), bench)
    assert drawn.columns == X.clashing(docs).columns
    assert {r["doc_id"] for r in drawn.collect()} == {r[0] for r in got if r[4]} - {None}
    assert op13_importance.weighed(empty, bench).count() == 0
    none = [tuple(r) for r in op13_importance.weighed(docs, bench.limit(0)).collect()]
    assert X.by_repr(none) == X.by_repr(resampling_want(rows, []))


# --- earlier operators: repeatable mixes, linear rows in large groups of near copies


def test_mix_of_rows_with_one_key_agrees_in_every_layout(spark, docs):
    rows = [(1, f"{w} b c d e", "en", "a", i) for i, w in enumerate("pqrstuv")] + [(2, "x y z " * 40, "en", "b", 1), (3, "k l", "en", "c", 1)]
    got = []
    for parts, seed in ((1, 0), (3, 1), (7, 2)):
        table = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), X.DOCS).repartition(parts)
        got.append(X.by_repr(tuple(r) for r in op07_mixing.mixed_documents(table).collect()))
    assert got[0] == got[1] == got[2] and len({r[1] for r in got[0] if r[0] == 1}) > 1


def near_copies(n, seed=1):
    """Copies of a base text with one to three words changed: some link, others miss the similarity by little."""
    rng, base = random.Random(seed), X.words(90, 4242, 10**6).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice((1, 2, 2, 3, 3))):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        out.append((i, " ".join(w), "en", "a", 1))
    return out


def test_large_groups_of_near_copies_take_linear_rows(spark, docs, monkeypatch):
    made = []
    deal = op09_jaccard.dealt_members

    def counted(many):
        dealt = deal(many)
        made.append(dealt.count())
        return dealt
    monkeypatch.setattr(op09_jaccard, "dealt_members", counted)
    sizes = (800, 4000)
    for n in sizes:
        assert op09_jaccard.linked(spark.createDataFrame(near_copies(n), X.DOCS).repartition(3)).count() == n
    assert 0 < made[1] <= 1.2 * made[0] * sizes[1] / sizes[0], made


def test_large_groups_in_several_blocks(spark, docs, monkeypatch):
    from .test_operators import component_ids
    monkeypatch.setattr(op09_jaccard, "BLOCK_SHINGLES", 5_000)
    data = near_copies(300)
    got = op09_jaccard.linked(spark.createDataFrame(data, X.DOCS).repartition(3)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((a, c) for a, _, c in component_ids(data))


def test_sources_in_ranges_get_the_targets_of_water(spark, monkeypatch):
    from skylane.llm import op07_mixing

    from .test_operators import water
    sizes = {f"s{i:04d}": (i * 7919) % 1000 + (100_000 if i == 17 else 0) for i in range(2000)} | {None: 50}
    units = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, rows long").repartition(5)
    want = water(sizes)
    one = {r["source"]: (r["source_size"], r["target"]) for r in op07_mixing.targets(units).collect()}
    monkeypatch.setattr(op07_mixing, "SOURCES_A_TASK", 100)
    many = {r["source"]: (r["source_size"], r["target"]) for r in op07_mixing.targets(units).collect()}
    assert one == many and set(one) == set(sizes)
    assert all(one[s][0] == sizes[s] and abs(one[s][1] - want[s]) < 1e-6 * max(want[s], 1) for s in sizes)
    plan = op07_mixing.targets(units)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition, ENSURE_REQUIREMENTS" not in plan.split("Subquery")[0] and "Window" in plan
    assert op07_mixing.targets(units.limit(0)).count() == 0


def test_toxic_spans_are_offsets_of_the_given_text():
    import numpy as np

    from skylane.llm import op02_toxicity
    for text in ("İİİ idiot", "an idiot", "İdiot", "x İ", "ΑΣ idiot\tİ idiot"):
        found = op02_toxicity.tokens(text)
        for i, token in enumerate(found):
            a, z = map(int, op02_toxicity.spans(text, np.eye(len(found))[i]).split("-"))
            assert set(text[a:z].lower()) >= set(token), (text, token)
    text = "İİİ you idiot scum"
    marks = np.array([t in ("idiot", "scum") for t in op02_toxicity.tokens(text)], dtype=float)
    a, z = map(int, op02_toxicity.spans(text, marks).split("-"))
    assert text[a:z] == "idiot scum"
