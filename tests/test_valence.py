"""The rule layer of the valence scorer against a plain reading of its rules, and the shape of its plan."""

import math
import string

import pytest

from skylane.operators import common
from skylane.operators import valence as va

LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, "fine": 0.0}
TEXTS = ["A good room", "a GOOD room", "GOOD ROOM", "not good", "isn't very good!", "never so VERY good!!!!!!", "good but bad", "but good", "bad but but GREAT??",
         "very bad??? really slightly good?", "", "   ", None, "... !!! ?", "fine, (good) \"bad\"", "good\tgood\nnot\x0bnot good", "x " * 5000 + "not x x good", "É good not-good"]


def _capital(w):
    return w == w.upper() and w != w.lower()


def _plain(text):
    text = text or ""
    words = [w.strip(string.punctuation) for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ")]
    words = [w for w in words if w]
    low = [w.lower() for w in words]
    mixed = any(map(_capital, words)) and not all(map(_capital, words))
    turn = low.index("but") if "but" in low else None
    values = []
    for i, w in enumerate(low):
        v = LEXICON.get(w, 0.0)
        sign = (v > 0) - (v < 0)
        v += sign * (va.CAPITALS if mixed and _capital(words[i]) else 0)
        for k, weight in enumerate(va.DISTANCE_WEIGHTS, 1):
            if i - k < 0:
                continue
            boost = va.DEFAULT_BOOSTERS.get(low[i - k], 0.0)
            boost += ((boost > 0) - (boost < 0)) * (va.CAPITALS if mixed and _capital(words[i - k]) else 0)
            v += boost * sign * weight
            if low[i - k] in va.DEFAULT_NEGATIONS or low[i - k].endswith("n't"):
                v *= va.NEGATION
        if turn is not None and i != turn:
            v *= va.BEFORE_CONTRAST if i < turn else va.AFTER_CONTRAST
        values.append(v)
    asked = text.count("?")
    extra = min(text.count("!"), 4) * va.EXCLAMATION + (0 if asked <= 1 else asked * va.QUESTION if asked <= 3 else va.MANY_QUESTIONS)
    s = sum(values)
    s += ((s > 0) - (s < 0)) * extra
    return s, s / math.sqrt(s * s + 15)


def _rows(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "PLACE_ID long, REVIEW_INDEX long, REVIEW_TEXT string")


def test_rules_equal_the_plain_reading(spark):
    got = {r["PLACE_ID"]: r for r in va.score_rules(_rows(spark, TEXTS), LEXICON).collect()}
    assert set(got) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        s, compound = _plain(text)
        assert got[i]["VALENCE_SUM"] == pytest.approx(s, abs=1e-5), text
        assert got[i]["VADER_COMPOUND"] == pytest.approx(compound, abs=1e-4), text
        parts = got[i]["VADER_POS"] + got[i]["VADER_NEU"] + got[i]["VADER_NEG"]
        assert parts == pytest.approx(1.0, abs=2e-3) or (parts == 0 and not (text or "").strip("!?. "))


def test_rules_without_tables_null_keys_and_salted_lexicon(spark, monkeypatch):
    bare = va.score_rules(_rows(spark, ["not very good but bad"]), LEXICON, va.Rules({}, (), None)).first()
    assert bare["VALENCE_SUM"] == pytest.approx(1.9 - 2.5)
    keyless = spark.createDataFrame([(None, None, "good"), (None, None, "bad"), (1, None, "great")], "PLACE_ID long, REVIEW_INDEX long, REVIEW_TEXT string")
    assert sorted(round(r["VALENCE_SUM"], 6) for r in va.score_rules(keyless, LEXICON).collect()) == [-0.6, 3.1]
    assert va.score_rules(_rows(spark, TEXTS).limit(0), LEXICON).count() == 0
    whole = sorted(map(tuple, va.score_rules(_rows(spark, TEXTS), LEXICON).collect()))
    monkeypatch.setattr(common, "BROADCAST_VALUES", 1)
    assert sorted(map(tuple, va.score_rules(_rows(spark, TEXTS), LEXICON).collect())) == whole


def test_texts_are_not_shuffled(spark):
    plan = va.score_rules(_rows(spark, TEXTS), LEXICON)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_broadcast_bound_counts_array_values(spark):
    side, size = common.counted(spark.sql("select id, sequence(1, 1000) as a, 'abc' as s from range(10)"))
    assert size.rows == 10 and size.values == 10 * (1 + 1000 + 1)
