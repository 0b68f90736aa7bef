"""Review extraction, lexicon, valence and topic edges."""

import math

from skylane.operators import text as tx


def _listings(spark, texts):
    rows = [(i, f"h{i}", "M", "Mid-Range", 4.0, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "PLACE_ID long, NAME string, MARKET string, PRICE_TIER string, RATING double, REVIEW_TEXTS string")


def test_extract_reviews_strips_and_indexes_after_dropping(spark):
    df = _listings(spark, ["a||| |||b", "   ", None, "\tpadded\t ||| x ", "one"])
    got = sorted((r["PLACE_ID"], r["REVIEW_INDEX"], r["REVIEW_TEXT"]) for r in tx.extract_reviews(df).collect())
    assert got == [(0, 0, "a"), (0, 1, "b"), (3, 0, "padded"), (3, 1, "x"), (4, 0, "one")]


def test_lexicon_default_words_and_unicode(spark):
    df = spark.createDataFrame([("Great room, but NOISY and small",), ("ébad food",), ("nothing here",), ("good good bad",)],
                               "REVIEW_TEXT string")
    got = [(r["VADER_COMPOUND"], r["SENTIMENT_LABEL"]) for r in tx.score_lexicon(df).collect()]
    assert got[0] == (-1 / 3, "Negative")
    assert got[1] == (0.0, "Neutral")           # "ébad" is one word, not "bad"
    assert got[2] == (0.0, "Neutral")
    assert got[3] == (0.0, "Neutral")           # distinct words: good vs bad


def test_valence_normalisation(spark):
    df = spark.createDataFrame([("the the of",), ("zzz",)], "REVIEW_TEXT string")
    got = [r["VADER_COMPOUND"] for r in tx.score_valence(df, {"the": 1.0, "of": -1.0}).collect()]
    assert got[0] == 1 / math.sqrt(1 + 15) and got[1] == 0.0


def test_topic_substring_and_primary(spark):
    df = spark.createDataFrame([("a nice place",), ("barely clean room",), ("nothing",)], "REVIEW_TEXT string")
    out = tx.topic_flags(df).collect()
    assert out[0]["TOPIC_AMENITIES"] == 1 and out[0]["PRIMARY_TOPIC"] == "amenities"   # "place" contains "ac"
    assert out[1]["TOPIC_FOOD_DINING"] == 1 and out[1]["PRIMARY_TOPIC"] == "room_quality"
    assert out[2]["PRIMARY_TOPIC"] == "general"


def test_rating_alignment_first_non_null_rating(spark):
    rows = [(1, "h", "M", None, 0, "great"), (1, "h", "M", 4.0, 1, "bad"), (1, "h", "M", 4.0, 2, "bad bad"),
            (2, "k", "M", 3.4, 0, "great"), (3, "z", "M", 3.4, 0, "great bad good")]
    df = spark.createDataFrame(rows, "PLACE_ID long, HOTEL_NAME string, MARKET string, RATING double, REVIEW_INDEX long, REVIEW_TEXT string")
    out = {r["PLACE_ID"]: r for r in tx.rating_alignment(tx.score_lexicon(df)).collect()}
    assert out[1]["GOOGLE_RATING"] == 4.0 and out[1]["MISMATCH"] == "HighRating_NegSent"
    assert out[2]["MISMATCH"] == "LowRating_PosSent"
    assert abs(out[3]["AVG_SENTIMENT"] - 1 / 3) < 1e-15 and out[3]["MISMATCH"] == "LowRating_PosSent"


def test_group_mean_is_exact(spark):
    texts = ["good great bad"] * 3 + ["bad"] * 7       # compounds 1/3 and -1
    df = spark.createDataFrame([("M", t) for t in texts], "MARKET string, REVIEW_TEXT string")
    r = tx.aggregate_sentiment(tx.score_lexicon(df), "MARKET").first()
    assert r["AVG_COMPOUND"] == -0.6 and r["REVIEW_COUNT"] == 10
    assert r["PCT_POSITIVE"] == 30.0 and r["PCT_NEGATIVE"] == 70.0


def test_rating_alignment_thresholds(spark):
    # rating 4.0 with a negative mean; 3.4 with a mean just above / at 0.3 (strict >)
    from pyspark.sql import functions as F
    rows = [(1, 4.0, -0.2), (2, 3.4, 0.31), (3, 3.4, 0.30), (4, None, -1.0)]
    df = spark.createDataFrame([(p, f"h{p}", "M", r, 0, "x", c) for p, r, c in rows],
                               "PLACE_ID long, HOTEL_NAME string, MARKET string, RATING double, REVIEW_INDEX long, "
                               "REVIEW_TEXT string, VADER_COMPOUND double")
    out = {r["PLACE_ID"]: r["MISMATCH"] for r in tx.rating_alignment(df).collect()}
    assert out == {1: "HighRating_NegSent", 2: "LowRating_PosSent", 3: "Aligned", 4: "Aligned"}
