"""Review text mining and sentiment.

All text work is JVM-side column expressions over whole texts: ``split`` +
``transform``/``filter`` + ``posexplode`` for packed reviews, tokenisation with
``split`` on non-word runs, lexicon matching with ``array_intersect`` or a join
of tokens to a lexicon table, substring topic flags
with ``contains``. Aggregations are ordinary ``groupBy`` with partial
aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import np_round, to_double
from ..sources.io import require_columns
from .common import BROADCAST_ROWS

# Default lexicon of the word-set scorer.
POSITIVE_WORDS = ("good", "great", "amazing", "perfect", "clean", "friendly", "best", "beautiful")
NEGATIVE_WORDS = ("bad", "terrible", "overpriced", "noisy", "small", "worst", "dirty", "uncomfortable")
# Default topic keywords, in declared order (matching is substring on lower-case text).
TOPIC_KEYWORDS = {
    "location": ["location", "near", "close", "walkable", "subway", "access"],
    "service": ["service", "staff", "friendly", "helpful", "concierge", "reception"],
    "price_value": ["price", "value", "expensive", "overpriced", "cheap", "budget", "worth"],
    "room_quality": ["room", "bed", "bathroom", "clean", "small", "spacious", "comfortable"],
    "food_dining": ["food", "breakfast", "buffet", "restaurant", "bar"],
    "amenities": ["pool", "gym", "spa", "wifi", "ac", "parking"],
    "views_ambiance": ["view", "views", "skyline", "stunning", "beautiful", "sunset"],
}
# Label thresholds, valence normalisation constant, mismatch rules.
POS_THRESHOLD, NEG_THRESHOLD = 0.05, -0.05
VALENCE_ALPHA = 15.0
REVIEW_SEPARATOR = "|||"
# Python's str.strip() whitespace: every code point for which str.isspace() holds (derived, not typed).
WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# Unicode word characters (letters, numbers, underscore) -- Python's ``\w``; NON_WORD splits on the rest
# (ASCII ranges first only so the common case is decided before the Unicode property lookups).
WORD_PATTERN = r"[\p{L}\p{N}_]+"
NON_WORD = r"[^a-z0-9_\p{L}\p{N}]+"


def _strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing characters of the whitespace set (no regex)."""
    return F.trim(c, F.lit(WS_CHARS))


def extract_reviews(df: DataFrame, text_col: str = "REVIEW_TEXTS") -> DataFrame:
    """One row per non-empty stripped review, indexed after dropping empties."""
    require_columns(df, ["PLACE_ID", text_col], "listings")
    parts = F.filter(F.transform(F.split(F.col(text_col), r"\|\|\|", -1), _strip), lambda p: p != F.lit(""))
    cols = df.columns
    carry = [
        F.col("PLACE_ID"),
        (F.col("NAME") if "NAME" in cols else F.lit(None).cast("string")).alias("HOTEL_NAME"),
        (F.col("MARKET") if "MARKET" in cols else F.lit(None).cast("string")).alias("MARKET"),
        (F.col("NEIGHBORHOOD") if "NEIGHBORHOOD" in cols else F.lit("")).alias("NEIGHBORHOOD"),
        (F.col("PRICE_TIER") if "PRICE_TIER" in cols else F.lit("Unknown")).alias("PRICE_TIER"),
        (to_double("RATING") if "RATING" in cols else F.lit(None).cast("double")).alias("RATING"),
    ]
    x = df.select(*carry, F.posexplode(parts).alias("REVIEW_INDEX", "REVIEW_TEXT"))
    return x.withColumn("REVIEW_INDEX", F.col("REVIEW_INDEX").cast("bigint"))


def words(c: Column | str, distinct: bool = True) -> Column:
    """Lower-case word tokens (Python ``re.findall(r"\\w+", text.lower())``): split on non-word runs."""
    c = F.col(c) if isinstance(c, str) else c
    w = F.filter(F.split(F.lower(c), NON_WORD, -1), lambda x: x != F.lit(""))
    return F.array_distinct(w) if distinct else w


def label(compound: Column) -> Column:
    """I4: Positive / Negative / Neutral by the +-0.05 thresholds."""
    return (F.when(compound >= POS_THRESHOLD, "Positive").when(compound <= NEG_THRESHOLD, "Negative")
            .otherwise("Neutral"))


#: Compounds are summed as integers of this unit, so that means do not depend on the order of the sum.
SENT_SCALE = 10 ** 15


def score_lexicon(df: DataFrame, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS,
                  text_col: str = "REVIEW_TEXT") -> DataFrame:
    """Distinct words vs the two word sets; compound (p-n)/(p+n), pos/neu/neg, label.

    ``SENT_UNITS`` is compound * ``SENT_SCALE`` as an integer (see ``mean_compound``).
    """
    w = F.col("_w")
    p = F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in positive])))
    n = F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in negative])))
    x = df.withColumn("_w", words(text_col)).withColumns({"_p": p, "_n": n}).drop("_w")
    tot = F.col("_p") + F.col("_n")
    c = F.when(tot == 0, F.lit(0.0)).otherwise((F.col("_p") - F.col("_n")) / tot)
    difference = (F.col("_p") - F.col("_n")).cast("bigint")
    units = F.when(tot == 0, F.lit(0)).otherwise(
        F.sign(difference).cast("bigint") * F.call_function("div", F.abs(difference) * F.lit(SENT_SCALE).cast("bigint"), tot.cast("bigint")))
    x = x.withColumn("VADER_COMPOUND", c)
    return x.withColumns({
        "VADER_POS": F.greatest(F.col("VADER_COMPOUND"), F.lit(0.0)),
        "VADER_NEU": F.lit(1.0) - F.abs(F.col("VADER_COMPOUND")),
        "VADER_NEG": F.greatest(-F.col("VADER_COMPOUND"), F.lit(0.0)),
        "SENTIMENT_LABEL": label(F.col("VADER_COMPOUND")),
        "SENT_UNITS": units.cast("bigint"),
    }).drop("_p", "_n")


def score_valence(df: DataFrame, valence: DataFrame | Mapping[str, float], text_col: str = "REVIEW_TEXT",
                  alpha: float = VALENCE_ALPHA, keys: Sequence[str] | None = None) -> DataFrame:
    """Sum of token valences (every occurrence), normalised s / sqrt(s^2 + alpha).

    Tokens are joined to the lexicon, a table (word, valence) of any size, so a
    longer lexicon costs no more per token; ``keys`` name a review (default:
    PLACE_ID and REVIEW_INDEX where given, else the text itself). Valences are
    summed in millionths, whatever the order.
    """
    if keys is None:
        keys = ["PLACE_ID", "REVIEW_INDEX"] if {"PLACE_ID", "REVIEW_INDEX"} <= set(df.columns) else [text_col]
    lex = valence if isinstance(valence, DataFrame) else df.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in sorted(valence.items())], "word string, valence double")
    if not isinstance(valence, DataFrame) and len(valence) <= BROADCAST_ROWS:
        lex = F.broadcast(lex)  # a driver-side dictionary: only the words it holds leave the text's task
    texts = df.select(*dict.fromkeys([*keys, text_col]))
    texts = texts.distinct() if list(keys) == [text_col] else texts
    found = (texts.select(*keys, F.explode(words(text_col, distinct=False)).alias("word")).join(lex, "word")
             .groupBy(*keys).agg(F.sum(F.rint(F.col("valence") * 1e6).cast("bigint")).alias("_v")))
    x = df.join(found, list(keys), "left").withColumn("VALENCE_SUM", F.coalesce(F.col("_v"), F.lit(0)) / F.lit(1e6)).drop("_v")
    c = F.col("VALENCE_SUM") / F.sqrt(F.col("VALENCE_SUM") * F.col("VALENCE_SUM") + F.lit(alpha))
    return x.withColumn("VADER_COMPOUND", c).withColumn("SENTIMENT_LABEL", label(F.col("VADER_COMPOUND")))


def topic_flags(df: DataFrame, topics: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS,
                text_col: str = "REVIEW_TEXT") -> DataFrame:
    """0/1 flag per topic (keyword substring of the lower-case text) and the first flagged topic."""
    t = F.lower(F.col(text_col).cast("string"))
    flags = {}
    for name, kws in topics.items():
        hit = reduce(lambda a, b: a | b, [t.contains(F.lit(k.lower())) for k in kws])
        flags[f"TOPIC_{name.upper()}"] = F.coalesce(hit, F.lit(False)).cast("int")
    x = df.withColumns(flags)
    primary = F.lit("general")
    for name in reversed(list(topics)):
        primary = F.when(F.col(f"TOPIC_{name.upper()}") == 1, F.lit(name.lower())).otherwise(primary)
    return x.withColumn("PRIMARY_TOPIC", primary)


def mean_compound(df: DataFrame) -> Column:
    """Mean of VADER_COMPOUND; from integer units when the lexicon scorer produced it."""
    if "SENT_UNITS" in df.columns:
        return F.sum(F.col("SENT_UNITS").cast("decimal(28,0)")).cast("double") / (F.count("SENT_UNITS").cast("double") * F.lit(float(SENT_SCALE)))
    return F.avg("VADER_COMPOUND")


def aggregate_sentiment(df: DataFrame, group_col: str, digits: int = 3) -> DataFrame:
    """Count, mean, median, sample std, % positive/negative/neutral per group; rounded; mean desc."""
    lab = F.col("SENTIMENT_LABEL")
    n = F.count(F.lit(1))
    out = df.filter(F.col(group_col).isNotNull()).groupBy(group_col).agg(
        F.count("REVIEW_TEXT").alias("REVIEW_COUNT"),
        mean_compound(df).alias("AVG_COMPOUND"),
        F.median("VADER_COMPOUND").alias("MEDIAN_COMPOUND"),
        F.stddev_samp("VADER_COMPOUND").alias("STD_COMPOUND"),
        (F.count(F.when(lab == "Positive", 1)) / n * 100).alias("PCT_POSITIVE"),
        (F.count(F.when(lab == "Negative", 1)) / n * 100).alias("PCT_NEGATIVE"),
        (F.count(F.when(lab == "Neutral", 1)) / n * 100).alias("PCT_NEUTRAL"),
    )
    num = ["AVG_COMPOUND", "MEDIAN_COMPOUND", "STD_COMPOUND", "PCT_POSITIVE", "PCT_NEGATIVE", "PCT_NEUTRAL"]
    out = out.withColumns({c: np_round(c, digits) for c in num})
    return out.orderBy(F.col("AVG_COMPOUND").desc(), F.col(group_col))


def mismatch(rating: Column, sentiment: Column) -> Column:
    """I8: class of a listing whose rating and mean sentiment disagree."""
    return (F.when((rating < 3.5) & (sentiment > 0.3), "LowRating_PosSent")
            .when((rating >= 4.0) & (sentiment < 0), "HighRating_NegSent").otherwise("Aligned"))


def rating_alignment(df: DataFrame) -> DataFrame:
    """I8: per listing first non-null rating (review order), mean sentiment, count, mismatch class."""
    x = df.filter(F.col("PLACE_ID").isNotNull() & F.col("HOTEL_NAME").isNotNull() & F.col("MARKET").isNotNull())
    r = F.col("RATING")
    out = x.groupBy("PLACE_ID", "HOTEL_NAME", "MARKET").agg(
        F.min_by(r, F.when(r.isNotNull(), F.col("REVIEW_INDEX"))).alias("GOOGLE_RATING"),
        mean_compound(df).alias("AVG_SENTIMENT"),
        F.count("REVIEW_TEXT").alias("REVIEW_COUNT"))
    return out.withColumn("MISMATCH", mismatch(F.col("GOOGLE_RATING"), F.col("AVG_SENTIMENT")))


def _listing_cells(scored: DataFrame) -> DataFrame:
    """One row per listing: its mismatch class and its (label, topic) cells with counts and compound sums.

    Shares, drivers and alignment all follow from it, so the texts are scored once. A listing has at most
    labels x topics cells.
    """
    listing = ["PLACE_ID", "HOTEL_NAME", "MARKET"]
    topic = F.col("PRIMARY_TOPIC") if "PRIMARY_TOPIC" in scored.columns else F.lit(None).cast("string")
    units = F.col("SENT_UNITS").cast("decimal(28,0)") if "SENT_UNITS" in scored.columns else F.col("VADER_COMPOUND")
    rated = F.when(F.col("RATING").isNotNull(), F.col("REVIEW_INDEX"))
    cells = scored.groupBy(*listing, F.col("SENTIMENT_LABEL").alias("label"), topic.alias("topic")).agg(
        F.count(F.lit(1)).alias("n"), F.count("REVIEW_TEXT").alias("texts"), F.sum(units).cast(_units_type(scored)).alias("units"),
        F.count(units).alias("scores"), F.min_by("RATING", rated).alias("rating"), F.min(rated).alias("rated"))
    rows = cells.groupBy(*listing).agg(
        F.min_by("rating", "rated").alias("GOOGLE_RATING"), _mean_of(scored, "units", "scores").alias("AVG_SENTIMENT"),
        F.collect_list(F.struct("label", "topic", "n", "texts", "units", "scores")).alias("cells"))
    named = F.col("PLACE_ID").isNotNull() & F.col("HOTEL_NAME").isNotNull() & F.col("MARKET").isNotNull()
    return rows.withColumn("MISMATCH", F.when(named, mismatch(F.col("GOOGLE_RATING"), F.col("AVG_SENTIMENT"))))


def _units_type(scored: DataFrame) -> str:
    return "decimal(38,0)" if "SENT_UNITS" in scored.columns else "double"


def _mean_of(scored: DataFrame, units: str, scores: str) -> Column:
    """``mean_compound`` from sums and counts of parts."""
    scale = F.lit(float(SENT_SCALE)) if "SENT_UNITS" in scored.columns else F.lit(1.0)
    return F.try_divide(F.sum(units).cast("double"), F.sum(scores).cast("double") * scale)


def label_shares(scored: DataFrame, alignment: bool = False) -> DataFrame:
    """Normalised shares of sentiment labels and primary topics (+ mismatch counts per listing)."""
    def entry(kind: str, value: Column, n: Column) -> Column:
        return F.struct(F.lit(kind).alias("KIND"), value.alias("VALUE"), n.cast("bigint").alias("n"))

    parts = F.concat(F.transform("cells", lambda c: entry("SENTIMENT_LABEL", c["label"], c["n"])),
                     F.transform("cells", lambda c: entry("PRIMARY_TOPIC", c["topic"], c["n"])))
    if alignment:
        parts = F.concat(parts, F.array(entry("MISMATCH", F.col("MISMATCH"), F.lit(1))))
    counts = (_listing_cells(scored).select(F.explode(parts).alias("s")).select("s.*").filter(F.col("VALUE").isNotNull())
              .groupBy("KIND", "VALUE").agg(F.sum("n").alias("COUNT")))
    total = F.sum("COUNT").over(Window.partitionBy("KIND"))  # a few labels, topics and classes
    return counts.select("KIND", "VALUE", "COUNT", (F.col("COUNT") / total * 100).alias("PCT"))


def review_qc(reviews: DataFrame) -> DataFrame:
    """Reviews, distinct listings, mean length, % blank text."""
    t = F.col("REVIEW_TEXT").cast("string")
    return reviews.agg(
        F.count(F.lit(1)).alias("N_REVIEWS"),
        F.countDistinct("PLACE_ID").alias("N_HOTELS_WITH_REVIEWS"),
        F.avg(F.length(t)).alias("AVG_REVIEW_LEN"),
        (F.avg(F.when(_strip(t) == "", 1.0).otherwise(0.0)) * 100).alias("PCT_EMPTY_TEXT"))


def topic_drivers(df: DataFrame) -> DataFrame:
    """Per primary topic count, mean, % pos, % neg, net; net desc then count desc."""
    lab = F.col("SENTIMENT_LABEL")
    n = F.count(F.lit(1))
    out = df.groupBy("PRIMARY_TOPIC").agg(
        F.count("REVIEW_TEXT").alias("REVIEW_COUNT"), mean_compound(df).alias("AVG_COMPOUND"),
        (F.count(F.when(lab == "Positive", 1)) / n * 100).alias("PCT_POSITIVE"),
        (F.count(F.when(lab == "Negative", 1)) / n * 100).alias("PCT_NEGATIVE"))
    out = out.withColumn("NET_SENTIMENT", F.col("PCT_POSITIVE") - F.col("PCT_NEGATIVE"))
    return out.orderBy(F.col("NET_SENTIMENT").desc(), F.col("REVIEW_COUNT").desc(), F.col("PRIMARY_TOPIC"))


def top_drivers(drivers: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` drivers (a top-k report; the limit is the feature)."""
    return drivers.orderBy(F.col("NET_SENTIMENT").desc(), F.col("REVIEW_COUNT").desc(), F.col("PRIMARY_TOPIC")).limit(n)


# Action table texts.
ACTION_MARKET = ("High", "Market Messaging", "%s has stronger sentiment than %s",
                 "Use %s UGC/testimonials for performance creatives; fix trust frictions in %s")
ACTION_TOPIC = ("High", "Content Strategy", "Best perception topic: %s; weakest: %s",
                "Lead ad copy with %s strengths; launch remediation playbook for %s")
ACTION_RISK = ("Medium", "Reputation Risk", "%s hotels show high rating but negative sentiment mismatch",
               "Audit listing content and recent complaints; downgrade placement until review quality recovers")


def marketing_actions(scored: DataFrame) -> DataFrame:
    """Three action rows: best and worst market, best and worst topic, listings at risk.

    One plan from the scored reviews to one row: cells per listing, sums per market and topic, their extremes (by
    value, with the name as tie-break), no driver round trip.
    """
    def sums(kind: str, key: Column, c: Column) -> Column:
        def only(name):
            return F.when(c["label"] == name, c["n"]).otherwise(F.lit(0).cast("bigint"))
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), c["n"].alias("n"), c["texts"].alias("texts"), c["units"].alias("units"),
                        c["scores"].alias("scores"), only("Positive").alias("pos"), only("Negative").alias("neg"))

    none = F.struct(F.lit("risk").alias("kind"), F.lit("").alias("key"), (F.col("MISMATCH") == "HighRating_NegSent").cast("bigint").alias("n"),
                    *[F.lit(0).cast(t).alias(c) for c, t in (("texts", "bigint"), ("units", _units_type(scored)), ("scores", "bigint"),
                                                             ("pos", "bigint"), ("neg", "bigint"))])
    parts = F.concat(F.transform("cells", lambda c: sums("market", F.col("MARKET"), c)),
                     F.transform("cells", lambda c: sums("topic", c["topic"], c)), F.array(none))
    per_key = (_listing_cells(scored).select(F.explode(parts).alias("s")).select("s.*")
               .filter((F.col("kind") != "market") | F.col("key").isNotNull()).groupBy("kind", "key").agg(
                   F.sum("n").alias("n"), F.sum("texts").alias("texts"), _mean_of(scored, "units", "scores").alias("mean"),
                   F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    market, topic = F.col("kind") == "market", F.col("kind") == "topic"
    mean, net = np_round("mean", 3), F.try_divide("pos", "n") * 100 - F.try_divide("neg", "n") * 100

    def least(which: Column, *order: Column) -> Column:
        return F.min(F.when(which, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("key").alias("key"))))["key"]

    ends = per_key.agg(least(market, -mean).alias("top"), least(market, mean).alias("low"),
                       least(topic, -net, -F.col("texts")).alias("best_t"), least(topic, net, -F.col("texts")).alias("worst_t"),
                       F.coalesce(F.sum(F.when(F.col("kind") == "risk", F.col("n"))), F.lit(0)).alias("high_neg"))

    def row(spec, insight, action):
        return F.struct(F.lit(spec[0]).alias("PRIORITY"), F.lit(spec[1]).alias("AREA"), insight.alias("INSIGHT"), action.alias("ACTION"))

    def pair(spec, a, b):
        return F.when(F.col(a).isNotNull(), row(spec, F.format_string(spec[2], a, b), F.format_string(spec[3], a, b)))

    risk = row(ACTION_RISK, F.format_string(ACTION_RISK[2], F.col("high_neg").cast("string")), F.lit(ACTION_RISK[3]))
    actions = F.array(pair(ACTION_MARKET, "top", "low"), pair(ACTION_TOPIC, "best_t", "worst_t"), risk)
    return ends.select(F.explode(F.filter(actions, lambda a: a.isNotNull())).alias("a")).select("a.*")
