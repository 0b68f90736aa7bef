"""Rule layer of the valence scorer (I3): negation, boosters, capitals, contrast and punctuation.

The words of a text are exploded with the three words before them, so each row
carries the context its rules need and nothing is looked up across rows. The
lexicon is a table joined to the words (broadcast behind a check of its size,
else joined by word and salt); what is left is one aggregate per text. Texts are
not shuffled: only one narrow row per text and task is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import np_round
from ..sources.io import require_columns
from .common import counted, join_counted
from .text import VALENCE_ALPHA, label

# Fixed values of the published rule set (Hutto and Gilbert, 2014).
CAPITALS = 0.733
NEGATION = -0.74
DISTANCE_WEIGHTS = (1.0, 0.95, 0.9)
CONTRAST_WORD, BEFORE_CONTRAST, AFTER_CONTRAST = "but", 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS, MOST_QUESTIONS = 0.18, 0.96, 3
BOOST = 0.293
DEFAULT_BOOSTERS = {"very": BOOST, "really": BOOST, "extremely": BOOST, "absolutely": BOOST, "so": BOOST,
                    "slightly": -BOOST, "somewhat": -BOOST, "barely": -BOOST, "hardly": -BOOST}
DEFAULT_NEGATIONS = ("not", "no", "never", "neither", "nor", "none", "nothing", "nowhere", "without", "cannot")

SPACE = r"[\x20\x09-\x0D]+"
EDGES = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"


@dataclass(frozen=True)
class Rules:
    """The rule tables: word -> boost, the negating words, the contrast word (None: no contrast rule)."""
    boosters: Mapping[str, float] = field(default_factory=lambda: DEFAULT_BOOSTERS)
    negations: Sequence[str] = DEFAULT_NEGATIONS
    contrast: str | None = CONTRAST_WORD


def _is_capital(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _occurrences(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def emphasis(text: Column) -> Column:
    """What the punctuation marks of a text add to its sum, away from zero."""
    asked = _occurrences(text, "?")
    return (F.least(_occurrences(text, "!"), F.lit(MOST_EXCLAMATIONS)) * F.lit(EXCLAMATION)
            + F.when(asked <= 1, F.lit(0.0)).when(asked <= MOST_QUESTIONS, asked * F.lit(QUESTION)).otherwise(F.lit(MANY_QUESTIONS)))


def words_in_context(df: DataFrame, keys: Sequence[str], text_col: str, contrast: str | None) -> DataFrame:
    """One row per word (a text without words: one row without a word) with the three words before it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = F.filter(F.transform(F.split(text, SPACE, -1), lambda w: F.regexp_replace(w, EDGES, "")), lambda w: w != "")
    texts = df.select(*keys, emphasis(text).alias("_emphasis"), cut.alias("_words"))

    def before(k):
        return F.concat(F.array_repeat(F.lit(None).cast("string"), k), F.col("_words"))
    capitals = F.exists("_words", _is_capital) & F.exists("_words", lambda w: ~_is_capital(w))
    turn = F.lit(0) if contrast is None else F.array_position(F.transform("_words", F.lower), F.lit(contrast))
    zipped = F.arrays_zip(F.col("_words").alias("w"), before(1).alias("b1"), before(2).alias("b2"), before(3).alias("b3"))
    # what holds for a whole text is a column before the words are exploded, else it would be worked out per word
    whole = texts.select(*keys, "_emphasis", capitals.alias("_mixed"), turn.alias("_turn"), F.slice(zipped, F.lit(1), F.size("_words")).alias("_zipped"))
    rows = whole.select(*keys, "_emphasis", "_mixed", "_turn", F.posexplode_outer("_zipped").alias("_at", "_z"))
    z = F.col("_z")
    return rows.select(*keys, "_emphasis", "_mixed", "_turn", "_at", z["w"].alias("_word"), z["b1"].alias("_b1"), z["b2"].alias("_b2"),
                       z["b3"].alias("_b3"), F.lower(z["w"]).alias("word"))


def _in_context(rules: Rules) -> Column:
    """Valence of a lexicon word after capitals, the boosters and negations before it, and the contrast."""
    v, sign = F.col("valence"), F.signum("valence")

    def loud(word):
        return F.when(_is_capital(F.col(word)) & F.col("_mixed"), F.lit(CAPITALS)).otherwise(F.lit(0.0))
    out = v + sign * loud("_word")
    for name, weight in zip(("_b1", "_b2", "_b3"), DISTANCE_WEIGHTS):
        low = F.lower(F.col(name))
        boost = reduce(lambda c, kv: c.when(low == kv[0], F.lit(float(kv[1]))), rules.boosters.items(), F.when(F.lit(False), F.lit(0.0)))
        boosted = (boost + F.signum(boost) * loud(name)) * sign * F.lit(weight)
        negated = low.isin(*rules.negations) | F.endswith(low, F.lit("n't")) if rules.negations else F.lit(False)
        out = (out + F.coalesce(boosted, F.lit(0.0))) * F.when(negated, F.lit(NEGATION)).otherwise(F.lit(1.0))
    at = F.col("_at") + 1
    side = (F.when((F.col("_turn") > 0) & (at < F.col("_turn")), F.lit(BEFORE_CONTRAST))
            .when((F.col("_turn") > 0) & (at > F.col("_turn")), F.lit(AFTER_CONTRAST)).otherwise(F.lit(1.0)))
    return out * side


def score_rules(df: DataFrame, valence: DataFrame | Mapping[str, float], rules: Rules = Rules(), text_col: str = "REVIEW_TEXT",
                keys: Sequence[str] = ("PLACE_ID", "REVIEW_INDEX"), alpha: float = VALENCE_ALPHA) -> DataFrame:
    """I3 with its rules: one row per key with VALENCE_SUM, VADER_COMPOUND, VADER_POS / NEU / NEG and the label.

    ``valence`` is a table (word, valence) of lower-case words, any length. Words
    are runs without white space, ASCII punctuation cut from their ends.

    * capitals: a word in capitals counts ``CAPITALS`` more, where the text has other words too;
    * the three words before it: a booster adds its weight away from zero (less with distance), a negation
      (listed, or ending in ``n't``) turns the sign;
    * contrast: words before the first contrast word count half, words after it one and a half;
    * punctuation: ``!`` and ``?`` move the sum away from zero.

    A null text or one without words scores 0 (Neutral); a null key is a key; rows that share a key are one
    text, each row's words in its own context. Sums are kept in millionths, whatever the order.
    """
    require_columns(df, [*keys, text_col], "reviews")
    lex = valence if isinstance(valence, DataFrame) else df.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in sorted(valence.items())], "word string, valence double")
    found = join_counted(words_in_context(df, keys, text_col, rules.contrast), counted(lex.select("word", "valence")), ["word"], "left")
    hit = F.when(F.col("valence").isNotNull(), F.rint(_in_context(rules) * 1e6).cast("bigint"))
    scored = found.withColumn("_v", hit)
    v, unit = F.col("_v"), F.lit(1_000_000)

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)) / F.lit(1e6)
    sums = scored.groupBy(*keys).agg(
        total(v).alias("_s"), total(F.when(v > 0, v + unit)).alias("_p"), total(F.when(v < 0, v - unit)).alias("_n"),
        F.count(F.when(F.col("word").isNotNull() & (F.coalesce(v, F.lit(0)) == 0), 1)).cast("double").alias("_u"),
        F.max("_emphasis").alias("_e"))
    s = F.col("_s") + F.signum("_s") * F.col("_e")
    p = F.col("_p") + F.when(F.col("_p") > -F.col("_n"), F.col("_e")).otherwise(F.lit(0.0))
    n = -F.col("_n") + F.when(F.col("_p") < -F.col("_n"), F.col("_e")).otherwise(F.lit(0.0))
    x = sums.select(*keys, s.alias("VALENCE_SUM"), p.alias("_p"), n.alias("_n"), "_u")
    whole = F.col("_p") + F.col("_n") + F.col("_u")

    def part(c):
        return F.when(whole == 0, F.lit(0.0)).otherwise(np_round(F.col(c) / whole, 3))
    c = np_round(F.col("VALENCE_SUM") / F.sqrt(F.col("VALENCE_SUM") * F.col("VALENCE_SUM") + F.lit(alpha)), 4)
    x = x.withColumns({"VADER_COMPOUND": c, "VADER_POS": part("_p"), "VADER_NEU": part("_u"), "VADER_NEG": part("_n")})
    return x.withColumn("SENTIMENT_LABEL", label(F.col("VADER_COMPOUND"))).drop("_p", "_n", "_u")
