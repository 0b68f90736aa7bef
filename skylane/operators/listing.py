"""Listing enrichment and market diagnostics.

Per-market constants (99th percentile of review volume, max photos, medians)
are computed with one ``groupBy(MARKET)`` (partial aggregation, so a market
holding a third of all listings is still combined map-side) and joined back.
The join is left to AQE: it becomes a broadcast hash join when the runtime
size of the per-market table is under the broadcast threshold, and a
skew-split sort-merge join otherwise -- nothing is broadcast unchecked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, np_round, to_count, to_double
from ..sources.io import require_columns
from .common import attach, fixed_width_histogram

# Price level -> tier names.
PRICE_TIERS = {1: "Budget", 2: "Mid-Range", 3: "Upscale", 4: "Luxury"}
PRICE_TIER_UNKNOWN = "Unknown"
# Rating tier thresholds (>=), highest first; missing -> "Unrated".
RATING_TIERS = [(4.5, "Excellent"), (4.0, "Good"), (3.5, "Average")]
RATING_TIER_LOW, RATING_TIER_NONE = "Low", "Unrated"
# Visibility weights (review volume, rating, photos) and bookability rules.
VIS_W_RATINGS, VIS_W_RATING, VIS_W_PHOTOS = 0.50, 0.35, 0.15
BOOKABLE_MIN_RATINGS = 10
BOOKABLE_STATUSES = ("OPERATIONAL", "")
ENRICHED_COLUMNS = ("PRICE_TIER", "RATING_TIER", "VISIBILITY_SCORE", "IS_BOOKABLE")
# Trust quadrant labels.
Q_STAR, Q_HIDDEN, Q_RISKY, Q_LOW = "⭐ Star Performer", "🔍 Hidden Gem", "⚠️ Known but Risky", "❌ Low Signal"


def mean_on_grid(c: Column | str, decimals: int = 1) -> Column:
    """Mean of values on a 10^-d grid, summed exactly as integers.

    Ratings and visibility scores carry one decimal; summing them as integer
    tenths makes the mean independent of partition/summation order.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = 10 ** decimals
    s = F.sum(F.rint(c * F.lit(float(scale))).cast("bigint"))
    return F.try_divide(s.cast("double"), F.lit(float(scale)) * F.count(c))


def price_tier(level: Column) -> Column:
    out = F.lit(PRICE_TIER_UNKNOWN)
    for k in sorted(PRICE_TIERS, reverse=True):
        out = F.when(level == F.lit(float(k)), F.lit(PRICE_TIERS[k])).otherwise(out)
    return out


def rating_tier(rating: Column) -> Column:
    expr = F.when(rating.isNull(), F.lit(RATING_TIER_NONE))
    for thr, name in RATING_TIERS:
        expr = expr.when(rating >= F.lit(thr), F.lit(name))
    return expr.otherwise(F.lit(RATING_TIER_LOW))


def prepare_listings(df: DataFrame) -> DataFrame:
    """Coerce numerics, PRICE_TIER, RATING_TIER, per-market VISIBILITY_SCORE, IS_BOOKABLE."""
    require_columns(df, ["MARKET", "RATING", "TOTAL_RATINGS", "PRICE_LEVEL", "BUSINESS_STATUS"], "listings")
    photos = to_count("NUM_PHOTOS") if "NUM_PHOTOS" in df.columns else F.lit(0).cast("bigint")
    x = df.withColumns({
        "RATING": to_double("RATING"),
        "TOTAL_RATINGS": to_count("TOTAL_RATINGS"),
        "PRICE_LEVEL": to_double("PRICE_LEVEL"),
        "NUM_PHOTOS": photos,
    })
    x = x.withColumns({"PRICE_TIER": price_tier(F.col("PRICE_LEVEL")), "RATING_TIER": rating_tier(F.col("RATING"))})
    per_market = x.filter(F.col("MARKET").isNotNull()).groupBy("MARKET").agg(
        F.percentile("TOTAL_RATINGS", 0.99).alias("_max_ratings"), F.max("NUM_PHOTOS").alias("_max_photos"))
    # "quantile or 1" / "max or 1": only an exact 0 is replaced
    mr = F.coalesce(F.nullif(F.col("_max_ratings"), F.lit(0.0)), F.lit(1.0))
    mp = F.coalesce(F.nullif(F.col("_max_photos").cast("double"), F.lit(0.0)), F.lit(1.0))
    score = (F.lit(VIS_W_RATINGS) * clip(F.col("TOTAL_RATINGS") / mr, 0.0, 1.0)
             + F.lit(VIS_W_RATING) * (F.coalesce(F.col("RATING"), F.lit(0.0)) / F.lit(5.0))
             + F.lit(VIS_W_PHOTOS) * clip(F.col("NUM_PHOTOS") / mp, 0.0, 1.0)) * F.lit(100.0)
    j = attach(x, per_market, ["MARKET"], "left")
    bookable = F.coalesce(
        F.col("RATING").isNotNull() & (F.col("TOTAL_RATINGS") >= BOOKABLE_MIN_RATINGS)
        & F.col("BUSINESS_STATUS").isin(*BOOKABLE_STATUSES), F.lit(False))
    return j.withColumns({
        "VISIBILITY_SCORE": F.when(F.col("MARKET").isNull(), F.lit(0.0)).otherwise(np_round(score, 1)),
        "IS_BOOKABLE": bookable,
    }).drop("_max_ratings", "_max_photos")


def compare_markets(df: DataFrame) -> DataFrame:
    """E5: per non-null market listings, bookable, rate %, mean price / rating / visibility."""
    b = F.col("IS_BOOKABLE")
    out = df.filter(F.col("MARKET").isNotNull()).groupBy("MARKET").agg(
        F.count(F.lit(1)).alias("TOTAL_LISTINGS"),
        F.count(F.when(b, 1)).alias("BOOKABLE_LISTINGS"),
        F.avg("PRICE_LEVEL").alias("_price"),
        mean_on_grid("RATING").alias("_rating"),
        mean_on_grid("VISIBILITY_SCORE").alias("_vis"),
    )
    return out.select(
        "MARKET", "TOTAL_LISTINGS", "BOOKABLE_LISTINGS",
        np_round(F.col("BOOKABLE_LISTINGS") / F.greatest(F.col("TOTAL_LISTINGS"), F.lit(1)) * 100, 1).alias("BOOKABILITY_RATE"),
        np_round("_price", 2).alias("AVG_PRICE_LEVEL"),
        np_round("_rating", 2).alias("AVG_RATING"),
        np_round("_vis", 1).alias("AVG_VISIBILITY"),
    )


def price_tier_mix(df: DataFrame) -> DataFrame:
    """Count and mean rating per (market, tier) incl. null keys; share of market %."""
    g = df.groupBy("MARKET", "PRICE_TIER").agg(F.count(F.lit(1)).alias("COUNT"),
                                               mean_on_grid("RATING").alias("AVG_RATING"))
    totals = g.filter(F.col("MARKET").isNotNull()).groupBy("MARKET").agg(F.sum("COUNT").alias("_tot"))
    return g.join(totals, "MARKET", "left").select(
        "MARKET", "PRICE_TIER", "COUNT", "AVG_RATING",
        np_round(F.col("COUNT") / F.col("_tot") * 100, 1).alias("PCT_OF_MARKET"))


def trust_quadrant(df: DataFrame) -> DataFrame:
    """Rating and review volume against per-market medians."""
    meds = df.filter(F.col("MARKET").isNotNull()).groupBy("MARKET").agg(
        F.median("RATING").alias("_rmed"), F.median("TOTAL_RATINGS").alias("_vmed"))
    r, v = F.col("RATING"), F.col("TOTAL_RATINGS")
    hi_r, hi_v = r >= F.col("_rmed"), v >= F.col("_vmed")
    lo_r, lo_v = r < F.col("_rmed"), v < F.col("_vmed")
    quad = (F.when(hi_r & hi_v, Q_STAR).when(hi_r & lo_v, Q_HIDDEN).when(lo_r & hi_v, Q_RISKY)
            .otherwise(Q_LOW))
    return attach(df, meds, ["MARKET"], "left").withColumn("TRUST_QUADRANT", quad).drop("_rmed", "_vmed")


def quadrant_summary(df: DataFrame) -> DataFrame:
    """Quadrant counts, market asc then count desc."""
    return (df.filter(F.col("MARKET").isNotNull()).groupBy("MARKET", "TRUST_QUADRANT")
              .agg(F.count(F.lit(1)).alias("COUNT"))
              .orderBy(F.col("MARKET").asc(), F.col("COUNT").desc(), F.col("TRUST_QUADRANT")))


def category_counts(df: DataFrame, columns: Sequence[str] = ("MARKET", "PRICE_TIER", "RATING_TIER")) -> DataFrame:
    """Value counts (null kept) of several columns in one scan, with share of rows."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("COLUMN_NAME"), F.col(c).cast("string").alias("VALUE")) for c in columns])).alias("s")
    ).select("s.*")
    counts = stacked.groupBy("COLUMN_NAME", "VALUE").agg(F.count(F.lit(1)).alias("COUNT"))
    total = df.agg(F.count(F.lit(1)).alias("_n"),
                   F.avg(F.col("IS_BOOKABLE").cast("int")).alias("BOOKABLE_SHARE"))
    return attach(counts, total).select("COLUMN_NAME", "VALUE", "COUNT", (F.col("COUNT") / F.col("_n")).alias("SHARE"),
                                        "BOOKABLE_SHARE")


def score_histogram(df: DataFrame, value_col: str = "VISIBILITY_SCORE", key: str = "MARKET",
                    bins: int = 20) -> DataFrame:
    """Numpy-style fixed-width histogram per key (edges from the key's min/max) plus median."""
    return fixed_width_histogram(df, value_col, bins, [key], with_median=True)
