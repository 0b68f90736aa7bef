"""Video engagement (F1/F2): coerced counts, publish calendar fields, per-100-view rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import np_round, to_count, to_double
from .cleaning import coerce_date

COUNTS = ("VIEW_COUNT", "LIKE_COUNT", "COMMENT_COUNT")


def prepare_videos(df: DataFrame) -> DataFrame:
    cols = {c: (to_count(c) if c in df.columns else F.lit(0).cast("bigint")) for c in COUNTS}
    x = df.withColumns(cols)
    if "PUBLISHED_AT" in df.columns:
        ts = coerce_date("PUBLISHED_AT", dict(df.dtypes)["PUBLISHED_AT"])
        x = x.withColumn("PUBLISHED_AT", ts).withColumns({
            "PUBLISH_YEAR": F.year("PUBLISHED_AT"),
            "PUBLISH_MONTH": F.month("PUBLISHED_AT"),
            "PUBLISH_DOW": F.date_format("PUBLISHED_AT", "EEEE"),
        })
    denom = F.greatest(F.col("VIEW_COUNT"), F.lit(1))
    x = x.withColumns({
        "LIKE_RATE": np_round(F.col("LIKE_COUNT") / denom * 100, 3),
        "COMMENT_RATE": np_round(F.col("COMMENT_COUNT") / denom * 100, 3),
        "ENGAGEMENT_RATE": np_round((F.col("LIKE_COUNT") + F.col("COMMENT_COUNT")) / denom * 100, 3),
    })
    if "DURATION_MINUTES" in df.columns:
        x = x.withColumn("DURATION_MINUTES", to_double("DURATION_MINUTES"))
    return x
