"""Landed-payload jobs (B1–B7): the table work of API collectors, over JSON already landed.

Payloads are JSON strings (one object per row) parsed with declared schemas
(``from_json``), so a landing job never infers a schema from the data.
Network clients, paging and retries are not part of this library.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import np_round
from .io import rename_if_present

PLACE_SCHEMA = T.StructType([
    T.StructField("place_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("user_ratings_total", T.LongType()),
    T.StructField("price_level", T.LongType()),
    T.StructField("formatted_address", T.StringType()),
    T.StructField("geometry", T.StructType([T.StructField("location", T.StructType([
        T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())]))])),
    T.StructField("business_status", T.StringType()),
    T.StructField("types", T.ArrayType(T.StringType())),
])

DETAIL_SCHEMA = T.StructType([
    T.StructField("place_id", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("formatted_phone_number", T.StringType()),
    T.StructField("photos", T.ArrayType(T.StructType([T.StructField("photo_reference", T.StringType())]))),
    T.StructField("reviews", T.ArrayType(T.StructType([
        T.StructField("rating", T.DoubleType()), T.StructField("text", T.StringType())]))),
    T.StructField("opening_hours", T.StructType([T.StructField("open_now", T.BooleanType())])),
])

VIDEO_ITEM_SCHEMA = T.StructType([
    T.StructField("id", T.StructType([T.StructField("videoId", T.StringType())])),
    T.StructField("snippet", T.StructType([
        T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
        T.StructField("channelTitle", T.StringType()), T.StructField("channelId", T.StringType()),
        T.StructField("publishedAt", T.StringType())])),
])

VIDEO_STATS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("statistics", T.StructType([
        T.StructField("viewCount", T.StringType()), T.StructField("likeCount", T.StringType()),
        T.StructField("commentCount", T.StringType())])),
    T.StructField("contentDetails", T.StructType([T.StructField("duration", T.StringType())])),
])

LISTING_COLUMNS = ["PLACE_ID", "NAME", "MARKET", "RATING", "TOTAL_RATINGS", "PRICE_LEVEL", "ADDRESS", "LAT", "LNG",
                   "BUSINESS_STATUS", "TYPES", "WEBSITE", "GOOGLE_URL", "PHONE", "NUM_PHOTOS", "NUM_REVIEWS_FETCHED",
                   "AVG_REVIEW_RATING", "REVIEW_TEXTS", "OPEN_NOW"]
REVIEW_JOIN = " ||| "


def parse(df: DataFrame, payload_col: str, schema: T.StructType, alias: str = "p") -> DataFrame:
    """Parse a JSON payload column with a declared schema (bad JSON -> NULL fields)."""
    return df.withColumn(alias, F.from_json(F.col(payload_col), schema))


def dedup_first_seen(df: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    """B2: one row per non-empty key, the one first in ``order_cols`` order (query order, position).

    The minimum of a struct that starts with the ordering columns is that row
    (remaining fields only break exact ties, deterministically). It is an
    aggregate with map-side partial aggregation, so a key repeated across a
    third of all results is reduced in every task before the shuffle (a window
    would send all its rows to one task).
    """
    others = [c for c in df.columns if c != key and c not in order_cols]
    # rows without a key are dropped after the aggregate: a filter on the key itself would be pushed below it, where a key
    # parsed from a payload would be parsed again for each comparison
    first = df.groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in [*order_cols, *others]])).alias("_first"),
                                F.max(F.col(key).isNotNull() & (F.col(key) != "")).alias("_keyed")).filter("_keyed")
    return first.select(key, *[F.col(f"_first.{c}").alias(c) for c in [*order_cols, *others]])


def flatten_places(parsed: DataFrame, market: Column | str, col: str = "p") -> DataFrame:
    """B1: 19-column listing rows with the collector's defaults for missing fields."""
    p = F.col(col)
    m = F.lit(market) if isinstance(market, str) else market
    return parsed.select(
        p["place_id"].alias("PLACE_ID"),
        F.coalesce(p["name"], F.lit("")).alias("NAME"),
        m.alias("MARKET"),
        p["rating"].alias("RATING"),
        F.coalesce(p["user_ratings_total"], F.lit(0)).alias("TOTAL_RATINGS"),
        p["price_level"].alias("PRICE_LEVEL"),
        F.coalesce(p["formatted_address"], F.lit("")).alias("ADDRESS"),
        p["geometry"]["location"]["lat"].alias("LAT"),
        p["geometry"]["location"]["lng"].alias("LNG"),
        F.coalesce(p["business_status"], F.lit("")).alias("BUSINESS_STATUS"),
        F.concat_ws(", ", F.coalesce(p["types"], F.array().cast("array<string>"))).alias("TYPES"),
        F.lit("").alias("WEBSITE"), F.lit("").alias("GOOGLE_URL"), F.lit("").alias("PHONE"),
        F.lit(0).cast("bigint").alias("NUM_PHOTOS"), F.lit(0).cast("bigint").alias("NUM_REVIEWS_FETCHED"),
        F.lit(None).cast("double").alias("AVG_REVIEW_RATING"), F.lit("").alias("REVIEW_TEXTS"),
        F.lit(None).cast("boolean").alias("OPEN_NOW"),
    )


def detail_rollup(details: DataFrame, col: str = "d") -> DataFrame:
    """B3 (per detail payload): photo/review counts, mean review rating (missing = 0, round 2),
    non-empty review texts joined by ' ||| ', open-now flag."""
    d = F.col(col)
    reviews = F.coalesce(d["reviews"], F.array().cast(DETAIL_SCHEMA["reviews"].dataType))
    n = F.size(reviews)
    total = F.aggregate(reviews, F.lit(0.0), lambda acc, r: acc + F.coalesce(r["rating"], F.lit(0.0)))
    texts = F.transform(F.filter(reviews, lambda r: r["text"].isNotNull() & (r["text"] != "")), lambda r: r["text"])
    return details.select(
        d["place_id"].alias("PLACE_ID"),
        F.coalesce(d["website"], F.lit("")).alias("WEBSITE"),
        F.coalesce(d["url"], F.lit("")).alias("GOOGLE_URL"),
        F.coalesce(d["formatted_phone_number"], F.lit("")).alias("PHONE"),
        F.size(F.coalesce(d["photos"], F.array().cast(DETAIL_SCHEMA["photos"].dataType))).cast("bigint").alias("NUM_PHOTOS"),
        n.cast("bigint").alias("NUM_REVIEWS_FETCHED"),
        F.when(n > 0, np_round(total / n, 2)).alias("AVG_REVIEW_RATING"),
        F.when(n > 0, F.array_join(texts, REVIEW_JOIN)).otherwise(F.lit("")).alias("REVIEW_TEXTS"),
        d["opening_hours"]["open_now"].alias("OPEN_NOW"),
    )


def enrich_with_details(listings: DataFrame, rollup: DataFrame) -> DataFrame:
    """Left join detail rollups on PLACE_ID; listings without details keep their defaults."""
    cols = ["WEBSITE", "GOOGLE_URL", "PHONE", "NUM_PHOTOS", "NUM_REVIEWS_FETCHED", "AVG_REVIEW_RATING",
            "REVIEW_TEXTS", "OPEN_NOW"]
    r = rollup.select("PLACE_ID", *[F.col(c).alias(f"_d_{c}") for c in cols]).withColumn("_has", F.lit(True))
    j = listings.join(r, "PLACE_ID", "left")
    has = F.col("_has").isNotNull()
    # a listing with details takes every detail field (the reviews ones only when reviews exist)
    out = {c: F.when(has, F.col(f"_d_{c}")).otherwise(F.col(c)) for c in ["WEBSITE", "GOOGLE_URL", "PHONE", "NUM_PHOTOS",
                                                                         "NUM_REVIEWS_FETCHED", "OPEN_NOW"]}
    with_reviews = has & (F.col("_d_NUM_REVIEWS_FETCHED") > 0)
    out["AVG_REVIEW_RATING"] = F.when(with_reviews, F.col("_d_AVG_REVIEW_RATING")).otherwise(F.col("AVG_REVIEW_RATING"))
    out["REVIEW_TEXTS"] = F.when(with_reviews, F.col("_d_REVIEW_TEXTS")).otherwise(F.col("REVIEW_TEXTS"))
    return j.withColumns(out).select(*listings.columns)


def trend_rows(df: DataFrame, index_col: str = "date", partial_col: str = "isPartial") -> DataFrame:
    """Landed search-interest rows without the partial flag, the index as DATE."""
    return rename_if_present(df.drop(partial_col), {index_col: "DATE"})


def union_markets(*frames: DataFrame) -> DataFrame:
    """Union of market frames by column name (missing columns become NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


ORIGIN_CANDIDATES = ("departureIata", "departure", "from")
DEST_CANDIDATES = ("arrivalIata", "arrival", "to")


def filter_routes(df: DataFrame, origins: Sequence[str], destination: str) -> DataFrame:
    """Origin in ``origins`` and destination equal, on the first present column names; else unfiltered."""
    have = set(df.columns)
    o = next((c for c in ORIGIN_CANDIDATES if c in have), None)
    d = next((c for c in DEST_CANDIDATES if c in have), None)
    if o and d:
        return df.filter(F.col(o).isin(*origins) & (F.col(d) == destination))
    return df


def flatten_videos(items: DataFrame, col: str = "v", query_col: str = "SEARCH_QUERY") -> DataFrame:
    """B7 (search part): one row per search item."""
    v = F.col(col)
    s = v["snippet"]
    return items.select(
        v["id"]["videoId"].alias("VIDEO_ID"),
        F.coalesce(s["title"], F.lit("")).alias("TITLE"),
        F.coalesce(s["description"], F.lit("")).alias("DESCRIPTION"),
        F.coalesce(s["channelTitle"], F.lit("")).alias("CHANNEL_TITLE"),
        F.coalesce(s["channelId"], F.lit("")).alias("CHANNEL_ID"),
        F.coalesce(s["publishedAt"], F.lit("")).alias("PUBLISHED_AT"),
        F.col(query_col).alias("SEARCH_QUERY"),
        *[c for c in items.columns if c.startswith("_ord")],
    )


def video_stats(stats: DataFrame, col: str = "s") -> DataFrame:
    """B7 (statistics part): counts as integers (missing -> 0) and duration text."""
    s = F.col(col)
    st = s["statistics"]

    def cnt(c):
        return F.coalesce(st[c].try_cast("bigint"), F.lit(0)).cast("bigint")

    return stats.select(s["id"].alias("VIDEO_ID"), cnt("viewCount").alias("VIEW_COUNT"),
                        cnt("likeCount").alias("LIKE_COUNT"), cnt("commentCount").alias("COMMENT_COUNT"),
                        F.coalesce(s["contentDetails"]["duration"], F.lit("")).alias("DURATION"))


def merge_video_stats(videos: DataFrame, stats: DataFrame) -> DataFrame:
    """Left merge of statistics by video id (videos without statistics keep NULL counts)."""
    return videos.join(stats, "VIDEO_ID", "left")
