"""Adapter views: shape the driver's TPC-H-like tables like the analytic inputs.

Each function returns a lazy DataFrame derived from the given parquet tables,
so every query's work grows with the tables. Definitions follow FIXTURES.md
(the SQL texts there are the oracle's copies of the same views).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import load_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, sf_dir, name)


def fx_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly supply/demand from line items: ds, monthly_flights, est_passengers, n_supp."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("ds"))
              .agg(F.count(F.lit(1)).alias("monthly_flights"),
                   F.sum("l_quantity").cast("bigint").alias("est_passengers"),
                   F.countDistinct("l_suppkey").alias("n_supp")))


def fx_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly keyword-like signals with gaps (NULL where a week has none)."""
    o = table(spark, sf_dir, "orders")

    def cnt(cond):
        return F.nullif(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))

    return (o.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("ds"))
             .agg(cnt(F.col("o_orderpriority") == "1-URGENT").alias("kw_urgent"),
                  cnt(F.col("o_orderpriority") == "5-LOW").alias("kw_low"),
                  cnt((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_custkey") % 7 == 0)).alias("kw_sparse")))


def fx_hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings: one per part, review volume from line-item counts."""
    p = table(spark, sf_dir, "part")
    q = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    size = F.col("p_size")
    key = F.col("p_partkey")
    j = p.join(q, q.l_partkey == p.p_partkey, "left")
    return j.select(
        key.alias("place_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("market"),
        F.when(size % 9 == 0, F.lit(None).cast("double"))
         .otherwise(F.least(F.lit(5.0), F.lit(2.5) + (size % 26) / F.lit(10.0))).alias("rating"),
        F.when(size % 11 == 0, (size % 13).cast("bigint"))
         .otherwise(F.coalesce(F.col("n"), F.lit(0)) * 7).alias("total_ratings"),
        F.when(size % 5 == 0, F.lit(None).cast("int")).otherwise(1 + size % 4).alias("price_level"),
        (size % 30).alias("num_photos"),
        F.when(key % 50 == 0, "CLOSED_TEMPORARILY").when(key % 17 == 0, "")
         .otherwise("OPERATIONAL").alias("business_status"),
    )


def fx_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment visitors from orders; outcome missing for every 25th visitor."""
    o = table(spark, sf_dir, "orders")
    ck = F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("visitor_id"),
        F.when(ck % 2 == 0, "control").otherwise("treatment").alias("ab_group"),
        F.when(F.col("o_orderkey") % 25 == 0, F.lit(None).cast("int"))
         .when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("converted"),
        F.col("o_totalprice").alias("display_price"),
        F.col("o_orderpriority").alias("fare_class"),
        F.when(ck % 211 == 0, "rare").when(ck % 3 == 0, "desktop").otherwise("mobile").alias("device"),
        F.col("o_orderdate").alias("event_time"),
    )


def fx_travelers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traveler profiles from orders x customer, with a given 4-way ``cluster``."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    ck, ok = F.col("o_custkey"), F.col("o_orderkey")
    hotel_night = 80 + ck % 900
    nights = 1 + ok % 14
    flight = F.col("o_totalprice") / F.lit(128.0)
    return o.join(c, c.c_custkey == o.o_custkey).select(
        ok.alias("traveler_id"),
        (20 + ck % 45).alias("age"),
        (1 + ck % 5).alias("group_size"),
        F.col("c_mktsegment").alias("trip_purpose"),
        nights.alias("stay_nights"),
        (ok % 400).alias("lead_time_days"),
        F.col("o_orderpriority").alias("fare_class"),
        flight.alias("flight_spend"),
        F.when(ok % 5 == 0, "Budget").when(ok % 5 == 1, "Mid-Range").when(ok % 5 == 2, "Upscale")
         .when(ok % 5 == 3, "Luxury").otherwise("Other").alias("preferred_price_tier"),
        hotel_night.alias("hotel_spend_per_night"),
        (hotel_night * nights).alias("total_hotel_spend"),
        (flight + hotel_night * nights).alias("total_trip_spend"),
        F.when(ck % 3 == 0, "NYC").otherwise("Dubai").alias("preferred_market"),
        F.when(ok % 2 == 0, "mobile").otherwise("desktop").alias("device"),
        F.when(ck % 2 == 0, "direct_web").otherwise("ota_app").alias("booking_channel"),
        (ok % 4 == 0).alias("loyalty_member"),
        (ok % 7 == 0).alias("repeat_visitor"),
        (ck % 4).alias("cluster"),
    )


def fx_hotel_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listings with packed review text (one review per line)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("place_id"),
        F.col("source").alias("name"),
        F.col("lang").alias("market"),
        F.col("source").alias("price_tier"),
        F.when(F.col("quality").isNull(), F.lit(None).cast("double"))
         .when(F.col("quality") == 1, F.lit(4.5)).otherwise(F.lit(3.0)).alias("rating"),
        F.replace(F.col("text"), F.lit("\n"), F.lit(" ||| ")).alias("review_texts"),
    )


def fx_hotel_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place_id and review_texts of ``fx_hotel_reviews``: its labels give the rating alone and drop no document, so texts needn't be shuffled to them."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("place_id"), F.replace(F.col("text"), F.lit("\n"), F.lit(" ||| ")).alias("review_texts"))


def fx_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 'video' per user from the event stream."""
    e = table(spark, sf_dir, "events")

    def n(kind):
        return F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0))

    return e.groupBy(F.col("user_id").alias("video_id")).agg(
        F.min("ts").alias("published_at"), n("view").alias("view_count"),
        n("click").alias("like_count"), n("signup").alias("comment_count"))


def fx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with a market per user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return e.withColumn("market", F.when(F.col("user_id") % 3 == 0, "NYC").otherwise("Dubai"))


# SQL texts of the same views for the DuckDB oracle (FIXTURES.md part 3).
FIXTURE_SQL = {
    "fx_events": "select user_id, ts, event_type, case when user_id % 3 = 0 then 'NYC' else 'Dubai' end as market from events",
    "fx_capacity": "select cast(date_trunc('month', l_shipdate) as date) as ds, count(*) as monthly_flights, cast(sum(l_quantity) as bigint) as est_passengers, count(distinct l_suppkey) as n_supp from lineitem group by 1",
    "fx_trends": "select cast(date_trunc('week', o_orderdate) as date) as ds, nullif(sum(case when o_orderpriority='1-URGENT' then 1 else 0 end),0) as kw_urgent, nullif(sum(case when o_orderpriority='5-LOW' then 1 else 0 end),0) as kw_low, nullif(sum(case when o_orderpriority='2-HIGH' and o_custkey % 7 = 0 then 1 else 0 end),0) as kw_sparse from orders group by 1",
    "fx_hotels": "select p.p_partkey as place_id, p.p_name as name, p.p_type as market, case when p.p_size % 9 = 0 then null else least(5e0, 25e-1 + (p.p_size % 26) / 10e0) end as rating, case when p.p_size % 11 = 0 then p.p_size % 13 else coalesce(q.n,0) * 7 end as total_ratings, case when p.p_size % 5 = 0 then null else 1 + p.p_size % 4 end as price_level, p.p_size % 30 as num_photos, case when p.p_partkey % 50 = 0 then 'CLOSED_TEMPORARILY' when p.p_partkey % 17 = 0 then '' else 'OPERATIONAL' end as business_status from part p left join (select l_partkey, count(*) as n from lineitem group by 1) q on q.l_partkey = p.p_partkey",
    "fx_ab": "select o_orderkey as visitor_id, case when o_custkey % 2 = 0 then 'control' else 'treatment' end as ab_group, case when o_orderkey % 25 = 0 then null when o_orderstatus = 'F' then 1 else 0 end as converted, o_totalprice as display_price, o_orderpriority as fare_class, case when o_custkey % 211 = 0 then 'rare' when o_custkey % 3 = 0 then 'desktop' else 'mobile' end as device, o_orderdate as event_time from orders",
    "fx_travelers": "select o.o_orderkey as traveler_id, 20 + o.o_custkey % 45 as age, 1 + o.o_custkey % 5 as group_size, c.c_mktsegment as trip_purpose, 1 + o.o_orderkey % 14 as stay_nights, o.o_orderkey % 400 as lead_time_days, o.o_orderpriority as fare_class, o.o_totalprice / 128e0 as flight_spend, case o.o_orderkey % 5 when 0 then 'Budget' when 1 then 'Mid-Range' when 2 then 'Upscale' when 3 then 'Luxury' else 'Other' end as preferred_price_tier, 80 + o.o_custkey % 900 as hotel_spend_per_night, (80 + o.o_custkey % 900) * (1 + o.o_orderkey % 14) as total_hotel_spend, o.o_totalprice / 128e0 + (80 + o.o_custkey % 900) * (1 + o.o_orderkey % 14) as total_trip_spend, case when o.o_custkey % 3 = 0 then 'NYC' else 'Dubai' end as preferred_market, case when o.o_orderkey % 2 = 0 then 'mobile' else 'desktop' end as device, case when o.o_custkey % 2 = 0 then 'direct_web' else 'ota_app' end as booking_channel, o.o_orderkey % 4 = 0 as loyalty_member, o.o_orderkey % 7 = 0 as repeat_visitor, o.o_custkey % 4 as cluster from orders o join customer c on c.c_custkey = o.o_custkey",
    "fx_hotel_reviews": "select d.doc_id as place_id, d.source as name, d.lang as market, d.source as price_tier, case when l.quality is null then null when l.quality = 1 then 45e-1 else 3e0 end as rating, replace(d.text, chr(10), ' ||| ') as review_texts from documents d left join labels l on l.doc_id = d.doc_id",
    "fx_videos": "select user_id as video_id, min(ts) as published_at, sum(case when event_type='view' then 1 else 0 end) as view_count, sum(case when event_type='click' then 1 else 0 end) as like_count, sum(case when event_type='signup' then 1 else 0 end) as comment_count from events group by 1",
}


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with the adapter views it uses as CTEs."""
    ctes = ",\n".join(f"{v} as ({FIXTURE_SQL[v]})" for v in views)
    return f"with {ctes}\n{body}" if views else body
