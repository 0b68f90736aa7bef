"""Registered landing-payload queries.

Landed payloads are JSON documents that Spark builds from the given tables
(search results from line items x parts, place details from documents, video
search items and statistics from events), then parses back with declared
schemas -- the same work a landing job does on API output, growing with the
tables. The DuckDB oracle computes the expected rows straight from the base
tables, so it also checks the JSON round trip.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from ..sources import landing as ld
from ..session import ensure_checkpoint_dir
from ..sources import io, publish
from ..sources.fixtures import table

MARKET = "Dubai"
ORIGINS = ("NATION_1", "NATION_2")
DESTINATION = "NATION_3"


def search_results(spark, sf):
    """One landed search result per line item: (query index, position, place JSON)."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                             "l_tax", "l_returnflag")
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey)
    place = F.struct(
        F.col("p_partkey").cast("string").alias("place_id"),
        F.col("p_name").alias("name"),
        (F.col("p_retailprice") / 400.0).alias("rating"),
        F.col("l_quantity").cast("bigint").alias("user_ratings_total"),
        (F.col("p_size") % 4 + 1).cast("bigint").alias("price_level"),
        F.col("p_brand").alias("formatted_address"),
        F.when(F.col("l_discount") > 0, F.struct(F.struct((F.col("p_retailprice") / 100.0).alias("lat"),
                                                          (-F.col("p_size").cast("double")).alias("lng")).alias("location"))
               ).alias("geometry"),
        F.when(F.col("l_returnflag") == "R", "CLOSED_TEMPORARILY").otherwise("OPERATIONAL").alias("business_status"),
        F.when(F.col("l_tax") > 0, F.array("p_type", "p_brand")).alias("types"),
    )
    return j.select(F.col("l_linenumber").alias("QUERY_IDX"), F.col("l_orderkey").alias("POS"),
                    F.to_json(place).alias("payload"))


def parsed_first_seen(spark, sf):
    # dedup the raw payloads on their key first, then parse only the first-seen ones
    res = search_results(spark, sf).withColumn("PLACE_KEY", F.get_json_object("payload", "$.place_id"))
    first = ld.dedup_first_seen(res, "PLACE_KEY", ["QUERY_IDX", "POS"])
    return ld.parse(first, "payload", ld.PLACE_SCHEMA).drop("payload")


def places(spark, sf):
    return ld.flatten_places(parsed_first_seen(spark, sf), MARKET)


def place_details(spark, sf):
    """One landed details payload per document (reviews = the document's lines)."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lines = F.split(F.col("text"), "\n", -1)
    reviews = F.transform(lines, lambda x: F.struct(
        F.when(F.length(x) % 7 == 0, F.lit(None).cast("double")).otherwise((F.length(x) % 5 + 1).cast("double")).alias("rating"),
        x.alias("text")))
    detail = F.struct(
        F.col("doc_id").cast("string").alias("place_id"), F.col("source").alias("website"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("formatted_phone_number"),
        F.array_repeat(F.struct(F.lit("ref").alias("photo_reference")), (F.col("n_chars") % 4).cast("int")).alias("photos"),
        reviews.alias("reviews"),
        F.struct((F.col("lang") == "en").alias("open_now")).alias("opening_hours"))
    return d.select(F.to_json(detail).alias("payload"))


def q_dedup_first_seen(spark, sf):
    return parsed_first_seen(spark, sf).select(F.col("PLACE_KEY").alias("PLACE_ID"), "QUERY_IDX", "POS")


def q_place_flatten(spark, sf):
    return places(spark, sf)


def q_review_rollup(spark, sf):
    rollup = ld.detail_rollup(ld.parse(place_details(spark, sf), "payload", ld.DETAIL_SCHEMA, "d"))
    return ld.enrich_with_details(places(spark, sf), rollup)


def q_market_union(spark, sf):
    other = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("PLACE_ID"), F.col("source").alias("NAME"),
        F.lit("NYC").alias("MARKET"), ((F.col("n_chars") % 50) / 10.0).alias("RATING"))
    return ld.union_markets(places(spark, sf), other)


def q_route_filter(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n1 = table(spark, sf, "nation").select(F.col("n_nationkey").alias("on"), F.col("n_name").alias("from"))
    n2 = table(spark, sf, "nation").select(F.col("n_nationkey").alias("dn"), F.col("n_name").alias("to"))
    routes = (li.join(sup, li.l_suppkey == sup.s_suppkey).join(n1, F.col("s_nationkey") == F.col("on"))
              .join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
              .join(n2, F.col("c_nationkey") == F.col("dn"))
              .select("l_orderkey", "l_linenumber", "from", "to"))
    return ld.filter_routes(routes, ORIGINS, DESTINATION)


def _video_items(spark, sf):
    e = table(spark, sf, "events").filter(F.col("event_type").isin("view", "click"))
    item = F.struct(F.struct(F.col("user_id").cast("string").alias("videoId")).alias("id"), F.struct(
        F.concat(F.lit("video "), F.col("user_id").cast("string")).alias("title"), F.col("props").alias("description"),
        F.col("event_type").alias("channelTitle"), F.lit(None).cast("string").alias("channelId"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("publishedAt")).alias("snippet"))
    return e.select(F.to_json(item).alias("payload"), F.col("event_type").alias("SEARCH_QUERY"),
                    F.when(F.col("event_type") == "view", 0).otherwise(1).alias("_ord_q"), F.col("event_id").alias("_ord_pos"))


def _video_stats(spark, sf):
    e = table(spark, sf, "events")

    def n(kind):
        return F.count(F.when(F.col("event_type") == kind, 1)).cast("string")

    per = e.groupBy("user_id").agg(n("view").alias("v"), n("click").alias("l"), n("signup").alias("c"),
                                   F.count(F.when(F.col("event_type") == "purchase", 1)).alias("np"))
    per = per.filter(F.col("np") > 0)
    st = F.struct(F.col("user_id").cast("string").alias("id"),
                  F.struct(F.col("v").alias("viewCount"), F.col("l").alias("likeCount"), F.col("c").alias("commentCount")
                           ).alias("statistics"),
                  F.struct(F.concat(F.lit("PT"), F.col("np").cast("string"), F.lit("M")).alias("duration")).alias("contentDetails"))
    return per.select(F.to_json(st).alias("payload"))


def q_video_flatten(spark, sf):
    items = ld.flatten_videos(ld.parse(_video_items(spark, sf), "payload", ld.VIDEO_ITEM_SCHEMA, "v"))
    first = ld.dedup_first_seen(items, "VIDEO_ID", ["_ord_q", "_ord_pos"]).drop("_ord_q", "_ord_pos")
    stats = ld.video_stats(ld.parse(_video_stats(spark, sf), "payload", ld.VIDEO_STATS_SCHEMA, "s"))
    return ld.merge_video_stats(first, stats)


def _scratch(spark, name):
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/skylane-{name}-{uuid.uuid4().hex}"


ORDERS = StructType([StructField("o_orderkey", LongType()), StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType()),
                     StructField("o_orderdate", DateType()), StructField("o_orderpriority", StringType())])


def _orders(spark, sf):
    return table(spark, sf, "orders").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ORDERS.fields])


def q_sink_round_trip(spark, sf):
    """A3/A4: line items published by return flag (half of them under one flag, some without), read back whole."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_linenumber") != 7, F.col("l_returnflag")).alias("l_returnflag"))
    path = _scratch(spark, "sink")
    publish.publish_table(li, path, ["l_returnflag"])
    return publish.read_published(spark, path, li.schema)


def q_landed_csv(spark, sf):
    """Orders as landed CSV, loaded with their declared schema behind the guards."""
    path = _scratch(spark, "landed")
    io.save_landed_csv(_orders(spark, sf), path)
    back = io.load_landed_csv(spark, path, ORDERS)
    return io.require_nonempty(io.require_columns(back, ORDERS.names, "landed orders"), "landed orders")


def _broken_csv(spark, sf, path, every):
    """Orders as header CSV in which the price of each ``every``-th order is no number."""
    price = F.when(F.col("o_orderkey") % every == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    _orders(spark, sf).withColumn("o_totalprice", price).write.option("header", True).csv(path)


def q_first_checked(spark, sf):
    """A2: a missing candidate and one with half of its rows broken are passed over; broken rows of the third are set aside."""
    base = _scratch(spark, "candidates")
    _broken_csv(spark, sf, f"{base}/half.csv", 2)
    _broken_csv(spark, sf, f"{base}/few.csv", 100)
    got = publish.load_first_checked(spark, [f"{base}/missing.parquet", f"{base}/half.csv", f"{base}/few.csv"], ORDERS, max_reject_share=0.1)
    rejects = got.rejects.select(F.split("LINE", ",")[0].cast("long").alias("o_orderkey"), F.lit(None).cast("double").alias("o_totalprice"), F.lit(True).alias("REJECTED"))
    return got.rows.select("o_orderkey", "o_totalprice", F.lit(False).alias("REJECTED")).unionByName(rejects)


QUERIES = {
    "sink_round_trip": q_sink_round_trip,
    "landed_csv": q_landed_csv,
    "first_checked": q_first_checked,
    "dedup_first_seen": q_dedup_first_seen,
    "place_flatten": q_place_flatten,
    "review_rollup": q_review_rollup,
    "market_union": q_market_union,
    "route_filter": q_route_filter,
    "video_flatten": q_video_flatten,
}

# ----------------------------------------------------------------------------- oracle

_FIRST = """first as (select * from (select l.l_linenumber as QUERY_IDX, l.l_orderkey as POS, l.l_quantity, l.l_discount,
    l.l_tax, l.l_returnflag, p.*, row_number() over (partition by p.p_partkey order by l.l_linenumber, l.l_orderkey) as rn
  from lineitem l join part p on p.p_partkey = l.l_partkey) q where rn = 1)"""

_PLACES = f"""with {_FIRST},
places as (select cast(p_partkey as varchar) as PLACE_ID, p_name as NAME, '{MARKET}' as MARKET,
  p_retailprice / 400e0 as RATING, cast(l_quantity as bigint) as TOTAL_RATINGS, cast(p_size % 4 + 1 as bigint) as PRICE_LEVEL,
  p_brand as ADDRESS, case when l_discount > 0 then p_retailprice / 100e0 end as LAT,
  case when l_discount > 0 then -cast(p_size as double) end as LNG,
  case when l_returnflag = 'R' then 'CLOSED_TEMPORARILY' else 'OPERATIONAL' end as BUSINESS_STATUS,
  case when l_tax > 0 then p_type || ', ' || p_brand else '' end as TYPES,
  '' as WEBSITE, '' as GOOGLE_URL, '' as PHONE, cast(0 as bigint) as NUM_PHOTOS, cast(0 as bigint) as NUM_REVIEWS_FETCHED,
  cast(null as double) as AVG_REVIEW_RATING, '' as REVIEW_TEXTS, cast(null as boolean) as OPEN_NOW from first)"""

_DETAILS = """dl as (select cast(doc_id as varchar) as PLACE_ID, source as WEBSITE, 'doc://' || cast(doc_id as varchar) as GOOGLE_URL,
  lang as PHONE, cast(n_chars % 4 as bigint) as NUM_PHOTOS, string_split(text, chr(10)) as lines, lang = 'en' as OPEN_NOW
  from documents),
dr as (select *, cast(len(lines) as bigint) as NUM_REVIEWS_FETCHED,
  round_even(list_sum(list_transform(lines, lambda x: case when length(x) % 7 = 0 then 0e0 else cast(length(x) % 5 + 1 as double) end))
             / len(lines), 2) as AVG_REVIEW_RATING,
  array_to_string(list_filter(lines, lambda x: x <> ''), ' ||| ') as REVIEW_TEXTS from dl)"""

ORACLE = {
    "sink_round_trip": "select l_orderkey, l_linenumber, l_quantity, case when l_linenumber <> 7 then l_returnflag end as l_returnflag from lineitem",
    "landed_csv": """select o_orderkey, o_orderstatus, cast(o_totalprice as double) as o_totalprice, cast(o_orderdate as date) as o_orderdate, o_orderpriority
from orders""",
    "first_checked": """select o_orderkey, case when o_orderkey % 100 <> 0 then cast(o_totalprice as double) end as o_totalprice, o_orderkey % 100 = 0 as REJECTED
from orders""",
    "dedup_first_seen": f"with {_FIRST} select cast(p_partkey as varchar) as PLACE_ID, QUERY_IDX, POS from first",
    "place_flatten": f"{_PLACES} select * from places",
    "review_rollup": f"""{_PLACES}, {_DETAILS}
select p.PLACE_ID, NAME, MARKET, RATING, TOTAL_RATINGS, PRICE_LEVEL, ADDRESS, LAT, LNG, BUSINESS_STATUS, TYPES,
  coalesce(d.WEBSITE, p.WEBSITE) as WEBSITE, coalesce(d.GOOGLE_URL, p.GOOGLE_URL) as GOOGLE_URL, coalesce(d.PHONE, p.PHONE) as PHONE,
  coalesce(d.NUM_PHOTOS, p.NUM_PHOTOS) as NUM_PHOTOS, coalesce(d.NUM_REVIEWS_FETCHED, p.NUM_REVIEWS_FETCHED) as NUM_REVIEWS_FETCHED,
  case when d.NUM_REVIEWS_FETCHED > 0 then d.AVG_REVIEW_RATING else p.AVG_REVIEW_RATING end as AVG_REVIEW_RATING,
  case when d.NUM_REVIEWS_FETCHED > 0 then d.REVIEW_TEXTS else p.REVIEW_TEXTS end as REVIEW_TEXTS,
  case when d.PLACE_ID is not null then d.OPEN_NOW else p.OPEN_NOW end as OPEN_NOW
from places p left join dr d on d.PLACE_ID = p.PLACE_ID""",
    "market_union": f"""{_PLACES} select * from places union all
select 'd' || cast(doc_id as varchar), source, 'NYC', (n_chars % 50) / 10e0, null, null, null, null, null, null, null, null, null,
  null, null, null, null, null, null from documents""",
    "route_filter": f"""select l.l_orderkey, l.l_linenumber, n1.n_name as "from", n2.n_name as "to"
from lineitem l join supplier s on s.s_suppkey = l.l_suppkey join nation n1 on n1.n_nationkey = s.s_nationkey
join orders o on o.o_orderkey = l.l_orderkey join customer c on c.c_custkey = o.o_custkey
join nation n2 on n2.n_nationkey = c.c_nationkey
where n1.n_name in {ORIGINS!r} and n2.n_name = '{DESTINATION}'""",
    "video_flatten": """with it as (select *, row_number() over (partition by user_id order by case when event_type = 'view' then 0 else 1 end, event_id) as rn
  from events where event_type in ('view', 'click')),
st as (select user_id, count(case when event_type = 'view' then 1 end) as v, count(case when event_type = 'click' then 1 end) as l,
  count(case when event_type = 'signup' then 1 end) as c, count(case when event_type = 'purchase' then 1 end) as np
  from events group by user_id having count(case when event_type = 'purchase' then 1 end) > 0)
select cast(it.user_id as varchar) as VIDEO_ID, 'video ' || cast(it.user_id as varchar) as TITLE, it.props as DESCRIPTION,
  it.event_type as CHANNEL_TITLE, '' as CHANNEL_ID, strftime(it.ts, '%Y-%m-%dT%H:%M:%S') as PUBLISHED_AT,
  it.event_type as SEARCH_QUERY, st.v as VIEW_COUNT, st.l as LIKE_COUNT, st.c as COMMENT_COUNT,
  case when st.user_id is not null then 'PT' || cast(st.np as varchar) || 'M' end as DURATION
from it left join st on st.user_id = it.user_id where it.rn = 1""",
}
