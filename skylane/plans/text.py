"""Registered review-text and video queries over ``fx_hotel_reviews`` / ``fx_videos``, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import np_round
from ..operators import text as tx
from ..operators import topics as tp
from ..operators import valence as va
from ..operators import video as vd
from ..sources.fixtures import fx_hotel_reviews, fx_hotel_texts, fx_videos, table, with_views
from ..sources.io import rename_if_present

# Test lexicon and topic map derived from the most frequent corpus words (FIXTURES.md part 3);
# the default lexicon is almost absent from the invented prose.
TEST_POS = ("the", "and", "la", "der")
TEST_NEG = ("of", "to", "de", "in")
TEST_TOPICS = {"t1": ["the"], "t2": ["der", "und"], "t3": ["que", "la"], "t4": ["ment"], "t5": ["zzz"]}
TEST_VALENCE = {**{w: 1.0 for w in TEST_POS}, **{w: -1.0 for w in TEST_NEG}}
Z9 = 9

REVIEW_NAMES = {"place_id": "PLACE_ID", "name": "NAME", "market": "MARKET", "price_tier": "PRICE_TIER",
                "rating": "RATING", "review_texts": "REVIEW_TEXTS"}
VIDEO_NAMES = {"video_id": "VIDEO_ID", "published_at": "PUBLISHED_AT", "view_count": "VIEW_COUNT",
               "like_count": "LIKE_COUNT", "comment_count": "COMMENT_COUNT"}
SCORE_COLS = ["PLACE_ID", "REVIEW_INDEX", "MARKET", "PRICE_TIER", "RATING", "VADER_COMPOUND", "VADER_POS",
              "VADER_NEU", "VADER_NEG", "SENTIMENT_LABEL"]


def reviews(spark, sf):
    return tx.extract_reviews(rename_if_present(fx_hotel_reviews(spark, sf), REVIEW_NAMES))


def review_texts(spark, sf):
    """The reviews' places, indexes and texts; a document with several labels is there once, not once a label."""
    return tx.extract_reviews(rename_if_present(fx_hotel_texts(spark, sf), REVIEW_NAMES)).select("PLACE_ID", "REVIEW_INDEX", "REVIEW_TEXT")


def scored(spark, sf):
    return tx.topic_flags(tx.score_lexicon(reviews(spark, sf), TEST_POS, TEST_NEG), TEST_TOPICS)


def q_reviews_extract(spark, sf):
    return reviews(spark, sf)


def q_sentiment_lexicon(spark, sf):
    return tx.score_lexicon(reviews(spark, sf), TEST_POS, TEST_NEG).select(*SCORE_COLS)


def q_sentiment_valence(spark, sf):
    r = tx.score_valence(reviews(spark, sf), TEST_VALENCE)
    return r.select("PLACE_ID", "REVIEW_INDEX", "VALENCE_SUM", np_round("VADER_COMPOUND", Z9).alias("VADER_COMPOUND"),
                    "SENTIMENT_LABEL")


# Frequent corpus words as boosters, negations and contrast word, so that every rule fires often.
TEST_RULES = va.Rules(boosters={"a": 0.293, "und": 0.293, "que": -0.293, "is": -0.293}, negations=("for", "en", "with", "die"), contrast="que")


def q_sentiment_rules(spark, sf):
    return va.score_rules(reviews(spark, sf), TEST_VALENCE, TEST_RULES)


def q_topic_flags(spark, sf):
    r = tx.topic_flags(reviews(spark, sf), TEST_TOPICS)
    return r.select("PLACE_ID", "REVIEW_INDEX", *[f"TOPIC_{t.upper()}" for t in TEST_TOPICS], "PRIMARY_TOPIC")


def keyword_rows(spark, sf):
    """Thousands of keywords: the third to the sixteenth word of every document, dealt to forty topics."""
    words = F.slice(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), 3, 14)
    return (table(spark, sf, "documents").select(F.concat(F.lit("topic"), (F.col("doc_id") % 40).cast("string")).alias("topic"), F.explode(words).alias("keyword"))
            .where("length(keyword) >= 7").distinct())


def q_topic_table(spark, sf):
    return tp.topic_hits(review_texts(spark, sf), keyword_rows(spark, sf))  # reads texts that share keys as one


def q_topic_table_flags(spark, sf):
    rows = spark.createDataFrame([(t, k) for t, ks in TEST_TOPICS.items() for k in ks], "topic string, keyword string")
    return tp.flag_topics(reviews(spark, sf).select("PLACE_ID", "REVIEW_INDEX", "REVIEW_TEXT"), rows, list(TEST_TOPICS)).drop("REVIEW_TEXT")


def q_sentiment_by_market(spark, sf):
    return tx.aggregate_sentiment(scored(spark, sf), "MARKET")


def q_sentiment_by_price_tier(spark, sf):
    return tx.aggregate_sentiment(scored(spark, sf), "PRICE_TIER")


def q_sentiment_by_topic(spark, sf):
    return tx.aggregate_sentiment(scored(spark, sf), "PRIMARY_TOPIC")


def q_rating_alignment(spark, sf):
    return tx.rating_alignment(scored(spark, sf))


def q_label_shares(spark, sf):
    return tx.label_shares(scored(spark, sf), alignment=True)


def q_review_qc(spark, sf):
    return tx.review_qc(reviews(spark, sf))


def q_topic_drivers(spark, sf):
    return tx.topic_drivers(scored(spark, sf))


def q_topic_drivers_top(spark, sf):
    return tx.top_drivers(tx.topic_drivers(scored(spark, sf)), 10)


def q_marketing_actions(spark, sf):
    return tx.marketing_actions(scored(spark, sf))


def q_video_engagement(spark, sf):
    return vd.prepare_videos(rename_if_present(fx_videos(spark, sf), VIDEO_NAMES))


def q_sentiment_default(spark, sf):
    """The default lexicon and topic map."""
    r = tx.topic_flags(tx.score_lexicon(reviews(spark, sf)))
    return r.select("PLACE_ID", "REVIEW_INDEX", "VADER_COMPOUND", "SENTIMENT_LABEL", *[f"TOPIC_{t.upper()}" for t in tx.TOPIC_KEYWORDS], "PRIMARY_TOPIC")


def q_valence_large_lexicon(spark, sf):
    """A lexicon of ten thousand words, all but the test words absent from the corpus."""
    known = spark.createDataFrame([(w, v) for w, v in TEST_VALENCE.items()], "word string, valence double")
    rest = spark.range(10_000).select(F.concat(F.lit("absent"), F.col("id")).alias("word"), F.lit(0.5).alias("valence"))
    r = tx.score_valence(reviews(spark, sf), known.unionByName(rest))
    return r.select("PLACE_ID", "REVIEW_INDEX", "VALENCE_SUM", np_round("VADER_COMPOUND", Z9).alias("VADER_COMPOUND"), "SENTIMENT_LABEL")


QUERIES = {
    "sentiment_default": q_sentiment_default,
    "valence_large_lexicon": q_valence_large_lexicon,
    "reviews_extract": q_reviews_extract,
    "sentiment_lexicon": q_sentiment_lexicon,
    "sentiment_valence": q_sentiment_valence,
    "sentiment_rules": q_sentiment_rules,
    "topic_flags": q_topic_flags,
    "topic_table": q_topic_table,
    "topic_table_flags": q_topic_table_flags,
    "sentiment_by_market": q_sentiment_by_market,
    "sentiment_by_price_tier": q_sentiment_by_price_tier,
    "sentiment_by_topic": q_sentiment_by_topic,
    "rating_alignment": q_rating_alignment,
    "label_shares": q_label_shares,
    "review_qc": q_review_qc,
    "topic_drivers": q_topic_drivers,
    "topic_drivers_top": q_topic_drivers_top,
    "marketing_actions": q_marketing_actions,
    "video_engagement": q_video_engagement,
}

# ----------------------------------------------------------------------------- oracle

_SCALE = 10 ** 15
_WS = "(" + " || ".join(f"chr({ord(c)})" for c in tx.WS_CHARS) + ")"


def _lst(ws):
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


_RV = f""", rv as (select place_id as PLACE_ID, name as HOTEL_NAME, market as MARKET, '' as NEIGHBORHOOD,
  price_tier as PRICE_TIER, cast(rating as double) as RATING,
  list_filter(list_transform(string_split(review_texts, '|||'),
    lambda x: trim(x, {_WS})), lambda x: x <> '') as parts
  from fx_hotel_reviews),
reviews as (select PLACE_ID, HOTEL_NAME, MARKET, NEIGHBORHOOD, PRICE_TIER, RATING,
  unnest(range(len(parts))) as REVIEW_INDEX, unnest(parts) as REVIEW_TEXT from rv),
wd as (select *, list_distinct(regexp_extract_all(lower(REVIEW_TEXT), '{tx.WORD_PATTERN}')) as w from reviews),
pn as (select *, len(list_intersect(w, {_lst(TEST_POS)})) as p, len(list_intersect(w, {_lst(TEST_NEG)})) as n from wd),
sc0 as (select *, case when p + n = 0 then 0e0 else (p - n) / (p + n) end as VADER_COMPOUND,
  case when p + n = 0 then 0 else sign(p - n)::bigint * ((abs(p - n)::bigint * {_SCALE}) // (p + n)) end as SENT_UNITS from pn),
sc as (select *, greatest(VADER_COMPOUND, 0e0) as VADER_POS, 1e0 - abs(VADER_COMPOUND) as VADER_NEU,
  greatest(-VADER_COMPOUND, 0e0) as VADER_NEG,
  case when VADER_COMPOUND >= 0.05e0 then 'Positive' when VADER_COMPOUND <= -0.05e0 then 'Negative' else 'Neutral' end
    as SENTIMENT_LABEL from sc0),
st as (select *, {", ".join(
    f"cast(({' or '.join(f'contains(lower(REVIEW_TEXT), {chr(39)}{k}{chr(39)})' for k in kws)}) as integer) as TOPIC_{t.upper()}"
    for t, kws in TEST_TOPICS.items())},
  case {" ".join(f"when ({' or '.join(f'contains(lower(REVIEW_TEXT), {chr(39)}{k}{chr(39)})' for k in kws)}) then '{t}'"
                 for t, kws in TEST_TOPICS.items())} else 'general' end as PRIMARY_TOPIC from sc)
"""

_MEAN = f"(cast(sum(SENT_UNITS) as double) / (cast(count(SENT_UNITS) as double) * {_SCALE}e0))"


def _agg(group):
    return f"""select {group}, count(REVIEW_TEXT) as REVIEW_COUNT, round_even({_MEAN}, 3) as AVG_COMPOUND,
  round_even(median(VADER_COMPOUND), 3) as MEDIAN_COMPOUND, round_even(stddev_samp(VADER_COMPOUND), 3) as STD_COMPOUND,
  round_even(count(case when SENTIMENT_LABEL = 'Positive' then 1 end) / count(*) * 100, 3) as PCT_POSITIVE,
  round_even(count(case when SENTIMENT_LABEL = 'Negative' then 1 end) / count(*) * 100, 3) as PCT_NEGATIVE,
  round_even(count(case when SENTIMENT_LABEL = 'Neutral' then 1 end) / count(*) * 100, 3) as PCT_NEUTRAL
from st where {group} is not null group by {group}"""


_ALIGN = f""", al0 as (select PLACE_ID, HOTEL_NAME, MARKET,
  arg_min(RATING, case when RATING is not null then REVIEW_INDEX end) as GOOGLE_RATING,
  {_MEAN} as AVG_SENTIMENT, count(REVIEW_TEXT) as REVIEW_COUNT
  from st where PLACE_ID is not null and HOTEL_NAME is not null and MARKET is not null group by PLACE_ID, HOTEL_NAME, MARKET),
al as (select *, case when GOOGLE_RATING < 3.5e0 and AVG_SENTIMENT > 0.3e0 then 'LowRating_PosSent'
  when GOOGLE_RATING >= 4e0 and AVG_SENTIMENT < 0 then 'HighRating_NegSent' else 'Aligned' end as MISMATCH from al0)
"""

_DRIVERS = """, dr as (select PRIMARY_TOPIC, count(REVIEW_TEXT) as REVIEW_COUNT, {mean} as AVG_COMPOUND,
  count(case when SENTIMENT_LABEL = 'Positive' then 1 end) / count(*) * 100 as PCT_POSITIVE,
  count(case when SENTIMENT_LABEL = 'Negative' then 1 end) / count(*) * 100 as PCT_NEGATIVE from st group by PRIMARY_TOPIC),
drv as (select *, PCT_POSITIVE - PCT_NEGATIVE as NET_SENTIMENT from dr)
""".format(mean=_MEAN)


def _capital(w):
    return f"({w} = upper({w}) and {w} <> lower({w}))"


def _before(k, weight):
    """One of the three words before: its boost, and the sign it turns."""
    w = f"lower(b{k})"
    boost = "case " + " ".join(f"when {w} = '{x}' then {b}e0" for x, b in TEST_RULES.boosters.items()) + " else 0e0 end"
    loud = f"case when {_capital(f'b{k}')} and mixed then {va.CAPITALS}e0 else 0e0 end"
    negated = f"({w} in {tuple(TEST_RULES.negations)} or ends_with({w}, 'n''t'))"
    return (f"(({boost}) + sign({boost}) * ({loud})) * sign(valence) * {weight}e0",
            f"case when {negated} then {va.NEGATION}e0 else 1e0 end")


def _rules_sql():
    punct = va.EDGES
    x = f"valence + sign(valence) * case when {_capital('w')} and mixed then {va.CAPITALS}e0 else 0e0 end"
    for k, weight in enumerate(va.DISTANCE_WEIGHTS, 1):
        boost, turn = _before(k, weight)
        x = f"(({x}) + {boost}) * ({turn})"
    words = "cast(string_split_regex(REVIEW_TEXT, '[\\x20\\x09-\\x0D]+') as varchar[])"
    asked = "(length(REVIEW_TEXT) - length(replace(REVIEW_TEXT, '?', '')))"
    return f""", tk as (select PLACE_ID, REVIEW_INDEX,
  least(length(REVIEW_TEXT) - length(replace(REVIEW_TEXT, '!', '')), {va.MOST_EXCLAMATIONS}) * {va.EXCLAMATION}e0
    + case when {asked} <= 1 then 0e0 when {asked} <= {va.MOST_QUESTIONS} then {asked} * {va.QUESTION}e0 else {va.MANY_QUESTIONS}e0 end as e,
  list_filter(list_transform({words}, lambda t: regexp_replace(t, '{punct}', '', 'g')), lambda t: t <> '') as ws from reviews),
te as (select *, len(list_filter(ws, lambda t: {_capital('t')})) between 1 and len(ws) - 1 as mixed,
  coalesce(list_position(list_transform(ws, lambda t: lower(t)), '{TEST_RULES.contrast}'), 0) as turn,
  unnest(case when len(ws) = 0 then [null] else range(1, len(ws) + 1) end) as i from tk),
tw as (select PLACE_ID, REVIEW_INDEX, e, mixed, turn, i, ws[i] as w, case when i > 1 then ws[i - 1] end as b1,
  case when i > 2 then ws[i - 2] end as b2, case when i > 3 then ws[i - 3] end as b3 from te),
lx as (select * from (values {", ".join(f"('{w}', {v}e0)" for w, v in TEST_VALENCE.items())}) t(word, valence)),
tv as (select tw.*, cast(round_even((({x})
    * case when turn > 0 and i < turn then {va.BEFORE_CONTRAST}e0 when turn > 0 and i > turn then {va.AFTER_CONTRAST}e0 else 1e0 end) * 1e6, 0) as bigint) as v
  from tw left join lx on lx.word = lower(tw.w)),
ts as (select PLACE_ID, REVIEW_INDEX, max(e) as e, cast(coalesce(sum(v), 0) as double) / 1e6 as s0,
  cast(coalesce(sum(case when v > 0 then v + 1000000 end), 0) as double) / 1e6 as p0, cast(-coalesce(sum(case when v < 0 then v - 1000000 end), 0) as double) / 1e6 as n0,
  cast(count(case when w is not null and coalesce(v, 0) = 0 then 1 end) as double) as u from tv group by PLACE_ID, REVIEW_INDEX),
tz as (select PLACE_ID, REVIEW_INDEX, u, s0 + sign(s0) * e as VALENCE_SUM, p0 + case when p0 > n0 then e else 0e0 end as p,
  n0 + case when p0 < n0 then e else 0e0 end as n from ts),
tc as (select *, round_even(VALENCE_SUM / sqrt(VALENCE_SUM * VALENCE_SUM + 15e0), 4) as VADER_COMPOUND from tz)
select PLACE_ID, REVIEW_INDEX, VALENCE_SUM, VADER_COMPOUND,
  case when p + n + u = 0 then 0e0 else round_even(p / (p + n + u), 3) end as VADER_POS,
  case when p + n + u = 0 then 0e0 else round_even(u / (p + n + u), 3) end as VADER_NEU,
  case when p + n + u = 0 then 0e0 else round_even(n / (p + n + u), 3) end as VADER_NEG,
  case when VADER_COMPOUND >= 0.05e0 then 'Positive' when VADER_COMPOUND <= -0.05e0 then 'Negative' else 'Neutral' end as SENTIMENT_LABEL from tc"""


def _t(body):
    return with_views(_RV + body, "fx_hotel_reviews")


def _any_of(kws):
    return "(" + " or ".join(f"contains(lower(REVIEW_TEXT), '{k}')" for k in kws) + ")"


ORACLE = {
    "sentiment_default": _t(f""", pd as (select *, len(list_intersect(w, {_lst(tx.POSITIVE_WORDS)})) as dp,
  len(list_intersect(w, {_lst(tx.NEGATIVE_WORDS)})) as dn from wd),
cd as (select *, case when dp + dn = 0 then 0e0 else (dp - dn) / (dp + dn) end as c from pd)
select PLACE_ID, REVIEW_INDEX, c as VADER_COMPOUND,
  case when c >= 0.05e0 then 'Positive' when c <= -0.05e0 then 'Negative' else 'Neutral' end as SENTIMENT_LABEL,
  {", ".join(f"cast({_any_of(kws)} as integer) as TOPIC_{t.upper()}" for t, kws in tx.TOPIC_KEYWORDS.items())},
  case {" ".join(f"when {_any_of(kws)} then '{t}'" for t, kws in tx.TOPIC_KEYWORDS.items())} else 'general' end as PRIMARY_TOPIC from cd"""),
    "reviews_extract": _t("select * from reviews"),
    "sentiment_lexicon": _t("select " + ", ".join(SCORE_COLS) + " from sc"),
    "sentiment_valence": _t(f""", vs as (select PLACE_ID, REVIEW_INDEX, cast(
    len(list_filter(regexp_extract_all(lower(REVIEW_TEXT), '{tx.WORD_PATTERN}'), lambda x: x in {tuple(TEST_POS)}))
  - len(list_filter(regexp_extract_all(lower(REVIEW_TEXT), '{tx.WORD_PATTERN}'), lambda x: x in {tuple(TEST_NEG)})) as double) as VALENCE_SUM
  from reviews),
vc as (select *, VALENCE_SUM / sqrt(VALENCE_SUM * VALENCE_SUM + 15e0) as c from vs)
select PLACE_ID, REVIEW_INDEX, VALENCE_SUM, round_even(c, {Z9}) as VADER_COMPOUND,
  case when c >= 0.05e0 then 'Positive' when c <= -0.05e0 then 'Negative' else 'Neutral' end as SENTIMENT_LABEL from vc"""),
    "topic_flags": _t("select PLACE_ID, REVIEW_INDEX, " + ", ".join(f"TOPIC_{t.upper()}" for t in TEST_TOPICS)
                      + ", PRIMARY_TOPIC from st"),
    "topic_table_flags": _t("select PLACE_ID, REVIEW_INDEX, " + ", ".join(f"TOPIC_{t.upper()}" for t in TEST_TOPICS)
                            + ", PRIMARY_TOPIC from st"),
    "topic_table": _t(""", kw as (select distinct 'topic' || (doc_id % 40) as topic, unnest(string_split(lower(coalesce(text, '')), ' ')[3:16]) as keyword from documents)
select PLACE_ID, REVIEW_INDEX, topic as TOPIC, count(distinct keyword) as N_KEYWORDS from st join kw on length(keyword) >= 7 and contains(lower(REVIEW_TEXT), keyword)
group by PLACE_ID, REVIEW_INDEX, topic"""),
    "sentiment_by_market": _t(_agg("MARKET")),
    "sentiment_by_price_tier": _t(_agg("PRICE_TIER")),
    "sentiment_by_topic": _t(_agg("PRIMARY_TOPIC")),
    "rating_alignment": _t(_ALIGN + " select * from al"),
    "label_shares": _t(_ALIGN + """, lg as (select 'SENTIMENT_LABEL' as KIND, SENTIMENT_LABEL as VALUE from st
  union all select 'PRIMARY_TOPIC', PRIMARY_TOPIC from st union all select 'MISMATCH', MISMATCH from al),
lc as (select KIND, VALUE, count(*) as COUNT from lg where VALUE is not null group by KIND, VALUE)
select KIND, VALUE, COUNT, COUNT / sum(COUNT) over (partition by KIND) * 100 as PCT from lc"""),
    "review_qc": _t(f""" select count(*) as N_REVIEWS, count(distinct PLACE_ID) as N_HOTELS_WITH_REVIEWS,
  avg(length(REVIEW_TEXT)) as AVG_REVIEW_LEN,
  avg(case when trim(REVIEW_TEXT, {_WS}) = '' then 1e0 else 0e0 end) * 100
    as PCT_EMPTY_TEXT from reviews"""),
    "topic_drivers": _t(_DRIVERS + " select * from drv order by NET_SENTIMENT desc, REVIEW_COUNT desc, PRIMARY_TOPIC"),
    "topic_drivers_top": _t(_DRIVERS + " select * from drv order by NET_SENTIMENT desc, REVIEW_COUNT desc, PRIMARY_TOPIC limit 10"),
    "marketing_actions": _t(_ALIGN + _DRIVERS + f""", bm as ({_agg('MARKET')}),
tops as (select (select MARKET from bm order by AVG_COMPOUND desc, MARKET limit 1) as top,
                (select MARKET from bm order by AVG_COMPOUND, MARKET limit 1) as low,
                (select PRIMARY_TOPIC from drv order by NET_SENTIMENT desc, REVIEW_COUNT desc, PRIMARY_TOPIC limit 1) as best_t,
                (select PRIMARY_TOPIC from drv order by NET_SENTIMENT, REVIEW_COUNT desc, PRIMARY_TOPIC limit 1) as worst_t)
select 'High' as PRIORITY, 'Market Messaging' as AREA, top || ' has stronger sentiment than ' || low as INSIGHT,
  'Use ' || top || ' UGC/testimonials for performance creatives; fix trust frictions in ' || low as ACTION from tops where top is not null
union all select 'High', 'Content Strategy', 'Best perception topic: ' || best_t || '; weakest: ' || worst_t,
  'Lead ad copy with ' || best_t || ' strengths; launch remediation playbook for ' || worst_t from tops where best_t is not null
union all select 'Medium', 'Reputation Risk',
  cast((select count(*) from al where MISMATCH = 'HighRating_NegSent') as varchar) || ' hotels show high rating but negative sentiment mismatch',
  '{tx.ACTION_RISK[3]}'"""),
    "video_engagement": with_views("""
select video_id as VIDEO_ID, published_at as PUBLISHED_AT, cast(view_count as bigint) as VIEW_COUNT,
  cast(like_count as bigint) as LIKE_COUNT, cast(comment_count as bigint) as COMMENT_COUNT,
  cast(year(published_at) as integer) as PUBLISH_YEAR, cast(month(published_at) as integer) as PUBLISH_MONTH,
  dayname(published_at) as PUBLISH_DOW,
  round_even(like_count / greatest(view_count, 1) * 100, 3) as LIKE_RATE,
  round_even(comment_count / greatest(view_count, 1) * 100, 3) as COMMENT_RATE,
  round_even((like_count + comment_count) / greatest(view_count, 1) * 100, 3) as ENGAGEMENT_RATE
from fx_videos""", "fx_videos"),
}
ORACLE["sentiment_rules"] = _t(_rules_sql())
ORACLE["valence_large_lexicon"] = ORACLE["sentiment_valence"]
