"""Booking funnel operators (E10-E12, E15) on an event log.

A stage counts when it is first reached after the previous one, per entity and
day. The times of all stages are kept in one frame that goes through the
stages once: each stage reads only its own events (the event-type filter
reaches the parquet scan) and adds one column; counts, drop-offs per group and
their diagnosis are sums over that frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGE_LABELS = ["Search", "View", "Compare", "Intent", "Book"]
# Drop-off diagnosis text per stage.
DIAGNOSIS = {
    "View": "Visibility / listing attractiveness issue",
    "Compare": "Price-value mismatch or inadequate anchoring",
    "Intent": "Offer confidence problem (trust, cancellation, deal clarity)",
    "Book": "Checkout friction or final trust barrier",
}
DIAGNOSIS_DEFAULT = "Top-of-funnel mismatch"


def _stage_table(sums: DataFrame, key: str, labels: Sequence[str], count_name: str) -> DataFrame:
    """Unpivot wide stage sums to rows with drop-off vs previous stage and overall conversion."""
    cols = [f"_s{i}" for i in range(len(labels))]
    items = []
    for i, lab in enumerate(labels):
        v = F.col(cols[i])
        drop = F.lit(None).cast("double") if i == 0 else F.when(
            F.col(cols[i - 1]) != 0, (F.lit(1.0) - v / F.col(cols[i - 1])) * F.lit(100.0))
        items.append(F.struct(F.lit(i + 1).alias("STAGE_NO"), F.lit(lab).alias("STAGE"), v.alias(count_name),
                              drop.alias("DROP_OFF_PCT"),
                              (F.try_divide(v.cast("double"), F.col(cols[0]).cast("double")) * F.lit(100.0)).alias("OVERALL_CONVERSION_PCT")))
    return sums.select(key, F.explode(F.array(*items)).alias("s")).select(key, "s.*")


def funnel_summary(frame: DataFrame, stage_cols: Sequence[str], labels: Sequence[str] = STAGE_LABELS) -> DataFrame:
    """Per market and stage: visitors, drop-off % vs previous, overall % vs first."""
    sums = frame.groupBy("MARKET").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(stage_cols)])
    return _stage_table(sums, "MARKET", labels, "VISITORS")


def dropoff_diagnosis(summary: DataFrame, market_a: str, market_b: str) -> DataFrame:
    """Two markets side by side per stage, gap, worse market, diagnosis text."""
    s = summary.filter(F.col("MARKET").isin(market_a, market_b))
    a, b = F.col("MARKET") == market_a, F.col("MARKET") == market_b
    ca, cb = f"DROP_OFF_PCT_{market_a.upper()}", f"DROP_OFF_PCT_{market_b.upper()}"
    wide = s.groupBy("STAGE_NO", "STAGE").agg(
        F.max(F.when(a, 1)).alias("_ha"), F.max(F.when(b, 1)).alias("_hb"),
        F.max(F.when(a, F.col("DROP_OFF_PCT"))).alias(ca), F.max(F.when(b, F.col("DROP_OFF_PCT"))).alias(cb))
    wide = wide.filter(F.col("_ha").isNotNull() & F.col("_hb").isNotNull())  # inner join on stage
    gap = F.col(ca) - F.col(cb)
    diag = F.lit(DIAGNOSIS_DEFAULT)
    for st, text in DIAGNOSIS.items():
        diag = F.when(F.col("STAGE") == st, F.lit(text)).otherwise(diag)
    return wide.select("STAGE_NO", "STAGE", ca, cb, gap.alias("DROPOFF_GAP"),
                       F.when(gap > 0, F.lit(market_a)).otherwise(F.lit(market_b)).alias("WORSE_MARKET"),
                       diag.alias("DIAGNOSIS"))


# Default ordered stages of the event-log funnel.
EVENT_STAGES = ("view", "click", "signup", "purchase")


#: Their places among the booking stages.
EVENT_LABELS = ("Search", "View", "Intent", "Book")


def stage_times(events: DataFrame, entity_col: str = "user_id", time_col: str = "ts", type_col: str = "event_type",
                stages: Sequence[str] = EVENT_STAGES, groups: Sequence[str] = ()) -> DataFrame:
    """Per (entity, day) with the first stage: the time ``_t<i>`` each stage is first reached after the previous one."""
    keys = [entity_col, "_day", *groups]

    def stage_events(s):
        return events.filter(F.col(type_col) == s).select(entity_col, F.to_date(F.col(time_col)).alias("_day"), *groups, F.col(time_col).alias("_t"))

    wide = stage_events(stages[0]).groupBy(*keys).agg(F.min("_t").alias("_t0"))
    for i, s in enumerate(stages[1:], start=1):
        later = F.when(F.col("_t") > F.col(f"_t{i - 1}"), F.col("_t"))
        wide = wide.join(stage_events(s), keys, "left").groupBy(*keys).agg(
            *[F.min(f"_t{j}").alias(f"_t{j}") for j in range(i)], F.min(later).alias(f"_t{i}"))
    return wide


def funnel_of_sums(sums: DataFrame, stages: Sequence[str] = EVENT_STAGES) -> DataFrame:
    """The funnel of one row that holds how many reach each stage (``_s0``, ``_s1``, ...)."""
    return _stage_table(sums.withColumn("_all", F.lit("all")), "_all", list(stages), "ENTITY_DAYS").drop("_all")


def event_funnel(events: DataFrame, entity_col: str = "user_id", time_col: str = "ts",
                 type_col: str = "event_type", stages: Sequence[str] = EVENT_STAGES) -> DataFrame:
    """Per stage the ENTITY_DAYS reaching it, drop-off % and overall %."""
    wide = stage_times(events, entity_col, time_col, type_col, stages)
    sums = wide.agg(*[F.count(f"_t{i}").alias(f"_s{i}") for i in range(len(stages))])
    return funnel_of_sums(sums, stages)


def event_funnel_by_market(events: DataFrame, market_col: str = "MARKET", stages: Sequence[str] = EVENT_STAGES,
                           labels: Sequence[str] = EVENT_LABELS) -> DataFrame:
    """E10 on an event log: the funnel of every market."""
    wide = stage_times(events, stages=stages, groups=[market_col])
    reached = wide.select(F.col(market_col).alias("MARKET"), *[F.col(f"_t{i}").isNotNull().cast("bigint").alias(f"_r{i}") for i in range(len(stages))])
    return funnel_summary(reached, [f"_r{i}" for i in range(len(stages))], labels)
