"""The event funnel (E15) over a stream, day by day, released by a watermark.

A day is closed once an event time a ``delay`` past its end has been seen. Until then its events are kept in order of arrival;
when it closes, the batch operator (``funnel.stage_times``) runs over the day's events, so events that arrive out of order
count as in a batch run. Events of a day that is closed already are late: they are kept and counted apart, not lost.

The stream's memory is a table in the shared folder, one part per micro-batch: ``clock`` (latest event time), ``open``
(events by day), ``reached`` (the stages of closed days), ``late``. A micro-batch reads the parts before its own and overwrites its own, so
one that is run again after a failure leaves the same table. A day is closed by one micro-batch only, and its
events are found by the day's folders.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.funnel import EVENT_STAGES, funnel_of_sums, stage_times

#: The part of days that ``finish`` closes.
LAST = 1 << 40


class EventFunnelStream:
    """State and results of one funnel under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, delay: timedelta = timedelta(days=3), entity_col: str = "user_id",
                 time_col: str = "ts", type_col: str = "event_type", stages: Sequence[str] = EVENT_STAGES):
        self.spark, self.root, self.delay, self.stages = spark, root.rstrip("/"), delay, list(stages)
        self.entity, self.time, self.type = entity_col, time_col, type_col

    def _parts(self, kind: str, before: int | None = None) -> DataFrame | None:
        """The parts of the micro-batches so far (before a given one); None while there is none."""
        try:
            df = self.spark.read.option("basePath", f"{self.root}/{kind}").parquet(f"{self.root}/{kind}/batch=*")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no part, or empty parts only
                raise
            return None
        return df if before is None else df.where(F.col("batch") < before)

    def _write(self, df: DataFrame, kind: str, batch_id: int, by: Sequence[str] = ()) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{kind}/batch={batch_id}")

    def _clock(self, before: int) -> datetime | None:
        seen = self._parts("clock", before)
        return None if seen is None else seen.agg(F.max("clock")).first()[0]

    def _closed_before(self, clock: datetime | None) -> date:
        """The first day that is still open."""
        return date.min if clock is None else (clock - self.delay).date()

    def _close(self, first: date, end: date | None, batch_id: int) -> None:
        """Write the stages that (entity, day) pairs reach on the days from ``first`` up to ``end`` (None: all)."""
        kept = self._parts("open", batch_id + 1)
        if kept is None:
            return
        days = F.col("day") >= F.lit(first.isoformat()).cast("date")
        if end is not None:
            days &= F.col("day") < F.lit(end.isoformat()).cast("date")
        reached = stage_times(kept.where(days), self.entity, self.time, self.type, self.stages).groupBy("_day").agg(
            *[F.count(f"_t{i}").alias(f"s{i}") for i in range(len(self.stages))])
        self._write(reached.withColumnRenamed("_day", "day"), "reached", batch_id)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch (for ``foreachBatch``)."""
        events = batch.select(self.entity, self.time, self.type).withColumn("day", F.to_date(self.time)).persist()
        before = self._clock(batch_id)
        first = self._closed_before(before)
        is_open = F.col("day") >= F.lit(first.isoformat()).cast("date")
        latest = events.agg(F.max(F.col(self.time)).cast("timestamp_ntz")).first()[0]
        clock = max((t for t in (before, latest) if t is not None), default=None)
        self._write(events.where(F.coalesce(~is_open, F.lit(True))), "late", batch_id)
        self._write(events.where(is_open), "open", batch_id, ["day"])
        if clock is not None:
            end = self._closed_before(clock)
            if end > first:
                self._close(first, end, batch_id)
            self._write(self.spark.createDataFrame([(clock,)], "clock timestamp_ntz"), "clock", batch_id)
        events.unpersist()

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Takes what has arrived and ends; starting it again goes on from there."""
        return (stream.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.root}/progress")
                .trigger(availableNow=True).start())

    def finish(self) -> None:
        """Close all days that are still open, as no more events will come. Running it again changes nothing."""
        self._close(self._closed_before(self._clock(LAST)), None, LAST)

    def funnel(self) -> DataFrame:
        """The funnel of all closed days, as ``funnel.event_funnel`` gives it."""
        reached = self._parts("reached")
        sums = [F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"_s{i}") for i in range(len(self.stages))]
        if reached is None:
            reached = self.spark.createDataFrame([], ", ".join(f"s{i} long" for i in range(len(self.stages))))
        else:  # a day that ``finish`` has closed may have been closed by a later micro-batch too, which knows more events
            reached = reached.groupBy("day").agg(*[F.min_by(f"s{i}", "batch").alias(f"s{i}") for i in range(len(self.stages))])
        return funnel_of_sums(reached.agg(*sums), self.stages)

    def late(self) -> DataFrame:
        """One row: events that came after their day was closed, and events without a time."""
        kept = self._parts("late")
        if kept is None:
            return self.spark.createDataFrame([(0, 0)], "LATE_EVENTS long, UNDATED_EVENTS long")
        return kept.agg(F.count("day").alias("LATE_EVENTS"), F.count(F.when(F.col("day").isNull(), 1)).alias("UNDATED_EVENTS"))
