"""Ordered scans of long series (C4, C10, D10, D14): no series' rows meet in one task, however long it is.

Rows are numbered in the order of (keys, order columns) by range partitions with offsets (``ranking.global_position``) and
cut into parts of equal length by that number. What a part needs from before its border is carried over it:

* the last k rows (rolling windows, lags, bounded fills): a row near the end of a part is copied to the parts that begin
  within the next k rows, and left out of the result there;
* the last (or next) value that isn't missing, however far away: one row per part and key holds the part's own last and
  first value, a short window over a key's parts carries them on, and they are joined back to the parts.

Windows then run inside (part, keys). The work of a task is a part, whatever the number and length of the series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import attach
from .ranking import global_position

POS, PART, OWN = "_pos", "_part", "_own"


def placed(df: DataFrame, order_cols: Sequence[str], keys: Sequence[str] = (), parts: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with its place in the order and its part; and the length of a part. The order must be total."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, n = global_position(df, [*keys, *order_cols], POS)
    length = max(1, -(-n // parts))
    return x.withColumn(PART, F.floor((F.col(POS) - 1) / F.lit(length)).cast("long")), length


def windowed(df: DataFrame, order_cols: Sequence[str], back: int, build: Callable[[WindowSpec], dict[str, Column]],
             keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``df`` with the columns of ``build``, which looks back at most ``back`` rows in the window it is given."""
    x, length = placed(df, order_cols, keys, parts)
    reach = F.least(F.floor((F.col(POS) + F.lit(back - 1)) / F.lit(length)).cast("long"), F.lit((1 << 62)))
    x = x.withColumn("_first", F.col(PART)).withColumn(PART, F.explode(F.sequence(F.col(PART), F.greatest(reach, F.col(PART)))))
    x = x.withColumn(OWN, F.col(PART) == F.col("_first"))
    columns = build(Window.partitionBy(PART, *keys).orderBy(POS))
    return x.withColumns(columns).where(OWN).drop(POS, PART, OWN, "_first")


def filled(df: DataFrame, order_cols: Sequence[str], value_cols: Sequence[str], keys: Sequence[str] = (), backward: bool = True,
           parts: int | None = None) -> DataFrame:
    """Missing values take the last one before them and, with ``backward``, what is still missing the next one."""
    x, _ = placed(df, order_cols, keys, parts)
    present = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(POS).alias("p"), F.col(c).alias("v"))) for c in value_cols}
    ends = x.groupBy(*keys, PART).agg(*[F.max(s).alias(f"_z{i}") for i, s in enumerate(present.values())],
                                      *[F.min(s).alias(f"_a{i}") for i, s in enumerate(present.values())])
    along = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(PART)  # a row per part
    # looking ahead is looking back in reverse order: a frame that ends at the last row is read to its end for every row
    reverse = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc(PART))
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), reverse.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, PART, *[F.last(F.col(f"_z{i}.v"), ignorenulls=True).over(before).alias(f"_before{i}") for i in range(len(present))],
                          *[F.last(F.col(f"_a{i}.v"), ignorenulls=True).over(after).alias(f"_after{i}") for i in range(len(present))])
    # null keys meet as well
    names = [f"_{w}{i}" for i in range(len(keys)) for w in ("null", "key")]
    named = {n: v for i, k in enumerate(keys) for n, v in ((f"_null{i}", F.col(k).isNull()), (f"_key{i}", F.coalesce(F.col(k).cast("string"), F.lit(""))))}
    x = attach(x.withColumns(named) if named else x, (carried.withColumns(named) if named else carried).drop(*keys), [PART, *names], "left")
    inside = Window.partitionBy(PART, *keys).orderBy(POS)
    back = inside.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(PART, *keys).orderBy(F.desc(POS)).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for i, c in enumerate(value_cols):
        options = [F.last(c, ignorenulls=True).over(back), F.col(f"_before{i}")]
        if backward:
            options += [F.last(c, ignorenulls=True).over(ahead), F.col(f"_after{i}")]
        out[c] = F.coalesce(*options)
    return x.withColumns(out).select(*df.columns)
