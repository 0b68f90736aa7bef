"""Small shared DataFrame helpers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField

from ..session import ensure_checkpoint_dir


#: Most rows and values (array elements and 16 characters of text count one each) of a table that may be
#: broadcast, and the tasks over which a key is spread beyond.
BROADCAST_ROWS = 200_000
BROADCAST_VALUES = 4_000_000
SALTS = 32


@dataclass(frozen=True)
class Size:
    rows: int
    values: int


def _values(field: StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, ArrayType):
        return F.greatest(F.size(c), F.lit(1))
    if isinstance(field.dataType, StringType):
        return F.coalesce(F.ceil(F.octet_length(c) / 16), F.lit(1))
    return F.lit(1)


def counted(per_key: DataFrame) -> tuple[DataFrame, Size]:
    """A per-key aggregate, computed once into the checkpoint folder, with its rows and values counted."""
    ensure_checkpoint_dir(per_key.sparkSession)
    side = per_key.checkpoint(eager=True)
    held = reduce(lambda a, b: a + b, [_values(f).cast("bigint") for f in side.schema.fields])
    rows, values = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0))).first()
    return side, Size(rows, values)


def join_counted(df: DataFrame, side: tuple[DataFrame, Size], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a counted per-key table to ``df``: broadcast if few rows and values, salted otherwise."""
    table, size = side
    if size.rows <= BROADCAST_ROWS and size.values <= BROADCAST_VALUES:
        return df.join(F.broadcast(table), list(keys), how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [*keys, "_salt"], how).drop("_salt")


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Join a per-key aggregate back onto ``df``.

    With no keys the aggregate has exactly one row; it is attached as a single
    scalar subquery (one struct, evaluated once, its fields read per row) --
    no join at all. A keyed aggregate is computed once (checkpointed) and
    counted: up to ``BROADCAST_ROWS`` rows and ``BROADCAST_VALUES`` values it is
    broadcast, so the rows of ``df`` don't move; a larger one is joined by key and salt, so a hot key
    is spread over ``SALTS`` tasks.
    """
    if keys:
        return join_counted(df, counted(per_key), keys, how)
    cols = per_key.columns
    one = per_key.select(F.struct(*cols).alias("_one")).scalar()
    return df.withColumn("_one", one).withColumns({c: F.col(f"_one.{c}") for c in cols}).drop("_one")


def fixed_width_histogram(df: DataFrame, value_col: str, bins: int, keys: Sequence[str] = (),
                          with_median: bool = False) -> DataFrame:
    """numpy.histogram-style fixed-width bins per key (edges from the key's min/max).

    Edges are ``i * step + lo`` (last edge = max), a value equal to the max falls in
    the last bin, and the computed bin is corrected against the edges as numpy does;
    a constant key gets the range [v - 0.5, v + 0.5].
    """
    v = F.col(value_col).cast("double")
    base = df.filter(v.isNotNull())
    for k in keys:
        base = base.filter(F.col(k).isNotNull())
    aggs = [F.min(v).alias("_lo0"), F.max(v).alias("_hi0")]
    if with_median:
        aggs.append(F.median(v).alias("MEDIAN"))
    stats = base.groupBy(*keys).agg(*aggs)
    same = F.col("_lo0") == F.col("_hi0")
    stats = stats.withColumns({
        "_lo": F.when(same, F.col("_lo0") - 0.5).otherwise(F.col("_lo0")),
        "_hi": F.when(same, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")),
    }).drop("_lo0", "_hi0")
    side = counted(stats) if keys else None
    j = join_counted(base, side, keys) if keys else attach(base, stats)
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))

    def edge(i):
        return F.when(i == bins, F.col("_hi")).otherwise(i * step + F.col("_lo"))

    idx0 = F.least(((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
    idx1 = F.when(v < edge(idx0), idx0 - 1).otherwise(idx0)
    idx = F.when((v >= edge(idx1 + 1)) & (idx1 != bins - 1), idx1 + 1).otherwise(idx1)
    counts = j.groupBy(*keys, idx.alias("BIN")).agg(F.count(F.lit(1)).alias("COUNT"))
    out = join_counted(counts, side, keys) if keys else attach(counts, stats)
    extra = ["MEDIAN"] if with_median else []
    return out.select(*keys, "BIN", edge(F.col("BIN")).alias("BIN_LOW"), edge(F.col("BIN") + 1).alias("BIN_HIGH"),
                      "COUNT", *extra)
