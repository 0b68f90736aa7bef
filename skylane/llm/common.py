"""Shared helpers of the corpus operators: word rules, shared-folder tables, size-checked joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.session import ensure_checkpoint_dir

#: ASCII white space; a word is a maximal run of anything else.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Most rows (or values, where rows hold arrays) a table may have to be sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text as an array (null text: empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(*cols: Column) -> Column:
    """A repeatable draw in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (``spark.checkpoint.dir``) and read it back.

    Cuts the lineage like ``checkpoint()``, but the result can be pruned by column and by value. The folder belongs
    to the application; remove it after the last result has been written.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/skylane-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (a stored table) with a broadcast hint if its counted rows allow it, else as it is."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_bytes(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a run of very long texts fits a worker's memory."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "4096"),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        spark.conf.set(key, value)


def fresh(df: DataFrame, prefix: str) -> str:
    """A prefix for working columns that no column of ``df`` begins with."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix


def together(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to ``most`` at most; a larger one is a range of its own."""
    a, n = 0, 0
    for z, size in enumerate(sizes):
        if z > a and n + size > most:
            yield a, z
            a, n = z, 0
        n += size
    if a < len(sizes):
        yield a, len(sizes)
