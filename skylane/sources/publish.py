"""Sinks that split hot partitions (A3/A4) and inputs that were read before they are used (A2).

Both sides work on whole tables in Spark tasks: what is published is read back
and compared before it becomes visible, and a candidate input counts as
readable only once every column of every row was decoded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .io import MissingInputError, format_of, read_format

RUNS, DATA = "_runs", "data"
RUN_SCHEMA = "run string, published timestamp, fmt string, n_rows long, digest string"
CORRUPT = "_corrupt_record"


class PublishError(RuntimeError):
    pass


def content(df: DataFrame, columns: Sequence[str]) -> tuple[int, str]:
    """Row count and an order-free digest (sum of row hashes) of a table."""
    r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")).first()
    return r[0], r[1]


def publish_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_per_file: int = 5_000_000, fmt: str = "parquet") -> str:
    """A3/A4: write ``df`` below ``path``, read it back, and only then make it the published run; returns the run's id.

    Rows are rebalanced by the partition columns: small partitions share a task
    (one file each), a hot one is split by AQE into tasks of the advisory size (with
    the values that share its shuffle partition), and no file holds more than ``rows_per_file`` rows. The run is written in a folder
    of its own; its line in the table of runs is written last, so readers see the
    former run or all of the new one, and a job that dies leaves the former. The
    counts and digests of what was written and what was asked for must agree, else
    ``PublishError`` (also where ``df`` gives other rows when computed again: pass
    a table that doesn't). Null partition values come back as null; an empty table
    is published with its columns.
    """
    run = uuid.uuid4().hex
    target = f"{path.rstrip('/')}/{DATA}/{run}"
    spread = df.hint("rebalance", *partition_by) if partition_by else df.hint("rebalance")
    writer = spread.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(target)
    spark = df.sparkSession
    back = _read_run(spark, target, fmt, df.schema)
    asked, held = content(df, df.columns), content(back, df.columns)
    if asked != held:
        raise PublishError(f"{target} holds {held[0]} rows with digest {held[1]}, expected {asked[0]} with {asked[1]}")
    line = spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("published"), F.lit(fmt).alias("fmt"),
                                 F.lit(held[0]).cast("long").alias("n_rows"), F.lit(held[1]).alias("digest"))
    line.coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/{RUNS}")
    return run


def _read_run(spark: SparkSession, target: str, fmt: str, schema: StructType) -> DataFrame:
    back = spark.read.format(fmt).schema(_nullable(schema)).load(target)
    return back.select(*[F.col(f"`{c}`") for c in schema.names])


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def published_runs(spark: SparkSession, path: str) -> DataFrame:
    """The table of published runs, one row each."""
    return spark.read.schema(RUN_SCHEMA).json(f"{path.rstrip('/')}/{RUNS}")


def read_published(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest published run (ties: the greater id); filters on partition columns still prune folders."""
    last = published_runs(spark, path).agg(F.max(F.struct("published", "run", "fmt")).alias("r")).select("r.run", "r.fmt").first()
    if last.run is None:
        raise MissingInputError(f"nothing was published at {path}")
    return _read_run(spark, f"{path.rstrip('/')}/{DATA}/{last.run}", last.fmt, schema)


@dataclass(frozen=True)
class Checked:
    """A candidate that was read whole: its rows, its broken rows (raw line, file) and what was tried before it."""
    path: str
    rows: DataFrame
    rejects: DataFrame
    n_rows: int
    n_rejects: int
    tried: tuple[str, ...]


def _split_text(spark: SparkSession, path: str, fmt: str, schema: StructType, options: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a text format that fit the schema, and the lines that don't with the name of their file."""
    wide = StructType([*_nullable(schema).fields, StructField(CORRUPT, StringType(), True)])
    whole = read_format(spark, path, fmt, wide, {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false", "enforceSchema": "false"})
    # always true, but names every column: a line is broken by the whole schema, whatever columns a query asks for
    parsed = F.greatest(F.xxhash64(*[F.col(f"`{c}`") for c in schema.names]), F.lit(0)) >= 0
    whole = whole.select("*", F.col("_metadata.file_name").alias("_file")).where(parsed)
    good = whole.where(F.col(CORRUPT).isNull()).select(*[F.col(f"`{c}`") for c in schema.names])
    return good, whole.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("LINE"), F.col("_file").alias("FILE"))


def load_first_checked(spark: SparkSession, paths: Iterable[str], schema: StructType, max_reject_share: float = 0.0,
                       options: Mapping[str, str] | None = None) -> Checked:
    """A2: the first candidate that can be read to its end, with its broken rows apart.

    Each candidate is decoded whole, by tasks, before it is taken: a missing path, a
    damaged footer or page, or missing columns lead on to the next one. Text
    formats keep rows that fit the schema and set the others aside; a candidate
    with more than ``max_reject_share`` of its rows broken is passed over, and so
    is one without any row. The price is one more scan of what is taken. If no
    candidate is left the error names each with its reason.
    """
    tried = []
    for path in paths:
        fmt = format_of(path)
        try:
            if fmt in ("csv", "json"):
                good, rejects = _split_text(spark, path, fmt, schema, dict(options or {}))
            else:
                found = read_format(spark, path, fmt, None, options)
                good = found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
                rejects = spark.createDataFrame([], "LINE string, FILE string")
            n_rows, _ = content(good, schema.names)
            n_rejects = rejects.count()
        except (PySparkException, Py4JError) as e:
            tried.append(f"{path} ({str(e).strip().splitlines()[0][:120]})")
            continue
        if n_rows == 0 or n_rejects > max_reject_share * (n_rows + n_rejects):
            tried.append(f"{path} ({n_rejects} of {n_rows + n_rejects} rows broken)")
            continue
        return Checked(path, good, rejects, n_rows, n_rejects, tuple(tried))
    raise MissingInputError("no readable input among: " + ", ".join(tried))
