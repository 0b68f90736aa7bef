"""Table sources and sinks.

Reads are lazy: nothing here triggers a job except ``require_nonempty``.
Formats are tried in order by planning their scan, so column pruning and
predicate pushdown still reach the scan of whichever format is chosen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DEFAULT_FORMATS = ("parquet", "csv")


class MissingInputError(FileNotFoundError):
    pass


class SchemaError(ValueError):
    pass


def read_format(spark: SparkSession, path: str, fmt: str, schema: StructType | None = None,
                options: Mapping[str, str] | None = None) -> DataFrame:
    """Read one path; ``options`` pass through (e.g. ``timestampFormat`` for landed CSV)."""
    reader = spark.read.options(**dict(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        # Header CSV; without a schema types are inferred (one extra pass over
        # the file) -- pass a schema for large inputs.
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.csv(path)
    if fmt == "json":
        return reader.json(path)
    return reader.format(fmt).load(path)


def format_of(path: str) -> str:
    """Format by file ending; parquet where it says nothing."""
    fmt = path.rsplit(".", 1)[-1].lower()
    return fmt if fmt in ("parquet", "csv", "json", "orc") else "parquet"


def load_table(spark: SparkSession, base: str, name: str, formats: Sequence[str] = DEFAULT_FORMATS,
               schema: StructType | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """A1: load ``base/name.<fmt>`` for the first format that can be read."""
    return load_first(spark, [f"{base.rstrip('/')}/{name}.{fmt}" for fmt in formats], schema=schema, options=options)


def load_first(spark: SparkSession, paths: Iterable[str], schema: StructType | None = None,
               options: Mapping[str, str] | None = None) -> DataFrame:
    """A2: first readable of a list of candidate paths, in any file system Spark reads; the error lists every candidate.

    A path is tried by planning its scan: a missing path fails there, and so
    does a parquet or ORC file whose footer can't be read.
    """
    tried = []
    for p in paths:
        fmt = format_of(p)
        try:
            if schema is not None and fmt in ("parquet", "orc"):
                read_format(spark, p, fmt, None, options)
            return read_format(spark, p, fmt, schema, options)
        except (PySparkException, Py4JError) as e:
            tried.append(f"{p} ({str(e).strip().splitlines()[0][:120]})")
    raise MissingInputError("no readable input among: " + ", ".join(tried))


def save_landed_csv(df: DataFrame, path: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> None:
    """A5: header CSV of a landed table."""
    df.write.mode("overwrite").option("header", True).option("timestampFormat", timestamp_format).csv(path)


def load_landed_csv(spark: SparkSession, path: str, schema: StructType | str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """A5: read it back with its declared schema (no inference pass)."""
    return read_format(spark, path, "csv", schema, {"timestampFormat": timestamp_format})


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """A3/A4: parquet (default) or header CSV sink, optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def require_columns(df: DataFrame, cols: Iterable[str], what: str = "input") -> DataFrame:
    """Raise before any job runs when columns are missing."""
    have = set(df.columns)
    missing = [c for c in cols if c not in have]
    if missing:
        raise SchemaError(f"{what} is missing required columns: {missing}")
    return df


def require_nonempty(df: DataFrame, what: str = "input") -> DataFrame:
    """Fail on empty input (one cheap LIMIT 1 job)."""
    if df.isEmpty():
        raise SchemaError(f"{what} is empty")
    return df


def rename_if_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename old -> new only when old exists and new does not."""
    have = set(df.columns)
    todo = {old: new for old, new in mapping.items() if old in have and new not in have}
    return df.withColumnsRenamed(todo) if todo else df


def has_columns(df: DataFrame, cols: Iterable[str]) -> bool:
    """A8 helper: are all of ``cols`` already present?"""
    have = set(df.columns)
    return all(c in have for c in cols)


def enrich_if_missing(df: DataFrame, cols: Iterable[str], enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``enrich`` unless all of ``cols`` are present already."""
    return df if has_columns(df, cols) else enrich(df)


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    have = set(df.columns)
    for c in candidates:
        if c in have:
            return c
    return None
