"""Cleaning, calendar resampling and filling.

Series operators take ``keys`` (series identifiers such as route or keyword)
so many series run at once; every window is ``partitionBy(*keys)``. They run
on time-bucketed tables (one row per series and week/month), never on raw
event rows, so a window partition holds one series' calendar, not its events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import np_round, to_double
from ..sources.io import require_columns
from . import scan


def series_window(keys: Sequence[str], order: str | Column) -> Window:
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return w.orderBy(order)


def coerce_date(c: Column | str, dtype: str) -> Column:
    """Parse to a timestamp; unparsable text becomes NULL (no ANSI failure)."""
    c = F.col(c) if isinstance(c, str) else c
    if dtype == "string":
        return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    return c


def coerce_clean(df: DataFrame, date_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Coerce the date (drop rows where it fails) and value columns (bad -> NULL)."""
    require_columns(df, [date_col, *value_cols], "series table")
    types = dict(df.dtypes)
    out = df.withColumns({date_col: coerce_date(date_col, types[date_col]),
                          **{c: to_double(c) for c in value_cols}})
    return out.filter(F.col(date_col).isNotNull())


def drop_all_missing(df: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    """Drop rows whose value columns are all missing."""
    return df.dropna(how="all", subset=list(value_cols))


def ffill(df: DataFrame, date_col: str, value_cols: Sequence[str], limit: int | None = 2,
          keys: Sequence[str] = (), long: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """C4 (bounded, ``limit`` rows) / C10 forward part (unbounded when ``limit`` is None).

    ``long`` scans in parts (``scan``) instead of a task per series; ``ties`` then order rows of one date.
    """
    if long and limit is None:
        return scan.filled(df, [date_col, *ties], value_cols, keys, backward=False)
    if long:
        return scan.windowed(df, [date_col, *ties], limit, lambda w: {
            c: F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0)) for c in value_cols}, keys)
    w = series_window(keys, date_col)
    w = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in value_cols})


def ffill_bfill(df: DataFrame, date_col: str, value_cols: Sequence[str], keys: Sequence[str] = (), long: bool = False,
                ties: Sequence[str] = ()) -> DataFrame:
    """Unbounded forward fill, then backward fill of what is still missing; ``long`` and ``ties`` as in ``ffill``."""
    if long:
        return scan.filled(df, [date_col, *ties], value_cols, keys)
    w = series_window(keys, date_col)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    # the rows ahead are read backwards: a frame up to the last row would be read to its end for every row
    ahead = series_window(keys, F.desc("_nth")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_nth", F.row_number().over(w)).withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.last(c, ignorenulls=True).over(ahead)) for c in value_cols}).drop("_nth")


def clean_series(df: DataFrame, date_col: str, value_cols: Sequence[str], limit: int = 2,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Coerce, drop bad dates, drop all-missing rows, forward fill at most ``limit`` rows."""
    x = drop_all_missing(coerce_clean(df, date_col, value_cols), value_cols)
    return ffill(x, date_col, value_cols, limit, keys)


def month_spine(df: DataFrame, month_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every month start between each series' first and last month."""
    bounds = df.groupBy(*keys).agg(F.min(month_col).alias("_lo"), F.max(month_col).alias("_hi"))
    return bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias(month_col))


def resample_monthly(df: DataFrame, date_col: str, value_cols: Sequence[str], keys: Sequence[str] = (),
                     digits: int | None = 1, out_col: str = "DATE") -> DataFrame:
    """C5 core: calendar-complete monthly means (empty months kept as NULL), optionally rounded."""
    month = F.trunc(F.to_date(F.col(date_col)), "month").alias(out_col)
    means = df.groupBy(*keys, month).agg(*[F.avg(c).alias(c) for c in value_cols])
    spine = month_spine(means, out_col, keys)
    out = spine.join(means, [*keys, out_col], "left")
    if digits is not None:
        out = out.withColumns({c: np_round(c, digits) for c in value_cols})
    return out


def resample_trends_monthly(df: DataFrame, date_col: str, value_cols: Sequence[str], limit: int = 2,
                            keys: Sequence[str] = ()) -> DataFrame:
    """Clean (C1–C4) then monthly mean rounded to one decimal."""
    return resample_monthly(clean_series(df, date_col, value_cols, limit, keys), date_col, value_cols, keys)


def regressor_name(col: str) -> str:
    """``trend_`` + lower case, spaces and dashes to underscores."""
    return "trend_" + str(col).lower().replace(" ", "_").replace("-", "_")


def prepare_forecast_data(capacity: DataFrame, trends: DataFrame | None = None, date_col: str = "DATE",
                          y_col: str = "EST_PASSENGERS", trend_date_col: str = "DATE",
                          keys: Sequence[str] = ()) -> DataFrame:
    """Forecast frame ``ds, y[, supply_flights, load_factor], trend_*``.

    Regressors are unrounded monthly means joined on the exact month start,
    forward- then back-filled before rows with missing ``y`` are dropped.
    """
    types = dict(capacity.dtypes)
    c = capacity.withColumn(date_col, coerce_date(date_col, types[date_col])).filter(F.col(date_col).isNotNull())
    cols = [*keys, F.to_date(F.col(date_col)).alias("ds"), to_double(y_col).alias("y")]
    if "MONTHLY_FLIGHTS" in capacity.columns:
        cols.append(to_double("MONTHLY_FLIGHTS").alias("supply_flights"))
    if "LOAD_FACTOR" in capacity.columns:
        cols.append(to_double("LOAD_FACTOR").alias("load_factor"))
    out = c.select(*cols)
    if trends is not None:
        ttypes = dict(trends.dtypes)
        numeric = [n for n, t in ttypes.items() if n != trend_date_col and n not in keys
                   and (t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal"))]
        t = trends.withColumn(trend_date_col, coerce_date(trend_date_col, ttypes[trend_date_col])) \
                  .filter(F.col(trend_date_col).isNotNull())
        t = drop_all_missing(t, numeric)
        t_m = resample_monthly(t, trend_date_col, numeric, keys, digits=None, out_col="ds")
        t_m = t_m.select(*keys, "ds", *[F.col(n).alias(regressor_name(n)) for n in numeric])
        out = out.join(t_m, [*keys, "ds"], "left")
        out = ffill_bfill(out, "ds", [regressor_name(n) for n in numeric], keys)
    return out.filter(F.col("ds").isNotNull() & F.col("y").isNotNull())
