"""Demand forecasting baselines and series diagnostics.

Input is a forecast frame (one row per series and month: ``ds``, ``y``, regressors)
with optional series ``keys``. Every step is a window partitioned by the series
keys, a ``groupBy`` on them, or an equi-join on (keys, position) -- the seasonal
naive forecast joins each test row to the training row it copies instead of
collecting arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import np_round
from . import scan
from .cleaning import series_window
from .common import attach

SEASON_LEN = 12
MODELS = ("naive", "seasonal_naive", "linear_trend")
# Push-timing season labels by peak month.
WINTER_MONTHS, SUMMER_MONTHS = (11, 12, 1, 2), (6, 7, 8)
SEASON_WINTER, SEASON_SUMMER, SEASON_OTHER = "Peak Winter", "Summer Low", "Transition"
PUSH_TEXT = "Start push in %s and sustain until %s for peak month %s"


def index_series(df: DataFrame, keys: Sequence[str] = (), ds: str = "ds", y: str = "y") -> DataFrame:
    """Rows with both ds and y, numbered 0.. in time order per series, with the series length."""
    x = df.filter(F.col(ds).isNotNull() & F.col(y).isNotNull())
    w = series_window(keys, ds)
    return x.withColumns({"idx": F.row_number().over(w) - 1,
                          "n": F.count(F.lit(1)).over(Window.partitionBy(*keys) if keys else Window.partitionBy())})


SPLIT_ERROR = "Not enough observations for stable split."


def train_test_split(df: DataFrame, test_periods: int = 12, keys: Sequence[str] = (),
                     check: bool = True) -> DataFrame:
    """Flag the last ``test_periods`` rows of each series as test (``is_test``).

    A series with ``test_periods + 6`` rows or fewer fails the job with
    ``SPLIT_ERROR``; the check is evaluated inside the plan (``raise_error``), so
    it costs no separate job.
    """
    x = index_series(df, keys)
    if check:
        ok = F.when(F.col("n") <= test_periods + 6, F.raise_error(F.lit(SPLIT_ERROR))).otherwise(F.lit(True))
        x = x.filter(ok)
    return x.withColumn("is_test", F.col("idx") >= F.col("n") - test_periods)


def forecast_predictions(df: DataFrame, test_periods: int = 12, keys: Sequence[str] = (),
                         season_len: int = SEASON_LEN, check: bool = True) -> DataFrame:
    """Naive, seasonal-naive and linear-trend predictions on the test rows (long format)."""
    x = train_test_split(df, test_periods, keys, check)
    train = x.filter(~F.col("is_test"))
    test = x.filter(F.col("is_test"))
    fit = train.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_train"),
        F.max_by("y", "idx").alias("last_y"),
        F.regr_slope("y", F.col("idx").cast("double")).alias("slope"),
        F.regr_intercept("y", F.col("idx").cast("double")).alias("intercept"),
        F.max("ds").alias("train_end"))
    span = test.groupBy(*keys).agg(F.min("ds").alias("test_start"), F.max("ds").alias("test_end"))
    t = attach(attach(test, fit, keys), span, keys)
    i = F.col("idx") - F.col("n_train")
    src = F.when(F.col("n_train") >= season_len, F.col("n_train") - season_len + i % season_len)
    t = t.withColumn("src_idx", src)
    season = train.select(*keys, F.col("idx").alias("src_idx"), F.col("y").alias("season_y"))
    t = t.join(season, [*keys, "src_idx"], "left")
    preds = {
        "naive": F.col("last_y"),
        "seasonal_naive": F.coalesce(F.col("season_y"), F.col("last_y")),
        "linear_trend": F.col("intercept") + F.col("slope") * F.col("idx").cast("double"),
    }
    long = t.select(*keys, "ds", "y", "train_end", "test_start", "test_end", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), p.alias("pred")) for m, p in preds.items()])).alias("p"))
    long = long.select(*keys, F.col("p.model").alias("model"), "ds", "y", F.col("p.pred").alias("pred"),
                       "train_end", "test_start", "test_end")
    return long.withColumn("residual", F.col("y") - F.col("pred"))


def forecast_metrics(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE (denominator |y|, 1 when < 1e-9) per model, rounded to 4."""
    err = F.col("y") - F.col("pred")
    denom = F.when(F.abs(F.col("y")) < 1e-9, F.lit(1.0)).otherwise(F.abs(F.col("y")))
    m = preds.groupBy(*keys, "model").agg(
        F.avg(F.abs(err)).alias("MAE"), F.sqrt(F.avg(err * err)).alias("RMSE"),
        (F.avg(F.abs(err / denom)) * 100).alias("MAPE"))
    return m.select(*keys, F.col("model").alias("MODEL"), *[np_round(c, 4).alias(c) for c in ("MAE", "RMSE", "MAPE")])


def best_model(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The model with the lowest RMSE per series (model name breaks ties)."""
    w = Window.partitionBy(*keys).orderBy("RMSE", "MODEL") if keys else Window.partitionBy().orderBy("RMSE", "MODEL")
    return metrics.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def forecast_band(preds: DataFrame, best: DataFrame, keys: Sequence[str] = (), z: float = 1.96) -> DataFrame:
    """Best model's predictions with pred +/- z * sample std of its residuals (0 for one row)."""
    p = preds.join(best.select(*keys, F.col("MODEL").alias("model")), [*keys, "model"])
    sd = p.groupBy(*keys).agg(F.coalesce(F.stddev_samp("residual"), F.lit(0.0)).alias("resid_std"))
    p = attach(p, sd, keys)
    return p.select(*keys, "model", "ds", "y", F.col("pred").alias("yhat"), "residual", "resid_std",
                    (F.col("pred") - F.lit(z) * F.col("resid_std")).alias("lower"),
                    (F.col("pred") + F.lit(z) * F.col("resid_std")).alias("upper"))


def seasonal_index(df: DataFrame, value_col: str = "y", date_col: str = "ds", keys: Sequence[str] = ()) -> DataFrame:
    """Mean by month of year (1..12 always listed), peak if above the mean of the monthly means."""
    x = df.filter(F.col(value_col).isNotNull() & F.col(date_col).isNotNull())
    prof = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("N_ROWS"), F.min(date_col).alias("FIRST_DATE"),
                                F.max(date_col).alias("LAST_DATE"))
    means = x.groupBy(*keys, F.month(date_col).alias("MONTH")).agg(F.avg(value_col).alias("AVG_VALUE"))
    spine = prof.select(*keys, "N_ROWS", "FIRST_DATE", "LAST_DATE",
                        F.explode(F.sequence(F.lit(1), F.lit(12))).alias("MONTH"))
    out = spine.join(means, [*keys, "MONTH"], "left")
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    out = out.withColumn("MEAN_OF_MONTHS", F.avg("AVG_VALUE").over(w))
    return out.withColumn("SEASON", F.when(F.col("AVG_VALUE") > F.col("MEAN_OF_MONTHS"), "peak")
                          .when(F.col("AVG_VALUE") <= F.col("MEAN_OF_MONTHS"), "trough"))


def detect_spikes(df: DataFrame, value_col: str, date_col: str = "ds", threshold: float = 1.5, window: int = 6,
                  min_periods: int = 3, keys: Sequence[str] = (), long: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Rolling mean/sample-std over the last ``window`` rows incl. the current one; z >= threshold.

    ``long`` scans in parts (``scan``) instead of a task per series; ``ties`` then order rows of one date and stay as columns.
    """
    x = df.filter(F.col(value_col).isNotNull() & F.col(date_col).isNotNull()).select(*keys, date_col, *ties, value_col)
    v = F.col(value_col)

    def magnitude(w):
        w = w.rowsBetween(-(window - 1), 0)
        enough = F.count(v).over(w) >= min_periods
        mean = F.when(enough, F.avg(v).over(w))
        std = F.when(enough, F.nullif(F.stddev_samp(v).over(w), F.lit(0.0)))
        return {"SPIKE_MAGNITUDE": (v - mean) / std}
    x = scan.windowed(x, [date_col, *ties], window - 1, magnitude, keys) if long else x.withColumns(magnitude(series_window(keys, date_col)))
    return x.filter(F.col("SPIKE_MAGNITUDE") >= threshold)


def top_spikes(spikes: DataFrame, n: int = 5, date_col: str = "ds") -> DataFrame:
    """The ``n`` largest spikes, earlier date first on ties (a top-k report; the limit is the feature)."""
    return spikes.orderBy(F.col("SPIKE_MAGNITUDE").desc(), F.col(date_col).asc()).limit(n)


def regime_impact(df: DataFrame, before: str, trough_start: str, trough_end: str, after: str,
                  value_col: str = "y", date_col: str = "ds", keys: Sequence[str] = ()) -> DataFrame:
    """Mean before / within / after dates in one pass, and % change vs the first period."""
    d, v = F.col(date_col), F.col(value_col)
    m = df.groupBy(*keys).agg(
        F.avg(F.when(d < F.lit(before).cast("date"), v)).alias("PRE_MEAN"),
        F.avg(F.when((d >= F.lit(trough_start).cast("date")) & (d <= F.lit(trough_end).cast("date")), v)).alias("TROUGH_MEAN"),
        F.avg(F.when(d >= F.lit(after).cast("date"), v)).alias("POST_MEAN"))
    pre = F.col("PRE_MEAN")
    return m.withColumns({"TROUGH_VS_PRE_PCT": F.try_divide(F.col("TROUGH_MEAN") - pre, pre) * 100,
                          "POST_VS_PRE_PCT": F.try_divide(F.col("POST_MEAN") - pre, pre) * 100})


def yoy_growth(df: DataFrame, value_col: str = "y", date_col: str = "ds", keys: Sequence[str] = ()) -> DataFrame:
    """Yearly sums and % change vs the previous listed year."""
    y = df.groupBy(*keys, F.year(date_col).alias("YEAR")).agg(F.sum(value_col).alias("TOTAL"))
    prev = F.lag("TOTAL").over(series_window(keys, "YEAR"))
    return y.withColumn("YOY_PCT", (F.try_divide(F.col("TOTAL"), prev) - 1) * 100)


def lag_correlation(df: DataFrame, search_col: str, y_col: str = "y", date_col: str = "ds", max_lag: int = 6,
                    min_n: int = 6, threshold: float = 0.5, keys: Sequence[str] = (), long: bool = False,
                    ties: Sequence[str] = ()) -> DataFrame:
    """Pearson r of the search signal shifted by 0..max_lag rows against y, on complete rows.

    ``long`` scans in parts (``scan``) instead of a task per series; ``ties`` then order rows of one date.
    """
    x = df.filter(F.col(date_col).isNotNull() & F.col(search_col).isNotNull() & F.col(y_col).isNotNull())

    def shifts(w):
        return {f"_l{k}": F.lag(search_col, k).over(w) for k in range(max_lag + 1)}
    # all shifts in one window pass, then unpivot to (lag, shifted value, y)
    x = scan.windowed(x, [date_col, *ties], max_lag, shifts, keys) if long else x.withColumns(shifts(series_window(keys, date_col)))
    shifted = x.select(*keys, F.col(y_col).alias("yv"), *[f"_l{k}" for k in range(max_lag + 1)])
    lags = F.array(*[F.struct(F.lit(k).alias("lag_months"), F.col(f"_l{k}").alias("s")) for k in range(max_lag + 1)])
    long = shifted.select(*keys, "yv", F.explode(lags).alias("l")) \
                  .select(*keys, "yv", "l.lag_months", "l.s").filter(F.col("s").isNotNull())
    # every lag appears even when no row survives the shift
    lag_spine = df.select(*keys).distinct() if keys else None
    r = long.groupBy(*keys, "lag_months").agg(F.count(F.lit(1)).alias("n"), 
                                              F.try_divide(F.covar_pop("s", "yv"), F.stddev_pop("s") * F.stddev_pop("yv")).alias("_r"))
    if lag_spine is not None:
        spine = lag_spine.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag_months"))
    else:
        spine = df.sparkSession.range(0, max_lag + 1).select(F.col("id").cast("int").alias("lag_months"))
    out = spine.join(r, [*keys, "lag_months"], "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
    corr = F.when(F.col("n") >= min_n, F.nanvl("_r", F.lit(None).cast("double")))  # a constant side has no correlation
    return out.select(*keys, "lag_months", corr.alias("correlation"),
                      F.coalesce(F.abs(corr) >= threshold, F.lit(False)).alias("significant"), "n")


def push_timing(pred: DataFrame, lead_months: int = 3, q: float = 0.75, keys: Sequence[str] = ()) -> DataFrame:
    """Months whose forecast is at least the 75th percentile, with push window and season text."""
    x = pred.filter(F.col("ds").isNotNull() & F.col("yhat").isNotNull())
    thr = x.groupBy(*keys).agg(F.percentile("yhat", q).alias("_thr"))
    x = attach(x, thr, keys)
    peaks = x.filter(F.col("yhat") >= F.col("_thr"))
    mon = F.month("ds")
    start = F.date_format(F.add_months("ds", -lead_months), "yyyy-MM")
    end = F.date_format(F.add_months("ds", -1), "yyyy-MM")
    season = (F.when(mon.isin(*WINTER_MONTHS), SEASON_WINTER).when(mon.isin(*SUMMER_MONTHS), SEASON_SUMMER)
              .otherwise(SEASON_OTHER))
    out = peaks.select(*keys, F.col("ds").alias("PEAK_MONTH"), F.col("yhat").alias("FORECAST_PAX"),
                       start.alias("PUSH_START"), end.alias("PUSH_END"), season.alias("SEASON"))
    out = out.withColumn("RECOMMENDATION", F.format_string(PUSH_TEXT, F.col("PUSH_START"), F.col("PUSH_END"),
                                                           F.date_format("PEAK_MONTH", "yyyy-MM")))
    return out.orderBy(F.col("FORECAST_PAX").desc())
