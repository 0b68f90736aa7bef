"""Cleaning / resampling / forecasting edges and brute-force checks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylane.operators import cleaning as cl
from skylane.operators import demand as dm


def _weeks(spark, values, start="2020-01-06"):
    d0 = dt.date.fromisoformat(start)
    rows = [((d0 + dt.timedelta(weeks=i)).isoformat(), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "DATE string, kw string")


def test_ffill_limit_and_bad_values(spark):
    # gaps of 1, 2, 3 and 5 rows after valid values; 'x' is a bad number; the last date is unparsable
    vals = ["1", None, "2", None, None, "3", None, None, None, "4", None, None, None, None, None, "x"]
    df = _weeks(spark, vals).union(spark.createDataFrame([("not a date", "9")], "DATE string, kw string"))
    out = cl.clean_series(df, "DATE", ["kw"], limit=2).orderBy("DATE").collect()
    got = [r["kw"] for r in out]
    import pandas as pd
    s = pd.Series(pd.to_numeric(pd.Series(vals), errors="coerce")).dropna(how="all")
    # reference semantics: rows whose value is missing are dropped (single value column), then ffill(limit=2)
    assert got == [float(v) for v in s.ffill(limit=2)]


def test_ffill_multi_column_keeps_partial_rows(spark):
    df = spark.createDataFrame([("2020-01-06", 1.0, None), ("2020-01-13", None, 5.0), ("2020-01-20", None, None),
                                ("2020-01-27", None, 6.0), ("2020-02-03", None, 7.0), ("2020-02-10", None, 8.0)],
                               "DATE string, a double, b double")
    out = cl.clean_series(df, "DATE", ["a", "b"], limit=2).orderBy("DATE").collect()
    assert [r["a"] for r in out] == [1.0, 1.0, 1.0, None, None]
    assert [r["b"] for r in out] == [None, 5.0, 6.0, 7.0, 8.0]


def test_resample_keeps_empty_months(spark):
    df = spark.createDataFrame([("2020-01-06", 2.0), ("2020-01-13", 3.0), ("2020-03-02", 5.0)], "DATE string, kw double")
    out = cl.resample_trends_monthly(df, "DATE", ["kw"]).orderBy("DATE").collect()
    assert [(str(r["DATE"]), r["kw"]) for r in out] == [("2020-01-01", 2.5), ("2020-02-01", None), ("2020-03-01", 5.0)]


def test_forecast_ready_fill_order(spark):
    cap = spark.createDataFrame([("2020-01-01", 10, 100), ("2020-02-01", None, 110), ("2020-03-01", 12, 120),
                                 ("2020-04-01", 13, 130)], "DATE string, EST_PASSENGERS int, MONTHLY_FLIGHTS int")
    tr = spark.createDataFrame([("2020-02-10", 4.0), ("2020-02-17", 6.0), ("2020-04-06", 8.0)], "DATE string, `Kw-One` double")
    out = cl.prepare_forecast_data(cap, tr).orderBy("ds").collect()
    # leading month back-filled, March forward-filled, the missing-y row dropped after filling
    assert [r["ds"].isoformat() for r in out] == ["2020-01-01", "2020-03-01", "2020-04-01"]
    assert [r["trend_kw_one"] for r in out] == [5.0, 5.0, 8.0]
    assert [r["supply_flights"] for r in out] == [100.0, 120.0, 130.0]


def _series(spark, ys):
    d0 = dt.date(2015, 1, 1)
    rows = []
    for i, y in enumerate(ys):
        m = (d0.month - 1 + i)
        rows.append((dt.date(d0.year + m // 12, m % 12 + 1, 1), float(y)))
    return spark.createDataFrame(rows, "ds date, y double")


def test_split_needs_enough_rows(spark):
    with pytest.raises(Exception, match="Not enough observations"):
        dm.forecast_predictions(_series(spark, range(12)), test_periods=6).collect()  # 12 <= 6 + 6
    assert dm.forecast_predictions(_series(spark, range(13)), test_periods=6).count() == 18


def test_predictions_match_numpy(spark):
    rng = np.random.default_rng(5)
    ys = np.round(rng.uniform(0, 100, 40), 1)
    ys[-2] = 0.0  # y = 0 -> MAPE denominator 1
    df = _series(spark, ys)
    preds = {(r["model"], r["ds"]): r["pred"] for r in dm.forecast_predictions(df, 6).collect()}
    train, test = ys[:-6], ys[-6:]
    m, b = np.polyfit(np.arange(len(train), dtype=float), train, 1)
    ds = sorted({k[1] for k in preds})
    for i, d in enumerate(ds):
        assert preds[("naive", d)] == train[-1]
        assert preds[("seasonal_naive", d)] == train[-12 + i % 12]
        assert abs(preds[("linear_trend", d)] - (b + m * (len(train) + i))) < 1e-8
    met = {r["MODEL"]: r for r in dm.forecast_metrics(dm.forecast_predictions(df, 6)).collect()}
    p = np.full(6, train[-1])
    denom = np.where(np.abs(test) < 1e-9, 1.0, np.abs(test))
    assert met["naive"]["MAPE"] == round(float(np.mean(np.abs((test - p) / denom)) * 100), 4)
    assert met["naive"]["RMSE"] == round(float(np.sqrt(np.mean((test - p) ** 2))), 4)


def test_seasonal_naive_falls_back_to_naive(spark):
    df = _series(spark, range(17))  # 11 training rows < season of 12
    preds = [r["pred"] for r in dm.forecast_predictions(df, 6).filter(F.col("model") == "seasonal_naive").collect()]
    assert preds == [10.0] * 6


def test_spikes_rolling_includes_current_row(spark):
    ys = [10, 10, 11, 10, 50, 10, 10]
    df = _series(spark, ys)
    s = dm.detect_spikes(df, "y", "ds").collect()
    import pandas as pd
    x = pd.Series(ys, dtype=float)
    z = (x - x.rolling(6, min_periods=3).mean()) / x.rolling(6, min_periods=3).std().replace(0, np.nan)
    want = sorted(round(v, 9) for v in z[z >= 1.5])
    assert sorted(round(r["SPIKE_MAGNITUDE"], 9) for r in s) == want


def test_lag_correlation_min_rows(spark):
    df = _series(spark, range(10)).withColumn("s", F.col("y") * 2 + 1)
    out = {r["lag_months"]: r for r in dm.lag_correlation(df, "s", max_lag=6).collect()}
    assert out[0]["n"] == 10 and abs(out[0]["correlation"] - 1.0) < 1e-12 and out[0]["significant"]
    assert out[5]["n"] == 5 and out[5]["correlation"] is None and out[5]["significant"] is False


def test_push_timing_text(spark):
    df = spark.createDataFrame([(dt.date(2024, m, 1), float(v)) for m, v in [(1, 1), (2, 9), (7, 10), (11, 2), (12, 3)]],
                               "ds date, yhat double")
    rows = dm.push_timing(df).collect()
    assert [r["PEAK_MONTH"].month for r in rows] == [7, 2]
    assert rows[0]["SEASON"] == "Summer Low" and rows[1]["SEASON"] == "Peak Winter"
    assert rows[0]["RECOMMENDATION"] == "Start push in 2024-04 and sustain until 2024-06 for peak month 2024-07"
