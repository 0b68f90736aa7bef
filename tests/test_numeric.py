import math

import numpy as np
from pyspark.sql import functions as F

from skylane.functions.numeric import chi2_sf, norm_sf2, np_round, to_count


def test_np_round_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = list(np.round(rng.uniform(-1000, 1000, 2000), 3)) + [0.125, 0.375, 2.675, -0.5, 1.5, 2.5]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r[0] for r in df.select(np_round("x", 2)).collect()]
    assert got == [float(v) for v in np.round(np.array(vals), 2)]


def test_norm_sf2_matches_erfc(spark):
    zs = [0.0, 0.3, -1.4, 1.96, 3.5, 5.9, 9.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(norm_sf2("z")).collect()]
    for z, p in zip(zs, got):
        assert abs(p - math.erfc(abs(z) / math.sqrt(2))) < 1e-14


def test_chi2_sf_closed_forms(spark):
    cases = [(3.2, 2, math.exp(-1.6)), (10.0, 4, math.exp(-5) * 6), (1.0, 1, math.erfc(math.sqrt(0.5))),
             (0.0, 3, 1.0), (7.5, 5, 0.18602983360286812)]
    df = spark.createDataFrame([(x, k) for x, k, _ in cases], "x double, k int")
    got = [r[0] for r in df.select(chi2_sf("x", "k")).collect()]
    for (_, _, want), p in zip(cases, got):
        assert abs(p - want) < 1e-12


def test_to_count_truncates_like_astype_int(spark):
    df = spark.createDataFrame([("3.7",), ("abc",), (None,), ("-2.9",), ("12",)], "s string")
    assert [r[0] for r in df.select(to_count("s")).collect()] == [3, 0, 0, -2, 12]
