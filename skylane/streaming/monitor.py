"""Structured Streaming form of the monitoring operators.

* ``ab_monitor``: G1+G2 as a running monitor -- one streaming aggregate of the
  per-arm counts (state is four numbers), with the z-test applied as a
  projection on every update. Output mode ``complete``/``update``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.experiment import coerce_outcome, ztest_exprs


def ab_monitor(stream: DataFrame, group_col: str = "GROUP", outcome_col: str = "CONVERTED",
               control_label: str = "control", treatment_label: str = "treatment", alpha: float = 0.05) -> DataFrame:
    """Running z-test over an experiment stream (write with outputMode complete or update)."""
    g = F.lower(F.col(group_col))
    y = coerce_outcome(outcome_col)
    counts = stream.agg(
        F.count(F.when(g == control_label, 1)).alias("n_c"),
        F.coalesce(F.sum(F.when(g == control_label, y)), F.lit(0)).alias("x_c"),
        F.count(F.when(g == treatment_label, 1)).alias("n_t"),
        F.coalesce(F.sum(F.when(g == treatment_label, y)), F.lit(0)).alias("x_t"))
    e = ztest_exprs(F.col("n_c"), F.col("x_c"), F.col("n_t"), F.col("x_t"), alpha)
    return counts.select(F.col("n_c").alias("N_CONTROL"), F.col("n_t").alias("N_TREATMENT"),
                         *[v.alias(k) for k, v in e.items()])
