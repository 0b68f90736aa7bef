"""A/B experiment operators.

Every statistic is computed from a handful of conditional aggregates, so the
row-level table is scanned once with map-side partial aggregation; hot arms or
segments (a third of all rows in one key) only ever send one partial row per
task to the final aggregate. Test math then runs on the driver-sized result
as plain column expressions (normal tails from ``functions.numeric``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import norm_sf2, to_count, to_double, zcrit
from ..session import ensure_checkpoint_dir
from ..sources.io import require_columns
from .common import fixed_width_histogram
from .ranking import global_position

MONITOR_NOTE = "Monitoring only; adjust for sequential testing if making stop/go decisions."
BLOCK_VALUES, MOST_BLOCKS = 4096, 1024  # distinct outcomes to a bootstrap task, and the most blocks they are dealt to


def coerce_outcome(c: Column | str) -> Column:
    """Outcome coerce: numeric or missing, missing -> 0, truncated to an integer."""
    return to_count(c)


def sanitize_ab(df: DataFrame, group_col: str = "GROUP", outcome_col: str = "CONVERTED") -> DataFrame:
    """Arm label to lower case, outcome coerced to an integer."""
    require_columns(df, [group_col, outcome_col], "experiment table")
    return df.withColumns({group_col: F.lower(F.col(group_col)), outcome_col: coerce_outcome(outcome_col)})


def ab_summary(df: DataFrame, group_col: str = "GROUP", outcome_col: str = "CONVERTED") -> DataFrame:
    """G1: per arm N (rows, incl. missing outcome), CONVERSIONS, CVR."""
    y = coerce_outcome(outcome_col)
    out = (df.filter(F.col(group_col).isNotNull())
             .groupBy(group_col)
             .agg(F.count(F.lit(1)).alias("N"), F.sum(y).alias("CONVERSIONS")))
    return out.withColumn("CVR", F.col("CONVERSIONS") / F.greatest(F.col("N"), F.lit(1)))


def ztest_exprs(n_c: Column, x_c: Column, n_t: Column, x_t: Column, alpha: float = 0.05) -> dict[str, Column]:
    """Two-proportion z-test with pooled SE (used for both z and CI)."""
    p1 = x_c / F.greatest(n_c, F.lit(1))
    p2 = x_t / F.greatest(n_t, F.lit(1))
    diff = p2 - p1
    pooled = (x_c + x_t) / F.greatest(n_c + n_t, F.lit(1))
    se = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / F.greatest(n_c, F.lit(1)) + F.lit(1.0) / F.greatest(n_t, F.lit(1))))
    z = F.when(se <= 0, F.lit(0.0)).otherwise(diff / se)
    p = F.when(se <= 0, F.lit(1.0)).otherwise(norm_sf2(z))
    zc = F.lit(zcrit(alpha))
    return {
        "cvr_control": p1,
        "cvr_treatment": p2,
        "abs_diff": diff,
        "rel_lift_pct": F.when(p1 > 0, diff / p1 * 100),
        "z_stat": z,
        "p_value": p,
        "ci_low": diff - zc * se,
        "ci_high": diff + zc * se,
        "significant": p < F.lit(alpha),
    }


def arm_counts(df: DataFrame, group_col: str, outcome_col: str, control_label: str, treatment_label: str,
               keys: Sequence[Column | str] = ()) -> DataFrame:
    """n/x per arm as columns n_c, x_c, n_t, x_t in one pass (exact label match)."""
    g = F.col(group_col)
    y = coerce_outcome(outcome_col)
    is_c, is_t = g == F.lit(control_label), g == F.lit(treatment_label)
    aggs = [
        F.count(F.when(is_c, 1)).alias("n_c"),
        F.coalesce(F.sum(F.when(is_c, y)), F.lit(0)).alias("x_c"),
        F.count(F.when(is_t, 1)).alias("n_t"),
        F.coalesce(F.sum(F.when(is_t, y)), F.lit(0)).alias("x_t"),
    ]
    return df.groupBy(*keys).agg(*aggs)


def ab_ztest(df: DataFrame, group_col: str = "GROUP", outcome_col: str = "CONVERTED",
             control_label: str = "control", treatment_label: str = "treatment", alpha: float = 0.05) -> DataFrame:
    """G1+G2 on a table: one row with the z-test result."""
    require_columns(df, [group_col, outcome_col], "experiment table")
    counts = arm_counts(df, group_col, outcome_col, control_label, treatment_label)
    e = ztest_exprs(F.col("n_c"), F.col("x_c"), F.col("n_t"), F.col("x_t"), alpha)
    return counts.select(*[v.alias(k) for k, v in e.items()])


def ab_srm(df: DataFrame, group_col: str = "GROUP", alpha: float = 0.05,
           control_label: str = "control", treatment_label: str = "treatment") -> DataFrame:
    """Sample-ratio mismatch, chi-square vs 50/50 with 1 dof."""
    g = F.col(group_col)
    counts = df.agg(F.count(F.when(g == control_label, 1)).alias("N_CONTROL"),
                    F.count(F.when(g == treatment_label, 1)).alias("N_TREATMENT"))
    nc, nt = F.col("N_CONTROL"), F.col("N_TREATMENT")
    exp = (nc + nt) / F.lit(2.0)
    chi2 = F.when(exp > 0, (nc - exp) * (nc - exp) / exp + (nt - exp) * (nt - exp) / exp)
    # chi2 with 1 dof: P(X > c) = erfc(sqrt(c/2)) = 2*(1 - Phi(sqrt(c)))
    p = F.when(exp > 0, norm_sf2(F.sqrt(chi2)))
    return counts.select(nc, nt, p.alias("SRM_PVALUE"), (p < F.lit(alpha)).alias("SRM_FLAG"))


def segment_ab(df: DataFrame, segment_col: str, group_col: str = "GROUP", outcome_col: str = "CONVERTED",
               control_label: str = "control", treatment_label: str = "treatment",
               min_n_per_arm: int = 50, alpha: float = 0.05) -> DataFrame:
    """Z-test per segment value; small arms get rates only and a skip reason."""
    seg = df.filter(F.col(segment_col).isNotNull()).withColumn("SEGMENT_VALUE", F.col(segment_col).cast("string"))
    return _segment_tests(arm_counts(seg, group_col, outcome_col, control_label, treatment_label, ["SEGMENT_VALUE"]),
                          min_n_per_arm, alpha)


def segment_ab_all(df: DataFrame, segment_cols: Sequence[str], group_col: str = "GROUP",
                   outcome_col: str = "CONVERTED", control_label: str = "control",
                   treatment_label: str = "treatment", min_n_per_arm: int = 50, alpha: float = 0.05) -> DataFrame:
    """G4 for several segment columns in one scan (unpivot, then one groupBy)."""
    present = [c for c in segment_cols if c in df.columns]
    if not present:
        raise ValueError("none of the segment columns are present")
    stacked = df.select(
        F.col(group_col), F.col(outcome_col),
        F.explode(F.array(*[F.struct(F.lit(c).alias("t"), F.col(c).cast("string").alias("v")) for c in present])).alias("s"),
    ).select(group_col, outcome_col, F.col("s.t").alias("SEGMENT_TYPE"), F.col("s.v").alias("SEGMENT_VALUE"))
    stacked = stacked.filter(F.col("SEGMENT_VALUE").isNotNull())
    counts = arm_counts(stacked, group_col, outcome_col, control_label, treatment_label, ["SEGMENT_TYPE", "SEGMENT_VALUE"])
    return _segment_tests(counts, min_n_per_arm, alpha, keep=["SEGMENT_TYPE"])


def _segment_tests(counts: DataFrame, min_n: int, alpha: float, keep: Sequence[str] = ()) -> DataFrame:
    nc, xc, nt, xt = F.col("n_c"), F.col("x_c"), F.col("n_t"), F.col("x_t")
    e = ztest_exprs(nc, xc, nt, xt, alpha)
    small = (nc < min_n) | (nt < min_n)

    def tested(c):
        return F.when(~small, c)

    return counts.select(
        *keep, "SEGMENT_VALUE",
        nc.alias("N_CONTROL"), nt.alias("N_TREATMENT"),
        e["cvr_control"].alias("CVR_CONTROL"), e["cvr_treatment"].alias("CVR_TREATMENT"),
        tested(e["abs_diff"]).alias("ABS_DIFF"),
        tested(e["rel_lift_pct"]).alias("RELATIVE_LIFT_PCT"),
        tested(e["p_value"]).alias("P_VALUE"),
        F.when(small, F.lit(False)).otherwise(e["significant"]).alias("SIGNIFICANT"),
        F.when(small, F.lit(f"min_n_per_arm<{min_n}")).otherwise(F.lit("")).alias("SKIP_REASON"),
    )


def order_segments(df: DataFrame) -> DataFrame:
    """G4 output order: relative lift desc, missing last."""
    return df.orderBy(F.col("RELATIVE_LIFT_PCT").desc_nulls_last(), "SEGMENT_VALUE")


def revenue_lens(df: DataFrame, keys: Sequence[str], group_col: str = "GROUP", outcome_col: str = "CONVERTED",
                 price_col: str = "DISPLAY_PRICE") -> DataFrame:
    """Visitors, bookings, revenue (price where converted), CVR, RPV, AOV per key set."""
    y = coerce_outcome(outcome_col)
    price = F.coalesce(to_double(price_col), F.lit(0.0))
    rev = F.when(y == 1, price).otherwise(F.lit(0.0))
    for k in (*keys, group_col):  # groups with a missing key are no groups
        df = df.filter(F.col(k).isNotNull())
    out = (df.groupBy(*keys, group_col)
             .agg(F.count(F.lit(1)).alias("VISITORS"), F.sum(y).alias("BOOKINGS"), F.sum(rev).alias("REVENUE")))
    return out.withColumns({
        "CVR": F.col("BOOKINGS") / F.col("VISITORS"),
        "RPV": F.col("REVENUE") / F.col("VISITORS"),
        "AOV": F.when(F.col("BOOKINGS") > 0, F.col("REVENUE") / F.col("BOOKINGS")),
    })


def revenue_pivot(df: DataFrame, key: str, group_col: str = "GROUP", outcome_col: str = "CONVERTED",
                  price_col: str = "DISPLAY_PRICE", arms: Sequence[str] = ("control", "treatment")) -> DataFrame:
    """CVR and RPV per key with arms as columns (explicit pivot values, no extra job)."""
    y = coerce_outcome(outcome_col)
    price = F.coalesce(to_double(price_col), F.lit(0.0))
    rev = F.when(y == 1, price).otherwise(F.lit(0.0))
    g = F.col(group_col)
    aggs = []
    for a in arms:
        n = F.count(F.when(g == a, 1))
        aggs.append(F.try_divide(F.sum(F.when(g == a, y)), n).alias(f"CVR_{a}"))
        aggs.append(F.try_divide(F.sum(F.when(g == a, rev)), n).alias(f"RPV_{a}"))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def linspace_cuts(n: int, checkpoints: int) -> list[int]:
    """Prefix sizes exactly as ``int(linspace(int(n/c), n, c))``."""
    return [int(v) for v in np.linspace(int(n / checkpoints), n, checkpoints).astype(int)]


def sequential_monitoring(df: DataFrame, time_col: str, group_col: str = "GROUP", outcome_col: str = "CONVERTED",
                          checkpoints: int = 10, tie_col: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Z-test on growing time-ordered prefixes.

    Each row is read once: rows get a global position in (time, tie) order
    (range partitioning + per-partition offsets, see ``ranking``), positions are
    mapped to the first checkpoint that covers them, and per-checkpoint counts
    are running sums over at most ``checkpoints`` buckets. Without ``tie_col``
    rows of one time are ordered by a hash of the row, whatever the layout.
    """
    require_columns(df, [time_col, group_col, outcome_col], "experiment table")
    ts = F.col(time_col).try_cast("timestamp") if dict(df.dtypes)[time_col] == "string" else F.col(time_col)
    tie = F.col(tie_col) if tie_col else F.xxhash64(*df.columns)  # rows with one hash are alike
    base = df.select(ts.alias("_t"), tie.alias("_tie"),
                     F.col(group_col).alias("_g"), coerce_outcome(outcome_col).alias("_y")) \
             .filter(F.col("_t").isNotNull())
    positioned, n = global_position(base, ["_t", "_tie"], "_pos")
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([], _SEQ_SCHEMA)
    cuts = linspace_cuts(n, checkpoints)
    distinct_cuts = sorted(set(cuts))
    # One pass: per arm, rows and conversions inside each prefix (<= c conditional aggregates).
    aggs = []
    for i, c in enumerate(distinct_cuts):
        inside = F.col("_pos") <= F.lit(c)
        aggs += [F.count(F.when(inside, 1)).alias(f"n{i}"),
                 F.coalesce(F.sum(F.when(inside, F.col("_y"))), F.lit(0)).alias(f"x{i}")]
    wide = positioned.filter(F.col("_g").isNotNull()).groupBy("_g").agg(*aggs)
    # Unpivot to (checkpoint, arm); duplicate cuts (n < checkpoints) repeat, as prefix loops do.
    long = wide.select("_g", F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), F.lit(c).cast("long").alias("cut"),
                 F.col(f"n{distinct_cuts.index(c)}").alias("n"), F.col(f"x{distinct_cuts.index(c)}").alias("x"))
        for j, c in enumerate(cuts)])).alias("s")).select("_g", "s.*").filter(F.col("n") > 0)
    w = Window.partitionBy("j")
    long = long.withColumn("n_arms", F.count(F.lit(1)).over(w)) \
               .withColumn("arm_rank", F.row_number().over(w.orderBy("_g")))
    lab = F.lower(F.col("_g"))
    is_c, is_t = lab == "control", lab == "treatment"

    def pick(val, cond):
        return F.min_by(F.when(cond, F.col(val)), F.when(cond, F.col("arm_rank")))

    per_cut = long.filter(F.col("n_arms") >= 2).groupBy("j", "cut").agg(
        F.max(is_c.cast("int")).alias("has_c"), F.max(is_t.cast("int")).alias("has_t"),
        pick("n", is_c).alias("nc_l"), pick("x", is_c).alias("xc_l"),
        pick("n", is_t).alias("nt_l"), pick("x", is_t).alias("xt_l"),
        pick("n", F.col("arm_rank") == 1).alias("n1"), pick("x", F.col("arm_rank") == 1).alias("x1"),
        pick("n", F.col("arm_rank") == 2).alias("n2"), pick("x", F.col("arm_rank") == 2).alias("x2"),
    )
    labelled = (F.col("has_c") == 1) & (F.col("has_t") == 1)
    nc = F.when(labelled, F.col("nc_l")).otherwise(F.col("n1"))
    xc = F.when(labelled, F.col("xc_l")).otherwise(F.col("x1"))
    nt = F.when(labelled, F.col("nt_l")).otherwise(F.col("n2"))
    xt = F.when(labelled, F.col("xt_l")).otherwise(F.col("x2"))
    e = ztest_exprs(nc, xc, nt, xt, 0.05)  # monitoring p-values always use 0.05
    return per_cut.select(F.col("cut").alias("CHECKPOINT_N"), e["cvr_control"].alias("CVR_CONTROL"),
                          e["cvr_treatment"].alias("CVR_TREATMENT"), e["abs_diff"].alias("ABS_DIFF"),
                          e["p_value"].alias("P_VALUE"), e["significant"].alias("SIGNIFICANT"),
                          F.lit(MONITOR_NOTE).alias("NOTE"))


_SEQ_SCHEMA = ("CHECKPOINT_N long, CVR_CONTROL double, CVR_TREATMENT double, ABS_DIFF double, "
               "P_VALUE double, SIGNIFICANT boolean, NOTE string")


# ---------------------------------------------------------------- bootstrap

def bootstrap_conversion_diff(df: DataFrame, group_col: str = "GROUP", outcome_col: str = "CONVERTED",
                              control_label: str = "control", treatment_label: str = "treatment",
                              n_bootstrap: int = 10000, seed: int = 42, alpha: float = 0.05,
                              num_slices: int | None = None) -> DataFrame:
    """Bootstrap of the conversion-rate difference.

    Outcomes are integers after coercion, so resampling an arm of n rows with
    replacement is exactly a multinomial draw over the arm's value histogram.
    The histogram is an aggregate (one row per distinct outcome value per arm);
    blocks of it and slices of the replicates are drawn in parallel by
    ``applyInPandas``, so the cost does not depend on the number of visitors.
    Returns one row: mean_diff, ci_lower, ci_upper, significant, n_bootstrap.
    """
    replicates = bootstrap_replicates(df, group_col, outcome_col, control_label, treatment_label,
                                      n_bootstrap, seed, num_slices)
    lo, hi = alpha / 2.0, 1.0 - alpha / 2.0
    return replicates.agg(
        F.avg("diff").alias("mean_diff"),
        F.percentile("diff", lo).alias("ci_lower"),
        F.percentile("diff", hi).alias("ci_upper"),
        F.count(F.lit(1)).alias("n_bootstrap"),
    ).withColumn("significant", (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0))


def bootstrap_replicates(df: DataFrame, group_col: str = "GROUP", outcome_col: str = "CONVERTED",
                         control_label: str = "control", treatment_label: str = "treatment",
                         n_bootstrap: int = 10000, seed: int = 42, num_slices: int | None = None) -> DataFrame:
    """One row per replicate: (rep, diff). Empty arm -> ValueError.

    The distinct outcomes of an arm lie in blocks. A replicate's draw is split as a multinomial is: first over
    the blocks' totals (every task draws the same split from the replicate's own seed), then inside each block.
    So a task holds one block, however many distinct outcomes there are.
    """
    y = coerce_outcome(outcome_col)
    g = F.col(group_col)
    ensure_checkpoint_dir(df.sparkSession)
    hist = (df.filter(g.isin(control_label, treatment_label))
              .groupBy(F.when(g == control_label, 0).otherwise(1).alias("arm"), y.alias("v"))
              .agg(F.count(F.lit(1)).alias("c"))).checkpoint()
    distinct = {r["arm"]: r["d"] for r in hist.groupBy("arm").agg(F.count(F.lit(1)).alias("d")).collect()}
    if len(distinct) < 2:
        raise ValueError("Control or treatment group is empty.")
    blocks = min(MOST_BLOCKS, -(-max(distinct.values()) // BLOCK_VALUES))
    slices = max(1, (num_slices or max(1, min(64, n_bootstrap // 500))) // blocks)
    hist = hist.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    totals = np.zeros((2, blocks), dtype=np.int64)
    for r in hist.groupBy("arm", "block").agg(F.sum("c").alias("n")).collect():  # at most 2 x MOST_BLOCKS rows
        totals[r["arm"], r["block"]] = r["n"]
    sizes = totals.sum(axis=1)

    def draw(key, part):  # self-contained: runs in Python workers without this package installed
        import numpy as np
        import pandas as pd
        arm, block, first = (int(x) for x in key)
        part = part.sort_values("v")
        vals, cnts = part["v"].to_numpy(dtype=float), part["c"].to_numpy()
        reps = np.arange(first, n_bootstrap, slices)
        out = np.empty(len(reps))
        for i, rep in enumerate(reps):
            here = np.random.default_rng([seed, int(rep), arm]).multinomial(sizes[arm], totals[arm] / sizes[arm])[block]
            inside = np.random.default_rng([seed, int(rep), arm, block + 1]).multinomial(here, cnts / cnts.sum())
            out[i] = float(np.dot(inside, vals))
        return pd.DataFrame({"rep": reps, "arm": arm, "total": out})

    keys = ["arm", "block", "slice"]
    dealt = hist.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(2 * blocks * slices, *keys)
    drawn = dealt.groupBy(*keys).applyInPandas(draw, "rep long, arm int, total double")

    def mean(arm):  # whole numbers: their sum does not depend on the order
        return F.sum(F.when(F.col("arm") == arm, F.col("total"))) / F.lit(float(sizes[arm]))
    return drawn.groupBy("rep").agg((mean(1) - mean(0)).alias("diff"))


def histogram(df: DataFrame, value_col: str, bins: int = 80, keys: Sequence[str] = ()) -> DataFrame:
    """Numpy-style fixed-width histogram (e.g. of bootstrap differences), optionally per key."""
    return fixed_width_histogram(df, value_col, bins, keys)
