"""DuckDB SQL fragments used by the oracle texts.

The oracle is an independent formulation: series terms are computed in closed
form with ``lgamma`` rather than by the recurrences used on the Spark side.
Arguments are SQL expressions; pass plain column names to keep texts short.
"""

from __future__ import annotations

from statistics import NormalDist


def rnd(expr: str, digits: int) -> str:
    """NumPy-style half-even rounding (equals Spark ``np_round``)."""
    return f"round_even(({expr}), {digits})"


def erfc_pos(x: str) -> str:
    """erfc(x) for x >= 0 from sum_n 4^n n! x^(2n+1) / (2n+1)! (positive terms)."""
    series = (f"list_sum(list_transform(range(0, 161), lambda n: exp(n * ln(4) + lgamma(n + 1) "
              f"+ (2 * n + 1) * ln({x}) - lgamma(2 * n + 2))))")
    return (f"(case when ({x}) is null then null when ({x}) > 6 then 0e0 when ({x}) = 0 then 1e0 "
            f"else greatest(0e0, 1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * {series}) end)")


def norm_sf2(z: str) -> str:
    """Two-sided normal p-value 2*(1-Phi(|z|))."""
    return erfc_pos(f"abs({z}) / sqrt(2e0)")


def chi2_sf(x: str, k: str) -> str:
    """Chi-square upper tail for integer dof ``k``."""
    h = f"(({x}) / 2e0)"
    even = f"list_sum(list_transform(range(0, ({k}) // 2), lambda i: exp(-{h} + i * ln({h}) - lgamma(i + 1))))"
    odd = (f"({erfc_pos(f'sqrt({h})')} + coalesce(list_sum(list_transform(range(1, (({k}) - 1) // 2 + 1), "
           f"lambda i: exp(-{h} + (i - 0.5) * ln({h}) - lgamma(i + 0.5)))), 0e0))")
    return (f"(case when ({x}) is null or ({k}) is null or ({k}) < 1 then null when ({x}) <= 0 then 1e0 "
            f"when ({k}) % 2 = 0 then least(1e0, {even}) else least(1e0, {odd}) end)")


def zcrit(alpha: float = 0.05) -> str:
    return repr(NormalDist().inv_cdf(1.0 - alpha / 2.0))
