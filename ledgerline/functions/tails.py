"""Distributions for test statistics: scalars on the driver, after an aggregation."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def normal_quantile(p: float) -> float:
    return NORMAL.inv_cdf(p)


def normal_tail(x: float) -> float:
    """Probability above x."""
    return 0.5 * math.erfc(x / math.sqrt(2))


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float | None, df: float) -> float | None:
    """Two-sided p-value of Student's t; None without a statistic or degrees of freedom."""
    if t is None or not math.isfinite(t) or df <= 0:
        return None
    return beta_share(df / 2, 0.5, df / (df + t * t))


def required_periods(alpha: float | None, sd: float, size: float = 0.05, power: float = 0.8) -> float:
    """Periods that are needed to see ``alpha`` a period behind a residual ``sd``; infinite if either is not positive."""
    if alpha is None or alpha <= 0 or sd <= 0:
        return math.inf
    return ((normal_quantile(1 - size / 2) + normal_quantile(power)) * sd / alpha) ** 2


def wilcoxon(n: int, rank_sum: float, ties: float) -> float | None:
    """Two-sided p-value of the signed-rank test: ``rank_sum`` of the positive ones, ``ties`` the sum of t^3 - t. Exact up to 50 without ties, else the normal approximation."""
    if n <= 10:
        return None
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)  # of choosing ranks with a sum
        for rank in range(1, n + 1):
            for at in range(len(ways) - 1, rank - 1, -1):
                ways[at] += ways[at - rank]
        at = round(rank_sum)
        return min(1.0, 2 * min(sum(ways[: at + 1]), sum(ways[at:])) / 2**n)
    sd = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return 2 * normal_tail(abs(rank_sum - n * (n + 1) / 4) / sd) if sd > 0 else None


def welch(mean_a: float, var_a: float, n_a: int, mean_b: float, var_b: float, n_b: int) -> tuple[float, float] | None:
    """t and its two-sided p-value."""
    a, b = var_a / n_a, var_b / n_b
    if n_a < 2 or n_b < 2 or a + b <= 0:
        return None
    t = (mean_a - mean_b) / math.sqrt(a + b)
    return t, t_two_sided(t, (a + b) ** 2 / (a * a / (n_a - 1) + b * b / (n_b - 1)))
