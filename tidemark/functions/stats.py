"""Correlation tests without further libraries: statistics and two-sided p-values of two vectors."""

from __future__ import annotations

import math

import numpy as np


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + numerator * d or tiny)
            c = 1 + numerator / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    _, index, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[index]


def _pearson(x: np.ndarray, y: np.ndarray) -> float | None:
    x, y = x - x.mean(), y - y.mean()
    scale = math.sqrt((x * x).sum() * (y * y).sum())
    return None if scale == 0 else float(np.clip((x * y).sum() / scale, -1, 1))


def _by_student(r: float | None, n: int) -> tuple[float | None, float | None]:
    if r is None or n < 3:
        return r, None
    return r, 0.0 if abs(r) == 1 else student_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def pearson(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None]:
    """Correlation and p-value; nothing for constant vectors, no p-value under three observations."""
    return _by_student(_pearson(x, y), len(x))


def spearman(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None]:
    """Rank correlation with the p-value of Student's approximation."""
    return _by_student(_pearson(ranks(x), ranks(y)), len(x))


def inversion_counts(n: int) -> np.ndarray:
    """Number of orders of n things with each number of concordant pairs."""
    counts = np.ones(1)
    for k in range(2, n + 1):
        counts = np.convolve(counts, np.ones(k))
    return counts


def kendall(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None]:
    """Tau-b; exact p-value under 50 observations without ties, else the normal approximation corrected for ties."""
    n = len(x)
    upper = np.triu_indices(n, 1)
    a, b = np.sign(x[upper[0]] - x[upper[1]]), np.sign(y[upper[0]] - y[upper[1]])
    s, scale = float((a * b).sum()), math.sqrt((a != 0).sum() * (b != 0).sum())
    if scale == 0:
        return None, None
    tau = s / scale
    if n < 50 and (a != 0).all() and (b != 0).all():
        q = round((tau + 1) * n * (n - 1) / 4)
        p = inversion_counts(n) / math.factorial(n)
        return tau, float(min(1.0, 2 * min(p[: q + 1].sum(), p[q:].sum())))
    tx, ty = (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
    v0, vt, vu = (n * (n - 1) * (2 * n + 5), (tx * (tx - 1) * (2 * tx + 5)).sum(), (ty * (ty - 1) * (2 * ty + 5)).sum())
    v1 = (tx * (tx - 1)).sum() * (ty * (ty - 1)).sum() / (2 * n * (n - 1))
    v2 = (tx * (tx - 1) * (tx - 2)).sum() * (ty * (ty - 1) * (ty - 2)).sum() / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0.0
    variance = (v0 - vt - vu) / 18 + v1 + v2
    return tau, normal_two_sided(s / math.sqrt(variance)) if variance > 0 else None


METHODS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}
