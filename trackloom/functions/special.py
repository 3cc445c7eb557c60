"""Tails of distributions, without other packages."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / (c if abs(c) > tiny else tiny)
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f / a


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_tail(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def hypergeometric_tail(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= k) of drawing `drawn` of `total`, `marked` of them marked."""
    log = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    low, high = max(0, drawn + marked - total), min(drawn, marked)
    if k <= low:
        return 1.0
    return min(1.0, sum(math.exp(log(marked, i) + log(total - marked, drawn - i) - log(total, drawn)) for i in range(k, high + 1)))
