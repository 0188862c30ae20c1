"""Distribution functions on the standard library and numpy only."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

NORMAL = NormalDist()


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(x: float, df: float) -> float:
    return gammaincc(df / 2, x / 2)


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isnan(t) or df <= 0:
        return math.nan
    half = betainc(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


def _invert(f: Callable[[float], float], lo: float, hi: float) -> float:
    """Where the increasing function f crosses zero."""
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def t_ppf(p: float, df: float) -> float:
    if df <= 0:
        return math.nan
    return _invert(lambda t: 1 - t_sf(t, df) - p, -1e6, 1e6) if df < 3 else _invert(lambda t: 1 - t_sf(t, df) - p, -1e3, 1e3)


def nct_cdf(t: float, df: float, delta: float) -> float:
    """Noncentral t, by its series of incomplete beta functions."""
    if t < 0:
        return 1 - nct_cdf(-t, df, -delta)
    x = t * t / (t * t + df)
    half = delta * delta / 2
    total, p, q = 0.0, math.exp(-half), delta * math.exp(-half) / math.sqrt(2) / math.gamma(1.5)
    for j in range(2000):
        total += p * betainc(j + 0.5, df / 2, x) + q * betainc(j + 1, df / 2, x)
        p *= half / (j + 1)
        q *= half / (j + 1.5)
        if j > half and abs(p) + abs(q) < 1e-16:
            break
    return min(1.0, max(0.0, NORMAL.cdf(-delta) + total / 2))


def t_test_power(effect: float, n1: float, n2: float, alpha: float) -> float:
    """Power of the two-sided t test for two independent groups."""
    df = n1 + n2 - 2
    crit = t_ppf(1 - alpha / 2, df)
    delta = effect * math.sqrt(n1 * n2 / (n1 + n2))
    return 1 - nct_cdf(crit, df, delta) + nct_cdf(-crit, df, delta)


def t_test_size(effect: float, power: float, alpha: float) -> float:
    """Size of either group that gives the power."""
    return _invert(lambda n: t_test_power(effect, n, n, alpha) - power, 2.0, 1e7)


def hypergeom_sf(k: int, total: int, good: int, drawn: int) -> float:
    """P(X > k) of a hypergeometric count."""
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    lo, hi = max(k + 1, drawn - (total - good), 0), min(good, drawn)
    return min(1.0, math.fsum(math.exp(choose(good, i) + choose(total - good, drawn - i) - choose(total, drawn)) for i in range(lo, hi + 1)))
