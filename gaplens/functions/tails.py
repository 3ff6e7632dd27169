"""Tail probabilities of common test statistics, without SciPy."""

from __future__ import annotations

import math


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000 + 20 * math.isqrt(int(a))):  # near x = a it takes some multiple of the root
        an = i * (a - i)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def _beta_part(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_part(a, b, x) / a
    return 1 - front * _beta_part(b, a, 1 - x) / b


def chi2_sf(x: float, df: float) -> float:
    """P(chi-squared with df degrees of freedom > x)."""
    return _gamma_upper(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    """P(|Student t| > |t|)."""
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The point below which Student's t lies with probability p > 0.5, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 2 * (1 - p):
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def ks_two_sided(d: float, n: int, m: int, exact_to: int = 10_000) -> float:
    """Two-sample Kolmogorov-Smirnov p-value; exact by lattice paths where max(n, m) is small enough, else asymptotic."""
    if d <= 0:
        return 1.0
    if max(n, m) <= exact_to and n * m <= 4_000_000:
        g = math.gcd(n, m)
        h = round(d * (n * m // g))  # paths that stay strictly inside |i/n - j/m| < d
        return min(1.0, max(0.0, 1 - _inside_paths(n, m, g, h)))
    en = n * m / (n + m)
    x = math.sqrt(en) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def _inside_paths(n: int, m: int, g: int, h: int) -> float:
    """Share of lattice paths from (0, 0) to (n, m) with |i m - j n| / g < h everywhere, row by row."""
    import numpy as np

    j = np.arange(m + 1)
    row = np.where(np.abs(j * n) // g < h, 1.0, 0.0)
    row = np.cumprod(row)
    for i in range(1, n + 1):
        inside = np.abs(i * m - j * n) < h * g
        # share[i, j] = share[i-1, j] * i/(i+j) + share[i, j-1] * j/(i+j)
        new = np.zeros(m + 1)
        left = 0.0
        for k in np.flatnonzero(inside):
            before = left if k and inside[k - 1] else 0.0
            new[k] = row[k] * i / (i + k) + before * k / (i + k)
            left = new[k]
        row = new
    return float(row[m])
