"""Distribution functions that the engine lacks, in numpy for arrays and as column functions over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(0, 2_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def _invert(cdf, p: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-squared distribution."""
    return 1 - gamma_p(df / 2, x / 2)


def chi2_ppf(p: float, df: float) -> float:
    """Quantile of the chi-squared distribution; NaN without degrees of freedom."""
    return _invert(lambda x: gamma_p(df / 2, x / 2), p, 0.0, df + 50 * math.sqrt(2 * df) + 100) if df > 0 else math.nan


def normal_sf(z: float) -> float:
    """Upper tail of the normal distribution."""
    return math.erfc(z / math.sqrt(2)) / 2


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's distribution."""
    half = beta_i(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


def beta_ppf(p: float, a: float, b: float) -> float:
    """Quantile of the beta distribution."""
    return _invert(lambda x: beta_i(a, b, x), p, 0.0, 1.0)


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(odds ratio, two-sided p) of a 2x2 table: the tables with the same margins that are no likelier."""
    r, k, n = a + b, a + c, a + b + c + d
    choose = lambda m, j: math.lgamma(m + 1) - math.lgamma(j + 1) - math.lgamma(m - j + 1)
    logs = {x: choose(k, x) + choose(n - k, r - x) - choose(n, r) for x in range(max(0, r + k - n), min(r, k) + 1)}
    p = sum(math.exp(v) for v in logs.values() if v <= logs[a] + 1e-7)
    odds = math.inf if b * c == 0 and a * d > 0 else (a * d / (b * c) if b * c else math.nan)
    return odds, min(1.0, p)


def _lgamma(x):
    """Log gamma function of each positive entry: Stirling's series beyond ten, to which smaller entries are lifted."""
    x = np.asarray(x, float)
    low = x < 10
    z = np.where(low, x + 10, x)
    inv = 1 / (z * z)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv * (1 / 1680 - inv * (1 / 1188 - inv * 691 / 360_360))))) / z
    out = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    lifted = np.ones_like(x)
    for k in range(10):
        lifted = lifted * np.where(low, x + k, 1.0)
    return out - np.log(lifted)


def log_poisson(y, mu):
    """Log density of the Poisson distribution."""
    return y * np.log(mu) - mu - _lgamma(np.asarray(y) + 1.0)


def log_negbin(y, mu, phi):
    """Log density of the negative binomial with mean mu and dispersion phi (variance mu + mu^2 / phi)."""
    y = np.asarray(y, float)
    return _lgamma(y + phi) - _lgamma(phi) - _lgamma(y + 1) + phi * np.log(phi / (phi + mu)) + y * np.log(mu / (phi + mu))


def log_dirichlet_multinomial(counts, alpha) -> float:
    """Log probability of ordered draws with these counts under a Dirichlet prior."""
    counts, alpha = np.asarray(counts, float), np.asarray(alpha, float)
    return float(math.lgamma(alpha.sum()) - math.lgamma(alpha.sum() + counts.sum()) + (_lgamma(alpha + counts) - _lgamma(alpha)).sum())


def log_normal(x, mean=0.0, sd=1.0):
    """Log density of the normal distribution."""
    return -0.5 * ((x - mean) / sd) ** 2 - np.log(sd) - 0.5 * math.log(2 * math.pi)


def log_half_normal(x, sd=1.0):
    """Log density of the half-normal distribution; minus infinity below 0."""
    return np.where(np.asarray(x) >= 0, log_normal(x, 0.0, sd) + math.log(2), -np.inf)


def log_student(x, df, scale=1.0):
    """Log density of Student's distribution."""
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - np.log(scale) - (df + 1) / 2 * np.log1p((x / scale) ** 2 / df)


def column(function, *args: Column) -> Column:
    """A function of numbers as a column, in Arrow batches; NULL or NaN arguments give NULL."""

    @F.pandas_udf("double")
    def apply(*series):
        def one(*v):
            return None if any(x is None or x != x for x in v) else float(function(*v))

        return pd.Series([one(*v) for v in zip(*series)], dtype="float64")

    return apply(*[a.cast("double") for a in args])
