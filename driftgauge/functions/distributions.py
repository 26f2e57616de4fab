"""Distribution functions: of Spark columns where a closed form serves, else in numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """By bisection of the distribution function, then Newton steps."""
    if not 0 < p < 1:
        return -math.inf if p == 0 else math.inf if p == 1 else math.nan
    lo, hi = -40.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - scale * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for k in range(1, 1000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= (step := c * d)
        if abs(step - 1) < 1e-16:
            break
    return scale * h


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = h = 1 / d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, k: float) -> float:
    return gamma_upper(k / 2, x / 2)


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


def _map(f, *cols):
    return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*cols)], dtype="float64")


@F.pandas_udf(DoubleType())
def _t(x: pd.Series, df: pd.Series) -> pd.Series:
    return _map(t_sf2, x, df)


@F.pandas_udf(DoubleType())
def _z(x: pd.Series) -> pd.Series:
    return _map(lambda v: 1 - normal_cdf(v), x)


@F.pandas_udf(DoubleType())
def _chi2(x: pd.Series, k: pd.Series) -> pd.Series:
    return _map(chi2_sf, x, k)


def t_two_sided(x: Column, df: Column) -> Column:
    """For result rows, of which there are few."""
    return _t(x, df)


def normal_upper(x: Column) -> Column:
    return _z(x)


def chi2_upper(x: Column, k: float) -> Column:
    return _chi2(x, F.lit(float(k)))


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def kde_log_density(sample: np.ndarray, y: float) -> float:
    """Log density of a Gaussian kernel estimate with Scott's bandwidth."""
    n = len(sample)
    h = sample.std(ddof=1) * n ** (-0.2)
    z = -0.5 * ((y - sample) / h) ** 2
    top = z.max()
    return float(top + math.log(np.exp(z - top).sum()) - math.log(n * h * math.sqrt(2 * math.pi)))
