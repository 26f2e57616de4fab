"""Seeded panels with a known truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.calendar import growth_weights


def factor_panel(n_monthly: int = 8, n_quarterly: int = 1, n_months: int = 120, phi: float = 0.7, noise: float = 0.5, seed: int = 0) -> tuple[pd.DataFrame, np.ndarray]:
    """Monthly series on one factor, quarterly ones on its triangular sum; the factor is returned too."""
    rng = np.random.default_rng(seed)
    f = np.zeros(n_months + 5)
    for t in range(1, len(f)):
        f[t] = phi * f[t - 1] + rng.standard_normal()
    load = rng.uniform(0.5, 1.5, n_monthly + n_quarterly)
    q = np.convolve(f, np.array(growth_weights(3)) / 3)[5 : 5 + n_months]
    f = f[5:]
    months = pd.period_range("2000-01", periods=n_months, freq="M").to_timestamp()
    out = {f"m{i}": load[i] * f + noise * rng.standard_normal(n_months) for i in range(n_monthly)}
    slot = np.arange(n_months) % 3 == 2
    out |= {f"q{i}": np.where(slot, load[n_monthly + i] * q + noise * rng.standard_normal(n_months), np.nan) for i in range(n_quarterly)}
    return pd.DataFrame(out, index=months), f


def weekly_panel(n_weeks: int = 520, n_weekly: int = 4, n_monthly: int = 5, phi: float = 0.9, noise: float = 0.6, start: str = "2010-01-03", ragged: bool = True, seed: int = 0) -> tuple[pd.DataFrame, np.ndarray]:
    """Weekly series on one weekly factor, and series of months and quarters on its mean over their weeks, in the last week that ends in them."""
    rng = np.random.default_rng(seed)
    f = np.zeros(n_weeks)
    for t in range(1, n_weeks):
        f[t] = phi * f[t - 1] + rng.standard_normal()
    weeks = pd.date_range(start, periods=n_weeks, freq="7D")
    ends = weeks + pd.Timedelta(days=6)
    out = {f"w{i}": rng.uniform(0.5, 1.5) * f + noise * rng.standard_normal(n_weeks) for i in range(n_weekly)}
    for name, freq, n in (("m", "M", n_monthly), ("q", "Q", 1)):
        period = ends.to_period(freq)
        mean = pd.Series(f).groupby(period).transform("mean").to_numpy()
        count = pd.Series(f).groupby(period).transform("size").to_numpy()
        last = np.append(period[1:] != period[:-1], period[-1].end_time.normalize() == ends[-1])
        slot = last & (count >= (4 if freq == "M" else 12))
        for i in range(n):
            out[f"{name}{i}"] = np.where(slot, rng.uniform(0.5, 1.5) * mean + noise * rng.standard_normal(n_weeks), np.nan)
    wide = pd.DataFrame(out, index=weeks)
    if ragged:
        for i, c in enumerate(wide.columns):
            wide.iloc[n_weeks - (i % 4) :, wide.columns.get_loc(c)] = np.nan
    return wide, f


def dynamic_panel(n_series: int = 20, n_factors: int = 2, n_periods: int = 240, phi: float = 0.7, noise: float = 0.5, own: float = 0.3, ragged: bool = True, start: str = "2000-01", seed: int = 0) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
    """Monthly series on several factors with autoregressive terms of their own, and the truth: factors and loadings."""
    rng = np.random.default_rng(seed)
    f, e = np.zeros((n_periods, n_factors)), np.zeros((n_periods, n_series))
    for t in range(1, n_periods):
        f[t] = phi * f[t - 1] + rng.standard_normal(n_factors)
        e[t] = own * e[t - 1] + noise * rng.standard_normal(n_series)
    load = rng.standard_normal((n_series, n_factors))
    wide = pd.DataFrame(f @ load.T + e, columns=[f"x{i}" for i in range(n_series)], index=pd.period_range(start, periods=n_periods, freq="M").to_timestamp())
    if ragged:
        for i in range(n_series):
            wide.iloc[n_periods - (i % 3) :, i] = np.nan
    return wide, {"factors": f, "loadings": load}


def two_step_example(n_periods: int = 180, n_series: int = 10, n_factors: int = 1, seed: int = 0) -> tuple[pd.DataFrame, np.ndarray]:
    """A monthly panel with a ragged edge and, first, a quarterly target on the mean of its factors."""
    wide, truth = dynamic_panel(n_series, n_factors, n_periods, seed=seed)
    f = truth["factors"]
    rng = np.random.default_rng(seed + 1)
    mean = np.array([f[max(0, t - 2) : t + 1].mean(0).sum() for t in range(n_periods)])
    target = np.where(np.arange(n_periods) % 3 == 2, mean + 0.2 * rng.standard_normal(n_periods), np.nan)
    target[-3:] = np.nan
    wide.insert(0, "target", target)
    return wide, f


def as_long(spark: SparkSession, wide: pd.DataFrame) -> DataFrame:
    """A simulated panel as (series, period, value)."""
    long = wide.rename_axis("period").reset_index().melt("period", var_name="series", value_name="value").dropna()
    long["period"] = long["period"].dt.date
    return spark.createDataFrame(long[["series", "period", "value"]], "series string, period date, value double")


def factor_panels(spark: SparkSession, replicates: int, **kwargs) -> DataFrame:
    """(replicate, series, period, value); every replicate's seed is its number, so a lost task gives the same rows again."""

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                wide, _ = factor_panel(seed=int(k), **kwargs)
                long = wide.rename_axis("period").reset_index().melt("period", var_name="series", value_name="value").dropna()
                long["period"] = long["period"].dt.date
                yield long.assign(replicate=int(k))[["replicate", "series", "period", "value"]]

    return spark.range(0, replicates, 1, min(replicates, 64)).mapInPandas(run, "replicate long, series string, period date, value double")
