"""Density nowcasts and their scores: Gaussian mixtures, samples, uniformity and coverage tests.

Column functions serve tables of results; numpy functions serve grouped maps.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf, kde_log_density, normal_cdf, normal_ppf
from .forecasters import nelder_mead


@dataclass
class Mixture:
    """A Gaussian mixture."""

    locs: np.ndarray
    scales: np.ndarray
    weights: np.ndarray

    @classmethod
    def gaussian(cls, loc: float, scale: float) -> Mixture:
        return cls(np.array([loc]), np.array([scale]), np.array([1.0]))

    @classmethod
    def bootstrap(cls, estimate: float, means: np.ndarray, stds: np.ndarray) -> Mixture:
        """Replicates as components, recentred on the estimate: filtering and parameter uncertainty together."""
        return cls(means - means.mean() + estimate, stds, np.full(len(means), 1 / len(means)))

    @property
    def mean(self) -> float:
        return float(self.weights @ self.locs)

    @property
    def std(self) -> float:
        return math.sqrt(float(self.weights @ (self.scales**2 + self.locs**2)) - self.mean**2)

    def cdf(self, x: float) -> float:
        return float(sum(w * normal_cdf((x - m) / s) for m, s, w in zip(self.locs, self.scales, self.weights)))

    def logpdf(self, x: float) -> float:
        e = np.log(self.weights) - 0.5 * ((x - self.locs) / self.scales) ** 2 - np.log(self.scales) - 0.5 * math.log(2 * math.pi)
        return float(e.max() + math.log(np.exp(e - e.max()).sum()))

    def ppf(self, p: float) -> float:
        if len(self.locs) == 1:
            return float(self.locs[0] + self.scales[0] * normal_ppf(p))
        lo, hi = float((self.locs - 12 * self.scales).min()), float((self.locs + 12 * self.scales).max())
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self.cdf(mid) < p else (lo, mid)
        return (lo + hi) / 2

    def interval(self, level: float) -> tuple[float, float]:
        return self.ppf((1 - level) / 2), self.ppf((1 + level) / 2)

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        k = rng.choice(len(self.weights), n, p=self.weights / self.weights.sum())
        return self.locs[k] + self.scales[k] * rng.standard_normal(n)

    def crps(self, y: float) -> float:
        """Closed form over pairs of components."""

        def a(m, s):
            z = m / s
            return m * (2 * normal_cdf(z) - 1) + 2 * s * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)

        first = sum(w * a(y - m, s) for m, s, w in zip(self.locs, self.scales, self.weights))
        second = sum(w * v * a(m - n, math.hypot(s, t)) for m, s, w in zip(self.locs, self.scales, self.weights) for n, t, v in zip(self.locs, self.scales, self.weights))
        return first - second / 2


def crps_gaussian(y: float, mean: float, std: float) -> float:
    z = (y - mean) / std
    return std * (z * (2 * normal_cdf(z) - 1) + 2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))


def crps_of_sample(y: float, x: np.ndarray, fair: bool = False) -> float:
    """Energy form by ranks; ``fair`` divides by m (m - 1)."""
    x, m = np.sort(x), len(x)
    pairs = 2 * float((2 * np.arange(1, m + 1) - m - 1) @ x)
    return float(np.abs(x - y).mean()) - pairs / (2 * m * (m - 1 if fair else m))


def log_score_of_sample(y: float, x: np.ndarray) -> float:
    return kde_log_density(x, y)


def pit_of_sample(y: float, x: np.ndarray, rng: np.random.Generator | None = None) -> float:
    """Share of the sample at or below y; with ``rng`` ties are split at random."""
    low, high = float((x < y).mean()), float((x <= y).mean())
    return high if rng is None else low + rng.random() * (high - low)


def berkowitz(pits: np.ndarray) -> dict:
    """Likelihood ratio of N(0, 1) scores against an AR(1) with free mean and variance; chi-squared, 3 degrees."""
    z = np.array([normal_ppf(min(max(p, 1e-6), 1 - 1e-6)) for p in pits])

    def loglik(mu, sigma, rho):
        if sigma <= 0 or abs(rho) >= 0.999:
            return -1e300
        e = z[1:] - mu - rho * (z[:-1] - mu)
        v0 = sigma**2 / (1 - rho**2)
        n = len(e)
        return -0.5 * (math.log(2 * math.pi * v0) + (z[0] - mu) ** 2 / v0) - 0.5 * (n * math.log(2 * math.pi * sigma**2) + float(e @ e) / sigma**2)

    th, best = nelder_mead(lambda t: -loglik(t[0], math.exp(t[1]), math.tanh(t[2])), np.array([z.mean(), math.log(max(z.std(), 1e-3)), 0.0]))
    lr = max(0.0, 2 * (-best - loglik(0.0, 1.0, 0.0)))
    return {"mean": float(th[0]), "sigma": math.exp(th[1]), "rho": math.tanh(th[2]), "lr": lr, "p_value": chi2_sf(lr, 3)}


def kolmogorov_pvalue(d: float, n: int) -> float:
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


def ks_uniformity(pits: np.ndarray) -> tuple[float, float]:
    u, n = np.sort(pits), len(pits)
    d = float(max((np.arange(1, n + 1) / n - u).max(), (u - np.arange(n) / n).max()))
    return d, kolmogorov_pvalue(d, n)


def quantile_weights(levels: list[float], kind: str = "uniform") -> list[float]:
    return [{"uniform": 1.0, "center": q * (1 - q), "left": (1 - q) ** 2, "right": q**2}[kind] for q in levels]


def pinball(actual: Column, quantile: Column, level: Column | float) -> Column:
    d = actual - quantile
    return F.when(d >= 0, level * d).otherwise((level - 1) * d)


def weighted_quantile_score(rows: DataFrame, by: list[str], kind: str = "uniform") -> DataFrame:
    """rows: by..., level, quantile, actual. 2 / K times the weighted sum of quantile scores, averaged over the rows of ``by``."""
    q = F.col("level")
    w = {"uniform": F.lit(1.0), "center": q * (1 - q), "left": (1 - q) * (1 - q), "right": q * q}[kind]
    return rows.groupBy(*by).agg((2 * F.avg(w * pinball(F.col("actual"), F.col("quantile"), q))).alias("score"))


def known_errors(errors: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``known``, the sorted errors of a row's model and horizon whose period was over at its vintage (``strict``: before it).

    Errors and vintages are events in order of date, and one window over each model and horizon collects what came
    before; no row is joined with the rows before it.
    """
    when = F.struct(F.col("period").alias("at"), F.lit(1 if strict else 0).alias("kind"), F.col("error").alias("e"), F.lit(None).cast(_row_type(errors)).alias("row"))
    asked = F.struct(F.col("vintage").alias("at"), F.lit(0 if strict else 1).alias("kind"), F.lit(None).cast("double").alias("e"), F.struct(*errors.columns).alias("row"))
    events = errors.select("model", "horizon", F.explode(F.array(when, asked)).alias("x")).select("model", "horizon", "x.*")
    before = Window.partitionBy("model", "horizon").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = events.withColumn("known", F.collect_list("e").over(before)).where(F.col("row").isNotNull())
    return got.select("row.*", F.sort_array("known").alias("known"))


def _row_type(df: DataFrame) -> str:
    return df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType.simpleString()


def quantile_of(known: Column, q: float) -> Column:
    """Linear interpolation between the values of a sorted array."""
    at = (F.size(known) - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    a, b = F.get(known, low), F.get(known, F.least(low + 1, F.size(known) - 1))
    return a + (b - a) * (at - low)


def empirical_bands(errors: DataFrame, levels: list[float], least: int = 8, strict: bool = False) -> DataFrame:
    """errors: model, horizon, vintage, period, forecast, actual, error. Every row gets its forecast plus the quantiles of the errors known at its vintage."""
    k = known_errors(errors, strict).withColumn("n", F.size("known").cast("long")).where(F.col("n") >= least)
    names = [f"q{round(100 * x):02d}" for x in levels]
    return k.select("model", "horizon", "vintage", "period", "forecast", "actual", "n", *[(F.col("forecast") + quantile_of(F.col("known"), q)).alias(c) for q, c in zip(levels, names)])


def sample_scores(errors: DataFrame, least: int = 8) -> DataFrame:
    """CRPS and probability transform of every row under the sample of its forecast plus the known errors, by ranks rather than pairs."""
    k = known_errors(errors).withColumn("n", F.size("known").cast("long")).where(F.col("n") >= least)
    own, n = F.col("error"), F.col("n")
    near = F.aggregate("known", F.lit(0.0), lambda s, e: s + F.abs(e - own)) / n
    ranked = F.zip_with("known", F.sequence(F.lit(1).cast("long"), n), lambda e, i: (2 * i - n - 1) * e)
    spread = F.aggregate(ranked, F.lit(0.0), lambda s, x: s + x) * 2 / (n * n)
    below = F.size(F.filter("known", lambda e: e <= own)) / n
    return k.select("model", "horizon", "vintage", "period", "n", (near - spread / 2).alias("crps"), below.cast("double").alias("pit"))


def error_scales(errors: DataFrame, winsorise: float | None = None) -> DataFrame:
    """Per model and horizon: n, bias, mean absolute and root mean square error, and the deviation that a normal error with that mean absolute one has.

    ``winsorise``: errors are pulled in to so many median absolute deviations from the median first.
    """
    e = errors
    if winsorise is not None:
        w = Window.partitionBy("model", "horizon")
        e = e.withColumn("_med", F.percentile("error", 0.5).over(w))
        e = e.withColumn("_mad", F.percentile(F.abs(F.col("error") - F.col("_med")), 0.5).over(w))
        e = e.withColumn("error", F.greatest(F.least("error", F.col("_med") + winsorise * F.col("_mad")), F.col("_med") - winsorise * F.col("_mad")))
    x = F.col("error")
    return e.groupBy("model", "horizon").agg(F.count("*").alias("n"), F.avg(x).alias("bias"), F.avg(F.abs(x)).alias("mae"), F.sqrt(F.avg(x * x)).alias("rmse"), (F.avg(F.abs(x)) * math.sqrt(math.pi / 2)).alias("sigma_mae"))


def gaussian_log_score(errors: DataFrame) -> DataFrame:
    """Mean log density of each model's and horizon's errors under a normal one with their deviation."""
    e = errors.withColumn("_s", F.stddev_samp("error").over(Window.partitionBy("model", "horizon")))
    z = F.col("error") / F.col("_s")
    return e.groupBy("model", "horizon").agg(F.avg(-0.5 * z * z - F.log("_s") - 0.5 * math.log(2 * math.pi)).alias("log_score"))


def uniformity_distance(errors: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov distance from the uniform of the normal transforms of each model's and horizon's standardised errors."""
    from ..functions.distributions import normal_upper

    w = Window.partitionBy("model", "horizon")
    u = 1 - normal_upper((F.col("error") - F.avg("error").over(w)) / F.stddev_samp("error").over(w))
    r = errors.withColumn("_u", u).withColumn("_n", F.count("error").over(w))
    r = r.withColumn("_i", F.row_number().over(w.orderBy("_u")))
    return r.groupBy("model", "horizon").agg(F.max("_n").alias("n"), F.max(F.greatest(F.col("_i") / F.col("_n") - F.col("_u"), F.col("_u") - (F.col("_i") - 1) / F.col("_n"))).alias("ks"))


def quantile_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: by..., level, quantile, actual. The mean quantile score of each group."""
    return rows.groupBy(*by).agg(F.avg(pinball(F.col("actual"), F.col("quantile"), F.col("level"))).alias("score"))


def interval_levels(columns: list[str]) -> dict[int, tuple[str, str]]:
    """Levels of the bands among columns such as q05, q95 or lower_90, upper_90."""
    out: dict[int, tuple[str, str]] = {}
    for c in columns:
        if (m := re.fullmatch(r"lower_(\d+)", c)) and f"upper_{m[1]}" in columns:
            out[int(m[1])] = (c, f"upper_{m[1]}")
        elif (m := re.fullmatch(r"q(\d\d)", c)) and int(m[1]) < 50 and f"q{100 - int(m[1]):02d}" in columns:
            out[100 - 2 * int(m[1])] = (c, f"q{100 - int(m[1]):02d}")
    return dict(sorted(out.items()))


def gaussian_quantiles(table: DataFrame, levels: tuple[float, ...] = (0.05, 0.16, 0.25, 0.5, 0.75, 0.84, 0.95), point: str = "estimate", std: str = "std") -> DataFrame:
    """Quantile columns of a point and a standard deviation."""
    return table.select("*", *[(F.col(point) + normal_ppf(q) * F.col(std)).alias(f"q{round(100 * q):02d}") for q in levels])


def fan_chart(m: Mixture, levels: tuple[float, ...] = (0.3, 0.6, 0.9)) -> list[dict]:
    """Bands of a distribution, widest last."""
    return [{"level": q, "lower": m.interval(q)[0], "upper": m.interval(q)[1]} for q in sorted(levels)]


def gaussian_bands(table: DataFrame, levels: list[float], point: str = "estimate", std: str = "std") -> DataFrame:
    """Long fan-chart rows: (…, level, lower, upper) from a point and a standard deviation."""
    z = F.create_map(*[F.lit(v) for q in levels for v in (q, normal_ppf((1 + q) / 2))])
    t = table.withColumn("level", F.explode(F.array(*[F.lit(q) for q in levels])))
    half = F.element_at(z, F.col("level")) * F.col(std)
    return t.withColumn("lower", F.col(point) - half).withColumn("upper", F.col(point) + half)


def tracker(news: DataFrame) -> DataFrame:
    """news: vintage, group, impact -> cumulative impact of each group over the vintages."""
    return news.groupBy("group", "vintage").agg(F.sum("impact").alias("impact")).withColumn("cumulative", F.sum("impact").over(Window.partitionBy("group").orderBy("vintage")))


def waterfall(steps: DataFrame, top: int) -> DataFrame:
    """steps: item, impact -> the largest impacts first, the others as one row."""
    r = steps.withColumn("_r", F.row_number().over(Window.orderBy(F.abs("impact").desc(), "item")))
    label = F.when(F.col("_r") <= top, F.col("item")).otherwise(F.lit("others"))
    place = F.when(F.col("_r") <= top, F.col("_r")).otherwise(F.lit(top + 1))
    return r.groupBy(label.alias("item"), place.cast("long").alias("place")).agg(F.sum("impact").alias("impact"))
