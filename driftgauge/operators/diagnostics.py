"""Diagnostics of panels and residuals, as grouped aggregates and windows by series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import outliers
from .panel import by, masks, whole


def quality_report(panel: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Per series: slots, values, leading, interior and ragged gaps, outliers, first and last value. The panel has ``slot``."""
    m = masks(outliers(panel, threshold))
    count = lambda c: F.sum(F.col(c).cast("long")).alias(f"n_{c}")
    return m.groupBy("series").agg(*[count(c) for c in ("slot", "observed", "leading", "interior", "ragged", "outlier")], F.min(F.when(F.col("observed"), F.col("period"))).alias("first_observed"), F.max(F.when(F.col("observed"), F.col("period"))).alias("last_observed"))


def availability(panel: DataFrame, n: int = 24) -> DataFrame:
    """Each of the last n periods' cells: 0 no slot, 1 observed, 2 missing, 3 pending at the ragged edge."""
    last = F.dense_rank().over(Window.partitionBy("series").orderBy(F.col("period").desc()))
    m = masks(panel).withColumn("_r", last).where(F.col("_r") <= n)
    code = F.when(~F.col("slot"), 0).when(F.col("observed"), 1).when(F.col("ragged"), 3).otherwise(2)
    return m.select("series", "period", code.alias("code"))


def zscores(panel: DataFrame, rolling: int | None = None) -> DataFrame:
    """Standard scores over the whole sample or a trailing window of periods."""
    w = whole() if rolling is None else by().rowsBetween(-(rolling - 1), 0)
    z = (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))
    return panel.withColumn("z", z)


def group_means(z: DataFrame, groups: DataFrame) -> DataFrame:
    return z.join(groups, "series").groupBy("label", "period").agg(F.avg("z").alias("z"))


def autocorrelation(panel: DataFrame, lags: int) -> DataFrame:
    """Lag-k autocorrelation over the pairs there are, about the overall mean."""
    p = panel.withColumn("c", F.col("value") - F.avg("value").over(whole()))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("c") * F.lag("c", k).over(by())).alias("x")) for k in range(1, lags + 1)])
    p = p.withColumn("_x", pairs).withColumn("_v", F.sum(F.col("c") * F.col("c")).over(whole())).withColumn("_n", F.count("c").over(whole()))
    return p.select("series", "_v", "_n", F.explode("_x").alias("_x")).groupBy("series", F.col("_x.k").alias("lag")).agg((F.sum("_x.x") / F.max("_v")).alias("acf"), F.max("_n").alias("n"))


def ljung_box(panel: DataFrame, lags: int) -> DataFrame:
    """Q statistic and its chi-squared p-value."""
    from ..functions.distributions import chi2_upper

    a = autocorrelation(panel, lags)
    q = a.groupBy("series").agg(F.max("n").alias("n"), (F.max("n") * (F.max("n") + 2) * F.sum(F.col("acf") ** 2 / (F.col("n") - F.col("lag")))).alias("q"))
    return q.withColumn("p_value", chi2_upper(F.col("q"), lags))


def jarque_bera(panel: DataFrame) -> DataFrame:
    """Skewness, excess kurtosis (of populations), the statistic and its p-value."""
    c = F.col("value") - F.avg("value").over(whole())
    g = panel.withColumn("c", c).groupBy("series").agg(F.count("c").alias("n"), F.avg(F.col("c") ** 2).alias("m2"), F.avg(F.col("c") ** 3).alias("m3"), F.avg(F.col("c") ** 4).alias("m4"))
    s, k = F.col("m3") / F.pow("m2", F.lit(1.5)), F.col("m4") / (F.col("m2") * F.col("m2")) - 3
    jb = F.col("n") / 6 * (s * s + k * k / 4)
    return g.select("series", "n", s.alias("skewness"), k.alias("kurtosis"), jb.alias("statistic"), F.exp(-jb / 2).alias("p_value"))


def adjust_pvalues(rows: DataFrame, family: list[str], method: str = "holm") -> DataFrame:
    """Adds ``adjusted``: bonferroni, holm or fdr_bh within each family of tests."""
    all_ = Window.partitionBy(*family)
    rank = F.row_number().over(all_.orderBy("p_value"))
    p = rows.withColumn("_i", rank).withColumn("_m", F.count("*").over(all_))
    if method == "bonferroni":
        adj = F.col("p_value") * F.col("_m")
    elif method == "holm":
        adj = F.max(F.col("p_value") * (F.col("_m") - F.col("_i") + 1)).over(all_.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    else:
        adj = F.min(F.col("p_value") * F.col("_m") / F.col("_i")).over(all_.orderBy("_i").rowsBetween(0, Window.unboundedFollowing))
    return p.withColumn("adjusted", F.least(adj, F.lit(1.0))).drop("_i", "_m")


def sup_break(y, X, trim: float = 0.15) -> tuple[int, float]:
    """Largest Wald statistic of a change of all coefficients over the candidate dates of a regression (numpy)."""
    import numpy as np

    from .forecasters import ols

    n, k = X.shape
    _, whole_ssr = ols(X, y)
    best = (0, -np.inf)
    for t in range(max(k + 1, int(trim * n)), min(n - k - 1, int((1 - trim) * n))):
        ssr = ols(X[:t], y[:t])[1] + ols(X[t:], y[t:])[1]
        best = max(best, (t, n * (whole_ssr - ssr) / max(ssr, 1e-300)), key=lambda v: v[1])
    return best


def factor_shares(x, loadings, factors) -> dict:
    """Share of each series' variance that the common component explains (numpy)."""
    import numpy as np

    common = factors @ loadings.T
    return {"r2": 1 - np.nanvar(x - common, 0) / np.nanvar(x, 0), "shares": np.var(factors, 0) * (loadings**2).sum(0) / np.nanvar(x, 0).sum()}


def convergence(paths: DataFrame, by: list[str], order: str = "iteration", value: str = "loglik", tolerance: float = 1e-4, falls_beyond: float = 1e-9) -> DataFrame:
    """Per path of log-likelihoods: steps, falls, the largest fall, the last relative change and whether it is below the tolerance."""
    w = Window.partitionBy(*by).orderBy(order)
    p = paths.withColumn("_b", F.lag(value).over(w)).withColumn("_d", F.col(value) - F.col("_b"))
    p = p.withColumn("_r", F.abs(F.col("_d")) / ((F.abs(F.col(value)) + F.abs(F.col("_b"))) / 2 + 1e-12))
    fall = F.col("_d") < -falls_beyond * (F.abs(F.col("_b")) + 1)
    g = p.groupBy(*by).agg(F.count("*").alias("n_iter"), F.sum(F.coalesce(fall, F.lit(False)).cast("long")).alias("n_decreases"), F.coalesce(F.max(F.when(fall, -F.col("_d"))), F.lit(0.0)).alias("largest_decrease"), F.max_by("_r", order).alias("last_relative_change"))
    return g.withColumn("converged", F.coalesce(F.col("last_relative_change") < tolerance, F.lit(False)))


def break_ssr(y, X, t: int) -> float:
    """Sum of squared residuals of two regressions, before row t and from it on (numpy)."""
    from .forecasters import ols

    return ols(X[:t], y[:t])[1] + ols(X[t:], y[t:])[1]


_DRAWS: dict = {}


def sup_break_draws(k: int, trim: float = 0.15, n_sim: int = 4000, n_grid: int = 500, seed: int = 0):
    """Draws of the largest squared and scaled Brownian bridge of k dimensions between the trimmed ends; the null distribution of ``sup_break``."""
    import numpy as np

    key = (k, trim, n_sim, n_grid, seed)
    if key not in _DRAWS:
        rng = np.random.default_rng(seed)
        at = np.arange(1, n_grid + 1) / n_grid
        inside = (at >= trim) & (at <= 1 - trim)
        out = []
        for _ in range(0, n_sim, 500):
            w = rng.standard_normal((min(500, n_sim), k, n_grid)).cumsum(2) / np.sqrt(n_grid)
            bridge = w - at * w[:, :, -1:]
            out.append(((bridge**2).sum(1) / np.where(inside, at * (1 - at), np.inf)).max(1))
        _DRAWS[key] = np.sort(np.concatenate(out))
    return _DRAWS[key]


def sup_break_pvalue(statistic: float, k: int, trim: float = 0.15, **kwargs) -> float:
    d = sup_break_draws(k, trim, **kwargs)
    return float((d >= statistic).mean())


def sup_break_critical_values(k: int, trim: float = 0.15, levels: tuple[float, ...] = (0.1, 0.05, 0.01), **kwargs) -> dict[float, float]:
    import numpy as np

    d = sup_break_draws(k, trim, **kwargs)
    return {a: float(np.quantile(d, 1 - a)) for a in levels}


def effective_loadings(layout, loadings) -> list:
    """Each series' loadings on a factor that stays constant: its loadings times the sum of its aggregation weights (numpy)."""
    return [load * float(layout.at(i, 0).sum()) for i, load in enumerate(loadings)]


def projection_residuals(x, factors) -> tuple:
    """(residuals, loadings, r2) of each series on a constant and the factors, over the rows it has (numpy)."""
    import numpy as np

    from .forecasters import ols

    X = np.column_stack([np.ones(len(factors)), factors])
    out, load, r2 = np.full(x.shape, np.nan), [], []
    for i in range(x.shape[1]):
        ok = ~np.isnan(x[:, i]) & ~np.isnan(X).any(1)
        b, ssr = ols(X[ok], x[ok, i])
        out[ok, i] = x[ok, i] - X[ok] @ b
        load.append(b[1:])
        r2.append(1 - ssr / max(float(((x[ok, i] - x[ok, i].mean()) ** 2).sum()), 1e-300))
    return out, np.array(load), np.array(r2)


def factor_blocks(names: list[str], blocks: list[str]) -> dict[str, str]:
    """The block of each factor whose name starts with the block's (the longest that does), else the factor's own name."""
    return {n: max((b for b in blocks if n == b or n.startswith(f"{b}_") or n.startswith(f"{b}.")), key=len, default=n) for n in names}


def run_diagnostics(results, names: list[str], trim: float = 0.15, alpha: float = 0.05, lags: int = 4, outlier: float = 4.0) -> dict:
    """All checks of a fitted mixed-frequency model, as lists of rows by name (numpy): convergence, stability, contribution, residuals, outliers, and notes."""
    import math

    import numpy as np

    from ..functions.distributions import chi2_sf

    e = results.idiosyncratic()
    f = results.factors()
    path = np.array(results.path)
    falls = np.diff(path)[np.diff(path) < -1e-9 * (np.abs(path[:-1]) + 1)]
    out = {"convergence": [{"n_iter": len(path), "converged": results.converged, "n_decreases": len(falls), "largest_decrease": float(-falls.min()) if len(falls) else 0.0}], "stability": [], "contribution": [], "residuals": [], "outliers": []}
    x = results.z
    resid, _, r2 = projection_residuals(x, f)
    for i, name in enumerate(names):
        ok = ~np.isnan(x[:, i])
        own = e[ok, i]
        n = len(own)
        out["contribution"].append({"series": name, "r2": float(r2[i])})
        if n <= 4 * f.shape[1] + 8:
            continue
        X = np.column_stack([np.ones(n), f[ok]])
        at, wald = sup_break(x[ok, i], X, trim)
        out["stability"].append({"series": name, "row": int(np.flatnonzero(ok)[at]), "statistic": float(wald), "p_value": sup_break_pvalue(wald, X.shape[1], trim)})
        c = own - own.mean()
        r = [float(c[k:] @ c[:-k] / (c @ c)) for k in range(1, lags + 1)]
        q = n * (n + 2) * sum(v * v / (n - k) for k, v in enumerate(r, 1))
        s, k4 = (float((c**m).mean() / (c.var() ** (m / 2))) for m in (3, 4))
        jb = n / 6 * (s * s + (k4 - 3) ** 2 / 4)
        out["residuals"].append({"series": name, "n": n, "ljung_box": float(q), "ljung_box_p": chi2_sf(q, lags), "jarque_bera": float(jb), "jarque_bera_p": math.exp(-jb / 2)})
        for t in np.flatnonzero(ok)[np.abs(c) > outlier * c.std()]:
            out["outliers"].append({"series": name, "row": int(t), "residual": float(e[t, i])})
    m = max(1, len(out["residuals"]))
    out["notes"] = [f"{r['series']}: residuals are autocorrelated" for r in out["residuals"] if r["ljung_box_p"] * m < alpha] + [f"{r['series']}: loadings change at row {r['row']}" for r in out["stability"] if r["p_value"] * m < alpha] + ([] if results.converged else ["the iteration has not converged"])
    return out
