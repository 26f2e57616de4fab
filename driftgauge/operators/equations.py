"""Bridge equations: all small regressions of a target on indicators, as grouped moments; and batches in numpy.

An equation with one or two indicators is a handful of sums over common periods, so
Spark fits all of them in one pass: a row of moments for each equation, combined
before the shuffle. Larger ones, and pseudo out-of-sample errors, are numpy batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def single_equations(rows: DataFrame) -> DataFrame:
    """rows: period, series, x, y. Least squares of y on a constant and each series alone: n, b0, b1, ssr, r2 by series."""
    r = rows.where("x IS NOT NULL AND y IS NOT NULL").groupBy("series").agg(F.count("*").alias("n"), F.regr_intercept("y", "x").alias("b0"), F.regr_slope("y", "x").alias("b1"), F.regr_syy("y", "x").alias("syy"), F.regr_r2("y", "x").alias("r2"))
    return r.select("series", "n", "b0", "b1", (F.col("syy") * (1 - F.col("r2"))).alias("ssr"), "r2")


def pair_equations(rows: DataFrame) -> DataFrame:
    """Least squares of y on a constant and each two series, by centred moments over their common periods: a, b, n, b0, b1, b2, ssr, r2.

    The pairs are the equations asked for; they meet by period.
    """
    seen = rows.where("x IS NOT NULL AND y IS NOT NULL")
    a = seen.select("period", F.col("series").alias("a"), F.col("x").alias("u"), "y")
    b = seen.select("period", F.col("series").alias("b"), F.col("x").alias("v"))
    j = a.join(b, "period").where("a < b")
    cov = lambda p, q: F.covar_pop(p, q)
    m = j.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.avg("y").alias("my"), cov("u", "u").alias("uu"), cov("v", "v").alias("vv"), cov("u", "v").alias("uv"), cov("u", "y").alias("uy"), cov("v", "y").alias("vy"), cov("y", "y").alias("yy"))
    det = F.col("uu") * F.col("vv") - F.col("uv") ** 2
    ok = det > 1e-12 * F.col("uu") * F.col("vv")
    m = m.withColumn("b1", F.when(ok, (F.col("vv") * F.col("uy") - F.col("uv") * F.col("vy")) / det)).withColumn("b2", F.when(ok, (F.col("uu") * F.col("vy") - F.col("uv") * F.col("uy")) / det))
    left = F.col("yy") - F.col("b1") * F.col("uy") - F.col("b2") * F.col("vy")
    return m.select("a", "b", "n", (F.col("my") - F.col("b1") * F.col("mu") - F.col("b2") * F.col("mv")).alias("b0"), "b1", "b2", (left * F.col("n")).alias("ssr"), (1 - left / F.nullif(F.col("yy"), F.lit(0.0))).alias("r2"))


def combination_weights(equations: DataFrame, scheme: str = "inverse_mse", parameters: Column | None = None) -> DataFrame:
    """Adds ``weight``, which sums to 1: equal, inverse_mse, r2 or bic over all equations. The equations are a table of results."""
    n, k = F.col("n"), F.lit(2) if parameters is None else parameters
    mse = F.col("ssr") / F.greatest(n - k, F.lit(1))
    raw = {"equal": F.lit(1.0), "inverse_mse": 1 / F.greatest(mse, F.lit(1e-12)), "r2": F.greatest(F.col("r2"), F.lit(0.0)), "bic": n * F.log(F.col("ssr") / n) + k * F.log(n)}[scheme]
    e = equations.withColumn("_w", raw)
    all_ = Window.partitionBy(F.lit(1))
    if scheme == "bic":
        e = e.withColumn("_w", F.exp(-(F.col("_w") - F.min("_w").over(all_)) / 2))
    return e.withColumn("weight", F.col("_w") / F.nullif(F.sum("_w").over(all_), F.lit(0.0))).drop("_w")


def nowcast_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """(equation, change, of_prediction, of_weight) between two tables (equation, prediction, weight); absent equations weigh nothing.

    The product's change is split at the midpoint, so the parts sum to it.
    """
    j = old.select("equation", F.col("prediction").alias("p0"), F.col("weight").alias("w0")).join(new.select("equation", F.col("prediction").alias("p1"), F.col("weight").alias("w1")), "equation", "full")
    p0, p1 = F.coalesce("p0", "p1"), F.coalesce("p1", "p0")
    w0, w1 = F.coalesce("w0", F.lit(0.0)), F.coalesce("w1", F.lit(0.0))
    return j.select("equation", (w1 * p1 - w0 * p0).alias("change"), ((p1 - p0) * (w0 + w1) / 2).alias("of_prediction"), ((w1 - w0) * (p0 + p1) / 2).alias("of_weight"))


def change_by_series(changes: DataFrame, separator: str = "+") -> DataFrame:
    """Changes of equations, in equal parts to the series whose names the equation joins."""
    names = F.split("equation", f"[{separator}]")
    return changes.select(F.explode(names).alias("series"), (F.col("change") / F.size(names)).alias("change")).groupBy("series").agg(F.sum("change").alias("change"))


# Batches


@dataclass
class BatchFit:
    beta: np.ndarray  # equation x coefficient, constant first
    ssr: np.ndarray
    tss: np.ndarray
    n: np.ndarray
    valid: np.ndarray

    @property
    def r2(self) -> np.ndarray:
        return 1 - self.ssr / np.where(self.tss > 0, self.tss, np.nan)


def design_tensor(features: np.ndarray, columns: list[tuple[int, ...]]) -> np.ndarray:
    """Equation x period x (constant and its columns); equations are as wide as the widest, in zeros."""
    wide = max(map(len, columns))
    out = np.zeros((len(columns), len(features), wide + 1))
    out[:, :, 0] = 1
    for e, cols in enumerate(columns):
        out[e, :, 1 : 1 + len(cols)] = features[:, list(cols)]
    return out


def training_mask(X: np.ndarray, y: np.ndarray, end: int | None = None) -> np.ndarray:
    """Equation x period: complete rows before ``end``."""
    ok = ~np.isnan(X).any(2) & ~np.isnan(y)[None]
    if end is not None:
        ok[:, end:] = False
    return ok


def batched_ols(X: np.ndarray, y: np.ndarray, mask: np.ndarray) -> BatchFit:
    """Every equation on its own rows, by normal equations with a minimum-norm solution; equations with too few rows are invalid."""
    Xm, ym = np.where(mask[:, :, None], X, 0.0), np.where(mask, np.nan_to_num(y), 0.0)
    G, c = np.einsum("etk,etl->ekl", Xm, Xm), np.einsum("etk,et->ek", Xm, ym)
    beta = np.einsum("ekl,el->ek", np.linalg.pinv(G, hermitian=True), c)
    n = mask.sum(1)
    e = np.where(mask, ym - np.einsum("etk,ek->et", Xm, beta), 0.0)
    centred = np.where(mask, ym - (ym.sum(1) / np.maximum(n, 1))[:, None], 0.0)
    width = (np.abs(Xm).sum(1) > 0).sum(1)
    return BatchFit(beta, (e**2).sum(1), (centred**2).sum(1), n, n > width)


def one_step_errors(X: np.ndarray, y: np.ndarray, start: int) -> np.ndarray:
    """Equation x period: errors of each equation fitted on the periods before; missing where it can't be."""
    out = np.full(X.shape[:2], np.nan)
    for t in range(start, len(y)):
        fit = batched_ols(X, y, training_mask(X, y, t))
        error = y[t] - np.einsum("ek,ek->e", X[:, t], fit.beta)
        out[:, t] = np.where(fit.valid, error, np.nan)
    return out


def newey_west_lags(n: int) -> int:
    return math.floor(4 * (n / 100) ** (2 / 9))
