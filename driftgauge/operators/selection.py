"""Selection of predictors and specifications."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sis(panel: DataFrame, target: str) -> DataFrame:
    """Predictors by absolute correlation with the target over common periods."""
    y = panel.where(F.col("series") == target).select("period", F.col("value").alias("y"))
    j = panel.where(F.col("series") != target).join(y, "period").where(F.col("value").isNotNull() & F.col("y").isNotNull())
    g = j.groupBy("series").agg(F.corr("value", "y").alias("correlation"), F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("correlation").desc(), "series")).cast("long"))


def t_statistics(panel: DataFrame, target: str) -> DataFrame:
    """Predictors by the absolute t statistic of a simple regression with constant."""
    s = sis(panel, target)
    t = F.col("correlation") * F.sqrt((F.col("n") - 2) / (1 - F.col("correlation") ** 2))
    return s.select("series", "n", t.alias("t"))


def rank_scores(scores: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """1 - (rank - 1) / (N - 1) within each group, ties by name; items without a score share the mean of the places left."""
    w = Window.partitionBy(group)
    p = scores.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.count(score).over(w))
    rank = F.when(F.col(score).isNotNull(), F.row_number().over(w.orderBy(F.col(score).desc_nulls_last(), item))).otherwise((F.col("_k") + 1 + F.col("_n")) / 2)
    return p.select(group, item, (1 - (rank - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("rank_score"))


def weighted_score(losses: DataFrame, weights: dict[str, float], normalise: str = "rank01") -> DataFrame:
    """Per specification the weighted sum over metrics of normalised losses (spec, metric, loss): rank01, relative to the least, or none. A missing loss is infinite."""
    w = Window.partitionBy("metric")
    x = F.coalesce("loss", F.lit(float("inf")))
    if normalise == "rank01":
        x = (F.rank().over(w.orderBy(x)) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    elif normalise == "relative":
        x = x / F.min(x).over(w)
    weight = F.element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col("metric"))
    return losses.withColumn("_x", x * weight).groupBy("spec").agg(F.sum("_x").alias("score"))


def elastic_net(X: np.ndarray, y: np.ndarray, alpha: float, l1: float = 0.5, rounds: int = 500, start: np.ndarray | None = None) -> np.ndarray:
    """Cyclic coordinate descent on the Gram matrix."""
    n, k = X.shape
    G, c = X.T @ X / n, X.T @ y / n
    b = np.zeros(k) if start is None else start.copy()
    for _ in range(rounds):
        was = b.copy()
        for j in range(k):
            r = c[j] - G[j] @ b + G[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - alpha * l1, 0) / (G[j, j] + alpha * (1 - l1))
        if np.abs(b - was).max() < 1e-10:
            break
    return b


def elastic_net_until(X: np.ndarray, y: np.ndarray, k: int, l1: float = 0.5) -> list[int]:
    """Active predictors where the path of falling penalties first holds k of them."""
    top = np.abs(X.T @ y / len(y)).max() / l1
    b = None
    for alpha in top * np.logspace(0, -4, 60):
        b = elastic_net(X, y, alpha, l1, start=b)
        if (b != 0).sum() >= min(k, X.shape[1]):
            break
    return np.flatnonzero(b).tolist()


def lars(X: np.ndarray, y: np.ndarray) -> list[int]:
    """Order in which predictors enter the least-angle path."""
    n, k = X.shape
    mu, active = np.zeros(n), []
    while len(active) < min(n - 1, k):
        c = X.T @ (y - mu)
        rest = [j for j in range(k) if j not in active]
        if not active:
            active.append(max(rest, key=lambda j: abs(c[j])))
            continue
        C = np.abs(c[active]).max()
        s = np.sign(c[active])
        Xa = X[:, active] * s
        Gi = np.linalg.pinv(Xa.T @ Xa)
        A = 1 / np.sqrt(Gi.sum())
        u = Xa @ (A * Gi.sum(1))
        a = X.T @ u
        steps = [(min(v for v in ((C - c[j]) / (A - a[j]), (C + c[j]) / (A + a[j]), C / A) if v > 1e-12), j) for j in rest]
        if not steps:
            break
        g, j = min(steps)
        mu = mu + g * u
        active.append(j)
    return active


def greedy(candidates: list, score, forward: bool = True) -> tuple[list, list[tuple[list, float]]]:
    """Add (or drop) one candidate at a time while the score falls."""
    now = [] if forward else list(candidates)
    best = score(now) if now else np.inf
    path = [(list(now), best)]
    while True:
        steps = [now + [c] for c in candidates if c not in now] if forward else [[d for d in now if d != c] for c in now if len(now) > 1]
        if not steps:
            break
        value, choice = min(((score(s), s) for s in steps), key=lambda v: v[0])
        if value >= best:
            break
        now, best = choice, value
        path.append((list(now), best))
    return now, path


class ParameterSpace:
    """Ranges (low, high) of whole numbers and lists of choices."""

    def __init__(self, **space):
        self.space = {k: list(range(v[0], v[1] + 1)) if isinstance(v, tuple) else list(v) for k, v in space.items()}

    def grid(self) -> list[dict]:
        return [dict(zip(self.space, v)) for v in itertools.product(*self.space.values())]

    def draw(self, n: int, seed: int = 0) -> list[dict]:
        rng = np.random.default_rng(seed)
        return [{k: v[int(rng.integers(len(v)))] for k, v in self.space.items()} for _ in range(n)]


def spec_key(spec: dict) -> str:
    """Stable text of a specification."""
    return ";".join(f"{k}={spec[k]!r}" for k in sorted(spec))


@dataclass
class LarsPath:
    """A least-angle path: penalties, coefficients at each of them, the order in which predictors entered, and those that left."""

    alphas: np.ndarray
    coefs: np.ndarray
    entry_order: list[int]
    drops: list[int]

    def first(self, k: int) -> list[int]:
        return list(dict.fromkeys(self.entry_order))[:k]


def lars_path(X: np.ndarray, y: np.ndarray, lasso: bool = False, most: int | None = None) -> LarsPath:
    """Steps along the equiangular direction until the next predictor is as correlated; in the ``lasso`` form a coefficient that reaches zero leaves."""
    n, k = X.shape
    most = min(n - 1, k) if most is None else min(most, n - 1, k)
    b, active, order, drops = np.zeros(k), [], [], []
    alphas, coefs = [], []
    blocked: set[int] = set()
    for _ in range(8 * k + 8):
        c = X.T @ (y - X @ b)
        C = float(np.abs(c).max())
        alphas.append(C / n)
        coefs.append(b.copy())
        if C < 1e-12:
            break
        for j in np.flatnonzero(np.abs(c) >= C * (1 - 1e-10)):
            if j not in active and j not in blocked and len(active) < most:
                active.append(int(j))
                order.append(int(j))
        blocked.clear()
        s = np.sign(c[active])
        Gi = np.linalg.pinv((X[:, active] * s).T @ (X[:, active] * s))
        A = 1 / np.sqrt(Gi.sum())
        w = A * Gi.sum(1) * s
        a = X.T @ (X[:, active] @ w)
        step = C / A
        if len(active) < most:
            for j in set(range(k)) - set(active):
                for v in ((C - c[j]) / (A - a[j]) if A != a[j] else np.inf, (C + c[j]) / (A + a[j]) if A != -a[j] else np.inf):
                    if 1e-12 < v < step:
                        step = v
        gone = None
        if lasso:
            for i, j in enumerate(active):
                if b[j] * w[i] < 0 and -b[j] / w[i] < step:
                    step, gone = -b[j] / w[i], j
        b = b.copy()
        b[active] += step * w
        if gone is not None:
            b[gone] = 0.0
            active.remove(gone)
            drops.append(gone)
            blocked.add(gone)
        elif len(active) == most and step >= C / A - 1e-15:
            alphas.append(0.0)
            coefs.append(b.copy())
            break
    return LarsPath(np.array(alphas), np.array(coefs), order, drops)


def elastic_net_path(X: np.ndarray, y: np.ndarray, l1: float = 0.5, n_alphas: int = 60, least: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(penalties, coefficients) from the smallest penalty without predictors down, each started at the one before."""
    alphas = np.abs(X.T @ y / len(y)).max() / l1 * np.logspace(0, np.log10(least), n_alphas)
    out, b = [], None
    for alpha in alphas:
        b = elastic_net(X, y, alpha, l1, start=b)
        out.append(b)
    return alphas, np.array(out)


def soft_thresholded(c: float, g: float, alpha: float, l1: float = 1.0) -> float:
    """The coefficient of one predictor with cross moment c and square g."""
    return float(np.sign(c) * max(abs(c) - alpha * l1, 0) / (g + alpha * (1 - l1)))


def hac_t(y: np.ndarray, X: np.ndarray, column: int = -1, lags: int | None = None) -> float:
    """t statistic of a coefficient with Bartlett weights over so many lags."""
    from .equations import newey_west_lags

    ok = ~np.isnan(np.column_stack([X, y])).any(1)
    X, y = X[ok], y[ok]
    n, k = X.shape
    if n <= k:
        return float("nan")
    Gi = np.linalg.pinv(X.T @ X)
    b = Gi @ X.T @ y
    u = X * (y - X @ b)[:, None]
    S = u.T @ u
    for j in range(1, (newey_west_lags(n) if lags is None else lags) + 1):
        g = u[j:].T @ u[:-j]
        S = S + (1 - j / ((newey_west_lags(n) if lags is None else lags) + 1)) * (g + g.T)
    v = (Gi @ S @ Gi)[column, column] * n / (n - k)
    return float(b[column] / np.sqrt(v)) if v > 0 else float("nan")


@dataclass
class Targeted:
    """Chosen predictors, scores and ranking of a method."""

    method: str
    selected: list[int]
    scores: dict[int, float]
    ranking: list[int]
    n_obs: int
    params: dict = field(default_factory=dict)


def select_targeted(X: np.ndarray, y: np.ndarray, method: str = "hard", k: int = 10, threshold: float = 1.28, own_lags: int = 4, horizon: int = 0, l1: float = 0.5) -> Targeted:
    """Predictors for one target: hard (t statistics beside lags of the target), sis, lars, lasso or elastic_net, for the target ``horizon`` periods on."""
    y0 = y[horizon:]
    X0 = X[: len(X) - horizon] if horizon else X
    if method == "hard":
        n = len(y0)
        own = [np.concatenate([np.full(j, np.nan), y[: n - j]]) if not horizon else np.concatenate([np.full(j - 1, np.nan), y[: n - j + 1]]) for j in range(1, own_lags + 1)]
        scores = {i: abs(hac_t(y0, np.column_stack([np.ones(n), *own, X0[:, i]]))) for i in range(X.shape[1])}
        ranking = sorted(scores, key=lambda i: (np.isnan(scores[i]), -np.nan_to_num(scores[i]), i))
        return Targeted(method, [i for i in ranking if scores[i] >= threshold], scores, ranking, n, {"threshold": threshold})
    ok = ~np.isnan(np.column_stack([X0, y0])).any(1)
    Z, t = X0[ok] - X0[ok].mean(0), y0[ok] - y0[ok].mean()
    Z, t = Z / np.where(Z.std(0) > 0, Z.std(0), 1.0), t / (t.std() or 1.0)
    if method == "sis":
        scores = {i: abs(float(Z[:, i] @ t / len(t))) for i in range(Z.shape[1])}
        ranking = sorted(scores, key=lambda i: (-scores[i], i))
    elif method in ("lars", "lasso"):
        path = lars_path(Z, t, method == "lasso")
        ranking = path.first(Z.shape[1])
        scores = {i: float(len(ranking) - p) for p, i in enumerate(ranking)}
    elif method == "elastic_net":
        alphas, coefs = elastic_net_path(Z, t, l1)
        enters = {i: next((float(a) for a, b in zip(alphas, coefs) if b[i]), 0.0) for i in range(Z.shape[1])}
        scores, ranking = enters, sorted(enters, key=lambda i: (-enters[i], i))
    else:
        raise ValueError(f"unknown method: {method}")
    return Targeted(method, ranking[:k], scores, ranking, int(ok.sum()), {"k": k})


@dataclass
class FactorSelection:
    """The number of factors by a criterion, with all criteria and the eigenvalues behind them."""

    chosen: int
    criterion: str
    by_criterion: dict[str, int]
    criteria: list[dict]
    eigenvalues: np.ndarray
    dropped_rows: int

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.eigenvalues.sum()


def select_factors(x: np.ndarray, rmax: int = 8, criterion: str = "ic2") -> FactorSelection:
    from .factors import bai_ng, standardised

    full = x[~np.isnan(x).any(1)]
    z, _, _ = standardised(full)
    rows = bai_ng(z, min(rmax, min(z.shape) - 1))
    best = {c: min(rows, key=lambda r: r[c])["r"] for c in ("ic1", "ic2", "ic3", "pc1", "pc2", "pc3")}
    return FactorSelection(best[criterion], criterion, best, rows, np.linalg.svd(z, compute_uv=False) ** 2 / z.size, len(x) - len(full))


@dataclass
class ShockSelection:
    chosen: int
    statistics: list[dict]
    eigenvalues: np.ndarray
    covariance: np.ndarray


def select_shocks(f: np.ndarray, p: int = 1, m: float = 1.0, delta: float = 0.1, n: int | None = None) -> ShockSelection:
    from .factors import shock_number, var_ols

    q, rows = shock_number(f, p, m, delta, n)
    _, s, _ = var_ols(f, p)
    d = np.sqrt(np.diag(s))
    return ShockSelection(q, rows, np.sort(np.linalg.eigvalsh(s / np.outer(d, d)))[::-1], s)


def panel_eigenvalues(x: np.ndarray) -> np.ndarray:
    """Eigenvalues of the correlation matrix of the complete rows, largest first."""
    full = x[~np.isnan(x).any(1)]
    return np.sort(np.linalg.eigvalsh(np.corrcoef(full, rowvar=False)))[::-1]


@dataclass
class ValidationSettings:
    """The vintages on which a selection is scored."""

    start: str
    end: str
    step: int = 1
    horizon: int = 1
    window: int | None = None
    refit_every: int = 1
    max_missing: float = 0.0


@dataclass
class SelectionPath:
    """What a greedy selection tried and took."""

    kind: str
    direction: str
    chosen: list[str]
    score: float
    path: list[tuple[list, float]]


def select_by_validation(candidates: dict[str, list[str]], score: Callable[[list[str]], float], kind: str = "variables", forward: bool = True, fixed: tuple[str, ...] = ()) -> SelectionPath:
    """Greedy choice of groups (blocks, or variables alone); ``score`` gets the series of those chosen, with the fixed ones."""
    members = lambda names: [*fixed, *dict.fromkeys(x for n in names for x in candidates[n])]
    now, path = greedy(list(candidates), lambda names: score(members(names)), forward)
    return SelectionPath(kind, "forward" if forward else "backward", now, path[-1][1], path)


def canonical(value):
    """A hashable form in which equal settings are equal, whatever the order of their keys."""
    if isinstance(value, dict):
        return tuple(sorted((str(k), canonical(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, (set, frozenset)):
        return tuple(sorted(map(canonical, value), key=repr))
    if isinstance(value, np.generic):
        return value.item()
    return value


def describe(value) -> str:
    """Text of a value that doesn't depend on the session: functions by name, objects by type and attributes."""
    if callable(value):
        return f"{getattr(value, '__module__', '')}.{getattr(value, '__qualname__', type(value).__name__)}"
    if hasattr(value, "__dict__") and not isinstance(value, type):
        return f"{type(value).__name__}({', '.join(f'{k}={describe(v)}' for k, v in sorted(vars(value).items()))})"
    return repr(canonical(value))


@dataclass
class Ranking:
    """A ranking of predictors, kept by the content it came from."""

    names: list[str]
    scores: list[float]


_RANKINGS: dict[tuple, Ranking] = {}


def preselect_ranking(panel: DataFrame, target: str, method: str = "sis") -> Ranking:
    """Predictors by correlation (sis) or t statistic (hard); a panel with the same content isn't ranked again."""
    from ..sources.files import fingerprint

    key = (fingerprint(panel.select("series", "period", "value")), target, method)
    if key not in _RANKINGS:
        rows = sis(panel, target).select("series", F.abs("correlation").alias("score")) if method == "sis" else t_statistics(panel, target).select("series", F.abs("t").alias("score"))
        got = rows.orderBy(F.col("score").desc_nulls_last(), "series").collect()  # a row for each series of one panel
        _RANKINGS[key] = Ranking([r["series"] for r in got], [r["score"] for r in got])
    return _RANKINGS[key]


def funnel(panel: DataFrame, target: str, k: int, method: str = "sis", start: str | None = None) -> DataFrame:
    """The target and its k best predictors, ranked on the periods from ``start``."""
    seen = panel if start is None else panel.where(F.col("period") >= F.lit(start).cast("date"))
    return seen.where(F.col("series").isin(target, *preselect_ranking(seen, target, method).names[:k]))
