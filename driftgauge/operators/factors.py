"""Factor numbers, principal components, two-step and EM dynamic factor models, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.calendar import growth_weights
from .statespace import StateSpace, companion, smooth, smoothed_moments, stationary_cov


def principal_components(x: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and loadings of a complete standardised panel; each column of loadings sums to 0 or more."""
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    v = vt[:r].T
    v = v * np.where(v.sum(0) < 0, -1, 1)
    return x @ v, v


def bai_ng(x: np.ndarray, rmax: int = 8) -> list[dict]:
    """Residual variance and the criteria IC1-3 and PC1-3 for 0 to rmax factors."""
    t, n = x.shape
    s2 = np.maximum(np.linalg.eigvalsh(x.T @ x if n < t else x @ x.T)[::-1], 0) / (n * t)
    v = [float(s2[r:].sum()) for r in range(rmax + 1)]
    c = min(n, t)
    g = [(n + t) / (n * t) * np.log(n * t / (n + t)), (n + t) / (n * t) * np.log(c), np.log(c) / c]
    return [{"r": r, "v": v[r]} | {f"ic{k + 1}": float(np.log(max(v[r], 1e-300)) + r * g[k]) for k in range(3)} | {f"pc{k + 1}": float(v[r] + r * v[rmax] * g[k]) for k in range(3)} for r in range(rmax + 1)]


def var_ols(f: np.ndarray, p: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """VAR(p) without constant on complete rows: coefficient matrices, residual covariance, residuals."""
    t, r = f.shape
    X = np.hstack([f[p - k : t - k] for k in range(1, p + 1)])
    Y = f[p:]
    ok = ~np.isnan(np.hstack([X, Y])).any(1)
    B = np.linalg.lstsq(X[ok], Y[ok], rcond=None)[0].T
    u = Y[ok] - X[ok] @ B.T
    return [B[:, k * r : (k + 1) * r] for k in range(p)], u.T @ u / max(1, len(u)), u


def shock_number(f: np.ndarray, p: int, m: float = 1.0, delta: float = 0.1, n: int | None = None) -> tuple[int, list[dict]]:
    """Smallest k whose eigenvalue statistic of the VAR residuals' correlation is below the bound."""
    t, r = f.shape
    _, s, _ = var_ols(f, p)
    d = np.sqrt(np.diag(s))
    c = np.sort(np.linalg.eigvalsh(s / np.outer(d, d)))[::-1]
    bound = m / min((n or t) ** (0.5 - delta), t ** (0.5 - delta))
    rows = [{"k": k, "d1": float(np.sqrt(c[k] ** 2 / (c**2).sum())) if k < r else 0.0, "d2": float(np.sqrt((c[k:] ** 2).sum() / (c**2).sum())), "bound": bound} for k in range(1, r + 1)]
    return next((x["k"] for x in rows if x["d2"] < bound), r), rows


def shock_loadings(s: np.ndarray, q: int) -> np.ndarray:
    """Rank-q factor B of a covariance, B B' close to it."""
    w, v = np.linalg.eigh(s)
    order = np.argsort(w)[::-1][:q]
    return v[:, order] * np.sqrt(np.maximum(w[order], 0))


@dataclass
class TwoStep:
    mean: np.ndarray
    std: np.ndarray
    loadings: np.ndarray
    model: StateSpace
    factors: np.ndarray
    bridge: np.ndarray | None = None

    def common(self) -> np.ndarray:
        return self.factors @ self.loadings.T * self.std + self.mean


def standardised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, std = np.nanmean(x, 0), np.nanstd(x, 0, ddof=1)
    std = np.where(std > 0, std, 1.0)
    return (x - mean) / std, mean, std


def two_step(x: np.ndarray, r: int = 2, p: int = 1, q: int | None = None, floor: float = 1e-4) -> TwoStep:
    """Components of the balanced rows, a VAR of them, then the smoother over all rows with their missing cells."""
    z, mean, std = standardised(x)
    full = z[~np.isnan(z).any(1)]
    f, L = principal_components(full, r)
    A, s, _ = var_ols(f, p)
    B = shock_loadings(s, q or r)
    idio = np.maximum((full - f @ L.T).var(0), floor)
    T = companion(A)
    Q = np.zeros_like(T)
    Q[:r, :r] = B @ B.T
    Z = np.hstack([L, np.zeros((len(L), r * (p - 1)))])
    model = StateSpace(Z, T, Q, idio, np.zeros(r * p), stationary_cov(T, Q + 1e-8 * np.eye(len(Q))))
    return TwoStep(mean, std, L, model, smoothed_moments(model, z).a[:, :r])


def em_dfm(x: np.ndarray, r: int = 1, p: int = 1, quarterly: np.ndarray | None = None, rounds: int = 500, tolerance: float = 1e-4) -> tuple[StateSpace, np.ndarray, list[float], np.ndarray, np.ndarray]:
    """Maximum likelihood by expectation-maximisation for panels with any missing cells.

    Quarterly growth series load on a triangular weighted sum of five monthly factors.
    Returns the model, its smoothed states, the log-likelihood path, means and deviations; iteration ends when the
    log-likelihood moves by less than ``tolerance``, or after ``rounds`` updates.
    """
    z, mean, std = standardised(x)
    n_t, n = z.shape
    quarterly = np.zeros(n, bool) if quarterly is None else quarterly
    w = np.array(growth_weights(3)) / 3
    lags = max(p, 5 if quarterly.any() else p)
    start = np.where(np.isnan(z), 0.0, z)
    f, _ = principal_components(start[:, ~quarterly] if (~quarterly).sum() >= r else start, r)
    f = f / np.maximum(f.std(0), 1e-8)
    A, s, _ = var_ols(f, p)
    A = [*A, *[np.zeros((r, r))] * (lags - p)]
    T = companion(A)
    Q = np.zeros_like(T)
    Q[:r, :r] = s

    def wide(load: np.ndarray) -> np.ndarray:
        Z = np.zeros((n, r * lags))
        for i in range(n):
            for j, c in enumerate(w if quarterly[i] else [1.0]):
                Z[i, j * r : (j + 1) * r] = c * load[i]
        return Z

    agg = lambda i, a: sum(c * a[..., j * r : (j + 1) * r] for j, c in enumerate(w if quarterly[i] else [1.0]))
    fl = np.hstack([np.vstack([np.zeros((k, r)), f[: n_t - k]]) for k in range(lags)])
    load, H = np.zeros((n, r)), np.ones(n)
    for i in range(n):
        ok = ~np.isnan(z[:, i])
        g = agg(i, fl)[ok]
        load[i] = np.linalg.lstsq(g, z[ok, i], rcond=None)[0]
        H[i] = max((z[ok, i] - g @ load[i]).var(), 1e-4)
    model = StateSpace(wide(load), T, Q, H, np.zeros(r * lags), stationary_cov(T, Q + 1e-6 * np.eye(len(Q))))
    path: list[float] = []
    while True:
        out = smoothed_moments(model, z)
        a, P, lag = out.a, out.P, out.lag
        path.append(out.loglik)
        if len(path) > rounds or len(path) > 1 and abs(path[-1] - path[-2]) / ((abs(path[-1]) + abs(path[-2])) / 2 + 1e-12) < tolerance:
            return model, a, path, mean, std
        S11 = (a[1:, :r].T @ a[1:, :r]) + P[1:, :r, :r].sum(0)
        S10 = (a[1:, :r].T @ a[:-1, : r * p]) + lag[1:, :r, : r * p].sum(0)
        S00 = (a[:-1, : r * p].T @ a[:-1, : r * p]) + P[:-1, : r * p, : r * p].sum(0)
        B = np.linalg.solve(S00 + 1e-10 * np.eye(r * p), S10.T).T
        T = model.T.copy()
        T[:r] = 0
        T[:r, : r * p] = B
        Q = np.zeros_like(T)
        q = (S11 - B @ S10.T) / (n_t - 1)
        Q[:r, :r] = (q + q.T) / 2
        load, H = load.copy(), H.copy()
        for i in range(n):
            ok = ~np.isnan(z[:, i])
            g = agg(i, a)[ok]
            c = np.zeros((r * lags, r))
            for j, cj in enumerate(w if quarterly[i] else [1.0]):
                c[j * r : (j + 1) * r] = cj * np.eye(r)
            V = np.einsum("mi,tmn,nj->ij", c, P[ok], c)
            M = g.T @ g + V
            load[i] = np.linalg.solve(M + 1e-10 * np.eye(r), g.T @ z[ok, i])
            e = z[ok, i] - g @ load[i]
            H[i] = max((e @ e + load[i] @ V @ load[i]) / ok.sum(), 1e-4)
        model = StateSpace(wide(load), T, Q, H, a[0], P[0])


def news(model: StateSpace, old: np.ndarray, new: np.ndarray, t: int, i: int) -> dict:
    """Revision of the smoothed signal (t, i) between two data sets of one shape: removed, revised and released cells.

    The identity old + removals + revisions + news = new holds exactly.
    """
    z = model.z(t)[i]
    signal = lambda y: float(z @ smooth(model, y)[0][t])
    kept = np.where(np.isnan(new), np.nan, old)  # without what was removed
    revised = np.where(np.isnan(kept), np.nan, new)
    a, b, c = signal(old), signal(kept), signal(revised)
    fresh = np.argwhere(np.isnan(revised) & ~np.isnan(new))
    expected = smooth(model, revised)[0]
    _, w = weights_on_new(model, new, t, z)
    rows = []
    for s, j in fresh:
        e = float(model.z(s)[j] @ expected[s])
        rows.append({"t": int(s), "series": int(j), "actual": float(new[s, j]), "expected": e, "weight": float(w[s, j]), "impact": float(w[s, j] * (new[s, j] - e))})
    d = signal(new)
    return {"old": a, "removals": b - a, "revisions": c - b, "news": rows, "new": d, "residual": d - c - sum(x["impact"] for x in rows)}


def weights_on_new(model: StateSpace, y: np.ndarray, t: int, z: np.ndarray) -> tuple[float, np.ndarray]:
    from .statespace import weights_on

    return weights_on(model, y, t, z)
