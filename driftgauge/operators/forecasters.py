"""Closed-form forecasters, bridge equations and their combination, MIDAS, Bayesian VARs; numpy."""

from __future__ import annotations

import itertools
import math

import numpy as np


def ols(X: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ b
    return b, float(e @ e)


def ar_fit(y: np.ndarray, p: int) -> tuple[np.ndarray, float, int]:
    """AR(p) with constant on rows with all lags: coefficients, residual sum of squares, rows."""
    X = np.column_stack([np.ones(len(y) - p), *[y[p - k : len(y) - k] for k in range(1, p + 1)]])
    ok = ~np.isnan(np.column_stack([X, y[p:]])).any(1)
    b, ssr = ols(X[ok], y[p:][ok])
    return b, ssr, int(ok.sum())


def ar_order(y: np.ndarray, pmax: int = 4, criterion: str = "bic") -> int:
    best = (math.inf, 1)
    for p in range(1, pmax + 1):
        _, ssr, n = ar_fit(y[pmax - p :], p)
        penalty = math.log(n) if criterion == "bic" else 2.0
        best = min(best, (n * math.log(max(ssr, 1e-300) / n) + penalty * (p + 1), p))
    return best[1]


def ar_forecast(y: np.ndarray, h: int, p: int) -> np.ndarray:
    """Iterated forecasts; a missing lag is the mean."""
    b, _, _ = ar_fit(y, p)
    mean, path = np.nanmean(y), list(y[-p:])
    for _ in range(h):
        lags = [mean if np.isnan(v) else v for v in path[: -p - 1 : -1]]
        path.append(float(b[0] + b[1:] @ np.array(lags)))
    return np.array(path[p:])


def random_walk(y: np.ndarray, h: int, drift: bool = False) -> np.ndarray:
    seen = y[~np.isnan(y)]
    d = np.diff(seen).mean() if drift and len(seen) > 1 else 0.0
    return seen[-1] + d * np.arange(1, h + 1)


def historical_mean(y: np.ndarray, h: int, window: int | None = None) -> np.ndarray:
    return np.full(h, np.nanmean(y[-window:] if window else y))


def exp_almon(theta1: float, theta2: float, k: int) -> np.ndarray:
    j = np.arange(1, k + 1)
    e = theta1 * j + theta2 * j**2
    w = np.exp(e - e.max())
    return w / w.sum()


def beta_weights(a: float, b: float, k: int) -> np.ndarray:
    x = (np.arange(k) + 0.5) / k
    e = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    w = np.exp(e - e.max())
    return w / w.sum()


def nelder_mead(f, x0: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    n = len(x0)
    s = [np.array(x0, float), *[np.array(x0, float) + (0.25 if v == 0 else 0.1 * abs(v) + 0.05) * np.eye(n)[i] for i, v in enumerate(x0)]]
    v = [f(x) for x in s]
    for _ in range(rounds):
        order = np.argsort(v)
        s, v = [s[i] for i in order], [v[i] for i in order]
        if abs(v[-1] - v[0]) < 1e-12:
            break
        c = np.mean(s[:-1], 0)
        r = c + (c - s[-1])
        fr = f(r)
        if fr < v[0]:
            e = c + 2 * (c - s[-1])
            fe = f(e)
            s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            s[-1], v[-1] = r, fr
        else:
            k = c + 0.5 * (s[-1] - c)
            fk = f(k)
            if fk < v[-1]:
                s[-1], v[-1] = k, fk
            else:
                s = [s[0], *[s[0] + 0.5 * (x - s[0]) for x in s[1:]]]
                v = [v[0], *[f(x) for x in s[1:]]]
    return s[0], v[0]


def midas(y: np.ndarray, X: np.ndarray, kind: str = "almon") -> tuple[np.ndarray, np.ndarray, float]:
    """y on a constant and a weighted sum of the columns of X (lags, most recent first): coefficients, weights, SSR."""
    shape = (lambda th: exp_almon(th[0], th[1], X.shape[1])) if kind == "almon" else (lambda th: beta_weights(math.exp(th[0]), math.exp(th[1]), X.shape[1]))
    design = lambda th: np.column_stack([np.ones(len(y)), X @ shape(th)])
    th, ssr = nelder_mead(lambda th: ols(design(th), y)[1] if np.abs(th).max() < 50 else 1e300, np.array([0.0, -0.05] if kind == "almon" else [0.0, 1.0]))
    return ols(design(th), y)[0], shape(th), ssr


def umidas(y: np.ndarray, X: np.ndarray) -> tuple[np.ndarray, float]:
    return ols(np.column_stack([np.ones(len(y)), X]), y)


def bridge(y: np.ndarray, X: np.ndarray, x_new: np.ndarray) -> dict:
    """Least squares of complete rows with constant, and the prediction for x_new."""
    ok = ~np.isnan(np.column_stack([X, y])).any(1)
    D = np.column_stack([np.ones(ok.sum()), X[ok]])
    b, ssr = ols(D, y[ok])
    return {"coef": b, "ssr": ssr, "n": int(ok.sum()), "prediction": float(b @ np.concatenate([[1.0], x_new]))}


def bridge_equation_count(n: int, most: int = 2) -> int:
    return sum(math.comb(n, k) for k in range(1, most + 1))


def bridge_combination(y: np.ndarray, X: np.ndarray, x_new: np.ndarray, most: int = 2, start: int = 12, discount: float = 0.95, weights: str = "inverse_mse") -> list[dict]:
    """All equations with up to ``most`` indicators; weights by discounted pseudo out-of-sample errors."""
    out = []
    for k in range(1, most + 1):
        for cols in itertools.combinations(range(X.shape[1]), k):
            c = list(cols)
            e = [y[t] - bridge(y[:t], X[:t, c], X[t, c])["prediction"] for t in range(start, len(y)) if not np.isnan(np.append(X[t, c], y[t])).any()]
            g = discount ** np.arange(len(e))[::-1]
            mse = float((g * np.square(e)).sum() / g.sum())
            out.append({"columns": cols, "prediction": bridge(y, X[:, c], x_new[c])["prediction"], "mse": mse})
    raw = np.array([1 / max(x["mse"], 1e-12) if weights == "inverse_mse" else 1.0 for x in out])
    for x, w in zip(out, raw / raw.sum()):
        x["weight"] = float(w)
    return out


def minnesota_dummies(Y: np.ndarray, p: int, lam: float = 0.2, mu: float = 1.0, delta: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Dummy rows of the Minnesota, sum-of-coefficients and initial-observation priors (random-walk centre)."""
    n = Y.shape[1]
    psi = np.array([math.sqrt(max(ar_fit(Y[:, i], 1)[1] / max(1, len(Y) - 3), 1e-12)) for i in range(n)])
    m = Y[:p].mean(0)
    rows_y, rows_x = [], []
    for k in range(1, p + 1):
        x = np.zeros((n, n * p + 1))
        x[:, 1 + (k - 1) * n : 1 + k * n] = np.diag(psi * k / lam)
        rows_x.append(x)
        rows_y.append(np.diag(psi / lam) if k == 1 else np.zeros((n, n)))
    rows_y.append(np.diag(psi))
    rows_x.append(np.zeros((n, n * p + 1)))
    rows_y.append(np.diag(m / mu))
    rows_x.append(np.hstack([np.zeros((n, 1)), *[np.diag(m / mu)] * p]))
    rows_y.append(m[None, :] / delta)
    rows_x.append(np.concatenate([[1.0], *[m] * p])[None, :] / delta)
    return np.vstack(rows_y), np.vstack(rows_x)


def bvar(Y: np.ndarray, p: int = 2, lam: float = 0.2, mu: float = 1.0, delta: float = 1.0) -> dict:
    """Posterior of a VAR(p) with constant under the dummy-row prior: mean coefficients (constant first), scale, degrees, precision."""
    X = np.column_stack([np.ones(len(Y) - p), *[Y[p - k : len(Y) - k] for k in range(1, p + 1)]])
    yd, xd = minnesota_dummies(Y, p, lam, mu, delta)
    ys, xs = np.vstack([Y[p:], yd]), np.vstack([X, xd])
    V = xs.T @ xs + 1e-8 * np.eye(xs.shape[1])
    B = np.linalg.solve(V, xs.T @ ys)
    e = ys - xs @ B
    return {"B": B, "S": e.T @ e, "V": V, "df": len(ys) - xs.shape[1], "p": p}


def log_marginal(Y: np.ndarray, p: int, lam: float) -> float:
    """Log marginal likelihood of the data given the dummies, up to a constant of the data's size."""
    yd, xd = minnesota_dummies(Y, p, lam)
    X = np.column_stack([np.ones(len(Y) - p), *[Y[p - k : len(Y) - k] for k in range(1, p + 1)]])

    def half(y, x):
        V = x.T @ x + 1e-8 * np.eye(x.shape[1])
        b = np.linalg.solve(V, x.T @ y)
        e = y - x @ b
        n, d = y.shape[1], len(y) - x.shape[1]
        return -n / 2 * np.linalg.slogdet(V)[1] - d / 2 * np.linalg.slogdet(e.T @ e + 1e-10 * np.eye(n))[1] + sum(math.lgamma((d - i) / 2) for i in range(n))

    return half(np.vstack([Y[p:], yd]), np.vstack([X, xd])) - half(yd, xd)


def select_tightness(Y: np.ndarray, p: int) -> float:
    th, _ = nelder_mead(lambda th: -log_marginal(Y, p, math.exp(th[0])) if abs(th[0]) < 6 else 1e300, np.array([math.log(0.2)]), 60)
    return math.exp(th[0])


def conditional_forecast(Y: np.ndarray, fit: dict, future: np.ndarray) -> np.ndarray:
    """Future values given those of its cells that are known (others NaN): the smoother of the companion form."""
    from .statespace import StateSpace, companion, smooth

    n, p = Y.shape[1], fit["p"]
    A = [fit["B"][1 + k * n : 1 + (k + 1) * n].T for k in range(p)]
    c = fit["B"][0]
    T = np.zeros((n * p + 1, n * p + 1))
    T[: n * p, : n * p] = companion(A)
    T[:n, -1] = c
    T[-1, -1] = 1
    Q = np.zeros_like(T)
    Q[:n, :n] = fit["S"] / fit["df"]
    a0 = np.concatenate([Y[-1 : -p - 1 : -1].ravel(), [1.0]])
    Z = np.hstack([np.eye(n), np.zeros((n, n * (p - 1) + 1))])
    model = StateSpace(Z, T, Q, np.full(n, 1e-10), T @ a0, Q + 1e-12 * np.eye(len(Q)))
    return smooth(model, future)[0][:, :n]


def bvar_draws(fit: dict, n_draws: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Draws of (coefficients, covariance) from the normal inverse-Wishart posterior."""
    n = len(fit["S"])
    L = np.linalg.cholesky(np.linalg.inv(fit["S"]))
    Vh = np.linalg.cholesky(np.linalg.inv(fit["V"]))
    B, S = [], []
    for _ in range(n_draws):
        W = L @ rng.standard_normal((n, fit["df"]))
        s = np.linalg.inv(W @ W.T)
        S.append(s)
        B.append(fit["B"] + Vh @ rng.standard_normal(fit["B"].shape) @ np.linalg.cholesky(s).T)
    return np.array(B), np.array(S)
