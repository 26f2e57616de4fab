"""Linear Gaussian state space: filter, smoother and simulation in numpy.

    y_t = Z_t a_t + e_t,  e ~ N(0, H) with H diagonal;   a_{t+1} = T a_t + n_t,  n ~ N(0, Q)

One model is a small dense problem; Spark spreads models (vintages, replicates,
specifications, series), each in a grouped map, not the recursion of one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LOG_2PI = float(np.log(2 * np.pi))


@dataclass
class StateSpace:
    Z: np.ndarray  # n x m, or t x n x m
    T: np.ndarray
    Q: np.ndarray
    H: np.ndarray  # n
    a0: np.ndarray
    P0: np.ndarray

    def z(self, t: int) -> np.ndarray:
        return self.Z[t] if self.Z.ndim == 3 else self.Z


@dataclass
class Filtered:
    a: np.ndarray  # predicted
    P: np.ndarray
    af: np.ndarray  # filtered
    Pf: np.ndarray
    loglik: float
    innovations: np.ndarray = field(repr=False)
    variances: np.ndarray = field(repr=False)


def kalman_filter(model: StateSpace, y: np.ndarray) -> Filtered:
    """Observation by observation; missing values (NaN) are skipped."""
    n_t, n = y.shape
    m = len(model.a0)
    a, P = model.a0.astype(float), model.P0.astype(float)
    ap, pp, af, pf = np.zeros((n_t, m)), np.zeros((n_t, m, m)), np.zeros((n_t, m)), np.zeros((n_t, m, m))
    v, f = np.full((n_t, n), np.nan), np.full((n_t, n), np.nan)
    loglik = 0.0
    for t in range(n_t):
        ap[t], pp[t] = a, P
        Z = model.z(t)
        for i in np.flatnonzero(~np.isnan(y[t])):
            z = Z[i]
            Pz = P @ z
            f[t, i] = z @ Pz + model.H[i]
            v[t, i] = y[t, i] - z @ a
            if f[t, i] <= 1e-12:
                continue
            k = Pz / f[t, i]
            a = a + k * v[t, i]
            P = P - np.outer(k, Pz)
            loglik -= 0.5 * (LOG_2PI + np.log(f[t, i]) + v[t, i] ** 2 / f[t, i])
        P = (P + P.T) / 2
        af[t], pf[t] = a, P
        a = model.T @ a
        P = model.T @ P @ model.T.T + model.Q
    return Filtered(ap, pp, af, pf, loglik, v, f)


def smooth(model: StateSpace, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Filtered]:
    """Smoothed means, covariances and lag-one covariances Cov(a_t, a_{t-1})."""
    r = kalman_filter(model, y)
    n_t = len(y)
    a, P = r.af.copy(), r.Pf.copy()
    lag = np.zeros_like(P)
    for t in range(n_t - 2, -1, -1):
        J = np.linalg.solve(r.P[t + 1] + 1e-12 * np.eye(len(model.a0)), model.T @ r.Pf[t]).T
        a[t] = r.af[t] + J @ (a[t + 1] - r.a[t + 1])
        P[t] = r.Pf[t] + J @ (P[t + 1] - r.P[t + 1]) @ J.T
        lag[t + 1] = P[t + 1] @ J.T
    return a, P, lag, r


def companion(A: list[np.ndarray]) -> np.ndarray:
    r, p = len(A[0]), len(A)
    T = np.zeros((r * p, r * p))
    T[:r] = np.hstack(A)
    T[r:, :-r] = np.eye(r * (p - 1))
    return T


def stationary_cov(T: np.ndarray, Q: np.ndarray, rounds: int = 60) -> np.ndarray:
    """P = T P T' + Q by doubling."""
    P, A = Q.copy(), T.copy()
    for _ in range(rounds):
        P = P + A @ P @ A.T
        A = A @ A
        if np.abs(A).max() < 1e-12 or not np.isfinite(P).all():
            break
    return P if np.isfinite(P).all() else np.eye(len(T)) * 1e4


def simulate(model: StateSpace, n_t: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    half = lambda S: np.linalg.cholesky(S + 1e-12 * np.eye(len(S)))
    a = model.a0 + half(model.P0) @ rng.standard_normal(len(model.a0))
    L = half(model.Q)
    states, out = [], []
    for t in range(n_t):
        states.append(a)
        out.append(model.z(t) @ a + np.sqrt(model.H) * rng.standard_normal(len(model.H)))
        a = model.T @ a + L @ rng.standard_normal(len(a))
    return np.array(states), np.array(out)


def weights_on(model: StateSpace, y: np.ndarray, t: int, z: np.ndarray) -> tuple[float, np.ndarray]:
    """z' a_t given y as a constant plus weights on the observed cells: the smoother is linear in them.

    All cells go through one gain sequence, as columns of a batch of data sets.
    """
    cells = np.argwhere(~np.isnan(y))
    n_t, m, k = len(y), len(model.a0), len(cells)
    at = {(int(i), int(j)): c for c, (i, j) in enumerate(cells)}
    r = kalman_filter(model, y)
    a = np.zeros((m, k + 1))
    a[:, k] = model.a0
    P = model.P0.astype(float)
    pred, filt = [], []
    for s in range(n_t):
        pred.append(a.copy())
        Z = model.z(s)
        for i in np.flatnonzero(~np.isnan(y[s])):
            zi = Z[i]
            Pz = P @ zi
            f = zi @ Pz + model.H[i]
            if f <= 1e-12:
                continue
            g = Pz / f
            e = -(zi @ a)
            e[at[s, int(i)]] += 1.0
            a = a + np.outer(g, e)
            P = P - np.outer(g, Pz)
        filt.append(a.copy())
        a = model.T @ a
        P = model.T @ ((P + P.T) / 2) @ model.T.T + model.Q
    s = filt[-1]
    for u in range(n_t - 2, t - 1, -1):
        J = np.linalg.solve(r.P[u + 1] + 1e-12 * np.eye(m), model.T @ r.Pf[u]).T
        s = filt[u] + J @ (s - pred[u + 1])
    w = z @ s
    full = np.zeros_like(y)
    for c, (i, j) in enumerate(cells):
        full[i, j] = w[c]
    return float(w[k]), full


@dataclass
class Moments:
    """Smoothed means, covariances and lag-one covariances Cov(a_t, a_{t-1}), and the log-likelihood."""

    a: np.ndarray
    P: np.ndarray
    lag: np.ndarray
    loglik: float

    def second(self) -> np.ndarray:
        """E[a_t a_t'] of every period."""
        return self.a[:, :, None] * self.a[:, None, :] + self.P


def smoothed_moments(model: StateSpace, y: np.ndarray, obs_var: np.ndarray | None = None) -> Moments:
    """The smoother with the observations of a period collapsed to the state's dimension.

    A period costs (series x states) for its sums and (states cubed) for the rest, whatever the number of series. No
    predicted covariance is inverted, so states that are known exactly do no harm. ``obs_var`` (time x series)
    takes the place of the model's measurement variances.
    """
    n_t, m = len(y), len(model.a0)
    seen = ~np.isnan(y)
    eye, T = np.eye(m), model.T
    a, P = model.a0.astype(float), model.P0.astype(float)
    ap, pp, keep, pull, info = np.zeros((n_t, m)), np.zeros((n_t, m, m)), np.zeros((n_t, m, m)), np.zeros((n_t, m)), np.zeros((n_t, m, m))
    shared: dict[bytes, np.ndarray] = {}
    loglik = 0.0
    for t in range(n_t):
        ok = seen[t]
        Z, h = model.z(t)[ok], (model.H if obs_var is None else obs_var[t])[ok]
        W = Z.T / h
        mark = ok.tobytes()
        C = shared.get(mark) if model.Z.ndim == 2 and obs_var is None else None
        if C is None:
            C = W @ Z
            if model.Z.ndim == 2 and obs_var is None:
                shared[mark] = C
        v = y[t, ok] - Z @ a
        u = W @ v
        solve = eye + P @ C
        M = np.linalg.inv(solve)
        Pf = M @ P
        Pf = (Pf + Pf.T) / 2
        loglik -= 0.5 * (ok.sum() * LOG_2PI + np.log(h).sum() + np.linalg.slogdet(solve)[1] + v @ (v / h) - u @ Pf @ u)
        ap[t], pp[t], keep[t], pull[t], info[t] = a, P, M, u, C
        a = T @ (a + Pf @ u)
        P = T @ Pf @ T.T + model.Q
    out, cov, lag = np.zeros((n_t, m)), np.zeros((n_t, m, m)), np.zeros((n_t, m, m))
    r, N = np.zeros(m), np.zeros((m, m))
    for t in range(n_t - 1, -1, -1):
        M = keep[t]
        if t < n_t - 1:
            lag[t + 1] = (eye - pp[t + 1] @ N) @ T @ M @ pp[t]
        r = M.T @ (pull[t] + T.T @ r)
        TM = T @ M
        N = M.T @ info[t] + TM.T @ N @ TM
        N = (N + N.T) / 2
        out[t] = ap[t] + pp[t] @ r
        cov[t] = pp[t] - pp[t] @ N @ pp[t]
    return Moments(out, cov, lag, float(loglik))


def signal_mean(model: StateSpace, a: np.ndarray) -> np.ndarray:
    """Z_t a_t of every period and series."""
    return a @ model.Z.T if model.Z.ndim == 2 else np.einsum("tnm,tm->tn", model.Z, a)


def signal_variance(model: StateSpace, P: np.ndarray) -> np.ndarray:
    """The diagonal of Z_t P_t Z_t'."""
    return np.einsum("nm,tmk,nk->tn", model.Z, P, model.Z) if model.Z.ndim == 2 else np.einsum("tnm,tmk,tnk->tn", model.Z, P, model.Z)


def diffuse_cov(T: np.ndarray, Q: np.ndarray, kappa: float = 1e6, states: str = "nonstationary") -> np.ndarray:
    """An initial covariance with kappa for all states, or for those of blocks with a root on or outside the unit circle; the stationary one for the rest."""
    if states == "all":
        return kappa * np.eye(len(T))
    from .structured import companion_blocks

    P = np.zeros_like(T, dtype=float)
    for i, size in companion_blocks(T):
        at = slice(i, i + size)
        block = T[at, at]
        stable = np.abs(np.linalg.eigvals(block)).max() < 1 - 1e-8
        P[at, at] = stationary_cov(block, Q[at, at]) if stable else kappa * np.eye(size)
    return P


def random_state_space(n: int, m: int, rng: np.random.Generator, radius: float = 0.9) -> StateSpace:
    """A random stable model for tests."""
    T = rng.standard_normal((m, m))
    T *= radius / np.abs(np.linalg.eigvals(T)).max()
    half = rng.standard_normal((m, m)) / np.sqrt(m)
    Q = half @ half.T + 0.1 * np.eye(m)
    return StateSpace(rng.standard_normal((n, m)), T, Q, rng.uniform(0.2, 1.0, n), np.zeros(m), stationary_cov(T, Q))


def random_missing(y: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """A copy with each cell missing by chance."""
    return np.where(rng.random(y.shape) < share, np.nan, y)


def prepare_observations(model: StateSpace, y) -> np.ndarray:
    """Observations as a float array that fits the model; None is missing."""
    y = np.asarray(y, float)
    y = y[:, None] if y.ndim == 1 else y
    if y.ndim != 2 or y.shape[1] != len(model.H):
        raise ValueError(f"observations of {len(model.H)} series expected, got an array of shape {y.shape}")
    if model.Z.ndim == 3 and len(model.Z) < len(y):
        raise ValueError(f"the design has {len(model.Z)} periods, the observations {len(y)}")
    if np.isinf(y).any():
        raise ValueError("observations are finite or missing")
    return y
