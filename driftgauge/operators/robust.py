"""Robust and structured variants of the factor models; numpy.

Splines, Student-t weights, pandemic treatments, blocks and blocked quarterly forms.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .factors import em_dfm, standardised
from .statespace import StateSpace, kalman_filter, smooth


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Interpolating cubic spline with not-a-knot ends (a parabola through 3 points, a line through 2)."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    A, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        A[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (d[i] - d[i - 1])
    A[0, :3] = h[1], -(h[0] + h[1]), h[0]
    A[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(A, b)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t, u = at - x[k], x[k + 1] - at
    return m[k] * u**3 / (6 * h[k]) + m[k + 1] * t**3 / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t


def fill_spline(y: np.ndarray) -> np.ndarray:
    """Interior gaps by the spline through the values; edges stay missing."""
    out, seen = y.astype(float).copy(), np.flatnonzero(~np.isnan(y))
    if len(seen) >= 2:
        inside = np.arange(seen[0], seen[-1] + 1)
        gap = inside[np.isnan(y[inside])]
        out[gap] = cubic_spline(seen.astype(float), y[seen], gap.astype(float))
    return out


def student_t_weights(e2: np.ndarray, scale: np.ndarray, df: float) -> np.ndarray:
    """Expected precision weights of Student-t errors given expected squared residuals."""
    return (df + 1) / (df + e2 / scale)


def robust_em(x: np.ndarray, r: int = 1, df: float = 4.0, passes: int = 5) -> tuple[StateSpace, np.ndarray, np.ndarray]:
    """EM with Student-t measurement errors: the observations are rescaled by weights from the smoothed residuals, pass by pass."""
    z, _, _ = standardised(x)
    model, a, *_ = em_dfm(x, r, 1, rounds=10)
    w = np.ones_like(z)
    for _ in range(passes):
        fit = a @ model.Z.T
        w = np.where(np.isnan(z), 1.0, student_t_weights((np.where(np.isnan(z), fit, z) - fit) ** 2, model.H, df))
        pulled = fit + np.sqrt(np.minimum(w, 1.0)) * (z - fit)
        a, _, _, _ = smooth(model, pulled)
    return model, a, w


def standardised_innovations(model: StateSpace, y: np.ndarray) -> np.ndarray:
    r = kalman_filter(model, y)
    return r.innovations / np.sqrt(r.variances)


def flag_outliers(model: StateSpace, y: np.ndarray, threshold: float = 4.0) -> np.ndarray:
    return np.nan_to_num(np.abs(standardised_innovations(model, y))) > threshold


def treat(x: np.ndarray, window: np.ndarray, how: str = "mask") -> np.ndarray:
    """Pandemic treatments of a panel: none, mask the window, or take out an impulse for each of its periods."""
    if how == "none":
        return x
    out = x.copy()
    if how == "mask":
        out[window] = np.nan
    elif how == "dummy":
        out[window] = np.nanmean(x[~window], 0)
    elif how == "outliers":
        q1, q2, q3 = np.nanpercentile(x[~window], [25, 50, 75], axis=0)
        far = window[:, None] & (np.abs(x - q2) > 4 * (q3 - q1))
        out[far] = np.nan
    else:
        raise ValueError(f"unknown treatment: {how}")
    return out


def block_model(x: np.ndarray, blocks: np.ndarray, rounds: int = 20) -> tuple[StateSpace, np.ndarray, list[float]]:
    """One AR(1) factor for each block (series x block, true or false); series load on their blocks' factors.

    Blocks are taken in order: each starts from what the ones before leave.
    """
    z, _, _ = standardised(x)
    n_t, n = z.shape
    k = blocks.shape[1]
    rest, f = np.where(np.isnan(z), 0.0, z), np.zeros((n_t, k))
    for b in range(k):
        own = rest[:, blocks[:, b]]
        _, _, vt = np.linalg.svd(own, full_matrices=False)
        v = vt[0] * (1 if vt[0].sum() >= 0 else -1)
        f[:, b] = own @ v
        f[:, b] /= max(f[:, b].std(), 1e-8)
        g = f[:, [b]]
        rest = rest - np.where(blocks[:, b], g @ np.linalg.lstsq(g, rest, rcond=None)[0], 0.0)
    phi = np.array([np.clip(f[1:, b] @ f[:-1, b] / max(f[:-1, b] @ f[:-1, b], 1e-8), -0.98, 0.98) for b in range(k)])
    Z, H = np.zeros((n, k)), np.ones(n)
    path: list[float] = []
    a, P = f, np.zeros((n_t, k, k))
    model = StateSpace(Z, np.diag(phi), np.diag(1 - phi**2), H, np.zeros(k), np.eye(k))
    for step in range(rounds):
        Z, H = np.zeros((n, k)), np.ones(n)
        for i in range(n):
            ok, c = ~np.isnan(z[:, i]), np.flatnonzero(blocks[i])
            M = a[ok][:, c].T @ a[ok][:, c] + P[ok][:, c][:, :, c].sum(0)
            Z[i, c] = np.linalg.solve(M + 1e-8 * np.eye(len(c)), a[ok][:, c].T @ z[ok, i])
            e = z[ok, i] - a[ok] @ Z[i]
            H[i] = max((e @ e + np.einsum("i,tij,j->", Z[i], P[ok], Z[i])) / ok.sum(), 1e-4)
        if step:
            s11 = (a[1:] ** 2).sum(0) + np.einsum("tii->i", P[1:])
            s10 = (a[1:] * a[:-1]).sum(0) + np.einsum("tii->i", lag[1:])
            s00 = (a[:-1] ** 2).sum(0) + np.einsum("tii->i", P[:-1])
            phi = s10 / s00
            q = np.maximum((s11 - phi * s10) / (n_t - 1), 1e-6)
        else:
            q = 1 - phi**2
        model = StateSpace(Z, np.diag(phi), np.diag(q), H, np.zeros(k), np.eye(k))
        a, P, lag, out = smooth(model, z)
        path.append(out.loglik)
    return model, a, path


def block_values(monthly: np.ndarray) -> np.ndarray:
    """Months as three columns a quarter for each series."""
    q = len(monthly) // 3
    return monthly[: 3 * q].reshape(q, 3, -1).transpose(0, 2, 1).reshape(q, -1)


def unblock_values(blocked: np.ndarray) -> np.ndarray:
    q = len(blocked)
    return blocked.reshape(q, -1, 3).transpose(0, 2, 1).reshape(3 * q, -1)


def aggregate_factors(f: np.ndarray, weights: list[float]) -> np.ndarray:
    """Weighted sum of a factor and its lags, missing until the window is full."""
    out = np.full_like(f, np.nan, dtype=float)
    k = len(weights)
    for t in range(k - 1, len(f)):
        out[t] = sum(w * f[t - j] for j, w in enumerate(weights))
    return out


#: Bounds of the degrees of freedom of Student-t errors.
DF_BOUNDS = (2.1, 100.0)


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def update_df(q: np.ndarray, log_q: np.ndarray, bounds: tuple[float, float] = DF_BOUNDS) -> float:
    """Degrees of freedom that maximise the expected likelihood of the weights: the root of a falling function, by bisection."""
    gap = float((log_q - q).mean())

    def slope(df: float) -> float:
        return math.log(df / 2) + 1 - digamma(df / 2) + gap

    lo, hi = bounds
    if slope(lo) <= 0:
        return lo
    if slope(hi) >= 0:
        return hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def student_t_bound(q: np.ndarray, log_q: np.ndarray, df: float, shape: float | None = None) -> float:
    """What gamma weights with means q and mean logarithms log_q add to the Gaussian log-likelihood with variances scaled by q, for a bound of the whole.

    ``shape`` is that of their distributions, if it isn't the one that df gives.
    """
    n, half, post = q.size, df / 2, (df + 1) / 2 if shape is None else shape
    prior = n * (half * math.log(half) - math.lgamma(half)) + (half - 1) * log_q.sum() - half * q.sum()
    entropy = (post - np.log(post / q) + math.lgamma(post) + (1 - post) * digamma(post)).sum()
    return float(prior + entropy + 0.5 * (log_q - np.log(q)).sum())


def expected_squared_residuals(model: StateSpace, a: np.ndarray, P: np.ndarray, y: np.ndarray) -> np.ndarray:
    """E[(y - Z a)^2] of each cell; missing where y is."""
    from .statespace import signal_mean, signal_variance

    return (y - signal_mean(model, a)) ** 2 + signal_variance(model, P)


def period_mask(periods: list, spec) -> np.ndarray:
    """Which of the ordered periods a list of periods and closed (first, last) intervals covers."""
    out = np.zeros(len(periods), bool)
    for part in spec:
        lo, hi = part if isinstance(part, tuple) else (part, part)
        out |= np.array([(lo is None or p >= lo) and (hi is None or p <= hi) for p in periods])
    return out


def update_interventions(z: np.ndarray, fitted: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Impulses (time x series) that maximise the likelihood: the whole residual in the periods marked, nothing elsewhere."""
    return np.where(periods[:, None] & ~np.isnan(z), z - fitted, 0.0)


def intervention_offset(dummies: np.ndarray, std: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The path that impulses add to a standardised panel, in its units about the mean."""
    return dummies * std + mean


@dataclass
class RobustResults:
    """A factor model with Student-t errors: weights of the cells, degrees of freedom, impulses and flags of outliers."""

    results: object
    weights: np.ndarray
    df: float
    dummies: np.ndarray
    bounds: list[float] = field(default_factory=list)

    def flags(self, least: float = 0.3) -> np.ndarray:
        return self.weights < least


def robust_fit(x: np.ndarray, n_factors: int = 1, factor_lags: int = 1, quarterly: np.ndarray | None = None, df: float = 5.0, estimate_df: bool = True, interventions: np.ndarray | None = None, max_iter: int = 200, tolerance: float = 1e-4) -> RobustResults:
    """EM with gamma weights of the measurement errors, so that a far cell counts less, until the bound settles.

    ``interventions`` marks periods with an impulse for each series: their cells say nothing about factors or parameters.
    """
    from dataclasses import replace

    from . import mixed
    from .statespace import signal_mean, smoothed_moments

    start = mixed.fit(x, n_factors, factor_lags, quarterly, idiosyncratic="white", max_iter=5)
    z, layout, p = start.z, start.layout, start.parameters
    used = z if interventions is None else np.where(interventions[:, None], np.nan, z)
    seen = ~np.isnan(used)
    q, log_q, shape, bounds = np.ones_like(z), None, 0.0, []
    while True:
        model = mixed.state_space(p, layout)
        s = smoothed_moments(model, used, p.obs_var / q)
        if log_q is not None:
            bounds.append(s.loglik + student_t_bound(q[seen], log_q[seen], df, shape))
        if len(bounds) > 1 and abs(bounds[-1] - bounds[-2]) <= tolerance * (abs(bounds[-1]) + 1e-12) or len(bounds) > max_iter:
            break
        e2 = expected_squared_residuals(model, s.a, s.P, used)
        shape = (df + 1) / 2
        q = np.where(seen, shape / ((df + np.nan_to_num(e2 / p.obs_var)) / 2), 1.0)
        log_q = np.log(q) + digamma(shape) - math.log(shape)
        p = mixed.m_step(used, layout, p, s, weights=q)
        if estimate_df:
            df = update_df(q[seen], log_q[seen])
    fitted = signal_mean(model, s.a)
    dummies = update_interventions(z, fitted, interventions) if interventions is not None else np.zeros_like(z)
    return RobustResults(replace(start, parameters=p, model=model, moments=s, path=bounds, converged=len(bounds) <= max_iter), q, df, dummies, bounds)
