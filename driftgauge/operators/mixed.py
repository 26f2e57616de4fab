"""Dynamic factor models of mixed-frequency panels by expectation-maximisation; numpy.

The state of a model has, one after the other: the factors of each block with the lags
that dynamics and aggregation need; for each series an autoregressive term of its own
(``ar1``), with its lags where the series is an aggregate; and slow random-walk means
for the series that have one. A series of a lower frequency is a weighted sum of base
periods, so its row of the design repeats one loading under those weights, fixed ones
or, for weeks in months of four or five, some for each period.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from ..functions.calendar import growth_weights
from . import separable
from .factors import standardised, var_ols
from .robust import fill_spline
from .statespace import Moments, StateSpace, companion, signal_mean, signal_variance, smoothed_moments, stationary_cov

#: Measurement variance where series have autoregressive terms of their own.
OBS_VAR, FLOOR = 1e-4, 1e-4


def trim_weights(w) -> np.ndarray:
    """Without zeros at the end; one weight is left at least."""
    w = np.asarray(w, float)
    seen = np.flatnonzero(w)
    return w[: seen[-1] + 1] if len(seen) else w[:1]


def quarterly_weights(quarterly: np.ndarray) -> list[np.ndarray]:
    """Triangular weights of growth rates for the quarterly series of a monthly panel, one weight for the others."""
    return [np.array(growth_weights(3)) / 3 if q else np.ones(1) for q in quarterly]


@dataclass
class Layout:
    """Where the parts of the state are."""

    weights: list[np.ndarray]
    blocks: np.ndarray  # series x block, true or false
    n_factors: list[int]
    factor_lags: int = 1
    idiosyncratic: str = "ar1"
    trends: tuple[int, ...] = ()
    calendar: dict[int, np.ndarray] = field(default_factory=dict)  # series -> period x lag, in place of its weights

    def __post_init__(self):
        if self.idiosyncratic not in ("ar1", "white"):
            raise ValueError(f"idiosyncratic terms are ar1 or white, not {self.idiosyncratic!r}")
        self.weights = [trim_weights(w) for w in self.weights]
        self.span = [self.calendar[i].shape[1] if i in self.calendar else len(w) for i, w in enumerate(self.weights)]
        self.lags = max(self.factor_lags, *self.span)
        at, self.factor_at, self.own_at, self.trend_at = 0, [], {}, {}
        for r in self.n_factors:
            self.factor_at.append(at)
            at += r * self.lags
        if self.idiosyncratic == "ar1":
            for i, k in enumerate(self.span):
                self.own_at[i] = at
                at += k
        for i in self.trends:
            self.trend_at[i] = at
            at += self.span[i]
        self.size = at

    @property
    def n(self) -> int:
        return len(self.weights)

    def at(self, i: int, t: int) -> np.ndarray:
        """The weights of series i in period t."""
        return self.calendar[i][min(t, len(self.calendar[i]) - 1)] if i in self.calendar else self.weights[i]

    def own_blocks(self, i: int) -> list[int]:
        return np.flatnonzero(self.blocks[i]).tolist()

    def regressors(self, i: int, t: int = 0) -> np.ndarray:
        """States -> the aggregated factors that series i loads on."""
        parts = []
        for b in self.own_blocks(i):
            r, s = self.n_factors[b], self.factor_at[b]
            G = np.zeros((self.size, r))
            for j, w in enumerate(self.at(i, t)):
                G[s + j * r : s + (j + 1) * r] += w * np.eye(r)
            parts.append(G)
        return np.hstack(parts) if parts else np.zeros((self.size, 0))

    def own(self, i: int, t: int = 0) -> np.ndarray:
        """States -> the aggregate of the series' own term and slow mean."""
        d = np.zeros(self.size)
        for part in (self.own_at, self.trend_at):
            if i in part:
                w = self.at(i, t)
                d[part[i] : part[i] + len(w)] += w
        return d


@dataclass
class Parameters:
    transition: list[np.ndarray]  # block -> r x r p
    shocks: list[np.ndarray]  # block -> r x r
    loadings: list[np.ndarray]  # series -> its blocks' factors
    own_ar: np.ndarray
    own_var: np.ndarray
    trend_var: dict[int, float]
    obs_var: np.ndarray


def transition_matrix(p: Parameters, layout: Layout) -> np.ndarray:
    T = np.zeros((layout.size, layout.size))
    for s, r, A in zip(layout.factor_at, layout.n_factors, p.transition):
        wide = [A[:, k * r : (k + 1) * r] if k < layout.factor_lags else np.zeros((r, r)) for k in range(layout.lags)]
        T[s : s + r * layout.lags, s : s + r * layout.lags] = companion(wide)
    for part, first in ((layout.own_at, p.own_ar), (layout.trend_at, None)):
        for i, s in part.items():
            k = layout.span[i]
            T[s, s] = 1.0 if first is None else first[i]
            T[range(s + 1, s + k), range(s, s + k - 1)] = 1.0
    return T


def state_space(p: Parameters, layout: Layout, n_periods: int = 0) -> StateSpace:
    """The model's matrices; the design has a period's rows for each of ``n_periods`` where weights follow the calendar."""
    T = transition_matrix(p, layout)
    Q = np.zeros_like(T)
    for s, r, S in zip(layout.factor_at, layout.n_factors, p.shocks):
        Q[s : s + r, s : s + r] = S
    for i, s in layout.own_at.items():
        Q[s, s] = p.own_var[i]
    for i, s in layout.trend_at.items():
        Q[s, s] = p.trend_var[i]

    def rows(t: int) -> np.ndarray:
        return np.stack([layout.regressors(i, t) @ p.loadings[i] + layout.own(i, t) for i in range(layout.n)])

    Z = np.stack([rows(t) for t in range(n_periods)]) if layout.calendar else rows(0)
    P0 = np.zeros_like(T)
    parts = [(s, r * layout.lags) for s, r in zip(layout.factor_at, layout.n_factors)] + [(s, layout.span[i]) for i, s in layout.own_at.items()]
    for s, k in parts:
        P0[s : s + k, s : s + k] = stationary_cov(T[s : s + k, s : s + k], Q[s : s + k, s : s + k] + 1e-10 * np.eye(k))
    for i, s in layout.trend_at.items():
        P0[s : s + layout.span[i], s : s + layout.span[i]] = np.ones((layout.span[i],) * 2) + 1e-6 * np.eye(layout.span[i])
    return StateSpace(Z, T, Q, p.obs_var, np.zeros(layout.size), P0)


def preliminary_trend(x: np.ndarray, window: int = 61) -> np.ndarray:
    """A centred moving average of what is there."""
    half = window // 2
    return np.array([np.nanmean(x[max(0, t - half) : t + half + 1]) if (~np.isnan(x[max(0, t - half) : t + half + 1])).any() else np.nan for t in range(len(x))])


def start_parameters(z: np.ndarray, layout: Layout) -> Parameters:
    """Principal components block by block, each from what the ones before leave; series at the base frequency define a block where there are enough."""
    n_t = len(z)
    full = np.column_stack([fill_spline(z[:, i]) for i in range(layout.n)])
    for i in layout.trends:
        full[:, i] = full[:, i] - np.nan_to_num(preliminary_trend(full[:, i]))
    full = np.where(np.isnan(full), 0.0, full)
    rest, f = full.copy(), []
    base = np.array([k == 1 for k in layout.span])
    for b, r in enumerate(layout.n_factors):
        at = layout.blocks[:, b]
        at = at & base if (at & base).sum() >= r else at
        _, _, vt = np.linalg.svd(rest[:, at], full_matrices=False)
        v = vt[:r].T * np.where(vt[:r].sum(1) < 0, -1, 1)
        g = rest[:, at] @ v
        g = g / np.maximum(g.std(0), 1e-8)
        f.append(g)
        rest = rest - np.where(layout.blocks[:, b], g @ np.linalg.lstsq(g, rest, rcond=None)[0], 0.0)
    A, S = [], []
    for g in f:
        coef, s, _ = var_ols(g, layout.factor_lags)
        a = np.hstack(coef)
        radius = np.abs(np.linalg.eigvals(companion(coef))).max()
        A.append(a if radius < 0.98 else a * 0.98 / radius)
        S.append(s + 1e-8 * np.eye(len(s)))
    loadings, ar, var, obs = [], np.zeros(layout.n), np.ones(layout.n), np.full(layout.n, OBS_VAR)
    for i in range(layout.n):
        ok, cols = ~np.isnan(z[:, i]), []
        for b in layout.own_blocks(i):
            g = np.vstack([np.zeros((layout.span[i] - 1, f[b].shape[1])), f[b]])
            agg = np.zeros((n_t, f[b].shape[1]))
            for t in range(n_t):
                w = layout.at(i, t)
                agg[t] = w @ g[t + layout.span[i] - 1 - np.arange(len(w))]
            cols.append(agg)
        X = np.hstack(cols) if cols else np.zeros((n_t, 0))
        y = full[:, i] if i in layout.trends else z[:, i]
        load = np.linalg.lstsq(X[ok], y[ok], rcond=None)[0] if X.shape[1] and ok.any() else np.zeros(X.shape[1])
        e = y[ok] - X[ok] @ load
        loadings.append(load)
        spread = float(e.var()) if len(e) else 1.0
        if layout.idiosyncratic == "white":
            obs[i] = max(spread, FLOOR)
        elif layout.span[i] == 1 and len(e) > 3:
            ar[i] = float(np.clip(e[1:] @ e[:-1] / max(e[:-1] @ e[:-1], 1e-12), -0.9, 0.9))
            var[i] = max(spread * (1 - ar[i] ** 2), FLOOR)
        else:
            ar[i], var[i] = 0.1, max(spread / float((layout.at(i, 0) ** 2).sum()), FLOOR)
    return Parameters(A, S, loadings, ar, var, {i: 0.01 for i in layout.trends}, obs)


def m_step(z: np.ndarray, layout: Layout, p: Parameters, s: Moments, estimate_trends: bool = True, weights: np.ndarray | None = None) -> Parameters:
    """Parameters that maximise the expected likelihood; ``weights`` (time x series) are those of the measurement errors' precision."""
    n_t = len(z)
    E = s.second()
    cross = s.a[1:, :, None] * s.a[:-1, None, :] + s.lag[1:]

    def moments(now: slice, past: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return E[1:, now, now].sum(0), cross[:, now, past].sum(0), E[:-1, past, past].sum(0)

    A, S = [], []
    for b, r in zip(layout.factor_at, layout.n_factors):
        k = r * layout.factor_lags
        s11, s10, s00 = moments(slice(b, b + r), slice(b, b + k))
        a = np.linalg.solve(s00 + 1e-10 * np.eye(k), s10.T).T
        q = (s11 - a @ s10.T) / (n_t - 1)
        A.append(a)
        S.append((q + q.T) / 2)
    ar, var, obs, trend = p.own_ar.copy(), p.own_var.copy(), p.obs_var.copy(), dict(p.trend_var)
    for i, b in layout.own_at.items():
        s11, s10, s00 = (float(x[0, 0]) for x in moments(slice(b, b + 1), slice(b, b + 1)))
        ar[i] = np.clip(s10 / max(s00, 1e-12), -0.99, 0.99)
        var[i] = max((s11 - 2 * ar[i] * s10 + ar[i] ** 2 * s00) / (n_t - 1), 1e-6)
    for i, b in layout.trend_at.items() if estimate_trends else ():
        trend[i] = random_walk_variance(*(float(x[0, 0]) for x in moments(slice(b, b + 1), slice(b, b + 1))), n_t - 1)
    loadings = []
    for i in range(layout.n):
        at = np.flatnonzero(~np.isnan(z[:, i]))
        G, d = layout.regressors(i), layout.own(i)
        k = G.shape[1]
        if i in layout.calendar:
            M, c = np.zeros((k, k)), np.zeros(k)
            for t in at:
                G, d = layout.regressors(i, t), layout.own(i, t)
                M += G.T @ E[t] @ G
                c += G.T @ (s.a[t] * z[t, i] - E[t] @ d)
        else:
            q = np.ones(len(at)) if weights is None else weights[at, i]
            whole = np.einsum("t,tij->ij", q, E[at])
            M, c = G.T @ whole @ G, G.T @ (s.a[at].T @ (q * z[at, i]) - whole @ d)
        load = np.linalg.solve(M + 1e-10 * np.eye(k), c) if k else np.zeros(0)
        loadings.append(load)
        if layout.idiosyncratic == "white" and len(at):
            e = 0.0
            for t in at:
                row = (layout.regressors(i, t) if i in layout.calendar else G) @ load + (layout.own(i, t) if i in layout.calendar else d)
                e += (1.0 if weights is None else weights[t, i]) * ((z[t, i] - row @ s.a[t]) ** 2 + row @ s.P[t] @ row)
            obs[i] = max(e / len(at), FLOOR)
    return Parameters(A, S, loadings, ar, var, trend, obs)


def random_walk_variance(s11: float, s10: float, s00: float, n: int, floor: float = 1e-6) -> float:
    """Expected mean square of the steps."""
    return max((s11 - 2 * s10 + s00) / n, floor)


@dataclass
class Results:
    """A fitted model. Values are in the units of the panel; rows are base periods."""

    layout: Layout
    parameters: Parameters
    model: StateSpace
    moments: Moments
    mean: np.ndarray
    std: np.ndarray
    z: np.ndarray
    path: list[float]
    converged: bool

    def fitted(self) -> np.ndarray:
        return signal_mean(self.model, self.moments.a) * self.std + self.mean

    def deviations(self) -> np.ndarray:
        """Standard deviation of the signal of each cell given the data, with the measurement's own variance."""
        return np.sqrt(np.maximum(signal_variance(self.model, self.moments.P), 0) + self.parameters.obs_var) * self.std

    def factors(self) -> np.ndarray:
        return np.hstack([self.moments.a[:, s : s + r] for s, r in zip(self.layout.factor_at, self.layout.n_factors)])

    def common(self) -> np.ndarray:
        """What the factors explain."""
        rows = [np.stack([self.layout.regressors(i, t) @ self.parameters.loadings[i] for i in range(self.layout.n)]) for t in (range(len(self.z)) if self.layout.calendar else [0])]
        Z = np.stack(rows) if self.layout.calendar else rows[0]
        return signal_mean(replace(self.model, Z=Z), self.moments.a) * self.std + self.mean

    def idiosyncratic(self) -> np.ndarray:
        """The observed values less what the factors explain."""
        return self.z * self.std + self.mean - self.common()

    def long_run(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Series -> the slow mean and its deviation."""
        return {i: (self.moments.a[:, s] * self.std[i] + self.mean[i], np.sqrt(np.maximum(self.moments.P[:, s, s], 0)) * self.std[i]) for i, s in self.layout.trend_at.items()}

    def update(self, x: np.ndarray) -> Results:
        """The same parameters on another panel of these series, of any length."""
        z = (np.asarray(x, float) - self.mean) / self.std
        model = state_space(self.parameters, self.layout, len(z)) if self.layout.calendar else self.model
        return replace(self, model=model, z=z, moments=smoothed_moments(model, z))

    def predict(self, horizon: int) -> np.ndarray:
        """Values of all series for further base periods."""
        ahead = np.vstack([self.z * self.std + self.mean, np.full((horizon, self.layout.n), np.nan)])
        return self.update(ahead).fitted()[len(self.z) :]

    def nowcast(self, i: int = 0, t: int | None = None) -> tuple[int, float, float]:
        """(period, mean, deviation) of series i; by default the first period of its frequency after its last value."""
        if t is None:
            seen = np.flatnonzero(~np.isnan(self.z[:, i]))
            step = int(np.gcd.reduce(np.diff(seen))) if len(seen) > 1 else 1
            t = int(seen[-1] + step) if len(seen) else len(self.z) - 1
        at = self if t < len(self.z) else self.update(np.vstack([self.z * self.std + self.mean, np.full((t + 1 - len(self.z), self.layout.n), np.nan)]))
        return t, float(at.fitted()[t, i]), float(at.deviations()[t, i])


def fit(x: np.ndarray, n_factors: int | list[int] = 1, factor_lags: int = 1, quarterly: np.ndarray | None = None, blocks: np.ndarray | None = None, idiosyncratic: str = "ar1", trends: tuple[int, ...] = (), calendar: dict[int, np.ndarray] | None = None, max_iter: int = 500, tolerance: float = 1e-4, start: Parameters | None = None) -> Results:
    """Fit to a panel (period x series, NaN where missing) until the log-likelihood moves by less than ``tolerance``."""
    x = np.asarray(x, float)
    if not (~np.isnan(x)).any(0).all():
        raise ValueError(f"series without any value: {np.flatnonzero(~(~np.isnan(x)).any(0)).tolist()}")
    z, mean, std = standardised(x)
    n = x.shape[1]
    blocks = np.ones((n, 1), bool) if blocks is None else np.asarray(blocks, bool)
    r = [n_factors] * blocks.shape[1] if isinstance(n_factors, int) else list(n_factors)
    layout = Layout(quarterly_weights(np.zeros(n, bool) if quarterly is None else quarterly), blocks, r, factor_lags, idiosyncratic, trends, calendar or {})
    p = start or start_parameters(z, layout)
    path: list[float] = []
    converged = False
    eliminate = separable.applies(layout, len(z))
    while True:
        moments = None
        if eliminate:
            try:
                loglik, following = separable.iteration(z, layout, p)
            except np.linalg.LinAlgError:  # shocks without full rank
                eliminate = False
        if not eliminate:
            moments = smoothed_moments(state_space(p, layout, len(z)), z)
            loglik = moments.loglik
        path.append(loglik)
        converged = len(path) > 1 and abs(path[-1] - path[-2]) / ((abs(path[-1]) + abs(path[-2])) / 2 + 1e-12) < tolerance
        if converged or len(path) > max_iter:
            model = state_space(p, layout, len(z))
            return Results(layout, p, model, moments or smoothed_moments(model, z), mean, std, z, path, converged)  # states of the model returned
        p = m_step(z, layout, p, moments) if moments else following


def week_weights(weeks_of: list[int], n_lags: int = 5) -> np.ndarray:
    """Period x lag: the mean of the weeks of a month, in its last week; ``weeks_of`` says how many weeks the month that a row ends has (0: it ends none)."""
    out = np.zeros((len(weeks_of), n_lags))
    for t, k in enumerate(weeks_of):
        if k:
            out[t, :k] = 1.0 / k
        else:
            out[t, 0] = 1.0
    return out
