"""An EM iteration in which the series' own terms are eliminated; numpy.

Given the factors, the series of a model with autoregressive terms of their own are
independent of each other. So each is a regression on the factors' path whose errors have
the covariance of an AR(1) under the series' weights, and what N series say of the path
is a sum of N terms. No matrix has the size of the state: the work is that of N matrices
as long as the sample and one as long as the path, where the recursion needs one of the
state's size, N and more, in each period.
"""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING

import numpy as np

from .statespace import LOG_2PI, companion, stationary_cov

if TYPE_CHECKING:
    from .mixed import Layout, Parameters

#: Series whose covariances are inverted at a time.
BATCH = 32


def applies(layout: Layout, n_t: int) -> bool:
    """Whether it can be used (own autoregressive terms, fixed weights, no slow means) and has fewer operations than the recursion."""
    if layout.idiosyncratic != "ar1" or layout.trends or layout.calendar:
        return False
    path = (n_t + layout.lags - 1) * sum(layout.n_factors)
    return path**3 + 6 * layout.n * n_t**3 < 12 * n_t * layout.size**3


def toeplitz_inverse(column: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log-determinant of the covariances (series x lag) of stationary series, by Levinson's recursion and the shifts of the inverse."""
    n = column.shape[1]
    a, v = np.zeros_like(column), column[:, 0].copy()
    a[:, 0] = 1.0
    logdet = np.log(v)
    for k in range(1, n):
        turn = -(a[:, :k] * column[:, k:0:-1]).sum(1) / v
        a[:, : k + 1] += turn[:, None] * a[:, k::-1]
        v = v * (1 - turn**2)
        logdet = logdet + np.log(v)
    back = np.zeros_like(a)
    back[:, 1:] = a[:, :0:-1]
    out = np.empty((len(column), n, n))
    step = a[:, :, None] * a[:, None, :] - back[:, :, None] * back[:, None, :]
    out[:, 0], out[:, :, 0] = step[:, 0], step[:, :, 0]
    for i in range(1, n):
        out[:, i, 1:] = out[:, i - 1, :-1] + step[:, i, 1:]
    return out / v[:, None, None], logdet


def _path_precision(p: Parameters, layout: Layout, n_s: int) -> tuple[np.ndarray, float]:
    """Prior precision of the factors' path (column of the factor, period) and its log-determinant."""
    R = sum(layout.n_factors)
    K = np.zeros((R, n_s, R, n_s))
    logdet, c = 0.0, 0
    for r, A, S in zip(layout.n_factors, p.transition, p.shocks):
        own, k = slice(c, c + r), layout.factor_lags
        T = companion([A[:, j * r : (j + 1) * r] if j < k else np.zeros((r, r)) for j in range(layout.lags)])
        Q = np.zeros_like(T)
        Q[:r, :r] = S
        P0 = stationary_cov(T, Q + 1e-10 * np.eye(len(T)))
        start = np.linalg.inv(P0).reshape(layout.lags, r, layout.lags, r)[::-1, :, ::-1]  # the state has the latest first
        K[own, : layout.lags, own, : layout.lags] += start.transpose(1, 0, 3, 2)
        Si = np.linalg.inv(S)
        lagged = [np.eye(r), *(-A[:, j * r : (j + 1) * r] for j in range(k))]
        now = np.arange(layout.lags, n_s)
        for i, X in enumerate(lagged):
            for j, Y in enumerate(lagged):
                K[own, now - i, own, now - j] += X.T @ Si @ Y
        logdet -= np.linalg.slogdet(P0)[1] + len(now) * np.linalg.slogdet(S)[1]
        c += r
    return K, float(logdet)


class _Own:
    """A series' own term: covariances with what is seen of it, for the cells where the series has a value."""

    def __init__(self, i: int, z: np.ndarray, layout: Layout, p: Parameters):
        n_t = len(z)
        self.at = np.flatnonzero(~np.isnan(z[:, i]))
        self.y, self.w, self.noise = z[self.at, i], layout.weights[i], p.obs_var[i]
        ends = np.cumsum([0, *layout.n_factors])
        self.columns = np.concatenate([np.zeros(0, int), *(np.arange(ends[b], ends[b + 1]) for b in layout.own_blocks(i))])
        self.load = p.loadings[i]
        k = len(self.w)
        gamma = p.own_var[i] / (1 - p.own_ar[i] ** 2) * p.own_ar[i] ** np.arange(n_t + k)
        self.gamma = gamma[:2]
        d = np.arange(n_t)
        self.to = sum(w * gamma[np.abs(np.arange(-n_t + 1, n_t) + j)] for j, w in enumerate(self.w))  # of the term in t with the aggregate in s, by t - s
        self.seen = sum(w * self.to[d - j + n_t - 1] for j, w in enumerate(self.w))  # of aggregates, by distance
        self.seen[0] += self.noise
        step = np.diff(self.at)
        self.regular = len(step) == 0 or bool((step == step[0]).all())
        self.rows = np.zeros((len(self.at), n_t + layout.lags - 1))  # path -> aggregates
        self.first = self.at + layout.lags - 1
        whole = len(self.at) and self.at[-1] - self.at[0] + 1 == len(self.at)
        self.run = slice(int(self.first[0]), int(self.first[-1]) + 1) if whole else None
        for j, w in enumerate(self.w):
            self.rows[np.arange(len(self.at)), self.at + layout.lags - 1 - j] = w

    def column(self) -> np.ndarray:
        return self.seen[self.at - self.at[0]]

    def project(self, S: np.ndarray) -> np.ndarray:
        """Covariances of the path -> of its aggregates in the cells."""
        if len(self.w) > 1:
            return self.rows @ S @ self.rows.T
        return self.w[0] ** 2 * (S[self.run, self.run] if self.run else S[np.ix_(self.first, self.first)])

    def add_to(self, K: np.ndarray, factor: float) -> None:
        """Adds what the cells say of the path, times ``factor``, to its precision."""
        if len(self.w) > 1:
            K += factor * (self.rows.T @ self.inverse @ self.rows)
        elif self.run:
            K[self.run, self.run] += factor * self.w[0] ** 2 * self.inverse
        else:
            K[np.ix_(self.first, self.first)] += factor * self.w[0] ** 2 * self.inverse

    def gain(self, to: np.ndarray) -> np.ndarray:
        """What a cell's residual says of the own term in each period; ``to`` are their covariances."""
        if len(self.w) > 1:
            return to @ self.inverse
        out = np.empty_like(to)
        out[self.at] = (np.eye(len(self.at)) - self.noise * self.inverse) / self.w[0]
        unseen = np.setdiff1d(np.arange(len(to)), self.at)
        out[unseen] = to[unseen] @ self.inverse
        return out


def _inverses(own: list[_Own]) -> None:
    """Sets the inverse and log-determinant of the cells' covariance of every series."""
    alike: dict[int, list[_Own]] = {}
    for o in own:
        if o.regular:
            alike.setdefault(len(o.at), []).append(o)
        else:
            R = o.seen[np.abs(o.at[:, None] - o.at[None, :])]
            o.inverse, o.logdet = np.linalg.inv(R), np.linalg.slogdet(R)[1]
    for group in alike.values():
        for k in range(0, len(group), BATCH):
            some = group[k : k + BATCH]
            for o, inverse, logdet in zip(some, *toeplitz_inverse(np.stack([o.column() for o in some]))):
                o.inverse, o.logdet = inverse, logdet


def iteration(z: np.ndarray, layout: Layout, p: Parameters) -> tuple[float, Parameters]:
    """Log-likelihood of the parameters, and those that maximise the expected likelihood under them.

    Equal to the recursion's, but needs shocks of full rank: it raises ``LinAlgError`` where a covariance is singular.
    """
    n_t, R = len(z), sum(layout.n_factors)
    n_s = n_t + layout.lags - 1
    K, prior = _path_precision(p, layout, n_s)
    own = [_Own(i, z, layout, p) for i in range(layout.n)]
    _inverses(own)
    b, loglik = np.zeros((R, n_s)), 0.0
    for o in own:
        Ry = o.inverse @ o.y
        loglik -= 0.5 * (len(o.y) * LOG_2PI + o.logdet + o.y @ Ry)
        for c, x in zip(o.columns, o.load):
            b[c] += x * (Ry @ o.rows)
            for d, v in zip(o.columns, o.load):
                o.add_to(K[c, :, d, :], x * v)
    K = K.reshape(R * n_s, R * n_s)
    half = np.linalg.cholesky((K + K.T) / 2)
    half_inverse = np.linalg.inv(half)
    S = half_inverse.T @ half_inverse
    f = S @ b.ravel()
    loglik += 0.5 * (b.ravel() @ f + prior - 2 * np.log(np.diag(half)).sum())
    S, f = S.reshape(R, n_s, R, n_s), f.reshape(R, n_s)
    return float(loglik), _maximise(n_t, layout, p, own, f, S)


def _maximise(n_t: int, layout: Layout, p: Parameters, own: list[_Own], f: np.ndarray, S: np.ndarray) -> Parameters:
    now = np.arange(layout.lags, f.shape[1])
    transition, shocks, c = [], [], 0
    for r in layout.n_factors:
        k, block = layout.factor_lags, slice(c, c + r)

        def moment(i: int, j: int) -> np.ndarray:
            return S[block, now - i, block, now - j].sum(0) + f[block, now - i] @ f[block, now - j].T  # noqa: B023

        s11 = moment(0, 0)
        s10 = np.hstack([moment(0, j) for j in range(1, k + 1)])
        s00 = np.block([[moment(i, j) for j in range(1, k + 1)] for i in range(1, k + 1)])
        a = np.linalg.solve(s00 + 1e-10 * np.eye(r * k), s10.T).T
        q = (s11 - a @ s10.T) / (n_t - 1)
        transition.append(a)
        shocks.append((q + q.T) / 2)
        c += r
    ar, var, loadings = p.own_ar.copy(), p.own_var.copy(), []
    periods = np.arange(n_t)
    for i, o in enumerate(own):
        x = f[o.columns] @ o.rows.T  # factors' aggregates in the cells
        rest = o.y - o.load @ x
        X = [[o.project(S[c, :, d, :]) for d in o.columns] for c in o.columns]
        B = np.zeros_like(o.inverse)
        for u, row in zip(o.load, X):
            for v, m in zip(o.load, row):
                B += u * v * m
        to = o.to[periods[:, None] - o.at[None, :] + n_t - 1]
        gain = o.gain(to)
        e, spread = gain @ rest, gain @ B - to
        same = o.gamma[0] + (spread * gain).sum(1) + e * e
        next_to = o.gamma[1] + (spread[1:] * gain[:-1]).sum(1) + e[1:] * e[:-1]
        s11, s10, s00 = same[1:].sum(), next_to.sum(), same[:-1].sum()
        ar[i] = np.clip(s10 / max(s00, 1e-12), -0.99, 0.99)
        var[i] = max((s11 - 2 * ar[i] * s10 + ar[i] ** 2 * s00) / (n_t - 1), 1e-6)
        k = len(o.columns)
        if not k:
            loadings.append(np.zeros(0))
            continue
        trace = np.array([[np.trace(m) for m in row] for row in X])
        mixed = np.array([[(m * o.inverse).sum() for m in row] for row in X])
        known = x @ (o.y - rest + o.noise * (o.inverse @ rest)) + (trace - o.noise * mixed) @ o.load
        loadings.append(np.linalg.solve(x @ x.T + trace + 1e-10 * np.eye(k), known))
    return replace(p, transition=transition, shocks=shocks, loadings=loadings, own_ar=ar, own_var=var)
