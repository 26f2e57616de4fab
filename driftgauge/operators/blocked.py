"""Large Bayesian VARs of quarters in which a monthly series is three variables; numpy.

The prior is normal inverse-Wishart with Minnesota moments, optionally with dummy rows
for sums of coefficients and for the initial observation. Its tightness is chosen by
the posterior of the hyperparameters, whose gradient is exact. A forecast conditions
on whatever cells of the future quarters are known, in closed form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

from .factors import standardised
from .forecasters import ar_fit
from .statespace import companion

# The quarters and their columns


@dataclass
class BlockedLayout:
    """Which blocked column is which series and month: a monthly series has three, a quarterly one the third month's."""

    series: list[str]
    monthly: np.ndarray

    def __post_init__(self):
        self.source = [i for i, m in enumerate(self.monthly) for _ in range(3 if m else 1)]
        self.month = [k for m in self.monthly for k in ((0, 1, 2) if m else (2,))]
        self.columns = [f"{self.series[i]}[m{k + 1}]" if self.monthly[i] else self.series[i] for i, k in zip(self.source, self.month)]

    def block(self, x: np.ndarray) -> np.ndarray:
        """Months x series -> quarters x columns; months after the last whole quarter are padded with missing cells."""
        pad = -len(x) % 3
        x = np.vstack([x, np.full((pad, x.shape[1]), np.nan)])
        return np.column_stack([x[k::3, i] for i, k in zip(self.source, self.month)])

    def unblock(self, q: np.ndarray) -> np.ndarray:
        out = np.full((3 * len(q), len(self.series)), np.nan)
        for c, (i, k) in enumerate(zip(self.source, self.month)):
            out[k::3, i] = q[:, c]
        return out

    def months_of(self, column: int, n_quarters: int) -> np.ndarray:
        """Base rows of one blocked variable."""
        return 3 * np.arange(n_quarters) + self.month[column]


def balanced_run(q: np.ndarray) -> tuple[int, int]:
    """[first, end) of the run of complete rows that ends with the last complete row."""
    full = ~np.isnan(q).any(1)
    if not full.any():
        return 0, 0
    end = int(np.flatnonzero(full)[-1]) + 1
    first = end
    while first and full[first - 1]:
        first -= 1
    return first, end


def window_end(q: np.ndarray, lags: int) -> int:
    """The row after the last one that ends ``lags`` complete rows; 0 if there is none."""
    full = (~np.isnan(q).any(1)).astype(int)
    runs = np.convolve(full, np.ones(lags, int))[: len(full)] if len(full) else full
    at = np.flatnonzero(runs == lags)
    return int(at[-1]) + 1 if len(at) else 0


# Prior and posterior


@dataclass
class System:
    """Y = X B + U with the regressors (lag 1, ..., lag p, constant)."""

    Y: np.ndarray
    X: np.ndarray
    first: np.ndarray  # mean of the rows before the sample
    lags: int
    residual: np.ndarray  # deviations of univariate autoregressions


def var_design(y: np.ndarray, lags: int, constant: bool = True) -> tuple[np.ndarray, np.ndarray]:
    X = np.hstack([y[lags - k : len(y) - k] for k in range(1, lags + 1)])
    return y[lags:], np.hstack([X, np.ones((len(X), 1))]) if constant else X


def system(y: np.ndarray, lags: int) -> System:
    Y, X = var_design(y, lags)
    spread = np.array([math.sqrt(max(ar_fit(y[:, i], 1)[1] / max(1, len(y) - 3), 1e-8)) for i in range(y.shape[1])])
    return System(Y, X, y[:lags].mean(0), lags, spread)


@dataclass
class Hyper:
    """Overall tightness; weights of the dummies (0 leaves them out); scales of the errors."""

    lam: float = 0.2
    mu: float = 0.0
    delta: float = 0.0
    psi: np.ndarray | None = None


@dataclass
class PriorSettings:
    prior_mean: str = "white_noise"  # or random_walk
    lag_decay: float = 2.0
    intercept_variance: float = 1e6

    def centre(self, n: int) -> float:
        return {"white_noise": 0.0, "random_walk": 1.0}[self.prior_mean]


def prior_rows(s: System, h: Hyper, settings: PriorSettings = PriorSettings()) -> tuple[np.ndarray, np.ndarray]:
    """Dummy rows (y, x) whose least squares is the prior. Sums of coefficients and the initial observation come last where they are asked for."""
    n, p = s.Y.shape[1], s.lags
    k = n * p + 1
    psi = s.residual if h.psi is None else h.psi
    ys, xs = [], []
    for lag in range(1, p + 1):
        x = np.zeros((n, k))
        x[:, (lag - 1) * n : lag * n] = np.diag(psi * lag ** (settings.lag_decay / 2)) / h.lam
        xs.append(x)
        ys.append(np.diag(settings.centre(n) * psi) / h.lam if lag == 1 else np.zeros((n, n)))
    const = np.zeros((1, k))
    const[0, -1] = 1 / math.sqrt(settings.intercept_variance)
    xs.append(const)
    ys.append(np.zeros((1, n)))
    if h.mu:
        xs.append(np.hstack([np.diag(s.first)] * p + [np.zeros((n, 1))]) / h.mu)
        ys.append(np.diag(s.first) / h.mu)
    if h.delta:
        xs.append(np.concatenate([s.first] * p + [[1.0]])[None] / h.delta)
        ys.append(s.first[None] / h.delta)
    return np.vstack(ys), np.vstack(xs)


@dataclass
class NIW:
    """Coefficients given S are normal with this mean and S x omega; S is inverse-Wishart."""

    mean: np.ndarray
    omega: np.ndarray
    scale: np.ndarray
    dof: float


def implied_prior(yd: np.ndarray, xd: np.ndarray, psi: np.ndarray) -> NIW:
    """The moments that dummy rows stand for, with n + 2 degrees and a diagonal scale."""
    omega = np.linalg.inv(xd.T @ xd)
    mean = omega @ (xd.T @ yd)
    e = yd - xd @ mean
    return NIW(mean, omega, np.diag(psi**2) + e.T @ e, yd.shape[1] + 2.0)


def posterior(s: System, prior: NIW) -> NIW:
    inv = np.linalg.inv(prior.omega)
    omega = np.linalg.inv(inv + s.X.T @ s.X)
    mean = omega @ (inv @ prior.mean + s.X.T @ s.Y)
    e, d = s.Y - s.X @ mean, mean - prior.mean
    scale = prior.scale + e.T @ e + d.T @ inv @ d
    return NIW(mean, omega, (scale + scale.T) / 2, prior.dof + len(s.Y))


def _multigamma(a: float, n: int) -> float:
    return n * (n - 1) / 4 * math.log(math.pi) + sum(math.lgamma(a - i / 2) for i in range(n))


def log_marginal_likelihood(s: System, h: Hyper, settings: PriorSettings = PriorSettings()) -> float:
    """Log density of the data with coefficients and covariance integrated out."""
    psi = s.residual if h.psi is None else h.psi
    a = implied_prior(*prior_rows(s, h, settings), psi)
    b = posterior(s, a)
    n, t = s.Y.shape[1], len(s.Y)
    logdet = lambda m: np.linalg.slogdet(m)[1]
    return float(-n * t / 2 * math.log(math.pi) + _multigamma(b.dof / 2, n) - _multigamma(a.dof / 2, n) + n / 2 * (logdet(b.omega) - logdet(a.omega)) + a.dof / 2 * logdet(a.scale) - b.dof / 2 * logdet(b.scale))


def _moments(y: np.ndarray, x: np.ndarray):
    V = x.T @ x
    Vi = np.linalg.inv(V)
    return V, Vi, Vi @ (x.T @ y)


def log_marginal_likelihood_gradient(s: System, h: Hyper, settings: PriorSettings = PriorSettings()) -> dict[str, float]:
    """Derivatives by lam and, where they are used, mu and delta; exact.

    With W = x'x of rows and residual cross products R, d log|W| = tr(W^-1 dW) and dR = dy'e + e'dy - ..., where the
    terms in the change of the coefficients vanish, for they minimise R.
    """
    psi = s.residual if h.psi is None else h.psi
    yd, xd = prior_rows(s, h, settings)
    n, p = s.Y.shape[1], s.lags
    _, Vi0, B0 = _moments(yd, xd)
    e0 = yd - xd @ B0
    S0 = np.diag(psi**2) + e0.T @ e0
    y1, x1 = np.vstack([yd, s.Y]), np.vstack([xd, s.X])
    _, Vi1, B1 = _moments(y1, x1)
    e1 = y1 - x1 @ B1
    S1 = np.diag(psi**2) + e1.T @ e1
    d0, d1 = n + 2.0, n + 2.0 + len(s.Y)
    S0i, S1i = np.linalg.inv(S0), np.linalg.inv(S1)
    spans = {"lam": (0, n * p, h.lam)}
    at = n * p + 1
    if h.mu:
        spans["mu"] = (at, at + n, h.mu)
        at += n
    if h.delta:
        spans["delta"] = (at, at + 1, h.delta)
    out = {}
    for name, (lo, hi, value) in spans.items():
        dx, dy = np.zeros_like(xd), np.zeros_like(yd)
        dx[lo:hi], dy[lo:hi] = -xd[lo:hi] / value, -yd[lo:hi] / value
        dV = dx.T @ xd + xd.T @ dx
        r0 = (dy - dx @ B0).T @ e0
        r1 = (dy - dx @ B1).T @ e1[: len(yd)]
        grad = n / 2 * (np.sum(Vi0 * dV.T) - np.sum(Vi1 * dV.T))
        grad += d0 / 2 * 2 * np.sum(S0i * r0.T) - d1 / 2 * 2 * np.sum(S1i * r1.T)
        out[name] = float(grad)
    return out


# Hyperpriors


@dataclass
class GammaHyperprior:
    """A gamma density given by its mode and standard deviation."""

    mode: float
    sd: float

    def __post_init__(self):
        self.scale = (-self.mode + math.sqrt(self.mode**2 + 4 * self.sd**2)) / 2
        self.shape = 1 + self.mode / self.scale

    def logpdf(self, x: float) -> float:
        return (self.shape - 1) * math.log(x) - x / self.scale - self.shape * math.log(self.scale) - math.lgamma(self.shape) if x > 0 else -math.inf

    def gradient(self, x: float) -> float:
        return (self.shape - 1) / x - 1 / self.scale


@dataclass
class InverseGammaHyperprior:
    shape: float = 0.02**2
    scale: float = 0.02**2

    def logpdf(self, x: float) -> float:
        return self.shape * math.log(self.scale) - math.lgamma(self.shape) - (self.shape + 1) * math.log(x) - self.scale / x if x > 0 else -math.inf

    def gradient(self, x: float) -> float:
        return -(self.shape + 1) / x + self.scale / x**2


@dataclass
class Hyperpriors:
    lam: GammaHyperprior = field(default_factory=lambda: GammaHyperprior(0.2, 0.4))
    mu: GammaHyperprior = field(default_factory=lambda: GammaHyperprior(1.0, 1.0))
    delta: GammaHyperprior = field(default_factory=lambda: GammaHyperprior(1.0, 1.0))
    psi: InverseGammaHyperprior = field(default_factory=InverseGammaHyperprior)

    def used(self, h: Hyper) -> list[str]:
        return ["lam", *(["mu"] if h.mu else []), *(["delta"] if h.delta else [])]

    def log_density(self, h: Hyper) -> float:
        out = sum(getattr(self, k).logpdf(getattr(h, k)) for k in self.used(h))
        return out + (sum(self.psi.logpdf(v**2) for v in h.psi) if h.psi is not None else 0.0)

    def gradient(self, h: Hyper) -> dict[str, float]:
        return {k: getattr(self, k).gradient(getattr(h, k)) for k in self.used(h)}


def numerical_hessian(gradient, x: np.ndarray, step: float = 1e-4) -> np.ndarray:
    """Central differences of a gradient, made symmetric."""
    H = np.array([(gradient(x + step * e) - gradient(x - step * e)) / (2 * step) for e in np.eye(len(x))])
    return (H + H.T) / 2


@dataclass
class HyperSelection:
    hyper: Hyper
    log_marginal: float
    log_posterior: float
    names: list[str]
    inverse_hessian: np.ndarray
    converged: bool
    n_evaluations: int


def select_hyperparameters(s: System, start: Hyper = Hyper(), settings: PriorSettings = PriorSettings(), priors: Hyperpriors | None = None, max_iter: int = 500) -> HyperSelection:
    """The mode of the hyperparameters' posterior in logarithms: gradient ascent by BFGS steps with halving."""
    priors = priors or Hyperpriors()
    names = priors.used(start)
    calls = 0

    def at(x: np.ndarray) -> Hyper:
        return replace(start, **{k: math.exp(v) for k, v in zip(names, x)})

    def value(x: np.ndarray) -> float:
        nonlocal calls
        calls += 1
        if np.abs(x).max() > 12:
            return -math.inf
        h = at(x)
        return log_marginal_likelihood(s, h, settings) + priors.log_density(h)

    def gradient(x: np.ndarray) -> np.ndarray:
        h = at(x)
        a, b = log_marginal_likelihood_gradient(s, h, settings), priors.gradient(h)
        return np.array([(a[k] + b[k]) * getattr(h, k) for k in names])

    x = np.array([math.log(getattr(start, k)) for k in names])
    f, g, H, done = value(x), gradient(x), np.eye(len(x)) * 0.01, False
    for _ in range(max_iter):
        if np.abs(g).max() < 1e-6 * max(1.0, abs(f)):
            done = True
            break
        d, step = H @ g, 1.0
        if d @ g <= 0:
            H = np.eye(len(x)) * 0.01
            d = H @ g
        while step > 1e-10 and not value(x + step * d) > f + 1e-4 * step * (d @ g):
            step /= 2
        if step <= 1e-10:
            done = np.abs(g).max() < 1e-3 * max(1.0, abs(f))
            break
        new = x + step * d
        ng = gradient(new)
        sx, sg = new - x, g - ng  # of the function's negative
        if sx @ sg > 1e-12:
            rho = 1 / (sx @ sg)
            A = np.eye(len(x)) - rho * np.outer(sx, sg)
            H = A @ H @ A.T + rho * np.outer(sx, sx)
        x, f, g = new, value(new), ng
    h = at(x)
    return HyperSelection(h, log_marginal_likelihood(s, h, settings), f, names, np.linalg.pinv(-numerical_hessian(gradient, x)), bool(done), calls)


# Parameters and forecasts


@dataclass
class VARParameters:
    intercept: np.ndarray
    coefficients: list[np.ndarray]
    sigma: np.ndarray

    def companion(self) -> np.ndarray:
        return companion(self.coefficients)

    def one_step(self, past: np.ndarray) -> np.ndarray:
        """The next row given the rows before, the last one last."""
        return self.intercept + sum(A @ past[-k] for k, A in enumerate(self.coefficients, 1))

    def fitted(self, y: np.ndarray) -> np.ndarray:
        p = len(self.coefficients)
        return np.array([self.one_step(y[t - p : t]) for t in range(p, len(y))])

    def impulse_responses(self, horizon: int) -> np.ndarray:
        """Responses to one-deviation shocks, in the order of the variables: period x response x shock."""
        T, n = self.companion(), len(self.intercept)
        shock, M, out = np.linalg.cholesky(self.sigma), np.eye(len(T)), []
        for _ in range(horizon + 1):
            out.append(M[:n, :n] @ shock)
            M = T @ M
        return np.array(out)


def parameters(b: NIW, lags: int) -> VARParameters:
    """Posterior means."""
    n = b.mean.shape[1]
    return VARParameters(b.mean[-1], [b.mean[k * n : (k + 1) * n].T for k in range(lags)], b.scale / max(b.dof - n - 1, 1.0))


def draw(b: NIW, lags: int, rng: np.random.Generator) -> VARParameters:
    n = len(b.scale)
    W = np.linalg.cholesky(np.linalg.inv(b.scale)) @ rng.standard_normal((n, int(b.dof)))
    sigma = np.linalg.inv(W @ W.T)
    B = b.mean + np.linalg.cholesky(b.omega) @ rng.standard_normal(b.mean.shape) @ np.linalg.cholesky(sigma).T
    return VARParameters(B[-1], [B[k * n : (k + 1) * n].T for k in range(lags)], sigma)


def conditional_moments(p: VARParameters, past: np.ndarray, future: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all cells of the future rows, stacked, given those that are known (others NaN)."""
    h, n = future.shape
    rows = list(past[-len(p.coefficients) :])
    mean = []
    for _ in range(h):
        rows.append(p.one_step(np.array(rows)))
        mean.append(rows[-1])
    mean = np.concatenate(mean)
    T = p.companion()
    psi, M = [], np.eye(len(T))
    for _ in range(h):
        psi.append(M[:n, :n])
        M = T @ M
    L = np.zeros((h * n, h * n))
    half = np.linalg.cholesky(p.sigma)
    for i in range(h):
        for j in range(i + 1):
            L[i * n : (i + 1) * n, j * n : (j + 1) * n] = psi[i - j] @ half
    cov = L @ L.T
    flat = future.ravel()
    known = np.flatnonzero(~np.isnan(flat))
    if len(known):
        K = np.linalg.solve(cov[np.ix_(known, known)] + 1e-12 * np.eye(len(known)), cov[known]).T
        mean = mean + K @ (flat[known] - mean[known])
        cov = cov - K @ cov[known]
    return mean, (cov + cov.T) / 2


@dataclass
class BlockedBVAR:
    layout: BlockedLayout
    mean: np.ndarray
    std: np.ndarray
    lags: int
    selection: HyperSelection
    posterior: NIW
    quarters: np.ndarray  # standardised
    end: int  # rows before it are complete

    @property
    def parameters(self) -> VARParameters:
        return parameters(self.posterior, self.lags)

    def forecast(self, horizon: int = 0, params: VARParameters | None = None, quarters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of all cells after the complete rows, in units of the panel, by quarters x columns."""
        q = self.quarters if quarters is None else quarters
        end = self.end if quarters is None else window_end(q, self.lags)
        future = np.vstack([q[end:], np.full((horizon, q.shape[1]), np.nan)])
        if not len(future):
            return np.zeros((0, q.shape[1])), np.zeros((0, q.shape[1]))
        m, c = conditional_moments(params or self.parameters, q[:end], future)
        m, sd = m.reshape(future.shape), np.sqrt(np.maximum(np.diag(c), 0)).reshape(future.shape)
        scale, shift = self.std[self.layout.source], self.mean[self.layout.source]
        return m * scale + shift, sd * scale

    def months(self, horizon: int = 0) -> np.ndarray:
        """The panel with forecasts in its missing cells after the complete rows, by months x series."""
        m, _ = self.forecast(horizon)
        scale, shift = self.std[self.layout.source], self.mean[self.layout.source]
        return self.layout.unblock(np.vstack([self.quarters[: self.end] * scale + shift, m]))

    def draws(self, n: int, rng: np.random.Generator, horizon: int = 0) -> np.ndarray:
        """Conditional forecasts under draws of the parameters, with the shocks: draw x quarter x column."""
        out = []
        for _ in range(n):
            p = draw(self.posterior, self.lags, rng)
            m, s = self.forecast(horizon, p)
            out.append(m + s * rng.standard_normal(m.shape))
        return np.array(out)

    def news(self, old: np.ndarray, new: np.ndarray, column: int, row: int) -> list[dict]:
        """What each cell known in ``new`` only adds to the conditional mean of one future cell, as weight times surprise; cells are standardised quarters."""
        end = window_end(old, self.lags)
        base = np.where(np.isnan(old[end:]), np.nan, new[end:])
        m0, c0 = conditional_moments(self.parameters, new[:end], base)
        fresh = np.flatnonzero((np.isnan(base) & ~np.isnan(new[end:])).ravel())
        target = (row - end) * old.shape[1] + column
        if not len(fresh):
            return []
        w = np.linalg.solve(c0[np.ix_(fresh, fresh)] + 1e-12 * np.eye(len(fresh)), c0[fresh, target])
        seen = new[end:].ravel()
        scale = self.std[self.layout.source[column]]
        return [{"row": int(f // old.shape[1]) + end, "column": self.layout.columns[f % old.shape[1]], "weight": float(v), "surprise": float(seen[f] - m0[f]), "impact": float(v * (seen[f] - m0[f]) * scale)} for f, v in zip(fresh, w)]


def fit_blocked(x: np.ndarray, monthly: np.ndarray, names: list[str] | None = None, lags: int = 1, settings: PriorSettings = PriorSettings(), start: Hyper = Hyper(), max_iter: int = 500) -> BlockedBVAR:
    """Fit to months x series; quarterly series (``monthly`` false) have their value in the third month."""
    layout = BlockedLayout(names or [str(i) for i in range(x.shape[1])], np.asarray(monthly, bool))
    z, mean, std = standardised(np.asarray(x, float))
    q = layout.block(z)
    first, end = balanced_run(q)
    if end - first < lags + 8:
        raise ValueError(f"{end - first} complete quarters are too few for {lags} lags")
    s = system(q[first:end], lags)
    chosen = select_hyperparameters(s, start, settings, max_iter=max_iter)
    psi = s.residual if chosen.hyper.psi is None else chosen.hyper.psi
    post = posterior(s, implied_prior(*prior_rows(s, chosen.hyper, settings), psi))
    return BlockedBVAR(layout, mean, std, lags, chosen, post, q, end)


