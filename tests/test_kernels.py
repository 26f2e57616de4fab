"""Numpy kernels against direct computations."""

import math

import numpy as np
import pytest

from driftgauge.functions import calendar as C
from driftgauge.functions import distributions as Dist
from driftgauge.functions import formula
from driftgauge.operators import factors as X
from driftgauge.operators import forecasters as B
from driftgauge.operators import selection as S
from driftgauge.operators import statespace as K
from driftgauge.operators import transforms as T
from driftgauge.plans.nowcasting import METHODS, estimate, load_spec
from driftgauge.sources import connectors
from driftgauge.sources.simulate import factor_panel


def model(rng, n=3, m=2):
    T_ = 0.5 * rng.standard_normal((m, m))
    A = rng.standard_normal((m, m))
    return K.StateSpace(rng.standard_normal((n, m)), T_, A @ A.T, rng.uniform(0.2, 1, n), rng.standard_normal(m), np.eye(m))


def joint(mod, n_t):
    """Mean and covariance of all states, by building them up."""
    m = len(mod.a0)
    mean = np.zeros(n_t * m)
    cov = np.zeros((n_t * m, n_t * m))
    mean[:m], cov[:m, :m] = mod.a0, mod.P0
    for t in range(1, n_t):
        a, b = slice((t - 1) * m, t * m), slice(t * m, (t + 1) * m)
        mean[b] = mod.T @ mean[a]
        cov[b, : t * m] = mod.T @ cov[a, : t * m]
        cov[: t * m, b] = cov[b, : t * m].T
        cov[b, b] = mod.T @ cov[a, a] @ mod.T.T + mod.Q
    return mean, cov


@pytest.mark.parametrize("seed", range(4))
def test_smoother_is_gaussian_conditioning(seed):
    rng = np.random.default_rng(seed)
    mod, n_t = model(rng), 6
    y = K.simulate(mod, n_t, rng)[1]
    y[rng.random(y.shape) < 0.3] = np.nan
    mean, cov = joint(mod, n_t)
    Z = np.kron(np.eye(n_t), mod.Z)
    seen = ~np.isnan(y.ravel())
    S_ = (Z @ cov @ Z.T + np.kron(np.eye(n_t), np.diag(mod.H)))[np.ix_(seen, seen)]
    e = (y.ravel() - Z @ mean)[seen]
    G = cov @ Z.T[:, seen] @ np.linalg.inv(S_)
    a, P, lag, out = K.smooth(mod, y)
    m = 2
    post = cov - G @ Z[seen] @ cov
    assert np.allclose(a.ravel(), mean + G @ e, atol=1e-6)
    for t in range(n_t):
        assert np.allclose(P[t], post[t * m : (t + 1) * m, t * m : (t + 1) * m], atol=1e-6)
        if t:
            assert np.allclose(lag[t], post[t * m : (t + 1) * m, (t - 1) * m : t * m], atol=1e-6)
    direct = -0.5 * (seen.sum() * math.log(2 * math.pi) + np.linalg.slogdet(S_)[1] + e @ np.linalg.solve(S_, e))
    assert math.isclose(out.loglik, direct, rel_tol=1e-9)


def test_weights_reproduce_the_smoother():
    rng = np.random.default_rng(9)
    mod = model(rng)
    y = K.simulate(mod, 8, rng)[1]
    y[rng.random(y.shape) < 0.2] = np.nan
    for t in (3, 7):
        const, w = K.weights_on(mod, y, t, mod.Z[1])
        assert math.isclose(const + np.nansum(w * y), mod.Z[1] @ K.smooth(mod, y)[0][t], rel_tol=1e-6, abs_tol=1e-8)


def test_news_identity():
    rng = np.random.default_rng(2)
    mod = model(rng)
    new = K.simulate(mod, 10, rng)[1]
    old = new + 0.1 * rng.standard_normal(new.shape)
    old[9], old[8, 1] = np.nan, np.nan
    new[2, 0] = np.nan
    n = X.news(mod, old, new, 9, 0)
    total = n["old"] + n["removals"] + n["revisions"] + sum(r["impact"] for r in n["news"])
    assert math.isclose(total, n["new"], abs_tol=1e-8) and abs(n["residual"]) < 1e-8 and len(n["news"]) == 4


def test_em_rises_and_finds_the_factor():
    wide, f = factor_panel(6, 1, 120, seed=3)
    x = wide.to_numpy()
    x[-2:, 3] = np.nan
    mod, a, path, _, _ = X.em_dfm(x, 1, 1, np.array([False] * 6 + [True]), rounds=25)
    assert all(b >= c - 1e-6 for c, b in zip(path, path[1:]))
    assert abs(np.corrcoef(a[:, 0], f)[0, 1]) > 0.97


def test_factor_number():
    rng = np.random.default_rng(0)
    load = rng.uniform(0.7, 1.3, (2, 80)) * np.sign(rng.standard_normal((2, 80)))
    x = rng.standard_normal((300, 2)) @ load + 0.5 * rng.standard_normal((300, 80))
    z, _, _ = X.standardised(x)
    assert min(X.bai_ng(z, 6), key=lambda r: r["ic2"])["r"] == 2


@pytest.mark.parametrize("method", METHODS)
def test_every_method_fills_the_edge(method):
    wide, _ = factor_panel(4, 0, 90, seed=1)
    x = wide.to_numpy()
    x[-2:, 0] = np.nan
    est = estimate(x, method)
    assert len(est) == 91 and np.isfinite(est[-3:]).all()


def test_ar_recovers_coefficients():
    rng = np.random.default_rng(0)
    y = np.zeros(4000)
    for t in range(1, 4000):
        y[t] = 1 + 0.6 * y[t - 1] + rng.standard_normal()
    b, _, n = B.ar_fit(y, 1)
    assert abs(b[1] - 0.6) < 0.05 and n == 3999
    assert np.allclose(B.ar_forecast(y, 2, 1), [b[0] + b[1] * y[-1], b[0] + b[1] * (b[0] + b[1] * y[-1])])


def test_bvar_conditions_on_known_cells():
    rng = np.random.default_rng(4)
    e = rng.standard_normal((300, 1))
    Y = np.hstack([e + 0.1 * rng.standard_normal((300, 1)), e + 0.1 * rng.standard_normal((300, 1))])
    future = np.array([[np.nan, 2.0]])
    f = B.conditional_forecast(Y, B.bvar(Y, 1, 1.0), future)
    assert abs(f[0, 1] - 2.0) < 1e-3 and abs(f[0, 0] - 2.0) < 0.4
    draws, _ = B.bvar_draws(B.bvar(Y, 1, 1.0), 200, rng)
    assert np.allclose(draws.mean(0), B.bvar(Y, 1, 1.0)["B"], atol=0.05)


def test_selection():
    rng = np.random.default_rng(0)
    Z = rng.standard_normal((300, 6))
    y = 3 * Z[:, 2] + 1.5 * Z[:, 4] + 0.1 * rng.standard_normal(300)
    assert S.lars(Z, y)[:2] == [2, 4]
    assert S.elastic_net_until(Z, y, 2) == [2, 4]
    assert S.greedy([1, 2, 3], lambda s: abs(sum(s) - 5))[0] in ([3, 2], [2, 3])
    space = S.ParameterSpace(p=(1, 3), kind=["a", "b"])
    assert len(space.grid()) == 6 and space.draw(3, 1) == space.draw(3, 1)


def test_distributions():
    assert math.isclose(Dist.normal_cdf(1.959963984540054), 0.975, abs_tol=1e-12)
    assert math.isclose(Dist.normal_ppf(0.975), 1.959963984540054, abs_tol=1e-9)
    assert math.isclose(Dist.chi2_sf(3.841458820694124, 1), 0.05, abs_tol=1e-10)
    assert math.isclose(Dist.t_sf2(2.2281388519649385, 10), 0.05, abs_tol=1e-9)


@pytest.mark.parametrize("spec", ["diff", "pct", "log", "dlog", "pct:12", "diff:12|diff", 3, 4, "scale:5"])
def test_inverse_transforms(spec):
    rng = np.random.default_rng(1)
    x = list(np.exp(rng.standard_normal(40) * 0.1 + 3))
    steps = T.parse(spec)
    y = x
    for s, a in steps:
        y = T.forward(y, s, a)
    k = T.n_lags(spec) + sum(int(a) for s, a in steps if s == "diff" and False)
    back = T.invert_steps(y, [v if i < k else None for i, v in enumerate(x)], steps)
    assert np.allclose(back, x)


def test_frequencies():
    assert [C.parse_frequency(v) for v in ("monthly", "Q", "W-SUN", 12, "yearly", 365)] == ["M", "Q", "W", "M", "A", "D"]
    assert C.ratio("M", "Q") == 3 and C.most_periods("W", "M") == 5 and C.growth_weights(3) == [1, 2, 3, 2, 1]
    with pytest.raises(ValueError):
        C.ratio("D", "M")


def test_formula():
    cols = ["y", "a", "b c", "d"]
    assert formula.parse("y ~ . - d", cols) == ("y", ["a", "b c"])
    assert formula.resolve("y", cols) == ("y", ["a", "b c", "d"])
    assert formula.parse("y ~ `b c` + a", cols)[1] == ["b c", "a"]
    with pytest.raises(ValueError):
        formula.parse("y ~ z", cols)


def test_connectors(tmp_path):
    import datetime as dt
    import json

    calls = []

    def get(url):
        calls.append(url)
        return json.dumps([{"data": "01/02/2000", "valor": "1,5"}]) if "sgs" in url else json.dumps({"observations": [{"date": "2000-01-01", "value": "."}]})

    assert connectors.central_bank(1, dt.date(1990, 1, 1), dt.date(2005, 1, 1), get)[0] == (dt.date(2000, 2, 1), 1.5) and len(calls) == 2
    one = connectors.cached(get, str(tmp_path))
    assert connectors.fred("X", "key", one) == connectors.fred("X", "key", one) == [(dt.date(2000, 1, 1), None)] and len(calls) == 3
    fails = iter([OSError(), OSError(), None])

    def flaky(url):
        if (e := next(fails)) is not None:
            raise e
        return "ok"

    assert connectors.retrying(flaky, sleep=lambda s: None)("u") == "ok"


def test_spec():
    with pytest.raises(ValueError, match="unknown key: zz; missing key: target"):
        load_spec({"data": {}, "zz": 1})
    assert load_spec("data: {path: x}\ntarget: y\n")["method"] == "em"
