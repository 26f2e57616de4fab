"""Structured smoothing, extrapolators and dataset folders."""

import numpy as np
import pytest

from driftgauge.operators import extrapolate as X
from driftgauge.operators import statespace as K
from driftgauge.operators import structured as S
from driftgauge.sources.datasets import Catalogue, sha256_file


def model(rng, n=5, m=3):
    A = rng.standard_normal((m, m))
    return K.StateSpace(rng.standard_normal((n, m)), 0.4 * rng.standard_normal((m, m)), A @ A.T + 0.1 * np.eye(m), rng.uniform(0.2, 1, n), rng.standard_normal(m), np.eye(m))


@pytest.mark.parametrize("seed", range(3))
def test_precision_smoother_equals_the_recursive_one(seed):
    rng = np.random.default_rng(seed)
    mod = model(rng)
    y = K.simulate(mod, 30, rng)[1]
    y[rng.random(y.shape) < 0.3] = np.nan
    a, P, lag, _ = K.smooth(mod, y)
    b, Q, lag2 = S.precision_smoother(mod, y)
    assert np.allclose(a, b, atol=1e-5) and np.allclose(P, Q, atol=1e-5) and np.allclose(lag[1:], lag2[1:], atol=1e-5)


def test_collapsed_observations_are_sufficient():
    rng = np.random.default_rng(1)
    mod = model(rng, n=40)
    y = K.simulate(mod, 12, rng)[1]
    est, prec = S.collapse(mod, y)
    w, v = zip(*(np.linalg.eigh(p) for p in prec))
    Z = np.array([x.T for x in v])
    small = np.array([x.T @ e for x, e in zip(v, est)])
    a = K.smooth(mod, y)[0]
    H = 1 / np.array(w)
    m = len(mod.a0)
    # One model with time-varying loadings, scaled so that its errors have variance 1.
    scaled = K.StateSpace(Z / np.sqrt(H)[:, :, None], mod.T, mod.Q, np.ones(m), mod.a0, mod.P0)
    assert np.allclose(K.smooth(scaled, small / np.sqrt(H))[0], a, atol=1e-6)


def test_blocks():
    T = np.zeros((5, 5))
    T[:2, :2] = 1
    T[2, 2] = 1
    T[3, 4] = 1
    assert S.companion_blocks(T) == [(0, 2), (2, 1), (3, 2)]


def test_extrapolators():
    x = np.column_stack([np.arange(20.0), np.ones(20)])
    x[-2:, 0] = np.nan
    assert np.allclose(X.complete(x, "drift")[-2:, 0], [18, 19]) and np.allclose(X.complete(x, "rw")[-2:, 0], 17)
    assert X.available() == ["ar", "drift", "mean", "rw"] and X.make(lambda y, h: y) is not None
    with pytest.raises(ValueError):
        X.make("none")
    rng = np.random.default_rng(0)
    e = rng.standard_normal((80, 1))
    z = np.hstack([e, e]) + 0.1 * rng.standard_normal((80, 2))
    z[-1] = [np.nan, 3.0]
    done = X.complete_jointly(z)
    assert abs(done[-1, 0] - 3) < 1 and abs(done[-1, 1] - 3) < 1e-2


def test_dataset_folder(spark, tmp_path):
    (tmp_path / "p.csv").write_text("period,a,b\n2000-01-01,1,x\n2000-02-01,2,3\n")
    (tmp_path / "one.yaml").write_text(f"title: One\npanel: p.csv\nsha256: {{p.csv: {sha256_file(str(tmp_path / 'p.csv'))}}}\n")
    c = Catalogue(str(tmp_path))
    assert c.names() == ["one"] and c.verify("one") == []
    d = c.load(spark, "one")
    assert d.select(["a"]).panel.count() == 2 and d.panel.where("value IS NULL").count() == 1
    (tmp_path / "p.csv").write_text("period,a\n")
    with pytest.raises(ValueError):
        c.load(spark, "one")
