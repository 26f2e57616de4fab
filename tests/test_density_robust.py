"""Densities, scores and robust kernels against direct computations."""

import math

import numpy as np
import pytest

from driftgauge.operators import density as D
from driftgauge.operators import robust as R
from driftgauge.sources.simulate import factor_panel


def test_mixture_quantities_agree_with_samples():
    m = D.Mixture(np.array([-1.0, 2.0]), np.array([0.5, 1.0]), np.array([0.3, 0.7]))
    x = m.sample(200_000, np.random.default_rng(0))
    assert math.isclose(m.mean, x.mean(), abs_tol=0.02) and math.isclose(m.std, x.std(), abs_tol=0.02)
    assert math.isclose(m.cdf(m.ppf(0.2)), 0.2, abs_tol=1e-9)
    assert math.isclose(m.crps(0.5), D.crps_of_sample(0.5, x), abs_tol=0.01)
    h = 1e-5
    assert math.isclose(math.exp(m.logpdf(0.3)), (m.cdf(0.3 + h) - m.cdf(0.3 - h)) / (2 * h), rel_tol=1e-6)
    one = D.Mixture.gaussian(1.0, 2.0)
    assert math.isclose(one.crps(0.3), D.crps_gaussian(0.3, 1.0, 2.0), rel_tol=1e-9) and math.isclose(one.ppf(0.5), 1.0, abs_tol=1e-9)


def test_sample_crps_is_the_energy_form():
    x = np.random.default_rng(1).standard_normal(50)
    pairs = np.abs(x[:, None] - x[None, :]).sum()
    assert math.isclose(D.crps_of_sample(0.2, x), np.abs(x - 0.2).mean() - pairs / (2 * 50 * 50))
    assert math.isclose(D.crps_of_sample(0.2, x, fair=True), np.abs(x - 0.2).mean() - pairs / (2 * 50 * 49))


def test_uniformity_tests():
    rng = np.random.default_rng(3)
    u, bad = rng.random(300), rng.beta(4, 4, 300)
    assert D.ks_uniformity(u)[1] > 0.05 > D.ks_uniformity(bad)[1]
    assert D.berkowitz(u)["p_value"] > 0.01 > D.berkowitz(bad)["p_value"]


def test_weighted_quantile_score(spark):
    rows = spark.createDataFrame([("m", 0.1, 1.0, 2.0), ("m", 0.9, 3.0, 2.0)], "model string, level double, quantile double, actual double")
    assert math.isclose(D.weighted_quantile_score(rows, ["model"]).first().score, 2 * (0.1 * 1 + 0.1 * 1) / 2)


def test_tracker_and_waterfall(spark):
    n = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (2, "b", -5.0), (3, "a", 0.5)], "vintage int, group string, impact double")
    t = {(r.group, r.vintage): r.cumulative for r in D.tracker(n).collect()}
    assert t["a", 3] == 3.5 and t["b", 2] == -5
    w = D.waterfall(n.groupBy("group").agg({"impact": "sum"}).toDF("item", "impact"), 1).orderBy("place").collect()
    assert [(r["item"], r["impact"]) for r in w] == [("b", -5.0), ("others", 3.5)]


def test_fan_chart(spark):
    t = spark.createDataFrame([(1.0, 2.0)], "estimate double, std double")
    r = D.gaussian_bands(t, [0.95]).first()
    assert math.isclose(r.upper, 1 + 2 * 1.959963985, rel_tol=1e-6)


def test_spline_is_exact_for_cubics():
    t = np.arange(12.0)
    y = 0.1 * t**3 - t**2 + 2
    gaps = y.copy()
    gaps[[3, 4, 8]] = np.nan
    assert np.allclose(R.fill_spline(gaps), y)
    edge = y.copy()
    edge[[0, 11]] = np.nan
    assert np.isnan(R.fill_spline(edge)[[0, 11]]).all()


def test_robust_em_gives_outliers_less_weight():
    wide, f = factor_panel(6, 0, 100, seed=5)
    x = wide.to_numpy()
    x[40, 2] += 15
    model, a, w = R.robust_em(x)
    assert w[40, 2] < 0.3 and np.median(w) > 0.7
    assert abs(np.corrcoef(a[:, 0], f)[0, 1]) > 0.95
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert R.flag_outliers(model, z)[40, 2]


def test_block_model_rises():
    rng = np.random.default_rng(0)
    g, h = (np.convolve(rng.standard_normal(203), [1, 0.7, 0.49, 0.34])[3:203] for _ in range(2))
    x = np.column_stack([*(g + 0.5 * rng.standard_normal(200) for _ in range(4)), *(g + h + 0.5 * rng.standard_normal(200) for _ in range(4))])
    blocks = np.array([[True, i >= 4] for i in range(8)])
    _, a, path = R.block_model(x, blocks)
    assert all(b >= c - 1e-6 for c, b in zip(path, path[1:])) and path[-1] > path[0]
    assert abs(np.corrcoef(a[:, 0], g)[0, 1]) > 0.85 and abs(np.corrcoef(a[:, 1], h)[0, 1]) > 0.8


def test_blocked_values_round_trip():
    x = np.arange(24.0).reshape(12, 2)
    assert np.array_equal(R.unblock_values(R.block_values(x)), x) and R.block_values(x).shape == (4, 6)


@pytest.mark.parametrize("how", ["none", "mask", "dummy", "outliers"])
def test_treatments(how):
    x = np.random.default_rng(0).standard_normal((40, 3))
    window = np.zeros(40, bool)
    window[20:23] = True
    x[21] = 50
    out = R.treat(x, window, how)
    assert np.array_equal(out[~window], x[~window])
    assert how == "none" or not (out[21] == 50).any()
