"""Mixed-frequency models, blocked VARs, robust variants, equations and selection against direct computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import blocked as B
from driftgauge.operators import diagnostics as G
from driftgauge.operators import equations as Q
from driftgauge.operators import evaluation as E
from driftgauge.operators import factors as X
from driftgauge.operators import mixed as M
from driftgauge.operators import robust as R
from driftgauge.operators import selection as S
from driftgauge.operators import separable
from driftgauge.operators import statespace as K
from driftgauge.operators import vintages as V
from driftgauge.operators.panel import literal
from driftgauge.plans import models, nowcasting
from driftgauge.sources.simulate import as_long, dynamic_panel, factor_panel, two_step_example, weekly_panel


@pytest.fixture(scope="module")
def panel():
    wide, factor = factor_panel(4, 1, 180)
    x = wide[["q0", "m0", "m1", "m2", "m3"]].to_numpy(float)
    truth = x[-1, 0]
    x[-3:, 0] = np.nan
    x[-1, 1:3] = np.nan
    return x, truth, factor


QUARTERLY = np.array([True, False, False, False, False])


def test_collapsed_smoother_equals_the_plain_one():
    rng = np.random.default_rng(0)
    for n, m in ((6, 3), (3, 5), (1, 1)):
        model = K.random_state_space(n, m, rng)
        _, y = K.simulate(model, 40, rng)
        y = K.random_missing(y, 0.3, rng)
        y[5] = np.nan
        a, P, lag, f = K.smooth(model, y)
        got = K.smoothed_moments(model, y)
        assert np.allclose(a, got.a, atol=1e-8) and np.allclose(P, got.P, atol=1e-8) and np.allclose(lag[1:], got.lag[1:], atol=1e-8)
        assert math.isclose(f.loglik, got.loglik, rel_tol=1e-9)
        same = K.smoothed_moments(model, y, np.tile(model.H, (len(y), 1)))
        assert np.allclose(same.a, got.a)
    with pytest.raises(ValueError):
        K.prepare_observations(model, np.zeros((3, 2)))
    P = K.diffuse_cov(np.diag([1.0, 0.5]), np.eye(2))
    assert P[0, 0] == 1e6 and math.isclose(P[1, 1], 1 / 0.75)


@pytest.mark.parametrize("own", ["ar1", "white"])
def test_em_rises_and_beats_the_mean(panel, own):
    x, truth, factor = panel
    r = M.fit(x, 1, 1, QUARTERLY, idiosyncratic=own)
    assert r.converged and np.diff(r.path).min() > -1e-6 * abs(r.path[0])
    t, mean, sd = r.nowcast(0)
    assert t == 179 and abs(mean - truth) < 2 * sd < 3 and abs(mean - truth) < abs(np.nanmean(x[:, 0]) - truth)
    assert abs(np.corrcoef(r.factors()[:, 0], factor)[0, 1]) > 0.95
    # an aggregate's row of the design repeats its loading under triangular weights
    Z = r.model.Z[0, :5] / r.model.Z[0, 0]
    assert np.allclose(Z, [1, 2, 3, 2, 1])


def test_states_belong_to_the_model_returned(panel):
    x, _, _ = panel
    for rounds in (1, 5):
        r = M.fit(x, 1, 1, QUARTERLY, max_iter=rounds)
        assert np.allclose(K.smoothed_moments(r.model, r.z).a, r.moments.a)
        model, a, path, mean, std = X.em_dfm(x, 1, 1, QUARTERLY, rounds=rounds)
        assert np.allclose(K.smoothed_moments(model, (x - mean) / std).a, a) and len(path) <= rounds + 1


def test_update_and_predict_keep_parameters(panel):
    x, _, _ = panel
    r = M.fit(x[:-6], 1, 1, QUARTERLY)
    u = r.update(x)
    assert u.parameters is r.parameters and u.fitted().shape == x.shape
    assert np.allclose(r.predict(6), r.update(np.vstack([x[:-6], np.full((6, 5), np.nan)])).fitted()[-6:])
    with pytest.raises(ValueError):
        M.fit(np.column_stack([x, np.full(len(x), np.nan)]), 1)


def test_blocks_restrict_loadings(panel):
    x, _, _ = panel
    blocks = np.array([[1, 0], [1, 0], [1, 1], [1, 1], [1, 1]], bool)
    r = M.fit(x, [1, 1], 1, QUARTERLY, blocks=blocks, max_iter=30)
    s = r.layout.factor_at[1]
    assert np.all(r.model.Z[:2, s : s + r.layout.lags] == 0) and np.diff(r.path).min() > -1e-3


def test_slow_means(panel):
    x, _, _ = panel
    drift = x.copy()
    drift[:, 0] += np.linspace(0, 12, len(x))
    r = M.fit(drift, 1, 1, QUARTERLY, trends=(0,), max_iter=60)
    path, sd = r.long_run()[0]
    assert np.corrcoef(path, np.arange(len(x)))[0, 1] > 0.9 and (sd > 0).all()


def test_weekly_series_follow_the_calendar():
    wide, f = weekly_panel(300, 3, 1, seed=2, ragged=False)
    x = wide[["m0", "w0", "w1", "w2"]].to_numpy(float)
    month = (wide.index + pd.Timedelta(days=6)).to_period("M")
    ends = np.flatnonzero(~np.isnan(x[:, 0]))
    weeks = [int((month[: t + 1] == month[t]).sum()) if t in set(ends) else 0 for t in range(len(x))]
    r = M.fit(x, 1, 1, np.zeros(4, bool), calendar={0: M.week_weights(weeks)}, max_iter=20)
    assert r.model.Z.shape[0] == len(x) and abs(np.corrcoef(r.factors()[:, 0], f)[0, 1]) > 0.9
    fit = r.fitted()[ends, 0]
    assert np.corrcoef(fit, x[ends, 0])[0, 1] > 0.9


def test_robust_weights_find_the_outlier(panel):
    x, _, _ = panel
    y = x.copy()
    y[40, 2] += 30
    r = R.robust_fit(y, 1, 1, QUARTERLY)
    assert r.weights[40, 2] < 0.05 and r.flags()[40, 2] and 2.1 <= r.df <= 100
    assert np.diff(r.bounds).min() > -1e-6 * abs(r.bounds[0])
    hit = np.zeros(len(y), bool)
    hit[40] = True
    z = R.robust_fit(y, 1, 1, QUARTERLY, interventions=hit)
    assert z.dummies[40, 2] > 3 and not z.dummies[~hit].any()
    assert R.period_mask([1, 2, 3, 4], [(2, 3)]).tolist() == [False, True, True, False]
    assert math.isclose(R.digamma(1.0), -0.5772156649015329, rel_tol=1e-10)


# Blocked VARs


@pytest.fixture(scope="module")
def quarters(panel):
    x, _, _ = panel
    order = [1, 2, 3, 4, 0]
    return x[:, order], np.array([True] * 4 + [False])


def test_blocks_go_and_come_back(quarters):
    x, monthly = quarters
    lay = B.BlockedLayout(list("abcdq"), monthly)
    q = lay.block(x)
    assert q.shape == (60, 13) and lay.columns[:3] == ["a[m1]", "a[m2]", "a[m3]"]
    back = lay.unblock(q)
    assert np.array_equal(back[:, :4], x[:, :4], equal_nan=True)
    first, end = B.balanced_run(q)
    assert (first, end) == (0, 59) and B.window_end(q, 2) == 59 and B.window_end(np.full((3, 2), np.nan), 1) == 0


def test_gradient_and_hessian(quarters):
    x, monthly = quarters
    q = B.BlockedLayout(list("abcdq"), monthly).block(x)[:59]
    s = B.system((q - q.mean(0)) / q.std(0), 1)
    from dataclasses import replace

    h = B.Hyper(0.3, 0.7, 0.9)
    for k, g in B.log_marginal_likelihood_gradient(s, h).items():
        e = 1e-5
        slope = (B.log_marginal_likelihood(s, replace(h, **{k: getattr(h, k) + e})) - B.log_marginal_likelihood(s, replace(h, **{k: getattr(h, k) - e}))) / (2 * e)
        assert math.isclose(g, slope, rel_tol=1e-5)
    best = B.select_hyperparameters(s)
    grid = [B.log_marginal_likelihood(s, B.Hyper(v)) + B.Hyperpriors().log_density(B.Hyper(v)) for v in np.linspace(0.05, 1, 40)]
    assert best.converged and best.log_posterior >= max(grid) - 1e-6
    assert np.allclose(B.numerical_hessian(lambda v: 2 * v, np.array([1.0, 2.0])), 2 * np.eye(2))


def test_marginal_likelihood_is_a_product_of_predictives():
    """With one variable and one lag: the density of the data is the product of Student-t predictive densities."""
    rng = np.random.default_rng(0)
    y = rng.standard_normal((12, 1)).cumsum(0)
    s = B.system(y, 1)
    prior = B.implied_prior(*B.prior_rows(s, B.Hyper(0.5)), s.residual)
    total, now = 0.0, prior
    for t in range(len(s.Y)):
        x = s.X[t]
        scale, df = float(now.scale[0, 0]) * (1 + x @ now.omega @ x), now.dof
        e = float(s.Y[t, 0] - x @ now.mean[:, 0])
        total += math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi * scale) - (df + 1) / 2 * math.log1p(e * e / scale)
        now = B.posterior(B.System(s.Y[t : t + 1], s.X[t : t + 1], s.first, 1, s.residual), now)
    assert math.isclose(total, B.log_marginal_likelihood(s, B.Hyper(0.5)), rel_tol=1e-9)


def test_hyperpriors_have_their_mode_and_deviation():
    g = B.GammaHyperprior(0.2, 0.4)
    assert math.isclose(g.scale * math.sqrt(g.shape), 0.4) and abs(g.gradient(0.2)) < 1e-9
    grid = np.linspace(1e-4, 8, 80_000)
    assert abs(np.sum(np.exp([g.logpdf(v) for v in grid])) * (grid[1] - grid[0]) - 1) < 1e-2


def test_conditioning_equals_the_joint_normal(quarters):
    x, monthly = quarters
    f = B.fit_blocked(x, monthly, list("abcdq"))
    past, future = f.quarters[: f.end], f.quarters[f.end :].copy()
    m, c = B.conditional_moments(f.parameters, past, future)
    free, cf = B.conditional_moments(f.parameters, past, np.full(future.shape, np.nan))
    known = np.flatnonzero(~np.isnan(future.ravel()))
    assert np.allclose(m[known], future.ravel()[known], atol=1e-5)
    rest = np.flatnonzero(np.isnan(future.ravel()))
    want = free[rest] + cf[np.ix_(rest, known)] @ np.linalg.solve(cf[np.ix_(known, known)], future.ravel()[known] - free[known])
    assert np.allclose(m[rest], want, atol=1e-6)
    draws = f.draws(300, np.random.default_rng(0), 1)
    _, sd = f.forecast(1)
    assert np.all(draws[:, -1].std(0) > 0.8 * sd[-1])
    irf = f.parameters.impulse_responses(3)
    assert np.allclose(irf[0] @ irf[0].T, f.parameters.sigma)
    assert np.array_equal(f.layout.months_of(0, 2), [0, 3])


def test_news_of_a_blocked_var_add_up(quarters):
    x, monthly = quarters
    f = B.fit_blocked(x, monthly, list("abcdq"))
    full = f.quarters.copy()
    full[-1, 3:9] = np.where(np.isnan(full[-1, 3:9]), 0.5, full[-1, 3:9])
    news = f.news(f.quarters, full, 12, 59)
    before, _ = B.conditional_moments(f.parameters, f.quarters[: f.end], f.quarters[f.end :])
    after, _ = B.conditional_moments(f.parameters, full[: f.end], full[f.end :])
    assert news and math.isclose(sum(n["impact"] for n in news), float((after[12] - before[12]) * f.std[4]), rel_tol=1e-6)


# Equations and selection


def test_batches_equal_single_regressions():
    rng = np.random.default_rng(1)
    X0, y = rng.standard_normal((60, 5)), rng.standard_normal(60)
    X0[3, 1] = np.nan
    cols = [(0,), (1, 2), (3, 4)]
    T = Q.design_tensor(X0, cols)
    fit = Q.batched_ols(T, y, Q.training_mask(T, y))
    errors = Q.one_step_errors(T, y, 40)
    for e, c in enumerate(cols):
        D = np.column_stack([np.ones(60), X0[:, c]])
        ok = ~np.isnan(D).any(1)
        b, ssr, *_ = np.linalg.lstsq(D[ok], y[ok], rcond=None)
        assert np.allclose(fit.beta[e, : len(b)], b) and math.isclose(fit.ssr[e], ssr[0]) and fit.n[e] == ok.sum()
        D, t = np.where(np.isnan(D), 0, D), 50
        b = np.linalg.lstsq(D[:t][ok[:t]], y[:t][ok[:t]], rcond=None)[0]
        assert math.isclose(errors[e, t], y[t] - D[t] @ b, rel_tol=1e-8)


def test_changes_of_a_combination_add_up(spark):
    old = spark.createDataFrame([("a", 1.0, 0.6), ("a+b", 2.0, 0.4)], "equation string, prediction double, weight double")
    new = spark.createDataFrame([("a", 1.5, 0.5), ("c", 3.0, 0.5)], "equation string, prediction double, weight double")
    rows = Q.nowcast_change(old, new).collect()
    assert math.isclose(sum(r.change for r in rows), 0.5 * 1.5 + 0.5 * 3 - 0.6 - 0.8)
    assert all(math.isclose(r.change, r.of_prediction + r.of_weight, abs_tol=1e-12) for r in rows)
    assert math.isclose(sum(r.change for r in Q.change_by_series(Q.nowcast_change(old, new)).collect()), sum(r.change for r in rows))


def test_paths_end_at_least_squares():
    rng = np.random.default_rng(1)
    Z, t = rng.standard_normal((120, 8)), rng.standard_normal(120)
    t = t + 2 * Z[:, 1] - Z[:, 4]
    Z, t = Z - Z.mean(0), t - t.mean()
    b = np.linalg.lstsq(Z, t, rcond=None)[0]
    for lasso in (False, True):
        path = S.lars_path(Z, t, lasso)
        assert np.allclose(path.coefs[-1], b) and path.entry_order[:2] == [1, 4] and np.all(np.diff(path.alphas) <= 1e-12)
    path = S.lars_path(Z, t, True)
    for alpha, coef in zip(path.alphas, path.coefs):
        c = Z.T @ (t - Z @ coef) / len(t)
        assert np.abs(c).max() <= alpha + 1e-8  # the lasso's conditions
        assert np.allclose(np.abs(c[coef != 0]), alpha, atol=1e-8)
    alphas, coefs = S.elastic_net_path(Z, t, 1.0)
    k = 20
    assert np.allclose(coefs[k], S.elastic_net(Z, t, alphas[k], 1.0), atol=1e-6)
    for m in ("hard", "sis", "lars", "lasso", "elastic_net"):
        assert S.select_targeted(Z, t, m, k=2).ranking[:2] == [1, 4]


def test_robust_t_equals_plain_sums():
    rng = np.random.default_rng(2)
    X0, y = np.column_stack([np.ones(80), rng.standard_normal(80)]), rng.standard_normal(80)
    Gi = np.linalg.inv(X0.T @ X0)
    b = Gi @ X0.T @ y
    u = X0 * (y - X0 @ b)[:, None]
    S0 = u.T @ u
    for j in range(1, 4):
        g = sum(np.outer(u[t], u[t - j]) for t in range(j, 80))
        S0 = S0 + (1 - j / 4) * (g + g.T)
    v = (Gi @ S0 @ Gi)[1, 1] * 80 / 78
    assert math.isclose(S.hac_t(y, X0, lags=3), b[1] / math.sqrt(v)) and Q.newey_west_lags(100) == 4


def test_records_of_settings():
    assert S.canonical({"b": [1, 2], "a": {3}}) == S.canonical({"a": {3}, "b": (1, 2)})
    assert S.describe(math.sqrt) == "math.sqrt" and "Settings" in S.describe(S.ValidationSettings("a", "b"))
    wide, _ = dynamic_panel(40, 2, 200, own=0.0, noise=1.0, seed=1)
    chosen = S.select_factors(wide.to_numpy(float), 6)
    assert chosen.chosen == 2 and math.isclose(chosen.explained.sum(), 1.0) and chosen.dropped_rows == 2
    e = S.panel_eigenvalues(wide.to_numpy(float))
    assert math.isclose(e.sum(), 40, rel_tol=1e-9)
    path = S.select_by_validation({"x": ["a"], "y": ["b"], "z": ["c"]}, lambda s: 1.0 - 0.5 * ("b" in s) + 0.1 * len(s), fixed=("t",))
    assert path.chosen == ["y"]


def test_break_statistics_have_their_null_distribution():
    c = G.sup_break_critical_values(1)
    assert 6.4 < c[0.1] < 7.6 and 7.9 < c[0.05] < 9.2 and 11 < c[0.01] < 13  # 7.17, 8.85 and 12.35 in the limit
    assert G.sup_break_pvalue(1e9, 1) == 0 and G.sup_break_pvalue(0.0, 1) == 1


def test_diagnostics_of_a_model(panel):
    x, _, _ = panel
    r = M.fit(x, 1, 1, QUARTERLY)
    d = G.run_diagnostics(r, list("qabcd"))
    assert d["convergence"][0]["converged"] and len(d["contribution"]) == 5 and all(0 <= p["r2"] <= 1 for p in d["contribution"][1:])
    assert np.allclose(G.effective_loadings(r.layout, r.parameters.loadings)[0], r.parameters.loadings[0] * 3)
    assert G.factor_blocks(["real_1", "f"], ["real"]) == {"real_1": "real", "f": "f"}


def test_convergence_table(spark):
    rows = spark.createDataFrame([("a", 0, -10.0), ("a", 1, -5.0), ("a", 2, -6.0), ("a", 3, -6.0001), ("b", 0, -3.0)], "k string, iteration int, loglik double")
    got = {r.k: r for r in G.convergence(rows, ["k"]).collect()}
    assert (got["a"].n_iter, got["a"].n_decreases, got["a"].largest_decrease, got["a"].converged) == (4, 2, 1.0, True)
    assert got["b"].converged is False and got["b"].largest_decrease == 0


# Nowcasts


@pytest.mark.parametrize("method", nowcasting.METHODS)
def test_quarterly_targets(method):
    wide, _ = two_step_example(150, 6, 1, seed=4)
    x = wide.to_numpy(float)
    months = np.array([d.month for d in wide.index])
    q = nowcasting.quarterly_columns(x, months)
    assert q.tolist() == [True] + [False] * 6
    e = nowcasting.estimate_block(x, months, method, q)
    assert np.isfinite(e.values[-1]) and (method in ("mean", "rw", "ar") or abs(e.values[-1] - np.nanmean(x[:, 0])) > 0)
    empty = x.copy()
    empty[:, 2] = np.nan
    got = nowcasting.estimate_block(empty, months, method, q)
    assert "without 1 series" in got.note and np.isfinite(got.values[-1])
    empty[:, 0] = np.nan
    got = nowcasting.estimate_block(empty, months, method, q)
    assert np.isnan(got.values).all() and "the target has 0 values" in got.note


def test_public_nowcast_of_a_quarterly_target(spark):
    wide, _ = two_step_example(150, 6, 1, seed=4)
    long = as_long(spark, wide)
    got = nowcasting.nowcast(long, "target", "bridge", names=list(wide.columns)).orderBy("period").collect()
    assert all(r.period.month % 3 == 0 for r in got) and got[-1].out_of_sample is not None and got[-1].note is None
    first = nowcasting.first_nowcast(nowcasting.nowcast(long, "target ~ x0 + x1", "em")).first()
    assert str(first.period) == "2012-06-01" and first.std > 0
    bands = nowcasting.add_density(nowcasting.nowcast(long, "target", "em")).where("out_of_sample IS NOT NULL").first()
    assert bands.lower_90 < bands.lower_68 < bands.out_of_sample < bands.upper_68 < bands.upper_90


def test_public_nowcast_with_blocks_and_slow_means(spark):
    wide, _ = two_step_example(150, 6, 1, seed=4)
    long = as_long(spark, wide)
    groups = {"all": list(wide.columns), "own": ["x0", "x1", "x2"]}
    got = {r.period: r for r in nowcasting.nowcast(long, "target", "em", blocks=groups, trends=["x3"], max_iter=5).collect()}
    x = wide[["target", *sorted(c for c in wide.columns if c != "target")]]
    loads = np.array([[True, c in groups["own"]] for c in x.columns])
    ahead = np.vstack([x.to_numpy(float), np.full((3, 7), np.nan)])  # a quarter ahead
    m = M.fit(ahead, [1, 1], 1, np.arange(7) == 0, loads, "white", (list(x.columns).index("x3"),), max_iter=5)
    for t, p in enumerate(x.index):
        if t % 3 == 2:
            r = got[p.date()]
            assert math.isclose(r.in_sample if r.observed is not None else r.out_of_sample, m.fitted()[t, 0], rel_tol=1e-9)
    with pytest.raises(ValueError, match="unknown series"):
        nowcasting.nowcast(long, "target", "em", blocks={"a": ["nobody"]})


def test_backtests_keep_parameters_between_refits(spark):
    wide, _ = two_step_example(120, 4, 1, seed=4)
    long = as_long(spark, wide)
    sched = V.schedule(long, literal(spark, [(c, 10) for c in wide.columns], "series string, delay int"))
    grid = literal(spark, [(f"2009-{m:02d}-20",) for m in (1, 2, 3, 4)], "vintage date")
    run = lambda k: nowcasting.backtest(sched, "target", [c for c in wide.columns if c != "target"], ["em", {"method": "rw", "label": "naive"}], grid, refit_every=k)
    rows = run(2).collect()
    assert {r.model for r in rows} == {"em", "naive"} and {r.kind for r in rows} <= {"backcast", "nowcast", "forecast"}
    each = {(r.model, r.vintage, r.period): r.forecast for r in run(1).collect()}
    kept = {(r.model, r.vintage, r.period): r.forecast for r in rows}
    assert set(each) == set(kept)
    odd = sorted({r.vintage for r in rows})[::2]
    assert all(math.isclose(each[k], kept[k], rel_tol=1e-6) for k in each if k[1] in odd or k[0] == "naive")
    assert any(abs(each[k] - kept[k]) > 1e-9 for k in each if k[1] not in odd and k[0] == "em")
    assert all(r.before is not None for r in rows if r.vintage not in odd and r.model == "naive")


def test_models_travel_as_rows(spark):
    wide, _ = two_step_example(120, 4, 1, seed=4)
    long = as_long(spark, wide).withColumn("block", F.lit("a"))
    blocks = long.union(long.withColumn("block", F.lit("b")).withColumn("value", F.col("value") * 2))
    m = models.Nowcaster(max_iter=20)
    fitted = m.fit(blocks, "target", list(wide.columns))
    est = m.update(fitted, blocks, "target", list(wide.columns)).where("out_of_sample IS NOT NULL")
    got = {(r.block, r.period): r.out_of_sample for r in est.collect()}
    assert got and all(math.isclose(2 * v, got["b", p], rel_tol=1e-5) for (b, p), v in got.items() if b == "a")
    with pytest.raises(ValueError):
        models.Nowcaster("zz", lags=0).validate()
    spec = models.SpecifiedModel(models.Nowcaster("rw"), n_series=2)
    assert spec.get_params()["model__method"] == "rw" and spec.clone().set_params(model__method="ar").model.method == "ar" and spec.model.method == "rw"


def test_benchmarks(spark):
    y = np.sin(np.arange(60) / 3)
    X0 = np.column_stack([np.cos(np.arange(62) / 3)])
    b = models.EstimatorBenchmark(lambda: models.Ridge(1e-6), 2).fit(y, X0)
    assert np.allclose(b.predict(2, X0[60:]), np.sin(np.arange(60, 62) / 3), atol=1e-3)
    assert models.clone_estimator(models.Ridge(2.0)).alpha == 2.0
    s = spark.createDataFrame([("s", (pd.Timestamp("2000-01-01") + pd.DateOffset(months=i)).date(), float(v)) for i, v in enumerate(y)], "series string, period date, value double")
    t = models.benchmark_table(s, {"rw": lambda: models.Benchmark("random_walk"), "ar": lambda: models.Benchmark("ar", 2)}, 2, 40)
    acc = {(r.model, r.horizon): r.rmsfe for r in E.accuracy(t).collect()}
    assert acc["ar", 1] < 1e-6 < acc["rw", 1] < acc["rw", 2]


def test_long_run_variance_has_every_lag(spark):
    """Horizon 15 and 1 against plain loops."""
    import datetime as dt

    rng = np.random.default_rng(0)
    rows, want = [], {}
    for h in (1, 15):
        d = np.convolve(rng.standard_normal(80), np.ones(h))[:60]
        day = [dt.date(2000, 1, 1) + dt.timedelta(days=31 * i) for i in range(60)]
        rows += [(h, v, v, float(x)) for v, x in zip(day, d)]
        c = d - d.mean()
        g = [float(c[k:] @ c[: 60 - k]) / 60 for k in range(h)]
        rect = g[0] + 2 * sum(g[1:])
        want[h] = rect if rect > 0 else g[0] + 2 * sum((1 - k / h) * g[k] for k in range(1, h))
    df = spark.createDataFrame(rows, "horizon int, vintage date, period date, d double")
    got = {r.horizon: r for r in E.long_run_variance(df).collect()}
    assert all(math.isclose(got[h].lrv, want[h], rel_tol=1e-9) and got[h].n == 60 for h in want)


def test_long_gaps_are_filled(spark):
    from driftgauge.operators.cleaning import fill_nearest_median

    n = 120
    v = [float(i) if i < 10 or i > 75 else None for i in range(n)]
    df = spark.createDataFrame([("s", (pd.Timestamp("2000-01-01") + pd.DateOffset(months=i)).date(), x) for i, x in enumerate(v)], "series string, period date, value double")
    for window in (3, 4, 5):
        got = [r.value for r in fill_nearest_median(df, window).orderBy("period").collect()]
        for t in range(n):
            w, want = window, v[t]
            while want is None:
                near = [v[s] for s in range(max(0, t - w // 2), min(n, t + (w - 1) // 2 + 1)) if v[s] is not None]
                want, w = (float(np.median(near)) if near else None), w + 2
            assert math.isclose(got[t], want), (window, t)


@pytest.mark.parametrize("r, lags, blocks", [(1, 1, False), (2, 2, False), (1, 2, True)])
def test_elimination_equals_the_recursion(r, lags, blocks):
    """Log-likelihood and every parameter after an iteration, with quarterly series, gaps, ragged ends and two blocks."""
    rng = np.random.default_rng(3)
    f = np.zeros((60, 2))
    for t in range(1, 60):
        f[t] = 0.7 * f[t - 1] + rng.standard_normal(2)
    x = f @ rng.standard_normal((2, 8)) + rng.standard_normal((60, 8))
    quarterly = np.arange(8) >= 6
    x[np.ix_(np.arange(60) % 3 != 2, quarterly)] = np.nan
    x[-2:, :2], x[-1, 3], x[10, 1], x[:5, 4] = np.nan, np.nan, np.nan, np.nan
    z = M.standardised(x)[0]
    which = np.ones((8, 2 if blocks else 1), bool)
    which[4:, 1:] = False
    layout = M.Layout(M.quarterly_weights(quarterly), which, [r] * which.shape[1], lags)
    p = M.start_parameters(z, layout)
    for _ in range(2):
        loglik, got = separable.iteration(z, layout, p)
        s = M.smoothed_moments(M.state_space(p, layout), z)
        want = M.m_step(z, layout, p, s)
        assert abs(loglik - s.loglik) < 1e-5
        for a, b in zip([got.own_ar, got.own_var, *got.loadings, *got.transition, *got.shocks], [want.own_ar, want.own_var, *want.loadings, *want.transition, *want.shocks]):
            assert np.allclose(a, b, atol=1e-8)
        p = want


def test_inverse_of_a_stationary_covariance():
    rng = np.random.default_rng(0)
    rho = rng.uniform(-0.9, 0.9, 5)
    column = rho[:, None] ** np.arange(12)
    column[:, 0] += 0.3
    inverse, logdet = separable.toeplitz_inverse(column)
    for c, i, d in zip(column, inverse, logdet):
        R = c[np.abs(np.subtract.outer(np.arange(12), np.arange(12)))]
        assert np.allclose(i @ R, np.eye(12)) and np.isclose(d, np.linalg.slogdet(R)[1])


def test_singular_shocks_go_back_to_the_recursion(panel, monkeypatch):
    """A fit by elimination equals one by the recursion, which takes over where a covariance is singular."""
    monkeypatch.setattr(separable, "applies", lambda *_: True)
    quick = M.fit(panel[0], 1, 1, QUARTERLY, max_iter=5)

    def fails(*_):
        raise np.linalg.LinAlgError

    monkeypatch.setattr(separable, "iteration", fails)
    plain = M.fit(panel[0], 1, 1, QUARTERLY, max_iter=5)
    assert np.allclose(quick.path, plain.path, rtol=1e-8) and np.allclose(quick.moments.a, plain.moments.a, atol=1e-6)
