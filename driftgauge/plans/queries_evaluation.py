"""Queries on forecast evaluation, tests, densities and scores."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from . import domain as D
from .catalogue import query
from .queries_panel import rounded


@query("SELECT model, vintage, period, horizon, round(forecast, 9) AS forecast, round(previous, 9) AS previous, round(actual, 9) AS actual FROM fc")
def forecast_table_rw_mean(spark, sf):
    return rounded(D.forecasts(spark, sf), "forecast", "previous", "actual")


_METRICS = """count(*) AS n, round(avg(error), 10) AS bias, round(avg(abs(error)), 10) AS mae, round(avg(error * error), 10) AS mse, round(sqrt(avg(error * error)), 10) AS rmsfe,
round(avg(CASE WHEN actual - previous IS NULL OR forecast - previous IS NULL THEN NULL WHEN (actual - previous) * (forecast - previous) > 0 THEN 1.0 ELSE 0.0 END), 10) AS directional"""
_M = ("bias", "mae", "mse", "rmsfe", "directional")


@query(f"SELECT model, horizon, {_METRICS} FROM err GROUP BY 1, 2")
def accuracy_by_horizon(spark, sf):
    return rounded(E.accuracy(D.forecasts(spark, sf)), *_M, n=10)


@query(f"SELECT model, {_METRICS} FROM err GROUP BY 1")
def accuracy_overall(spark, sf):
    return rounded(E.accuracy(D.forecasts(spark, sf), ["model"]), *_M, n=10)


_COMMON = "+ common AS (SELECT * FROM err QUALIFY count(*) OVER (PARTITION BY vintage, period) = 3) "


@query(_COMMON + "SELECT model, horizon, count(*) AS n FROM common GROUP BY 1, 2")
def common_sample(spark, sf):
    return E.common_sample(D.forecasts(spark, sf), D.MODELS).groupBy("model", "horizon").agg(F.count("*").alias("n"))


@query(_COMMON + ", r AS (SELECT model, horizon, sqrt(avg(error * error)) AS x FROM common GROUP BY 1, 2) SELECT r.model, r.horizon, round(r.x / nullif(b.x, 0), 10) AS relative_rmsfe FROM r JOIN r b ON b.model = 'mean' AND b.horizon = r.horizon")
def relative_rmsfe(spark, sf):
    return rounded(E.relative(D.forecasts(spark, sf), "mean", D.MODELS), "relative_rmsfe", n=10)


@query("""+ i AS (SELECT * FROM (VALUES ('pre', DATE '1900-01-01', DATE '1998-12-31'), ('during', DATE '1999-01-01', DATE '1999-06-30'), ('post', DATE '1999-07-01', DATE '2100-01-01'), ('without', DATE '1900-01-01', DATE '1998-12-31'), ('without', DATE '1999-07-01', DATE '2100-01-01')) t(sample, lo, hi))
SELECT model, sample, """ + _METRICS + " FROM err JOIN i ON period BETWEEN lo AND hi GROUP BY 1, 2")
def subperiod_metrics(spark, sf):
    parts = {"pre": [(None, "1998-12-31")], "during": [("1999-01-01", "1999-06-30")], "post": [("1999-07-01", None)], "without": [(None, "1998-12-31"), ("1999-07-01", None)]}
    return rounded(E.accuracy(E.sub_periods(D.forecasts(spark, sf), parts), ["model", "sample"]), *_M, n=10)


@query("SELECT model, horizon, round(avg(CASE WHEN actual - previous IS NULL OR forecast - previous IS NULL THEN NULL WHEN (actual - previous) * (forecast - previous) > 0 THEN 1.0 ELSE 0.0 END), 10) AS directional FROM err GROUP BY 1, 2")
def directional_accuracy(spark, sf):
    return E.errors(D.forecasts(spark, sf)).groupBy("model", "horizon").agg(F.round(E.hits(), 10).alias("directional"))


@query(_COMMON + "SELECT horizon, vintage, period, round(max(CASE WHEN model = 'mean' THEN error * error END), 10) AS mean, round(max(CASE WHEN model = 'rw' THEN error * error END), 10) AS rw, round(max(CASE WHEN model = 'sn' THEN error * error END), 10) AS sn FROM common GROUP BY 1, 2, 3")
def loss_table(spark, sf):
    return rounded(E.loss_table(D.forecasts(spark, sf), D.MODELS), *D.MODELS, n=10)


def _dm(d):
    return f"""+ pair AS (SELECT * FROM err WHERE model IN ('rw', 'mean') QUALIFY count(*) OVER (PARTITION BY vintage, period) = 2),
d AS (SELECT horizon, vintage, period, {d} AS d FROM (SELECT horizon, vintage, period, max(CASE WHEN model = 'mean' THEN error END) AS a, max(CASE WHEN model = 'rw' THEN error END) AS b FROM pair GROUP BY 1, 2, 3)),
c AS (SELECT *, d - avg(d) OVER (PARTITION BY horizon) AS c, avg(d) OVER (PARTITION BY horizon) AS mean, count(*) OVER (PARTITION BY horizon) AS n FROM d),
p AS (SELECT horizon, n, mean, c * c AS g0, c * lag(c) OVER w AS g1, c * lag(c, 2) OVER w AS g2 FROM c WINDOW w AS (PARTITION BY horizon ORDER BY vintage, period)),
s AS (SELECT horizon, any_value(n) AS n, any_value(mean) AS mean, sum(g0) / any_value(n) AS g0, sum(g1) / any_value(n) AS g1, sum(g2) / any_value(n) AS g2 FROM p GROUP BY 1),
v AS (SELECT horizon, n, mean, g0 + CASE WHEN horizon > 1 THEN 2 * g1 ELSE 0 END + CASE WHEN horizon > 2 THEN 2 * g2 ELSE 0 END AS rect, g0 + CASE WHEN horizon > 1 THEN 2 * (1 - 1.0 / horizon) * g1 ELSE 0 END + CASE WHEN horizon > 2 THEN 2 * (1 - 2.0 / horizon) * g2 ELSE 0 END AS bart FROM s),
l AS (SELECT horizon, n, mean, CASE WHEN rect > 0 THEN rect ELSE bart END AS lrv FROM v) """


@query(_dm("a * a - b * b") + "SELECT horizon, n, round(mean, 7) AS mean, round(sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n) * mean / sqrt(nullif(lrv, 0) / n), 7) AS statistic FROM l")
def diebold_mariano_stat(spark, sf):
    return rounded(E.diebold_mariano(D.forecasts(spark, sf), "rw", "mean").drop("p_value"), "mean", "statistic", n=7)


@query(_dm("a * a - b * b + (a - b) * (a - b)") + "SELECT horizon, n, round(mean, 7) AS mean, round(mean / sqrt(nullif(lrv, 0) / n), 7) AS statistic FROM l")
def clark_west_stat(spark, sf):
    return rounded(E.clark_west(D.forecasts(spark, sf), "rw", "mean").drop("p_value"), "mean", "statistic", n=7)


@query(_dm("a * a - b * b") + """, z AS (SELECT d AS z0, d * lag(d) OVER (ORDER BY vintage, period) AS z1, lag(d) OVER (ORDER BY vintage, period) AS l FROM d WHERE horizon = 1),
m AS (SELECT count(*) AS n, avg(z0) AS a, avg(z1) AS b, avg(z0 * z0) AS p, avg(z0 * z1) AS q, avg(z1 * z1) AS r FROM z WHERE l IS NOT NULL)
SELECT 1 AS horizon, n, round(n * (a * a * r - 2 * a * b * q + b * b * p) / nullif(p * r - q * q, 0), 6) AS statistic, round(exp(-n * (a * a * r - 2 * a * b * q + b * b * p) / nullif(p * r - q * q, 0) / 2), 6) AS p_value FROM m""")
def giacomini_white_stat(spark, sf):
    return rounded(E.giacomini_white(D.forecasts(spark, sf), "rw", "mean"), "statistic", "p_value", n=6)


@query("""+ x AS (SELECT model, horizon, CASE WHEN actual > previous THEN 1.0 ELSE 0.0 END AS y, CASE WHEN forecast > previous THEN 1.0 ELSE 0.0 END AS x FROM err WHERE previous IS NOT NULL),
g AS (SELECT model, horizon, count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(y) AS py, avg(x) AS px FROM x GROUP BY 1, 2),
s AS (SELECT *, py * px + (1 - py) * (1 - px) AS star FROM g),
v AS (SELECT *, star * (1 - star) / n - (((2 * py - 1) * (2 * py - 1) * px * (1 - px) + (2 * px - 1) * (2 * px - 1) * py * (1 - py)) / n + 4 * py * px * (1 - py) * (1 - px) / (CAST(n AS DOUBLE) * n)) AS d FROM s)
SELECT model, horizon, n, round(hit_rate, 10) AS hit_rate, round(star, 10) AS expected, round(CASE WHEN d > 1e-15 THEN (hit_rate - star) / sqrt(d) END, 6) AS statistic FROM v""")
def pesaran_timmermann_stat(spark, sf):
    p = E.pesaran_timmermann(D.forecasts(spark, sf)).drop("p_value")
    return rounded(rounded(p, "hit_rate", "expected", n=10), "statistic", n=6)


def _bands(spark, sf, alpha=0.2):
    """Per model, horizon and period an interval from the quantiles of errors known strictly before the vintage."""
    from ..operators.density import empirical_bands

    b = empirical_bands(E.errors(D.forecasts(spark, sf)), [alpha / 2, 1 - alpha / 2], strict=True)
    return b.withColumnsRenamed({"q10": "lower", "q90": "upper"})


_BANDS = """+ bands AS (SELECT r.model, r.horizon, r.period, any_value(r.actual) AS actual, any_value(r.forecast) AS forecast, any_value(r.forecast) + quantile_cont(p.error, 0.1) AS lower_, any_value(r.forecast) + quantile_cont(p.error, 0.9) AS upper_
FROM err r JOIN err p ON p.model = r.model AND p.horizon = r.horizon AND p.period < r.vintage GROUP BY 1, 2, 3 HAVING count(*) >= 8) """


@query(_BANDS + "SELECT model, horizon, period, round(actual, 11) AS actual, round(lower_, 10) AS lower, round(upper_, 10) AS upper FROM bands")
def backtest_empirical_bands(spark, sf):
    return rounded(rounded(_bands(spark, sf).select("model", "horizon", "period", "actual", "lower", "upper"), "actual", n=11), "lower", "upper", n=10)


@query(_BANDS + "SELECT model, horizon, count(*) AS n, round(avg(upper_ - lower_), 9) AS width, round(avg(upper_ - lower_ + 10 * (greatest(lower_ - actual, 0) + greatest(actual - upper_, 0))), 7) AS interval_score, round(avg(CASE WHEN actual BETWEEN lower_ AND upper_ THEN 1.0 ELSE 0.0 END), 10) AS coverage FROM bands GROUP BY 1, 2")
def interval_score(spark, sf):
    s = E.interval_summary(_bands(spark, sf), 0.2, ("model", "horizon")).select("model", "horizon", "n", "width", "interval_score", "coverage")
    return rounded(rounded(rounded(s, "coverage", n=10), "width"), "interval_score", n=7)


@query(_BANDS + """, h AS (SELECT model, horizon, period, CASE WHEN actual BETWEEN lower_ AND upper_ THEN 1 ELSE 0 END AS hit FROM bands),
t AS (SELECT *, lag(hit) OVER (PARTITION BY model, horizon ORDER BY period) AS was FROM h),
g AS (SELECT model, horizon, count(*) AS n, CAST(sum(hit) AS BIGINT) AS k, CAST(sum(CASE WHEN was = 0 AND hit = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n00, CAST(sum(CASE WHEN was = 0 AND hit = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n01, CAST(sum(CASE WHEN was = 1 AND hit = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n10, CAST(sum(CASE WHEN was = 1 AND hit = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n11 FROM t GROUP BY 1, 2)
SELECT model, horizon, n, k AS n_hits, n00, n01, n10, n11, round(-2 * (k * ln(0.8) + (n - k) * ln(0.2) - CASE WHEN k > 0 THEN k * ln(k / n) ELSE 0 END - CASE WHEN n > k THEN (n - k) * ln((n - k) / n) ELSE 0 END), 7) AS lr_uc FROM g""")
def christoffersen_lr(spark, sf):
    s = E.interval_summary(_bands(spark, sf), 0.2, ("model", "horizon")).select("model", "horizon", "n", "n_hits", "n00", "n01", "n10", "n11", "lr_uc")
    return rounded(s, "lr_uc", n=7)


@query("+ q AS (SELECT model, horizon, actual, forecast * (1 + (t - 0.5) / 5) AS q, t FROM err, (VALUES (0.1), (0.5), (0.9)) v(t)) SELECT model, horizon, CAST(t AS DOUBLE) AS tau, round(avg(CASE WHEN actual >= q THEN t * (actual - q) ELSE (1 - t) * (q - actual) END), 10) AS score FROM q GROUP BY ALL")
def pinball(spark, sf):
    from ..operators.density import quantile_scores

    e = E.errors(D.forecasts(spark, sf)).withColumn("level", F.explode(F.array(*[F.lit(t) for t in (0.1, 0.5, 0.9)])))
    e = e.withColumn("quantile", F.col("forecast") * (1 + (F.col("level") - 0.5) / 5))
    return rounded(quantile_scores(e, ["model", "horizon", "level"]).withColumnRenamed("level", "tau"), "score", n=10)


@query("""+ s AS (SELECT a.model, a.horizon, a.period, a.vintage, a.actual, a.forecast + b.error AS x FROM err a JOIN err b ON a.model = b.model AND a.horizon = b.horizon AND b.period <= a.vintage),
m AS (SELECT model, horizon, period, any_value(actual) AS actual, count(*) AS n, avg(abs(x - actual)) AS d1, avg(CASE WHEN x <= actual + 1e-12 THEN 1.0 ELSE 0.0 END) AS pit FROM s GROUP BY 1, 2, 3),
r AS (SELECT model, horizon, period, x, row_number() OVER (PARTITION BY model, horizon, period ORDER BY x) AS i, count(*) OVER (PARTITION BY model, horizon, period) AS n FROM s),
e AS (SELECT model, horizon, period, sum((2 * i - n - 1) * x) * 2 / (CAST(any_value(n) AS DOUBLE) * any_value(n)) AS d2 FROM r GROUP BY 1, 2, 3)
SELECT model, horizon, period, n, round(d1 - d2 / 2, 7) AS crps, round(pit, 10) AS pit FROM m JOIN e USING (model, horizon, period) WHERE n >= 8""")
def crps_sample(spark, sf):
    """Energy form over the sample of known errors, by ranks rather than pairs."""
    from ..operators.density import sample_scores

    return rounded(rounded(sample_scores(E.errors(D.forecasts(spark, sf))).drop("vintage"), "crps", n=7), "pit", n=10)


#: The normal distribution by its series phi(z) (z + z^3 / 3 + z^5 / 15 + ...), for the oracle.
_PIT = """+ u0 AS (SELECT model, horizon, (error - avg(error) OVER w) / stddev_samp(error) OVER w AS z, count(error) OVER w AS n FROM err WINDOW w AS (PARTITION BY model, horizon)),
u AS (SELECT model, horizon, n, 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: sign(z) * exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))) AS u FROM u0),
r AS (SELECT model, horizon, u, row_number() OVER (PARTITION BY model, horizon ORDER BY u) AS i, n FROM u) """


@query(_PIT + "SELECT model, horizon, any_value(n) AS n, round(max(greatest(i / n - u, u - (i - 1) / n)), 8) AS ks FROM r GROUP BY 1, 2")
def ks_stat(spark, sf):
    """Kolmogorov-Smirnov distance of normal probability transforms from the uniform."""
    from ..operators.density import uniformity_distance

    return rounded(uniformity_distance(E.errors(D.forecasts(spark, sf))), "ks", n=8)


@query("SELECT model, horizon, count(*) AS n, round(avg(error), 10) AS bias, round(avg(abs(error)), 10) AS mae, round(sqrt(avg(error * error)), 10) AS rmse, round(avg(abs(error)) * sqrt(pi() / 2), 10) AS sigma_mae FROM err GROUP BY 1, 2")
def empirical_error_scales(spark, sf):
    from ..operators.density import error_scales

    return rounded(error_scales(E.errors(D.forecasts(spark, sf))), "bias", "mae", "rmse", "sigma_mae", n=10)


@query("+ x AS (SELECT model, horizon, error, quantile_cont(error, 0.5) OVER w AS med FROM err WINDOW w AS (PARTITION BY model, horizon)), y AS (SELECT *, quantile_cont(abs(error - med), 0.5) OVER (PARTITION BY model, horizon) AS mad FROM x) SELECT model, horizon, round(avg(greatest(least(error, med + 3 * mad), med - 3 * mad)), 10) AS bias, round(avg(abs(greatest(least(error, med + 3 * mad), med - 3 * mad))), 10) AS mae FROM y GROUP BY 1, 2")
def winsorised_error_scales(spark, sf):
    from ..operators.density import error_scales

    return rounded(error_scales(E.errors(D.forecasts(spark, sf)), 3.0).select("model", "horizon", "bias", "mae"), "bias", "mae", n=10)


@query("+ g AS (SELECT model, horizon, stddev_samp(error) AS s FROM err GROUP BY 1, 2) SELECT model, horizon, round(avg(-0.5 * (error / s) * (error / s) - ln(s) - 0.5 * ln(2 * pi())), 7) AS log_score FROM err JOIN g USING (model, horizon) GROUP BY 1, 2")
def log_score_gaussian(spark, sf):
    from ..operators.density import gaussian_log_score

    return rounded(gaussian_log_score(E.errors(D.forecasts(spark, sf))), "log_score", n=7)


@query()
def forecast_tests_pvalues(spark, sf):
    """Diebold-Mariano, Clark-West and Giacomini-White with their p-values."""
    f = D.forecasts(spark, sf)
    cols = ["horizon", "n", "statistic", "p_value"]
    rows = E.diebold_mariano(f, "rw", "mean").select(F.lit("diebold_mariano").alias("test"), *cols)
    return rows.union(E.clark_west(f, "rw", "mean").select(F.lit("clark_west"), *cols)).union(E.giacomini_white(f, "rw", "mean").select(F.lit("giacomini_white"), *cols))


@query()
def model_confidence_set(spark, sf):
    return E.model_confidence_set(E.loss_table(D.forecasts(spark, sf), D.MODELS), D.MODELS)
