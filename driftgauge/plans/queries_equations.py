"""Queries on backtests in closed form, equations, weights, identities of models, legends and reports."""


from pyspark.sql import functions as F

from ..operators import cleaning as K
from ..operators import density as X
from ..operators import diagnostics as G
from ..operators import equations as Q
from ..operators import evaluation as E
from ..operators import panel as P
from ..operators import transforms as T
from ..operators import vintages as V
from . import domain as D
from .catalogue import query
from .queries_panel import rounded

_GROWTH = """+ gr AS (SELECT p.series, p.period, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS value FROM panel p WINDOW w AS (PARTITION BY series ORDER BY period)),
sched AS (SELECT series, period, value, CAST(last_day(period) + delay AS DATE) AS released FROM gr JOIN delays USING (series)),
v AS (SELECT CAST(DATE '1998-01-15' + to_months(3 * k) AS DATE) AS vintage FROM (SELECT unnest(generate_series(0, 7)) AS k))"""


def _grid(spark, rows, start="1998-01-15", end="1999-12-15", step=3):
    return V.vintage_grid(rows.agg(F.count("*").alias("n")), start, end, step)


def _table(t):
    return rounded(t.select("model", "vintage", "period", "horizon", "forecast", "previous", "actual", "kind", "days_to_end", "days_to_release"), "forecast", "previous", "actual")


@query(_GROWTH + """, known AS (SELECT vintage, period, value FROM sched JOIN v ON period <= vintage AND released <= vintage WHERE series = '1-URGENT' AND value IS NOT NULL),
l AS (SELECT vintage, max(period) AS last, arg_max(value, period) AS rw, avg(value) AS mean FROM known GROUP BY 1),
f AS (SELECT *, CAST(unnest(generate_series(last + INTERVAL 1 MONTH, date_trunc('month', vintage) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS period FROM l),
x AS (SELECT model, vintage, period, row_number() OVER (PARTITION BY model, vintage ORDER BY period) AS horizon, CASE model WHEN 'rw' THEN rw ELSE mean END AS forecast, rw AS previous FROM f, (VALUES ('rw'), ('mean')) m(model))
SELECT model, vintage, x.period, horizon, round(forecast, 9) AS forecast, round(previous, 9) AS previous, round(s.value, 9) AS actual,
CASE WHEN last_day(x.period) < vintage THEN 'backcast' WHEN x.period <= vintage THEN 'nowcast' ELSE 'forecast' END AS kind, CAST(last_day(x.period) - vintage AS INTEGER) AS days_to_end, CAST(s.released - vintage AS INTEGER) AS days_to_release
FROM x LEFT JOIN sched s ON s.series = '1-URGENT' AND s.period = x.period""")
def backtest_closed_form(spark, sf):
    """A pseudo real-time backtest by the random walk and the mean of what was known, with its labels."""
    from .nowcasting import backtest

    sched = V.schedule(T.apply(D.panel(spark, sf), "pct"), D.delays(spark))
    return _table(backtest(sched, D.TARGET, D.SERIES[1:], ["rw", "mean"], _grid(spark, sched)))


def _quarterly(spark, sf):
    """Monthly growth of all series and quarterly growth of the total, which is released 60 days after its quarter."""
    total = T.apply(D.quarterly(spark, sf), "pct", "Q").select("series", "period", "value")
    monthly = T.apply(D.panel(spark, sf), "pct").select("series", "period", "value")
    delays = P.literal(spark, [*D.DELAYS.items(), ("total", 60)], "series string, delay int")
    return V.schedule(monthly.unionByName(total), delays)


@query(_GROWTH + """, qt AS (SELECT period, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS value, CAST(last_day(period) + 60 AS DATE) AS released FROM quarterly WINDOW w AS (ORDER BY period)),
known AS (SELECT vintage, period, value FROM qt JOIN v ON period <= vintage AND released <= vintage WHERE value IS NOT NULL),
l AS (SELECT vintage, max(period) AS last, arg_max(value, period) AS rw, avg(value) AS mean FROM known GROUP BY 1),
e AS (SELECT *, date_trunc('quarter', date_trunc('month', vintage) + INTERVAL 1 MONTH) + INTERVAL 2 MONTH AS last_asked FROM l),
f AS (SELECT *, CAST(unnest(generate_series(last + INTERVAL 3 MONTH, last_asked, INTERVAL 3 MONTH)) AS DATE) AS period FROM e),
x AS (SELECT model, vintage, period, row_number() OVER (PARTITION BY model, vintage ORDER BY period) AS horizon, CASE model WHEN 'rw' THEN rw ELSE mean END AS forecast, rw AS previous FROM f, (VALUES ('rw'), ('mean')) m(model))
SELECT model, vintage, x.period, horizon, round(forecast, 9) AS forecast, round(previous, 9) AS previous, round(s.value, 9) AS actual,
CASE WHEN last_day(x.period) < vintage THEN 'backcast' WHEN x.period <= vintage THEN 'nowcast' ELSE 'forecast' END AS kind, CAST(last_day(x.period) - vintage AS INTEGER) AS days_to_end, CAST(s.released - vintage AS INTEGER) AS days_to_release
FROM x LEFT JOIN qt s ON s.period = x.period""")
def backtest_quarterly_target(spark, sf):
    """The quarterly total as the target of a monthly panel: its forecasts are quarters, until the one of the vintage or the next."""
    from .nowcasting import backtest

    sched = _quarterly(spark, sf)
    return _table(backtest(sched, "total", D.SERIES, ["rw", "mean"], _grid(spark, sched)))


@query()
def quarterly_target_methods(spark, sf):
    """The quarterly total by every method at three vintages."""
    from .nowcasting import METHODS, backtest

    sched = _quarterly(spark, sf)
    t = backtest(sched, "total", D.SERIES, list(METHODS), _grid(spark, sched, "1999-03-15", "1999-12-15", 3), refit_every=2)
    return t.select("model", "vintage", "period", "horizon", "forecast", "std", "actual", "kind", "note")


@query(_GROWTH + """, z AS (SELECT vintage, s.series, s.period, s.value FROM sched s JOIN v ON s.period <= vintage AND released <= vintage WHERE s.value IS NOT NULL)
SELECT vintage, count(*) AS n_known, TRUE AS converged, CAST(0 AS BIGINT) AS n_decreases, CAST(0 AS DOUBLE) AS gap FROM z GROUP BY 1""")
def em_identities(spark, sf):
    """At every vintage a mixed-frequency model's log-likelihood never falls and settles, and estimates are the weighted sum of the data."""
    sched = V.schedule(T.apply(D.panel(spark, sf), "pct"), D.delays(spark))
    cells = V.at_dates(sched, _grid(spark, sched), lambda v: F.col("period") <= v)
    cells = V.release_mask(cells, F.col("vintage")).where("value IS NOT NULL").select("vintage", "series", "period", "value")

    def run(pdf):
        import numpy as np
        import pandas as pd

        from driftgauge.operators import mixed, statespace

        x = pdf.pivot(index="period", columns="series", values="value").sort_index().to_numpy(float)
        r = mixed.fit(x, 1, 1, idiosyncratic="white")
        t = len(x) - 1
        const, w = statespace.weights_on(r.model, r.z, t, r.model.Z[0])
        gap = const + np.nansum(w * r.z) - r.moments.a[t] @ r.model.Z[0]
        return pd.DataFrame({"vintage": pdf["vintage"].iloc[0], "n_known": len(pdf), "iteration": range(len(r.path)), "loglik": r.path, "gap": abs(gap)})

    paths = cells.groupBy("vintage").applyInPandas(run, "vintage date, n_known long, iteration long, loglik double, gap double")
    g = G.convergence(paths, ["vintage"]).select("vintage", "converged", "n_decreases")
    return paths.groupBy("vintage").agg(F.max("n_known").alias("n_known"), F.round(F.max("gap"), 6).alias("gap")).join(g, "vintage").select("vintage", "n_known", "converged", "n_decreases", "gap")


@query("""+ a AS (SELECT series, period, arg_max_null(value, vintage) AS v FROM store WHERE vintage <= DATE '1999-06-15' GROUP BY 1, 2), b AS (SELECT series, period, arg_max_null(value, vintage) AS v FROM store WHERE vintage <= DATE '1999-09-15' GROUP BY 1, 2),
m AS (SELECT period FROM (SELECT period FROM a UNION SELECT period FROM b) QUALIFY period < max(period) OVER ())
SELECT count(*) FILTER (WHERE a.v IS NULL AND b.v IS NOT NULL) AS n_news, count(*) FILTER (WHERE a.v <> b.v) AS n_revised, CAST(0 AS DOUBLE) AS gap FROM b JOIN m USING (period) LEFT JOIN a USING (series, period)""")
def news_identity(spark, sf):
    """Releases and revisions between two vintages, and what the decomposition leaves unexplained."""
    from .queries_models import _news, _two_vintages

    def run(pdf):
        import numpy as np
        import pandas as pd

        from driftgauge.operators import factors as M

        _, model, old, new, _ = _news(pdf)
        n = M.news(model, old, new, len(old) - 1, 0)
        gap = n["old"] + n["removals"] + n["revisions"] + sum(x["impact"] for x in n["news"]) - n["new"]
        revised = int((~np.isnan(old) & ~np.isnan(new) & (np.abs(old - new) > 1e-12)).sum())
        return pd.DataFrame({"n_news": [len(n["news"])], "n_revised": [revised], "gap": [round(abs(float(gap)), 7)]})

    return _two_vintages(spark, sf).groupBy(F.lit(1).alias("_k")).applyInPandas(run, "n_news long, n_revised long, gap double")


# Equations

_XY = """+ xs AS (SELECT series, CAST(date_trunc('quarter', period) + INTERVAL 2 MONTH AS DATE) AS period, avg(value) AS x FROM panel GROUP BY 1, 2 HAVING count(value) = 3),
xy AS (SELECT xs.series, xs.period, x, q.value AS y FROM xs JOIN quarterly q ON q.period = xs.period)"""


def _bridge_rows(spark, sf):
    """Quarterly means of the monthly series beside the quarterly total."""
    from ..operators import aggregation as A

    x = P.place_at_period_end(A.to_lower(D.panel(spark, sf), "M", "Q", "mean"), "M", "Q").select("series", "period", F.col("value").alias("x"))
    return x.join(D.quarterly(spark, sf).select("period", F.col("value").alias("y")), "period")


@query(_XY + " SELECT series, regr_count(y, x) AS n, round(regr_slope(y, x), 8) AS b1, round(regr_intercept(y, x), 7) AS b0, round(regr_r2(y, x), 8) AS r2 FROM xy GROUP BY 1")
def bridge_equations(spark, sf):
    """All equations of one indicator."""
    e = Q.single_equations(_bridge_rows(spark, sf)).select("series", "n", "b1", "b0", "r2")
    return rounded(rounded(e, "b1", "r2", n=8), "b0", n=7)


@query(_XY + """, j AS (SELECT a.series AS a, b.series AS b, a.x AS u, b.x AS v, a.y FROM xy a JOIN xy b ON a.period = b.period AND a.series < b.series),
r AS (SELECT a, b, count(*) AS n, regr_slope(y, u) AS byu, regr_slope(v, u) AS bvu, corr(y, u) AS ryu, corr(y, v) AS ryv, corr(u, v) AS ruv, stddev_pop(y) AS sy, stddev_pop(u) AS su, stddev_pop(v) AS sv FROM j GROUP BY 1, 2),
c AS (SELECT a, b, n, (ryu - ryv * ruv) / (1 - ruv * ruv) * sy / su AS b1, (ryv - ryu * ruv) / (1 - ruv * ruv) * sy / sv AS b2, (ryu * ryu + ryv * ryv - 2 * ryu * ryv * ruv) / (1 - ruv * ruv) AS r2 FROM r)
SELECT a, b, n, round(b1, 6) AS b1, round(b2, 6) AS b2, round(r2, 7) AS r2 FROM c""")
def bridge_pairs(spark, sf):
    """All equations of two indicators, by centred moments; the oracle goes by partial correlations."""
    e = Q.pair_equations(_bridge_rows(spark, sf)).select("a", "b", "n", "b1", "b2", "r2")
    return rounded(rounded(e, "b1", "b2", n=6), "r2", n=7)


@query(_XY + """, e AS (SELECT series, regr_count(y, x) AS n, regr_syy(y, x) * (1 - regr_r2(y, x)) AS ssr, regr_r2(y, x) AS r2 FROM xy GROUP BY 1),
w AS (SELECT series, (n - 2) / ssr AS i, r2 AS r, n * ln(ssr / n) + 2 * ln(n) AS b FROM e),
x AS (SELECT series, i / sum(i) OVER () AS inverse_mse, r / sum(r) OVER () AS r2, exp(-(b - min(b) OVER ()) / 2) AS k FROM w)
SELECT series, round(inverse_mse, 8) AS inverse_mse, round(r2, 8) AS r2, round(k / sum(k) OVER (), 7) AS bic FROM x""")
def combination_weights(spark, sf):
    """Weights of the single equations by three schemes."""
    e = Q.single_equations(_bridge_rows(spark, sf))
    out = None
    for scheme in ("inverse_mse", "r2", "bic"):
        w = Q.combination_weights(e, scheme).select("series", F.col("weight").alias(scheme))
        out = w if out is None else out.join(w, "series")
    return rounded(rounded(out, "inverse_mse", "r2", n=8), "bic", n=7)


@query("""+ k AS (SELECT unnest(generate_series(1, 12)) AS k), a AS (SELECT 'almon' AS kind, k AS lag, exp(0.1 * k - 0.05 * k * k) AS w FROM k), b AS (SELECT 'beta' AS kind, k AS lag, pow((k - 0.5) / 12, 0.5) * pow(1 - (k - 0.5) / 12, 2) AS w FROM k)
SELECT kind, lag, round(w / sum(w) OVER (PARTITION BY kind), 10) AS weight FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def lag_weight_curves(spark, sf):
    """Exponential Almon and beta weights of twelve lags."""
    from ..operators import forecasters as B

    rows = [("almon", k, float(w)) for k, w in enumerate(B.exp_almon(0.1, -0.05, 12), 1)] + [("beta", k, float(w)) for k, w in enumerate(B.beta_weights(1.5, 3.0, 12), 1)]
    return rounded(P.literal(spark, rows, "kind string, lag long, weight double"), "weight", n=10)


@query(_GROWTH + """, l AS (SELECT series, period, value AS v0, lag(value) OVER w AS v1, lag(value, 2) OVER w AS v2 FROM gr WINDOW w AS (PARTITION BY series ORDER BY period)),
k AS (SELECT exp(0.05) AS a, exp(0.0) AS b, exp(-0.15) AS c), x AS (SELECT series, period, (a * v0 + b * v1 + c * v2) / (a + b + c) AS x FROM l, k),
y AS (SELECT period, value AS y FROM gr WHERE series = '1-URGENT')
SELECT x.series, regr_count(y, x) AS n, round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 8) AS intercept, round(regr_r2(y, x), 8) AS r2 FROM x JOIN y USING (period) WHERE x.series <> '1-URGENT' GROUP BY 1""")
def midas_given_weights(spark, sf):
    """The target's growth on Almon-weighted sums of three lags of each other series."""
    from ..operators import forecasters as B

    g = T.apply(D.panel(spark, sf), "pct")
    x = K.weighted_moving_average(g, [float(w) for w in B.exp_almon(0.1, -0.05, 3)]).where(F.col("series") != D.TARGET).select("series", "period", F.col("value").alias("x"))
    y = g.where(F.col("series") == D.TARGET).select("period", F.col("value").alias("y"))
    e = Q.single_equations(x.join(y, "period")).select("series", "n", F.col("b1").alias("slope"), F.col("b0").alias("intercept"), "r2")
    return rounded(e, "slope", "intercept", "r2", n=8)


@query("""+ y AS (SELECT period, value AS y FROM panel WHERE series = '1-URGENT'), c AS (SELECT series, corr(value, y) AS c, count(*) AS n FROM panel p JOIN y USING (period) WHERE series <> '1-URGENT' AND value IS NOT NULL AND y IS NOT NULL GROUP BY 1)
SELECT series, n, CAST(floor(4 * pow(n / 100.0, 2.0 / 9)) AS BIGINT) AS hac_lags, round(sign(c) * greatest(abs(c) - 0.05, 0), 9) AS lasso, round(sign(c) * greatest(abs(c) - 0.025, 0) / 1.025, 9) AS elastic_net FROM c""")
def single_predictor_penalties(spark, sf):
    """Penalised coefficients of each standardised predictor alone, and the lags of its robust t statistic."""
    from ..operators.selection import sis, soft_thresholded

    def run(batches):
        for pdf in batches:
            c = pdf["correlation"]
            yield pdf.assign(hac_lags=[Q.newey_west_lags(int(n)) for n in pdf["n"]], lasso=[soft_thresholded(v, 1.0, 0.05) for v in c], elastic_net=[soft_thresholded(v, 1.0, 0.05, 0.5) for v in c])[["series", "n", "hac_lags", "lasso", "elastic_net"]]

    return rounded(sis(D.panel(spark, sf), D.TARGET).select("series", "n", "correlation").mapInPandas(run, "series string, n long, hac_lags long, lasso double, elastic_net double"), "lasso", "elastic_net")


@query("""+ m AS (SELECT series, avg(value) AS x FROM panel GROUP BY 1), g AS (SELECT series, x, (-1.0 + sqrt(1 + 4 * 4)) / 2 AS s1, (-0.2 + sqrt(0.04 + 4 * 0.16)) / 2 AS s2 FROM m),
k AS (SELECT *, 1 + 1.0 / s1 AS k1, 1 + 0.2 / s2 AS k2 FROM g)
SELECT series, round((k1 - 1) * ln(x) - x / s1 - k1 * ln(s1) - lgamma(k1), 8) AS wide, round((k2 - 1) * ln(x) - x / s2 - k2 * ln(s2) - lgamma(k2), 7) AS narrow, round(3 * ln(2.0) - lgamma(3) - 4 * ln(x) - 2 / x, 8) AS inverse FROM k""")
def hyperprior_densities(spark, sf):
    """Log densities of gamma and inverse gamma hyperpriors at the mean of each series."""
    from ..operators.blocked import GammaHyperprior, InverseGammaHyperprior

    wide, narrow, inverse = GammaHyperprior(1.0, 2.0), GammaHyperprior(0.2, 0.4), InverseGammaHyperprior(3.0, 2.0)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(wide=pdf["x"].map(wide.logpdf), narrow=pdf["x"].map(narrow.logpdf), inverse=pdf["x"].map(inverse.logpdf))[["series", "wide", "narrow", "inverse"]]

    m = D.panel(spark, sf).groupBy("series").agg(F.avg("value").alias("x"))
    return rounded(rounded(m.mapInPandas(run, "series string, wide double, narrow double, inverse double"), "wide", "inverse", n=8), "narrow", n=7)


@query("+ y AS (SELECT period, value AS y FROM panel WHERE series = '1-URGENT'), c AS (SELECT series, abs(corr(value, y)) AS c FROM panel JOIN y USING (period) WHERE series <> '1-URGENT' AND value IS NOT NULL AND y IS NOT NULL GROUP BY 1) SELECT series, round(1 + c, 9) AS first, round(1 - c, 9) AS second FROM c")
def pair_eigenvalues(spark, sf):
    """Eigenvalues of the correlation of the target with each other series."""
    from ..operators.selection import panel_eigenvalues

    p = D.panel(spark, sf)
    y = p.where(F.col("series") == D.TARGET).select("period", F.col("value").alias("y"))

    def run(pdf):
        import pandas as pd

        e = panel_eigenvalues(pdf[["value", "y"]].to_numpy(float))
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "first": [float(e[0])], "second": [float(e[1])]})

    return rounded(p.where(F.col("series") != D.TARGET).join(y, "period").groupBy("series").applyInPandas(run, "series string, first double, second double"), "first", "second")


# Reports and tables of results


@query("""+ t AS (SELECT series, period, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS value FROM panel WINDOW w AS (PARTITION BY series ORDER BY period)),
q AS (SELECT *, quantile_cont(value, 0.25) OVER s AS lo, quantile_cont(value, 0.5) OVER s AS mid, quantile_cont(value, 0.75) OVER s AS hi, count(value) OVER s AS n, min(CASE WHEN value IS NOT NULL THEN period END) OVER s AS f, max(CASE WHEN value IS NOT NULL THEN period END) OVER s AS l FROM t WINDOW s AS (PARTITION BY series))
SELECT series, count(*) AS n, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 10) AS missing_share, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) > 1.0 / 3 AS dropped,
CAST(sum(CASE WHEN n >= 4 AND hi > lo AND abs(value - mid) > 1.5 * (hi - lo) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers, CAST(sum(CASE WHEN value IS NULL AND period > f AND period < l THEN 1 ELSE 0 END) AS BIGINT) AS n_filled FROM q GROUP BY 1""")
def preparation_report(spark, sf):
    """What preparation does to each series."""
    return rounded(K.report(D.panel(spark, sf), "pct", threshold=1.5), "missing_share", n=10)


@query("""+ d AS (SELECT series, period, value, lag(value) OVER w AS b, count(*) OVER (PARTITION BY series) AS n FROM panel WINDOW w AS (PARTITION BY series ORDER BY period)),
f AS (SELECT *, value - b < -1e-9 * (abs(b) + 1) AS fall, abs(value - b) / ((abs(value) + abs(b)) / 2 + 1e-12) AS r FROM d)
SELECT series, any_value(n) AS n_iter, CAST(sum(CASE WHEN fall THEN 1 ELSE 0 END) AS BIGINT) AS n_decreases, round(coalesce(max(CASE WHEN fall THEN b - value END), 0), 9) AS largest_decrease, round(arg_max_null(r, period), 9) AS last_relative_change, coalesce(arg_max_null(r, period) < 0.05, false) AS converged FROM f GROUP BY 1""")
def path_convergence(spark, sf):
    """The checks of a log-likelihood path, on the paths of the panel's series."""
    return rounded(G.convergence(D.panel(spark, sf), ["series"], "period", "value", 0.05), "largest_decrease", "last_relative_change")


@query("SELECT model AS vintage, count(*) AS n, round(sqrt(avg(error * error)), 9) AS rmse, round(avg(abs(error)), 9) AS mae, round(1 - sum(error * error) / nullif(var_pop(actual) * count(*), 0), 8) AS r2 FROM err WHERE horizon = 1 GROUP BY 1")
def in_sample_fit(spark, sf):
    """Fit of the one-step forecasts of each model, as of results within a sample."""
    from .nowcasting import in_sample_metrics

    t = E.errors(D.forecasts(spark, sf)).where("horizon = 1").select(F.col("model").alias("vintage"), F.col("actual").alias("observed"), F.col("forecast").alias("in_sample"))
    return rounded(rounded(in_sample_metrics(t), "rmse", "mae"), "r2", n=8)


@query("+ g AS (SELECT model, horizon, avg(forecast) AS m, stddev_samp(error) AS s FROM err GROUP BY 1, 2) SELECT model, horizon, round(m - 1.6448536269514722 * s, 8) AS q05, round(m, 8) AS q50, round(m + 0.6744897501960817 * s, 8) AS q75, round(m + 1.6448536269514722 * s, 8) AS q95 FROM g")
def gaussian_fan(spark, sf):
    """Quantiles of a fan from points and deviations."""
    g = E.errors(D.forecasts(spark, sf)).groupBy("model", "horizon").agg(F.avg("forecast").alias("estimate"), F.stddev_samp("error").alias("std"))
    return rounded(X.gaussian_quantiles(g, (0.05, 0.5, 0.75, 0.95)).drop("estimate", "std"), "q05", "q50", "q75", "q95", n=8)


_STEPS = "+ s AS (SELECT series || ' ' || strftime(period, '%Y-%m') AS item, sum(r) AS impact FROM (SELECT series, period, value - lag(value) OVER (PARTITION BY series, period ORDER BY vintage) AS r FROM store) GROUP BY 1 HAVING sum(r) IS NOT NULL), "


def _revision_impacts(spark, sf):
    r = V.revisions(D.store(spark, sf)).where("revision IS NOT NULL")
    return r.withColumn("item", F.concat("series", F.lit(" "), F.date_format("period", "yyyy-MM")))


@query(_STEPS + "k AS (SELECT *, row_number() OVER (ORDER BY abs(impact) DESC, item) AS r FROM s) SELECT CASE WHEN r <= 10 THEN item ELSE 'others' END AS item, least(r, 11) AS place, round(sum(impact), 8) AS impact FROM k GROUP BY 1, 2")
def largest_revisions(spark, sf):
    """The ten cells revised most, and the sum of the others."""
    return rounded(X.waterfall(_revision_impacts(spark, sf).groupBy("item").agg(F.sum("revision").alias("impact")), 10), "impact", n=8)


@query("""+ r AS (SELECT series, vintage, value - lag(value) OVER (PARTITION BY series, period ORDER BY vintage) AS r FROM store), g AS (SELECT series AS "group", vintage, sum(r) AS impact FROM r WHERE r IS NOT NULL AND r <> 0 GROUP BY 1, 2)
SELECT "group", vintage, round(impact, 8) AS impact, round(sum(impact) OVER (PARTITION BY "group" ORDER BY vintage), 7) AS cumulative FROM g""")
def cumulative_revisions(spark, sf):
    """Impacts by group and vintage, and their running sum."""
    n = _revision_impacts(spark, sf).select("vintage", F.col("series").alias("group"), F.col("revision").alias("impact"))
    return rounded(rounded(X.tracker(n.where("impact <> 0")), "impact", n=8), "cumulative", n=7)


# Legends and inputs

_LEGEND = "+ lg AS (SELECT p_brand AS series, CASE WHEN max(p_size) % 3 = 0 THEN 'Q' WHEN max(p_size) % 3 = 1 THEN 'M' ELSE 'W' END AS frequency, string_agg(DISTINCT p_type, '; ') AS blocks FROM part GROUP BY 1) "


def _legend(spark, sf):
    p = D.table(spark, sf, "part")
    kind = F.pmod(F.max("p_size"), F.lit(3))
    return p.groupBy(F.col("p_brand").alias("series")).agg(F.when(kind == 0, "Q").when(kind == 1, "M").otherwise("W").alias("frequency"), F.concat_ws("; ", F.collect_set("p_type")).alias("blocks"))


@query(_LEGEND + "SELECT frequency, string_agg(series, ',' ORDER BY series) AS series FROM lg GROUP BY 1")
def legend_by_frequency(spark, sf):
    from ..sources.files import series_by_frequency

    return series_by_frequency(_legend(spark, sf)).select("frequency", F.concat_ws(",", "series").alias("series"))


@query("SELECT DISTINCT p_brand AS series, p_type AS block FROM part")
def legend_blocks(spark, sf):
    """Series and their blocks, from texts that join the blocks."""
    from ..sources.files import block_members

    return block_members(_legend(spark, sf))


@query("SELECT p_brand AS series, bool_or(p_type = 'ECONOMY') AS economy, bool_or(p_type = 'SMALL') AS small FROM part GROUP BY 1")
def legend_block_matrix(spark, sf):
    from ..sources.files import block_matrix

    return block_matrix(_legend(spark, sf), ["ECONOMY", "SMALL"]).withColumnsRenamed({"ECONOMY": "economy", "SMALL": "small"})


@query("+ q AS (SELECT DISTINCT CAST(date_trunc('quarter', period) AS DATE) AS period FROM obs), m AS (SELECT DISTINCT period FROM obs) SELECT year(period) || 'Q' || quarter(period) AS text, period FROM q UNION ALL SELECT year(period) || 'M' || month(period), period FROM m UNION ALL SELECT strftime(period, '%Y-%m'), period FROM m UNION ALL SELECT strftime(period, '%Y-%m-%d'), period FROM m")
def period_texts(spark, sf):
    """Quarters, months and days as texts, read back as dates."""
    from ..sources.files import period_of

    m = D.obs(spark, sf).select("period").distinct()
    year = F.year("period").cast("string")
    texts = m.select(F.concat(year, F.lit("Q"), F.quarter("period").cast("string")).alias("text")).distinct()
    for t in (F.concat(year, F.lit("M"), F.month("period").cast("string")), F.date_format("period", "yyyy-MM"), F.date_format("period", "yyyy-MM-dd")):
        texts = texts.union(m.select(t))
    return texts.select("text", period_of(F.col("text")).alias("period"))


@query("SELECT series, period, round(value, 9) AS value FROM obs")
def collapsed_repeats(spark, sf):
    """A panel given twice, once: equal repeats collapse, others would end the job."""
    from ..sources.files import single_values

    o = D.obs(spark, sf).select("series", "period", "value")
    return rounded(single_values(o.union(o)), "value")


@query("SELECT series, CASE WHEN series < '3' THEN 10 ELSE delay END AS delay FROM delays UNION ALL SELECT 'new', 5")
def changed_delays(spark, sf):
    changes = P.literal(spark, [(s, 10) for s in D.SERIES if s < "3"] + [("new", 5)], "series string, delay int")
    return V.with_delays(D.delays(spark), changes)


@query("+ d AS (SELECT period, CAST(last_day(period) + 20 AS DATE) AS date FROM months) SELECT p.series, p.period, CASE WHEN p.series IN ('1-URGENT', '5-LOW') THEN d.date ELSE CAST(last_day(p.period) + delay AS DATE) END AS release_date FROM panel p JOIN d USING (period) JOIN delays USING (series)")
def explicit_calendar(spark, sf):
    """Series with a published calendar have its dates, the others the rule."""
    from ..functions import calendar as C

    p = D.panel(spark, sf)
    dates = p.select("period").distinct().select(F.lit("official").alias("calendar"), "period", F.date_add(C.end_of(F.col("period"), "M"), 20).alias("date"))
    own = P.literal(spark, [("1-URGENT", "official"), ("5-LOW", "official")], "series string, calendar string")
    return V.schedule(p, D.delays(spark), V.explicit_releases(own, dates)).select("series", "period", "release_date")


