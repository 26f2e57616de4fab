"""Queries on diagnostics, selection, forecasters, factor models and news.

Models are numpy functions in grouped maps: Spark spreads vintages, specifications,
replicates and series, and gives each group its small block of a panel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import diagnostics as G
from ..operators import panel as P
from ..operators import selection as S
from ..operators import transforms as T
from ..operators import vintages as V
from . import domain as D
from .catalogue import query
from .queries_panel import rounded


@query("SELECT series, period, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 9) AS z FROM panel WINDOW w AS (PARTITION BY series)")
def zscores_full(spark, sf):
    return rounded(G.zscores(D.panel(spark, sf)).select("series", "period", "z"), "z")


@query("""+ z AS (SELECT series, period, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM panel WINDOW w AS (PARTITION BY series ORDER BY period ROWS BETWEEN 35 PRECEDING AND CURRENT ROW))
SELECT CASE WHEN series < '3' THEN 'fast' ELSE 'slow' END AS label, period, round(avg(z), 9) AS z FROM z GROUP BY 1, 2""")
def zscores_rolling_grouped(spark, sf):
    groups = P.literal(spark, [(s, "fast" if s < "3" else "slow") for s in D.SERIES], "series string, label string")
    return rounded(G.group_means(G.zscores(D.panel(spark, sf), 36), groups), "z")


@query("""+ q AS (SELECT *, quantile_cont(value, 0.25) OVER s AS lo, quantile_cont(value, 0.5) OVER s AS mid, quantile_cont(value, 0.75) OVER s AS hi, count(value) OVER s AS n, min(CASE WHEN value IS NOT NULL THEN period END) OVER s AS f, max(CASE WHEN value IS NOT NULL THEN period END) OVER s AS l FROM slotted WINDOW s AS (PARTITION BY series))
SELECT series, count(*) AS n_slot, count(value) AS n_observed, CAST(sum(CASE WHEN value IS NULL AND period < f THEN 1 ELSE 0 END) AS BIGINT) AS n_leading, CAST(sum(CASE WHEN value IS NULL AND period > f AND period < l THEN 1 ELSE 0 END) AS BIGINT) AS n_interior, CAST(sum(CASE WHEN value IS NULL AND (l IS NULL OR period > l) THEN 1 ELSE 0 END) AS BIGINT) AS n_ragged,
CAST(sum(CASE WHEN n >= 4 AND hi > lo AND abs(value - mid) > 1.5 * (hi - lo) THEN 1 ELSE 0 END) AS BIGINT) AS n_outlier, max(f) AS first_observed, max(l) AS last_observed FROM q GROUP BY series""")
def data_quality_report(spark, sf):
    return G.quality_report(D.slotted(spark, sf), 1.5)


@query("""+ r AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY period DESC) AS k, max(CASE WHEN value IS NOT NULL THEN period END) OVER (PARTITION BY series) AS l FROM slotted)
SELECT series, period, CASE WHEN value IS NOT NULL THEN 1 WHEN l IS NULL OR period > l THEN 3 ELSE 2 END AS code FROM r WHERE k <= 24""")
def data_availability(spark, sf):
    return G.availability(D.slotted(spark, sf))


_ACF = """+ c AS (SELECT series, period, value - avg(value) OVER (PARTITION BY series) AS c FROM panel),
v AS (SELECT series, sum(c * c) AS v, count(c) AS n FROM c GROUP BY 1), l AS (SELECT CAST(unnest(generate_series(1, 10)) AS INTEGER) AS lag),
i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period) AS i FROM c),
a AS (SELECT x.series, lag, sum(x.c * y.c) AS s FROM i x CROSS JOIN l JOIN i y ON y.series = x.series AND y.i = x.i - lag GROUP BY 1, 2) """


@query(_ACF + "SELECT a.series, lag, n, round(s / v, 9) AS acf FROM a JOIN v USING (series)")
def autocorrelation(spark, sf):
    return rounded(G.autocorrelation(D.panel(spark, sf), 10), "acf")


@query(_ACF + "SELECT a.series, any_value(n) AS n, round(any_value(n) * (any_value(n) + 2) * sum((s / v) * (s / v) / (n - lag)), 8) AS q FROM a JOIN v USING (series) GROUP BY 1")
def autocorrelation_ljung_box(spark, sf):
    return rounded(G.ljung_box(D.panel(spark, sf), 10).drop("p_value"), "q", n=8)


@query("""+ c AS (SELECT series, value - avg(value) OVER (PARTITION BY series) AS c FROM panel), m AS (SELECT series, count(c) AS n, avg(c * c) AS m2, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4 FROM c GROUP BY 1),
k AS (SELECT series, n, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) - 3 AS k FROM m)
SELECT series, n, round(s, 8) AS skewness, round(k, 8) AS kurtosis, round(n / 6 * (s * s + k * k / 4), 7) AS statistic, round(exp(-n / 6 * (s * s + k * k / 4) / 2), 8) AS p_value FROM k""")
def jarque_bera(spark, sf):
    return rounded(rounded(G.jarque_bera(D.panel(spark, sf)), "skewness", "kurtosis", "p_value", n=8), "statistic", n=7)


_JBP = """+ c AS (SELECT series, value - avg(value) OVER (PARTITION BY series) AS c FROM panel), m AS (SELECT series, count(c) AS n, avg(c * c) AS m2, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4 FROM c GROUP BY 1),
p AS (SELECT series, 'jb' AS family, exp(-n / 12 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)) AS p FROM m), r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p) """


def _adjusted(name, method, sql):
    def run(spark, sf):
        rows = G.jarque_bera(D.panel(spark, sf)).select("series", F.lit("jb").alias("family"), "p_value")
        return rounded(G.adjust_pvalues(rows, ["family"], method), "p_value", "adjusted", n=8)

    run.__name__ = name
    query(_JBP + f"SELECT series, family, round(p, 8) AS p_value, round(least({sql}, 1.0), 8) AS adjusted FROM r")(run)


_adjusted("adjust_pvalues_bonferroni", "bonferroni", "p * m")
_adjusted("adjust_pvalues_holm", "holm", "max(p * (m - i + 1)) OVER (ORDER BY i)")
_adjusted("adjust_pvalues_bh", "fdr_bh", "min(p * m / i) OVER (ORDER BY i DESC)")

_SIS = "+ g AS (SELECT p.series, corr(p.value, t.value) AS c, count(*) AS n FROM panel p JOIN panel t ON t.period = p.period AND t.series = '1-URGENT' WHERE p.series <> '1-URGENT' AND p.value IS NOT NULL AND t.value IS NOT NULL GROUP BY 1) "


@query(_SIS + "SELECT series, n, round(c, 9) AS correlation, row_number() OVER (ORDER BY abs(c) DESC, series) AS rank FROM g")
def sis_ranking(spark, sf):
    return rounded(S.sis(D.panel(spark, sf), D.TARGET), "correlation")


@query(_SIS + "SELECT series, n, round(c * sqrt((n - 2) / (1 - c * c)), 8) AS t FROM g")
def hard_threshold_tstat(spark, sf):
    return rounded(S.t_statistics(D.panel(spark, sf), D.TARGET), "t", n=8)


@query(_SIS + ", x AS (SELECT 'sis' AS method, series, CASE WHEN series < '5' THEN abs(c) END AS s FROM g), w AS (SELECT *, count(*) OVER () AS n, count(s) OVER () AS k, row_number() OVER (ORDER BY s DESC NULLS LAST, series) AS i FROM x) SELECT method, series, round(1 - (CASE WHEN s IS NOT NULL THEN i ELSE (k + 1 + n) / 2 END - 1) / (n - 1), 9) AS rank_score FROM w")
def rank_scores(spark, sf):
    s = S.sis(D.panel(spark, sf), D.TARGET).select(F.lit("sis").alias("method"), "series", F.when(F.col("series") < "5", F.abs("correlation")).alias("s"))
    return rounded(S.rank_scores(s, "method", "series", "s"), "rank_score")


@query("""+ lg AS (SELECT series, k, period, lag(value, k) OVER (PARTITION BY series, k ORDER BY period) AS v FROM panel, (VALUES (0), (1), (2)) t(k)),
g AS (SELECT l.series, k, abs(corr(l.v, t.value)) AS s FROM lg l JOIN panel t ON t.period = l.period AND t.series = '1-URGENT' WHERE l.series <> '1-URGENT' AND l.v IS NOT NULL AND t.value IS NOT NULL GROUP BY 1, 2)
SELECT series, CAST(k AS INTEGER) AS best_lag, round(s, 9) AS score FROM g QUALIFY row_number() OVER (PARTITION BY series ORDER BY s DESC, k) = 1 ORDER BY score DESC LIMIT 3""")
def preselect_topk(spark, sf):
    """The best lag of each candidate, and the three best candidates."""
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("period")
    p = D.panel(spark, sf)
    y = p.where(F.col("series") == D.TARGET).select("period", F.col("value").alias("y"))
    x = p.where(F.col("series") != D.TARGET).withColumn("_x", F.array(*[F.struct(F.lit(k).alias("k"), F.lag("value", k).over(w).alias("v")) for k in (0, 1, 2)])).select("series", "period", F.explode("_x").alias("_x"))
    j = x.join(y, "period").where("_x.v IS NOT NULL AND y IS NOT NULL")
    g = j.groupBy("series", F.col("_x.k").alias("best_lag")).agg(F.abs(F.corr("_x.v", "y")).alias("score"))
    best = g.withColumn("_r", F.row_number().over(Window.partitionBy("series").orderBy(F.col("score").desc(), "best_lag"))).where("_r = 1").drop("_r")
    return rounded(best, "score").orderBy(F.col("score").desc()).limit(3)


@query("""+ l AS (SELECT model AS spec, 'h' || horizon AS metric, sqrt(avg(error * error)) AS loss FROM err GROUP BY 1, 2), n AS (SELECT *, (rank() OVER (PARTITION BY metric ORDER BY loss) - 1) / 2.0 * CASE metric WHEN 'h1' THEN 0.5 WHEN 'h2' THEN 0.3 ELSE 0.2 END AS x FROM l) SELECT spec, round(sum(x), 9) AS score FROM n GROUP BY 1""")
def search_weighted_score(spark, sf):
    from ..operators import evaluation as E

    losses = E.accuracy(D.forecasts(spark, sf)).select(F.col("model").alias("spec"), F.concat(F.lit("h"), F.col("horizon").cast("string")).alias("metric"), F.col("rmsfe").alias("loss"))
    return rounded(S.weighted_score(losses, {"h1": 0.5, "h2": 0.3, "h3": 0.2}), "score")


@query("SELECT series, CAST(max(CASE WHEN value IS NOT NULL THEN period END) + INTERVAL 1 MONTH AS DATE) AS headline FROM slotted GROUP BY 1")
def headline_period(spark, sf):
    return D.slotted(spark, sf).groupBy("series").agg(F.add_months(F.max(F.when(F.col("value").isNotNull(), F.col("period"))), 1).alias("headline"))


@query("""+ a AS (SELECT series, period, arg_max_null(value, vintage) AS v FROM store WHERE vintage <= DATE '1999-06-15' GROUP BY 1, 2), b AS (SELECT series, period, arg_max_null(value, vintage) AS v FROM store WHERE vintage <= DATE '1999-09-15' GROUP BY 1, 2),
j AS (SELECT coalesce(a.series, b.series) AS series, a.v AS old, b.v AS new FROM a FULL JOIN b ON a.series = b.series AND a.period = b.period WHERE a.v IS DISTINCT FROM b.v)
SELECT series, CAST(sum(CASE WHEN old IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS released, CAST(sum(CASE WHEN old IS NOT NULL AND new IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS revised, CAST(sum(CASE WHEN new IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS removed FROM j GROUP BY 1""")
def snapshot_diff(spark, sf):
    s = D.store(spark, sf)
    c = V.compare(V.as_of(s, "1999-06-15"), V.as_of(s, "1999-09-15"))
    return c.groupBy("series").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("released", "revised", "removed")])


@query("""+ p AS (SELECT series, period, value, lag(value) OVER (PARTITION BY series ORDER BY period) AS l FROM panel),
g AS (SELECT series, regr_slope(value, l) AS slope, regr_intercept(value, l) AS icept, regr_count(value, l) AS n FROM p GROUP BY 1), z AS (SELECT series, arg_max(value, period) AS last FROM panel WHERE value IS NOT NULL GROUP BY 1)
SELECT series, CAST(n AS BIGINT) AS n, round(slope, 9) AS slope, round(icept, 8) AS intercept, round(icept + slope * last, 8) AS h1, round(icept + slope * (icept + slope * last), 8) AS h2 FROM g JOIN z USING (series)""")
def ar1_forecast(spark, sf):
    """AR(1) of every series by its regression moments, and two iterated forecasts."""
    p = D.panel(spark, sf).withColumn("l", F.lag("value").over(P.by()))
    g = p.groupBy("series").agg(F.regr_count("value", "l").alias("n"), F.regr_slope("value", "l").alias("slope"), F.regr_intercept("value", "l").alias("intercept"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("period"))).alias("last"))
    h1 = F.col("intercept") + F.col("slope") * F.col("last")
    g = g.withColumn("h1", h1).withColumn("h2", F.col("intercept") + F.col("slope") * F.col("h1")).drop("last")
    return rounded(rounded(g, "slope"), "intercept", "h1", "h2", n=8)


@query("""+ x AS (SELECT CAST(date_trunc('quarter', period) AS DATE) AS q, avg(value) AS x FROM panel WHERE series = '2-HIGH' GROUP BY 1 HAVING count(value) = 3), y AS (SELECT CAST(date_trunc('quarter', period) AS DATE) AS q, value AS y FROM quarterly)
SELECT regr_count(y, x) AS n, round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 7) AS intercept, round(regr_r2(y, x), 8) AS r2 FROM x JOIN y USING (q)""")
def bridge_ols(spark, sf):
    """A bridge equation: the quarterly total on the quarterly mean of one monthly series."""
    from ..operators import aggregation as A

    x = A.to_lower(D.panel(spark, sf).where(F.col("series") == "2-HIGH"), "M", "Q", "mean").select("period", F.col("value").alias("x"))
    y = D.quarterly(spark, sf).select(C.start_of(F.col("period"), "Q").alias("period"), F.col("value").alias("y"))
    j = x.join(y, "period")
    g = j.agg(F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    return rounded(rounded(g, "slope", "r2", n=8), "intercept", n=7)


@query("SELECT series, round(value, 9) AS last, round(value, 9) AS h1, round(value + (value - f) / (n - 1), 8) AS h1_drift FROM (SELECT series, arg_max(value, period) AS value, arg_min(value, period) AS f, count(*) AS n FROM panel WHERE value IS NOT NULL GROUP BY 1)")
def random_walk_drift(spark, sf):
    p = D.panel(spark, sf).where("value IS NOT NULL")
    g = p.groupBy("series").agg(F.max_by("value", "period").alias("last"), F.min_by("value", "period").alias("f"), F.count("*").alias("n"))
    return g.select("series", F.round("last", 9).alias("last"), F.round("last", 9).alias("h1"), F.round(F.col("last") + (F.col("last") - F.col("f")) / (F.col("n") - 1), 8).alias("h1_drift"))


# Models: grouped maps over blocks of the panel.


def _growth(spark, sf):
    """Monthly growth of all series, with a ragged edge, as one wide block for each key of ``blocks``."""
    p = T.apply(D.slotted(spark, sf).select("series", "period", "value"), "pct")
    return P.pivot(p, D.SERIES).where("period > DATE '1995-01-01'").select("period", *[F.col(f"`{s}`").alias(f"s{i}") for i, s in enumerate(D.SERIES)])


_COLS = [f"s{i}" for i in range(5)]


def _per_block(wide, blocks: list[str], f, schema: str):
    """f(key, block) for each key; every key's task gets the rows of the small wide panel."""
    keyed = wide.withColumn("_k", F.explode(F.array(*[F.lit(b) for b in blocks])))
    return keyed.groupBy("_k").applyInPandas(lambda key, pdf: f(key[0], pdf.sort_values("period").reset_index(drop=True)), schema)


@query()
def bai_ng_criteria(spark, sf):
    def run(key, pdf):
        from driftgauge.operators import factors as X

        z, _, _ = X.standardised(pdf[_COLS].dropna().to_numpy(float))
        return pd.DataFrame(X.bai_ng(z, 4))

    return _per_block(_growth(spark, sf), ["all"], run, "r long, v double, ic1 double, ic2 double, ic3 double, pc1 double, pc2 double, pc3 double")


@query()
def shock_number(spark, sf):
    def run(key, pdf):
        from driftgauge.operators import factors as X

        z, _, _ = X.standardised(pdf[_COLS].dropna().to_numpy(float))
        f, _ = X.principal_components(z, 3)
        q, rows = X.shock_number(f, 1, n=5)
        return pd.DataFrame(rows).assign(chosen=q)

    return _per_block(_growth(spark, sf), ["all"], run, "k long, d1 double, d2 double, bound double, chosen long")


@query()
def lars_order(spark, sf):
    def run(key, pdf):
        from driftgauge.operators import factors as X
        from driftgauge.operators import selection as Y

        z, _, _ = X.standardised(pdf[_COLS].dropna().to_numpy(float))
        order = Y.lars(z[:, 1:], z[:, 0])
        return pd.DataFrame({"place": range(1, len(order) + 1), "series": [D.SERIES[j + 1] for j in order]})

    return _per_block(_growth(spark, sf), ["all"], run, "place long, series string")


@query()
def elastic_net_selection(spark, sf):
    def run(key, pdf):
        from driftgauge.operators import factors as X
        from driftgauge.operators import selection as Y

        z, _, _ = X.standardised(pdf[_COLS].dropna().to_numpy(float))
        return pd.DataFrame({"series": [D.SERIES[j + 1] for j in Y.elastic_net_until(z[:, 1:], z[:, 0], int(key))], "k": int(key)})

    return _per_block(_growth(spark, sf), ["1", "2", "3"], run, "series string, k long")


@query()
def two_step_nowcast(spark, sf):
    """Two-step dynamic factor model at three sizes; each fills the ragged edge."""

    def run(key, pdf):
        from driftgauge.operators import factors as X

        m = X.two_step(pdf[_COLS].to_numpy(float), r=int(key), p=2)
        out = pd.DataFrame(m.common(), columns=D.SERIES).assign(period=pdf["period"], n_factors=int(key))
        return out.melt(["period", "n_factors"], var_name="series", value_name="estimate")[["n_factors", "series", "period", "estimate"]]

    return _per_block(_growth(spark, sf), ["1", "2", "3"], run, "n_factors long, series string, period date, estimate double")


@query()
def em_factor_model(spark, sf):
    """EM for one and two factors: the log-likelihood path, which never falls."""

    def run(key, pdf):
        from driftgauge.operators import factors as X

        path = X.em_dfm(pdf[_COLS].to_numpy(float), r=int(key), p=1)[2]
        return pd.DataFrame({"n_factors": int(key), "iteration": range(len(path)), "loglik": path})

    return _per_block(_growth(spark, sf), ["1", "2"], run, "n_factors long, iteration long, loglik double")


@query()
def kalman_nowcast(spark, sf):
    """Nowcasts of the target's missing months by an EM factor model at several vintages, spread over tasks."""
    grid = [f"1999-{m:02d}-15" for m in (3, 6, 9, 12)] + ["2000-06-15"]
    sched = V.schedule(T.apply(D.panel(spark, sf), "pct"), D.delays(spark))
    cells = sched.where("period > DATE '1995-01-01'").withColumn("vintage", F.explode(F.array(*[F.lit(d).cast("date") for d in grid]))).where("period <= vintage")
    cells = V.release_mask(cells, F.col("vintage")).select("vintage", "series", "period", "value")

    def run(pdf):
        from driftgauge.operators import factors as X

        wide = pdf.pivot(index="period", columns="series", values="value").reindex(columns=D.SERIES)
        x = wide.to_numpy(float)
        model, a, _, mean, std = X.em_dfm(x, r=1, p=1)
        est = a @ model.Z[0] * std[0] + mean[0]
        at = np.isnan(x[:, 0])
        return pd.DataFrame({"vintage": pdf["vintage"].iloc[0], "period": wide.index[at], "nowcast": est[at]})

    return cells.groupBy("vintage").applyInPandas(run, "vintage date, period date, nowcast double")


def _two_vintages(spark, sf):
    s = D.store(spark, sf)
    parts = [V.as_of(s, d).select(F.lit(d).alias("vintage"), "series", "period", "value") for d in ("1999-06-15", "1999-09-15")]
    return parts[0].union(parts[1])


def _news(pdf):
    from driftgauge.operators import factors as X

    months = sorted(pdf["period"].unique())
    old, new = (pdf[pdf["vintage"] == v].pivot(index="period", columns="series", values="value").reindex(index=months, columns=D.SERIES).to_numpy(float) for v in ("1999-06-15", "1999-09-15"))
    z = np.log(old[:-1]), np.log(new[:-1])
    _, mean, std = X.standardised(z[1])
    old, new = (z[0] - mean) / std, (z[1] - mean) / std
    model = X.em_dfm(new, r=1, p=1)[0]
    return months, model, old, new, std[0]


@query()
def news_decomposition(spark, sf):
    """The target's revision between two vintages: removals, revisions and the impact of each release; the residual is 0."""

    def run(pdf):
        from driftgauge.operators import factors as X

        months, model, old, new, scale = _news(pdf)
        n = X.news(model, old, new, len(old) - 1, 0)
        rows = [("old", n["old"]), ("removals", n["removals"]), ("revisions", n["revisions"]), *[(f"{D.SERIES[x['series']]} {pd.Timestamp(months[x['t']]):%Y-%m}", x["impact"]) for x in n["news"]], ("residual", n["residual"]), ("new", n["new"])]
        return pd.DataFrame({"step": range(len(rows)), "item": [r[0] for r in rows], "impact": [float(r[1]) * scale for r in rows]})

    return _two_vintages(spark, sf).groupBy(F.lit(1).alias("_k")).applyInPandas(run, "step long, item string, impact double")


@query()
def level_contributions(spark, sf):
    """What each series adds to the level of the target's estimate; with the constant they sum to it."""

    def run(pdf):
        from driftgauge.operators import statespace as K

        _, model, _, new, scale = _news(pdf)
        const, w = K.weights_on(model, new, len(new) - 1, model.Z[0])
        parts = np.nansum(w * new, 0) * scale
        return pd.DataFrame({"series": ["constant", *D.SERIES], "contribution": [const * scale, *parts]})

    return _two_vintages(spark, sf).groupBy(F.lit(1).alias("_k")).applyInPandas(run, "series string, contribution double")


@query()
def bridge_combination_inverse_mse(spark, sf):
    def run(key, pdf):
        from driftgauge.operators import forecasters as B

        x = pdf[_COLS].dropna().to_numpy(float)
        rows = B.bridge_combination(x[:-1, 0], x[:-1, 1:], x[-1, 1:], weights=key)
        return pd.DataFrame({"scheme": key, "equation": ["+".join(D.SERIES[j + 1] for j in r["columns"]) for r in rows], "prediction": [r["prediction"] for r in rows], "mse": [r["mse"] for r in rows], "weight": [r["weight"] for r in rows]})

    return _per_block(_growth(spark, sf), ["inverse_mse", "equal"], run, "scheme string, equation string, prediction double, mse double, weight double")


@query()
def midas_weights(spark, sf):
    def run(key, pdf):
        from driftgauge.operators import forecasters as B

        x = pdf[_COLS[:2]].dropna().to_numpy(float)
        lags = np.column_stack([x[5 - k : len(x) - k, 1] for k in range(6)])
        b, w, ssr = B.midas(x[5:, 0], lags, key)
        return pd.DataFrame({"kind": key, "lag": range(6), "weight": w, "slope": b[1], "ssr": ssr})

    return _per_block(_growth(spark, sf), ["almon", "beta"], run, "kind string, lag long, weight double, slope double, ssr double")


@query()
def bvar_conditional(spark, sf):
    """Bayesian VAR of log levels: the target's next months given known values of the others, by prior tightness."""

    def run(key, pdf):
        from driftgauge.operators import forecasters as B

        y = np.log(pdf[_COLS].dropna().to_numpy(float))
        known, future = y[:-3], y[-3:].copy()
        future[:, 0] = np.nan
        lam = B.select_tightness(known, 2) if key == "chosen" else float(key)
        path = B.conditional_forecast(known, B.bvar(known, 2, lam), future)
        return pd.DataFrame({"tightness": key, "horizon": [1, 2, 3], "forecast": path[:, 0], "actual": y[-3:, 0]})

    levels = P.pivot(P.truncate(D.panel(spark, sf), None, "2001-06-01"), D.SERIES).select("period", *[F.col(f"`{s}`").alias(f"s{i}") for i, s in enumerate(D.SERIES)])
    return _per_block(levels, ["0.1", "0.5", "chosen"], run, "tightness string, horizon long, forecast double, actual double")


@query()
def block_bootstrap(spark, sf):
    """Moving-block replicates of the target's mean growth; every replicate's seed is its key, so reruns agree."""

    def run(key, pdf):
        x = pdf["s0"].dropna().to_numpy(float)
        rng = np.random.default_rng(int(key))
        n, block = len(x), 6
        at = (rng.integers(0, n - block + 1, -(-n // block))[:, None] + np.arange(block)).ravel()[:n]
        return pd.DataFrame({"replicate": [int(key)], "mean": [x[at].mean()], "std": [x[at].std(ddof=1)]})

    return _per_block(_growth(spark, sf), [str(k) for k in range(20)], run, "replicate long, mean double, std double")


@query()
def loading_stability(spark, sf):
    def run(key, pdf):
        from driftgauge.operators import diagnostics as Y
        from driftgauge.operators import factors as X

        d = pdf[["period", *_COLS]].dropna()
        z, _, _ = X.standardised(d[_COLS].to_numpy(float))
        f, _ = X.principal_components(z, 1)
        rows = [(s, *Y.sup_break(z[:, i], f)) for i, s in enumerate(D.SERIES)]
        return pd.DataFrame({"series": [r[0] for r in rows], "period": [d["period"].iloc[r[1]] for r in rows], "sup_wald": [float(r[2]) for r in rows]})

    return _per_block(_growth(spark, sf), ["all"], run, "series string, period date, sup_wald double")
