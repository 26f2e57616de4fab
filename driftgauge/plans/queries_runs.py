"""Queries that run whole plans: nowcasts, backtests, streams, snapshots, simulations."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import panel as P
from ..operators import transforms as T
from ..operators import vintages as V
from . import domain as D
from .catalogue import query
from .queries_panel import rounded


def _scheduled_growth(spark, sf):
    return V.schedule(T.apply(D.panel(spark, sf), "pct"), D.delays(spark)).where("period > DATE '1995-01-01'")


@query()
def nowcast_methods(spark, sf):
    """The target's next months by every method, as of one vintage."""
    from .nowcasting import METHODS, backtest

    vintage = D.obs(spark, sf).agg(F.to_date(F.lit("2000-06-15")).alias("vintage"))
    return backtest(_scheduled_growth(spark, sf), D.TARGET, D.SERIES[1:], list(METHODS), vintage).select("model", "vintage", "period", "horizon", "forecast", "actual")


@query()
def pseudo_real_time_backtest(spark, sf):
    """RMSFE by method and horizon over monthly vintages; each vintage and method is a task."""
    from .nowcasting import backtest

    sched = _scheduled_growth(spark, sf)
    grid = V.vintage_grid(sched.agg(F.count("*").alias("n")), "1998-01-15", "1999-12-15", 3)
    table = backtest(sched, D.TARGET, D.SERIES[1:], ["em", "ar", "rw", "bridge"], grid)
    return E.accuracy(table).select("model", "horizon", "n", "rmsfe", "mae", "bias")


@query("+ ch AS (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS k FROM store WINDOW w AS (PARTITION BY series, period ORDER BY vintage)) SELECT series, period, vintage, round(value, 9) AS value, row_number() OVER (PARTITION BY series, period ORDER BY vintage) - 1 AS release_number FROM ch WHERE k = 1 OR before IS DISTINCT FROM value")
def streaming_revisions(spark, sf):
    """Revisions by keyed state over a stream of records, run to its end."""
    return rounded(_stream(spark, sf, "revisions").select("series", "period", "vintage", "value", "release_number"), "value")


@query("SELECT series, period, vintage, round(value, 9) AS value FROM (SELECT series, period, arg_max_null(value, vintage) AS value, max(vintage) AS vintage FROM store GROUP BY 1, 2)")
def streaming_latest(spark, sf):
    return rounded(_stream(spark, sf, "latest").select("series", "period", "vintage", "value"), "value")


def _shared(spark, name):
    """A new folder that the driver and executors share: below spark.checkpoint.dir, or a temporary one in tests."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="driftgauge-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf, kind):
    """The store goes to a folder of files, which a stream reads to its end; its sink is a table in the shared folder."""
    from ..streaming import store as R

    source, sink = _shared(spark, "records"), _shared(spark, "stream")
    D.store(spark, sf).repartition(2).write.parquet(source)
    records = R.read_records(spark, source)
    if kind == "revisions":
        q = R.revisions(records).writeStream.format("parquet").option("path", sink).outputMode("append")
    else:
        q = R.latest(records).writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(sink)).outputMode("complete")
    q.option("checkpointLocation", sink + "-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    """Daily windows of event time: the batch form of the streaming aggregate."""
    e = D.table(spark, sf, "events").select("ts", "event_type", D.money("value").alias("value"))
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("SELECT series, period, round(value, 9) AS value FROM panel")
def panel_round_trip_csv(spark, sf):
    """Written and read back as a wide file."""
    from ..sources import files

    path = _shared(spark, "wide")
    P.pivot(D.panel(spark, sf), D.SERIES).write.option("header", True).csv(path)
    return rounded(files.read_wide(spark, path).select("series", "period", "value"), "value")


@query("SELECT series, period, vintage, round(value, 9) AS value FROM store WHERE series = '5-LOW'")
def store_round_trip(spark, sf):
    """Written by series and read back with its partitions pruned."""
    from ..sources import files

    path = _shared(spark, "store")
    files.write_store(D.store(spark, sf), path)
    return rounded(files.read_store(spark, path).where("series = '5-LOW'"), "value")


@query("+ a AS (SELECT series, avg(value) AS m FROM panel WHERE period < DATE '2000-01-01' GROUP BY 1), b AS (SELECT series, avg(value) AS m FROM panel GROUP BY 1) SELECT series, round(a.m, 9) AS old, round(b.m, 9) AS new, round(b.m - a.m, 9) AS change FROM a JOIN b USING (series) WHERE a.m IS DISTINCT FROM b.m")
def snapshot_history_diff(spark, sf):
    """Two runs' tables in a snapshot folder, compared."""
    from ..sources.snapshots import Snapshots

    store = Snapshots(spark, _shared(spark, "snapshots"))
    p = D.panel(spark, sf)
    for run, rows in (("a1", p.where("period < DATE '2000-01-01'")), ("b2", p)):
        store.write(run, f"2024-01-0{1 + (run == 'b2')}", {"means": rows.groupBy("series").agg(F.avg("value").alias("mean"))})
    return rounded(store.diff("means", ["series"], "mean"), "old", "new", "change")


@query()
def simulated_panels(spark, sf):
    """Mean and deviation of seeded factor panels by replicate."""
    from ..sources.simulate import factor_panels

    return factor_panels(spark, 8).groupBy("replicate", "series").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


@query("""+ p AS (SELECT model, horizon, vintage AS v, period AS p, error AS e FROM err),
g AS (SELECT r.model, r.horizon, r.vintage, r.period, any_value(r.forecast) AS f, any_value(r.actual) AS a, count(*) AS n, quantile_cont(e, 0.1) AS lo, quantile_cont(e, 0.5) AS mid, quantile_cont(e, 0.9) AS hi FROM err r JOIN p ON p.model = r.model AND p.horizon = r.horizon AND v < r.vintage AND p.p <= r.vintage GROUP BY 1, 2, 3, 4)
SELECT model, horizon, vintage, period, round(f, 9) AS forecast, round(a, 9) AS actual, n, round(f + lo, 11) AS q10, round(f + mid, 11) AS q50, round(f + hi, 11) AS q90 FROM g WHERE n >= 8""")
def empirical_bands_by_availability(spark, sf):
    """Bands from errors that were known at each vintage: earlier vintages, periods over by then."""
    from ..operators.density import empirical_bands

    b = empirical_bands(E.errors(D.forecasts(spark, sf)), [0.1, 0.5, 0.9])
    return rounded(rounded(b, "q10", "q50", "q90", n=11), "forecast", "actual")


@query("""+ q AS (SELECT model, t AS level, forecast * (1 + (t - 0.5) / 5) AS q, actual FROM err, (VALUES (0.1), (0.5), (0.9)) v(t))
SELECT model, round(2 * avg((1 - level) * (1 - level) * CASE WHEN actual >= q THEN level * (actual - q) ELSE (1 - level) * (q - actual) END), 9) AS score FROM q GROUP BY 1""")
def weighted_quantile_score(spark, sf):
    from ..operators.density import weighted_quantile_score as score

    e = E.errors(D.forecasts(spark, sf)).withColumn("level", F.explode(F.array(*[F.lit(t) for t in (0.1, 0.5, 0.9)])))
    rows = e.select("model", "level", (F.col("forecast") * (1 + (F.col("level") - 0.5) / 5)).alias("quantile"), "actual")
    return rounded(score(rows, ["model"], "left"), "score")


@query()
def density_tests(spark, sf):
    """Uniformity and independence of probability transforms by model: Kolmogorov-Smirnov and Berkowitz."""
    rows = E.errors(D.forecasts(spark, sf)).where("horizon = 1").select("model", "period", "error")

    def run(pdf):
        import pandas as pd

        from driftgauge.functions.distributions import normal_cdf
        from driftgauge.operators import density as X

        e = pdf.sort_values("period")["error"].to_numpy(float)
        u = X.np.array([normal_cdf((v - e.mean()) / e.std(ddof=1)) for v in e])
        d, p = X.ks_uniformity(u)
        b = X.berkowitz(u)
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "ks": [d], "ks_p": [p], "lr": [b["lr"]], "lr_p": [b["p_value"]]})

    return rows.groupBy("model").applyInPandas(run, "model string, ks double, ks_p double, lr double, lr_p double")


@query()
def density_nowcast(spark, sf):
    """A bootstrapped mixture for the target's next month: each replicate is a task, the mixture is of their summaries."""
    from .queries_models import _COLS, _growth, _per_block

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        from driftgauge.plans.nowcasting import estimate

        x = pdf[_COLS].to_numpy(float)
        rng = np.random.default_rng(int(key))
        rows = ~np.isnan(x).any(1)
        full = x[rows]
        at = (rng.integers(0, len(full) - 6, -(-len(full) // 6))[:, None] + np.arange(6)).ravel()[: len(full)]
        est = estimate(np.vstack([full[at], x[~rows]]), "em")
        return pd.DataFrame({"replicate": [int(key)], "nowcast": [float(est[-1])], "std": [float(np.nanstd(full[at][:, 0], ddof=1))]})

    reps = _per_block(_growth(spark, sf), [str(k) for k in range(12)], run, "replicate long, nowcast double, std double")

    def mix(pdf):
        import pandas as pd

        from driftgauge.operators.density import Mixture

        m = Mixture.bootstrap(pdf["nowcast"].mean(), pdf["nowcast"].to_numpy(), pdf["std"].to_numpy())
        return pd.DataFrame({"quantile": [0.05, 0.16, 0.5, 0.84, 0.95], "value": [m.ppf(q) for q in (0.05, 0.16, 0.5, 0.84, 0.95)]})

    return reps.groupBy(F.lit(1).alias("_k")).applyInPandas(mix, "quantile double, value double")


@query()
def fill_spline(spark, sf):
    """Interior gaps by a not-a-knot cubic spline, one task a series."""
    p = D.panel(spark, sf).withColumn("value", F.when(F.month("period") % 4 != 1, F.col("value")))

    def run(pdf):
        from driftgauge.operators.robust import fill_spline as fill

        pdf = pdf.sort_values("period")
        return pdf.assign(value=fill(pdf["value"].to_numpy(float)))[["series", "period", "value"]]

    out = p.groupBy("series").applyInPandas(run, "series string, period date, value double")
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


@query()
def robust_factor_model(spark, sf):
    """Student-t weights of the cells, by series: the least and the mean."""
    from .queries_models import _COLS, _growth, _per_block

    def run(key, pdf):
        import pandas as pd

        from driftgauge.operators.robust import robust_em

        w = robust_em(pdf[_COLS].to_numpy(float), 1, float(key))[2]
        return pd.DataFrame({"df": float(key), "series": D.SERIES, "least": w.min(0), "mean": w.mean(0)})

    return _per_block(_growth(spark, sf), ["3", "8"], run, "df double, series string, least double, mean double")


@query()
def nowcast_tracker(spark, sf):
    """Quarterly vintages' nowcasts of one month by a factor model and how much each vintage moved them."""
    from pyspark.sql import Window

    from .nowcasting import backtest

    sched = _scheduled_growth(spark, sf)
    grid = V.vintage_grid(sched.agg(F.count("*").alias("n")), "2000-01-15", "2000-06-15")
    t = backtest(sched, D.TARGET, D.SERIES[1:], ["em"], grid, horizon=4)
    w = Window.partitionBy("period").orderBy("vintage")
    return t.where("period = DATE '2000-06-01'").select("vintage", "period", "forecast", (F.col("forecast") - F.lag("forecast").over(w)).alias("change"))


@query()
def alternative_models(spark, sf):
    """The target's nowcast without each predictor in turn, and its range."""
    from .queries_models import _COLS, _growth, _per_block

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        from driftgauge.plans.nowcasting import estimate

        x = pdf[_COLS].to_numpy(float)
        keep = [i for i in range(5) if i != int(key)]
        return pd.DataFrame({"without": ["none" if key == "9" else D.SERIES[int(key)]], "nowcast": [float(estimate(np.ascontiguousarray(x[:, keep]), "em")[-1])]})

    return _per_block(_growth(spark, sf), ["9", "1", "2", "3", "4"], run, "without string, nowcast double")


@query()
def treatments(spark, sf):
    """Nowcasts under treatments of a window of months."""
    from .queries_models import _COLS, _growth, _per_block

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        from driftgauge.operators.robust import treat
        from driftgauge.plans.nowcasting import estimate

        month = pd.to_datetime(pdf["period"])
        window = ((month >= "1999-01-01") & (month <= "1999-06-01")).to_numpy()
        return pd.DataFrame({"treatment": [key], "nowcast": [float(estimate(np.array(treat(pdf[_COLS].to_numpy(float), window, key)), "em")[-1])]})

    return _per_block(_growth(spark, sf), ["none", "mask", "dummy", "outliers"], run, "treatment string, nowcast double")


def _search_inputs(spark, sf):
    sched = _scheduled_growth(spark, sf)
    grid = V.vintage_grid(sched.agg(F.count("*").alias("n")), "1998-01-15", "1999-12-15", 6)
    return sched, grid


@query()
def specification_search(spark, sf):
    """A grid of specifications scored in pseudo real time, from a checkpoint where there is one."""
    from ..operators.selection import ParameterSpace
    from .experiments import search

    sched, grid = _search_inputs(spark, sf)
    specs = ParameterSpace(method=["ar", "rw", "mean"], lags=(1, 2)).grid()
    return search(sched, D.TARGET, D.SERIES[1:], specs, grid, {"h1": 0.6, "h2": 0.4}, _shared(spark, "search"))


@query()
def nowcasts_without_groups(spark, sf):
    """Nowcasts without groups of predictors, and their range."""
    from .experiments import comparison, evaluate, without_groups

    sched, grid = _search_inputs(spark, sf)
    specs = without_groups({"slow": D.SERIES[3:], "fast": D.SERIES[1:3]}, {"method": "em"})
    return comparison(evaluate(sched, D.TARGET, D.SERIES[1:], specs, grid))
