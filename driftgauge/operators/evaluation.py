"""Forecast tables and their evaluation.

A forecast table has (model, vintage, period, horizon, forecast, previous, actual).
Everything is a grouped aggregate over error rows; a common sample is a window
count of models per target, not a join of each pair of models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET = ["vintage", "period"]


def errors(table: DataFrame) -> DataFrame:
    """Adds error = actual - forecast; rows without one are left out."""
    return table.withColumn("error", F.col("actual") - F.col("forecast")).where(F.col("error").isNotNull())


def common_sample(table: DataFrame, models: list[str]) -> DataFrame:
    """Error rows of targets that every one of the models has."""
    e = errors(table).where(F.col("model").isin(*models))
    have = F.size(F.collect_set("model").over(Window.partitionBy(*TARGET)))
    return e.withColumn("_n", have).where(F.col("_n") == len(models)).drop("_n")


def metrics() -> list[Column]:
    e = F.col("error")
    return [
        F.count("*").alias("n"),
        F.avg(e).alias("bias"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmsfe"),
        hits().alias("directional"),
    ]


def hits() -> Column:
    """Share of changes of the right sign; no change counts as wrong."""
    a, f = F.col("actual") - F.col("previous"), F.col("forecast") - F.col("previous")
    return F.avg(F.when(a.isNotNull() & f.isNotNull(), (a * f > 0).cast("double")))


def accuracy(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    return errors(table).groupBy(*(by or ["model", "horizon"])).agg(*metrics())


def sub_periods(table: DataFrame, intervals: dict[str, list[tuple[str | None, str | None]]]) -> DataFrame:
    """Rows labelled by the unions of closed intervals of periods that hold them; a row may have several labels."""
    labels = []
    for name, parts in intervals.items():
        inside = F.lit(False)
        for lo, hi in parts:
            one = F.lit(True)
            if lo:
                one = one & (F.col("period") >= F.lit(lo).cast("date"))
            if hi:
                one = one & (F.col("period") <= F.lit(hi).cast("date"))
            inside = inside | one
        labels.append(F.when(inside, F.lit(name)))
    return table.withColumn("sample", F.explode(F.filter(F.array(*labels), lambda x: x.isNotNull())))


def relative(table: DataFrame, reference: str, models: list[str]) -> DataFrame:
    """RMSFE of each model over the reference's, on their common sample, by horizon."""
    r = common_sample(table, models).groupBy("model", "horizon").agg(F.sqrt(F.avg(F.col("error") ** 2)).alias("rmsfe"))
    base = r.where(F.col("model") == reference).select("horizon", F.col("rmsfe").alias("_b"))
    return r.join(base, "horizon").select("model", "horizon", (F.col("rmsfe") / F.nullif(F.col("_b"), F.lit(0.0))).alias("relative_rmsfe"))


def loss_differentials(table: DataFrame, model: str, reference: str, loss: str = "squared", kind: str = "plain") -> DataFrame:
    """(horizon, vintage, period, d): the reference's loss less the model's; ``clark_west`` adds the squared difference of the forecasts."""
    e = common_sample(table, [model, reference])
    of = lambda name, c: F.max(F.when(F.col("model") == name, F.col(c)))
    p = e.groupBy("horizon", *TARGET).agg(of(reference, "error").alias("a"), of(model, "error").alias("b"))
    l = (lambda c: c * c) if loss == "squared" else F.abs  # noqa: E731, E741
    d = l(F.col("a")) - l(F.col("b"))
    if kind == "clark_west":
        d = F.col("a") ** 2 - F.col("b") ** 2 + (F.col("a") - F.col("b")) ** 2
    return p.select("horizon", *TARGET, d.alias("d"))


def long_run_variance(d: DataFrame) -> DataFrame:
    """Per horizon: n, mean, and the long-run variance with all lags below the horizon; Bartlett weights where the rectangular sum isn't positive."""
    whole, w = Window.partitionBy("horizon"), Window.partitionBy("horizon").orderBy(*TARGET)
    p = d.select("horizon", F.row_number().over(w).alias("i"), (F.col("d") - F.avg("d").over(whole)).alias("c"), F.count("*").over(whole).alias("n"), F.avg("d").over(whole).alias("mean"))
    lags = F.explode(F.sequence(F.lit(0), F.least(F.greatest(F.col("horizon"), F.lit(1)), F.col("n")).cast("int") - 1)).alias("k")
    x = p.select("horizon", "n", "mean", "c", "i", lags).withColumn("j", F.col("i") - F.col("k"))
    y = p.select(F.col("horizon").alias("_h"), F.col("i").alias("_j"), F.col("c").alias("_c"))
    rows = x.join(y, (F.col("horizon") == F.col("_h")) & (F.col("j") == F.col("_j")))
    g = rows.groupBy("horizon", "k", "n", "mean").agg((F.sum(F.col("c") * F.col("_c"))).alias("s")).withColumn("g", F.col("s") / F.col("n"))
    rect = F.sum(F.when(F.col("k") == 0, F.col("g")).otherwise(2 * F.col("g")))
    bart = F.sum(F.when(F.col("k") == 0, F.col("g")).otherwise(2 * (1 - F.col("k") / F.greatest(F.col("horizon"), F.lit(1))) * F.col("g")))
    return g.groupBy("horizon").agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.when(rect > 0, rect).otherwise(bart).alias("lrv"))


def diebold_mariano(table: DataFrame, model: str, reference: str, loss: str = "squared") -> DataFrame:
    """Statistic with the small-sample factor, and its two-sided p-value from Student's t with n - 1 degrees."""
    from ..functions.distributions import t_two_sided

    v = long_run_variance(loss_differentials(table, model, reference, loss))
    n, h = F.col("n"), F.col("horizon")
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    s = v.select("horizon", "n", "mean", (factor * F.col("mean") / F.sqrt(F.nullif(F.col("lrv"), F.lit(0.0)) / n)).alias("statistic"))
    return s.withColumn("p_value", t_two_sided(F.col("statistic"), (n - 1).cast("double")))


def clark_west(table: DataFrame, model: str, reference: str) -> DataFrame:
    """One-sided normal test that the larger model improves on the reference it nests."""
    from ..functions.distributions import normal_upper

    v = long_run_variance(loss_differentials(table, model, reference, kind="clark_west"))
    s = v.select("horizon", "n", "mean", (F.col("mean") / F.sqrt(F.nullif(F.col("lrv"), F.lit(0.0)) / F.col("n"))).alias("statistic"))
    return s.withColumn("p_value", normal_upper(F.col("statistic")))


def giacomini_white(table: DataFrame, model: str, reference: str) -> DataFrame:
    """Conditional predictive ability at horizon 1 with instruments (1, d_{t-1}): n zbar' Omega^-1 zbar, chi-squared with 2 degrees."""
    d = loss_differentials(table, model, reference).where("horizon = 1")
    w = Window.partitionBy("horizon").orderBy(*TARGET)
    z = d.withColumn("_l", F.lag("d").over(w)).where(F.col("_l").isNotNull()).select("horizon", F.col("d").alias("z0"), (F.col("d") * F.col("_l")).alias("z1"))
    m = z.groupBy("horizon").agg(F.count("*").alias("n"), F.avg("z0").alias("a"), F.avg("z1").alias("b"), F.avg(F.col("z0") ** 2).alias("p"), F.avg(F.col("z0") * F.col("z1")).alias("q"), F.avg(F.col("z1") ** 2).alias("r"))
    det = F.col("p") * F.col("r") - F.col("q") ** 2
    stat = F.col("n") * (F.col("a") ** 2 * F.col("r") - 2 * F.col("a") * F.col("b") * F.col("q") + F.col("b") ** 2 * F.col("p")) / F.nullif(det, F.lit(0.0))
    return m.select("horizon", "n", stat.alias("statistic"), F.exp(-stat / 2).alias("p_value"))


def pesaran_timmermann(table: DataFrame) -> DataFrame:
    """Per model and horizon: hit rate, the rate under independence and the statistic with its one-sided normal p-value."""
    from ..functions.distributions import normal_upper

    a, f = F.col("actual") - F.col("previous"), F.col("forecast") - F.col("previous")
    p = errors(table).where(a.isNotNull() & f.isNotNull()).select("model", "horizon", (a > 0).cast("double").alias("y"), (f > 0).cast("double").alias("x"))
    g = p.groupBy("model", "horizon").agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("x")).cast("double")).alias("hit_rate"), F.avg("y").alias("py"), F.avg("x").alias("px"))
    py, px, n = F.col("py"), F.col("px"), F.col("n")
    star = py * px + (1 - py) * (1 - px)
    v = star * (1 - star) / n
    vs = ((2 * py - 1) ** 2 * px * (1 - px) + (2 * px - 1) ** 2 * py * (1 - py)) / n + 4 * py * px * (1 - py) * (1 - px) / (n * n)
    stat = F.when(v - vs > 1e-12 * v, (F.col("hit_rate") - star) / F.sqrt(v - vs))  # a smaller difference is rounding
    return g.select("model", "horizon", "n", "hit_rate", star.alias("expected"), stat.alias("statistic"), normal_upper(stat).alias("p_value"))


def model_confidence_set(losses: DataFrame, models: list[str], alpha: float = 0.1, draws: int = 500, block: int = 4, seed: int = 0) -> DataFrame:
    """(model, p_value, included) by the range-maximum statistic and a circular block bootstrap. losses: one row a target, one column a model.

    Losses are one row for each evaluated target, a table of results and not of data; one task gets them.
    """
    import numpy as np

    def run(pdf):
        x = pdf.sort_values("_o")[models].to_numpy(float)
        n = len(x)
        rng = np.random.default_rng(seed)
        starts = rng.integers(0, n, (draws, -(-n // block)))
        at = ((starts[:, :, None] + np.arange(block)) % n).reshape(draws, -1)[:, :n]
        boot = x[at].mean(1) - x.mean(0)
        alive, p, out = list(range(len(models))), 0.0, {}
        while len(alive) > 1:
            mean, b = x[:, alive].mean(0), boot[:, alive]
            d, db = mean - mean.mean(), b - b.mean(1, keepdims=True)
            sd = np.sqrt((db**2).mean(0))
            sd[sd == 0] = np.inf
            t, tb = d / sd, (db / sd).max(1)
            p = max(p, float((tb >= t.max()).mean()))
            out[models[alive.pop(int(t.argmax()))]] = p
        out[models[alive[0]]] = 1.0
        import pandas as pd

        return pd.DataFrame({"model": list(out), "p_value": list(out.values()), "included": [v >= alpha for v in out.values()]})

    rows = losses.withColumn("_o", F.struct(*TARGET)).select(F.date_format("vintage", "yyyyMMdd").alias("_v"), F.date_format("period", "yyyyMMdd").alias("_p"), *models)
    rows = rows.select(F.concat("_v", "_p").alias("_o"), *models)
    return rows.groupBy(F.lit(1).alias("_all")).applyInPandas(run, "model string, p_value double, included boolean")


def loss_table(table: DataFrame, models: list[str], loss: str = "squared") -> DataFrame:
    """One column of losses for each model, on the common sample."""
    e = common_sample(table, models)
    x = F.col("error") ** 2 if loss == "squared" else F.abs("error")
    return e.groupBy("horizon", *TARGET).agg(*[F.max(F.when(F.col("model") == m, x)).alias(m) for m in models])


def interval_summary(rows: DataFrame, alpha: float, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Per model, or what ``by`` names: coverage, width, interval score, and Christoffersen's tests from hit transitions. rows: model, period, actual, lower, upper."""
    from ..functions.distributions import chi2_upper

    hit = ((F.col("actual") >= F.col("lower")) & (F.col("actual") <= F.col("upper"))).cast("int")
    score = F.col("upper") - F.col("lower") + 2 / alpha * (F.greatest(F.col("lower") - F.col("actual"), F.lit(0.0)) + F.greatest(F.col("actual") - F.col("upper"), F.lit(0.0)))
    p = rows.withColumn("hit", hit).withColumn("was", F.lag(hit).over(Window.partitionBy(*by).orderBy("period")))
    n = lambda a, b: F.sum(((F.col("was") == a) & (F.col("hit") == b)).cast("long"))
    g = p.groupBy(*by).agg(F.count("*").alias("n"), F.sum("hit").alias("n_hits"), F.avg(score).alias("interval_score"), F.avg(F.col("upper") - F.col("lower")).alias("width"), n(0, 0).alias("n00"), n(0, 1).alias("n01"), n(1, 0).alias("n10"), n(1, 1).alias("n11"))
    xlog = lambda k, q: F.when(k > 0, k * F.log(q)).otherwise(0.0)
    k, m = F.col("n_hits"), F.col("n") - F.col("n_hits")
    lr_uc = -2 * (k * F.log(F.lit(1 - alpha)) + m * F.log(F.lit(alpha)) - xlog(k, k / F.col("n")) - xlog(m, m / F.col("n")))
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    p01, p11, pi = n01 / F.nullif(n00 + n01, F.lit(0)), n11 / F.nullif(n10 + n11, F.lit(0)), (n01 + n11) / (n00 + n01 + n10 + n11)
    l0 = xlog(n00 + n10, 1 - pi) + xlog(n01 + n11, pi)
    l1 = xlog(n00, 1 - p01) + xlog(n01, p01) + xlog(n10, 1 - p11) + xlog(n11, p11)
    g = g.withColumn("lr_uc", lr_uc).withColumn("lr_ind", -2 * (l0 - l1))
    return g.select("*", (F.col("lr_uc") + F.col("lr_ind")).alias("lr_cc"), (k / F.col("n")).alias("coverage"), chi2_upper(F.col("lr_uc"), 1).alias("p_uc"))
