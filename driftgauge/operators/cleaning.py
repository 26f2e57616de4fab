"""Outliers, gaps and panel preparation, as windows by series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import by, whole
from .transforms import apply


def around(window: int):
    """A centred window; an even one leans left."""
    return by().rowsBetween(-(window // 2), (window - 1) // 2)


def outliers(panel: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Adds ``outlier``: further than threshold interquartile ranges from the median. None with under 4 values or no range."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(whole())
    p = panel.withColumn("_q", q).withColumn("_n", F.count("value").over(whole()))
    iqr = F.col("_q")[2] - F.col("_q")[0]
    flag = (F.col("_n") >= 4) & (iqr > 0) & (F.abs(F.col("value") - F.col("_q")[1]) > threshold * iqr)
    return p.select(*panel.columns, F.coalesce(flag, F.lit(False)).alias("outlier"))


def moving_median(panel: DataFrame, window: int = 3) -> DataFrame:
    return panel.withColumn("value", F.percentile("value", 0.5).over(around(window)))


def replace_outliers(panel: DataFrame, threshold: float = 4.0, window: int = 3, replacement: str = "moving_median") -> DataFrame:
    """Outliers become the moving median of the other values (or, where it has none, their median), the median, or missing."""
    p = outliers(panel, threshold).withColumn("_rest", F.when(~F.col("outlier"), F.col("value")))
    overall = F.percentile("_rest", 0.5).over(whole())
    new = {"moving_median": F.coalesce(F.percentile("_rest", 0.5).over(around(window)), overall), "median": overall, "nan": F.lit(None).cast("double")}[replacement]
    p = p.withColumn("_new", new)
    return p.withColumn("value", F.when(F.col("outlier"), F.col("_new")).otherwise(F.col("value"))).select(*panel.columns, "outlier")


def fill_linear(panel: DataFrame) -> DataFrame:
    """Interior gaps by straight lines between their neighbours."""
    at = F.row_number().over(by())
    seen = F.when(F.col("value").isNotNull(), F.struct("_i", "value"))
    p = panel.withColumn("_i", at)
    p = p.withColumn("_a", F.last(seen, True).over(by().rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(seen, True).over(by().rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("_a.value") + (F.col("_b.value") - F.col("_a.value")) * (F.col("_i") - F.col("_a._i")) / (F.col("_b._i") - F.col("_a._i"))
    return p.withColumn("value", F.coalesce("value", line)).select(panel.columns)


def fill_edges(panel: DataFrame, window: int = 3, method: str = "median", ragged: bool = True, leading: bool = False) -> DataFrame:
    """Missing cells after the last (or before the first) value, from the nearest ``window`` values: their median, mean, or the nearest."""
    rank = lambda order: F.row_number().over(Window.partitionBy("series").orderBy(F.col("value").isNull(), order))
    p = panel.withColumn("_late", rank(F.col("period").desc())).withColumn("_early", rank(F.col("period").asc()))
    first = F.min(F.when(F.col("value").isNotNull(), F.col("period"))).over(whole())
    last = F.max(F.when(F.col("value").isNotNull(), F.col("period"))).over(whole())

    def of(rank_col: str):
        near = F.when(F.col("value").isNotNull() & (F.col(rank_col) <= (1 if method == "last" else window)), F.col("value"))
        return (F.avg(near) if method == "mean" else F.percentile(near, 0.5)).over(whole())

    p = p.withColumn("_f", first).withColumn("_l", last).withColumn("_end", of("_late")).withColumn("_start", of("_early"))
    v = F.col("value")
    if ragged:
        v = F.coalesce(v, F.when(F.col("period") > F.col("_l"), F.col("_end")))
    if leading:
        v = F.coalesce(v, F.when(F.col("period") < F.col("_f"), F.col("_start")))
    return p.withColumn("value", v).select(panel.columns)


def fill_nearest_median(panel: DataFrame, window: int = 3) -> DataFrame:
    """Interior gaps by the median of a centred window, widened by two until it holds a value.

    A window that had to be widened holds just the values that the last step reached: the nearer one of those before
    and after the gap or, where they are as near, their mean. So every gap is filled, whatever its length.
    """
    seen = F.when(F.col("value").isNotNull(), F.struct("_i", "value"))
    p = panel.withColumn("_i", F.row_number().over(by()))
    p = p.withColumn("_a", F.last(seen, True).over(by().rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(seen, True).over(by().rowsBetween(0, Window.unboundedFollowing)))
    left, right = F.col("_i") - F.col("_a._i") - window // 2, F.col("_b._i") - F.col("_i") - (window - 1) // 2
    near = F.when(left < right, F.col("_a.value")).when(left > right, F.col("_b.value")).otherwise((F.col("_a.value") + F.col("_b.value")) / 2)
    p = p.withColumn("_new", F.coalesce(F.percentile("value", 0.5).over(around(window)), near))
    inside = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return p.withColumn("value", F.coalesce("value", F.when(inside, F.col("_new")))).select(panel.columns)


def weighted_moving_average(panel: DataFrame, weights: list[float]) -> DataFrame:
    """sum of w_j x_{t-j}, most recent first: missing until the window is full; weights of 0 don't look at their cell."""
    total = None
    for j, w in enumerate(weights):
        if w:
            term = F.lag("value", j).over(by()) * w
            total = term if total is None else total + term
    return panel.withColumn("value", total)


def drop_sparse(panel: DataFrame, most: float = 1 / 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without the series of which a larger share of cells is missing."""
    share = F.avg(F.col("value").isNull().cast("double")).over(whole())
    return panel.withColumn("_m", share).where((F.col("_m") <= most) | F.col("series").isin(*keep)).select(panel.columns)


def prepare(panel: DataFrame, transform: str | int = 0, threshold: float = 4.0, window: int = 3, most_missing: float = 1 / 3, keep: tuple[str, ...] = (), freq: str = "M", fill: bool = True, edges: bool = False) -> DataFrame:
    """Transform, drop sparse series, replace outliers, fill interior gaps and, if asked for, the ragged edge."""
    p = drop_sparse(apply(panel, transform, freq), most_missing, keep)
    p = replace_outliers(p, threshold, window).drop("outlier")
    p = fill_linear(p) if fill else p
    return fill_edges(p, window) if edges else p


def report(panel: DataFrame, transform: str | int = 0, threshold: float = 4.0, most_missing: float = 1 / 3, keep: tuple[str, ...] = (), freq: str = "M") -> DataFrame:
    """What ``prepare`` does to each series: cells, share missing after the transform, whether it is dropped, outliers replaced and interior gaps filled."""
    p = apply(panel, transform, freq)
    p = outliers(p, threshold)
    seen = F.col("value").isNotNull()
    first, last = F.min(F.when(seen, F.col("period"))).over(whole()), F.max(F.when(seen, F.col("period"))).over(whole())
    gap = ~seen & (F.col("period") > first) & (F.col("period") < last)
    p = p.withColumn("_gap", gap)
    g = p.groupBy("series").agg(F.count("*").alias("n"), F.avg((~seen).cast("double")).alias("missing_share"), F.sum(F.col("outlier").cast("long")).alias("n_outliers"), F.sum(F.coalesce(F.col("_gap"), F.lit(False)).cast("long")).alias("n_filled"))
    dropped = (F.col("missing_share") > most_missing) & ~F.col("series").isin(*keep)
    return g.select("series", "n", "missing_share", dropped.alias("dropped"), *[F.when(dropped, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in ("n_outliers", "n_filled")])
