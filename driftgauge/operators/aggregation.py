"""Between frequencies: aggregation to coarser periods and distribution to finer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from .cleaning import fill_linear, weighted_moving_average


def to_lower(panel: DataFrame, base: str, freq: str, how: str | int = "mean", complete: bool = True) -> DataFrame:
    """One value for each native period: mean, sum, first, middle, last, or the value at a position.

    With ``complete`` the observed count must be the calendar's length of the period, not the number of rows there.
    """
    p = panel.select("series", C.native_of(F.col("period"), base, freq).alias("native"), C.position(F.col("period"), base, freq).alias("pos"), C.native_length(F.col("period"), base, freq).alias("len"), "value")
    at = {"first": F.lit(0), "middle": F.floor((F.col("len") - 1) / 2), "last": F.col("len") - 1}.get(how, how if isinstance(how, str) else F.lit(how))
    value = {"mean": F.avg("value"), "sum": F.sum("value")}.get(how) if how in ("mean", "sum") else F.max(F.when(F.col("pos") == at, F.col("value")))
    out = p.groupBy("series", "native").agg(value.alias("value"), F.count("value").alias("n"), F.max("len").alias("len"))
    whole = (F.col("n") == F.col("len")) if complete else F.lit(True)
    return out.select("series", F.col("native").alias("period"), F.when(whole, F.col("value")).alias("value"))


def to_higher(panel: DataFrame, freq: str, base: str, how: str = "end") -> DataFrame:
    """Fine values of coarse ones: at the end, start or middle, repeated, divided, or by straight lines between period ends."""
    n = C.ratio(base, freq)
    fine = panel.select("series", F.col("period").alias("native"), "value", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    fine = fine.withColumn("period", C.shift(F.col("native"), F.col("pos"), base))
    at = {"end": n - 1, "start": 0, "middle": (n - 1) // 2, "linear": n - 1}.get(how)
    value = F.col("value") if how == "repeat" else F.col("value") / n if how == "divide" else F.when(F.col("pos") == at, F.col("value"))
    out = fine.select("series", "period", value.alias("value"))
    return fill_linear(out) if how == "linear" else out


def rolling_to_slots(panel: DataFrame, base: str, freq: str, kind: str = "growth", normalise: bool = True) -> DataFrame:
    """Aggregation weights rolled over the base grid, then the last base period of each native period."""
    p = weighted_moving_average(panel, C.aggregation_weights(kind, C.ratio(base, freq), normalise))
    return p.where(C.is_slot(F.col("period"), base, freq)).withColumn("period", C.native_of(F.col("period"), base, freq))


def calendar_weights(periods: DataFrame, base: str, freq: str) -> DataFrame:
    """Growth weights of every base period by the calendar: (native, period, weight), for lags into the previous native period too."""
    p = periods.select("period", C.native_of(F.col("period"), base, freq).alias("native"), C.position(F.col("period"), base, freq).alias("pos"), C.native_length(F.col("period"), base, freq).alias("len"))
    current = p.select("native", "period", ((F.col("len") - F.col("pos")) / F.col("len")).alias("weight"))
    previous = p.where("pos > 0").select(C.shift(F.col("native"), 1, freq).alias("native"), "period", (F.col("pos") / F.col("len")).alias("weight"))
    return current.union(previous)


def loading_constraints(weights: list[float]) -> list[list[float]]:
    """Rows R of R lambda = 0, which tie a loading's lags to the weights."""
    return [[weights[j] if i == 0 else (-weights[0] if i == j else 0.0) for i in range(len(weights))] for j in range(1, len(weights))]


def lagged(panel: DataFrame, lags: list[int]) -> DataFrame:
    """Copies of each series at lags, named series_lagk (lag 0 keeps the name)."""
    w = Window.partitionBy("series").orderBy("period")
    cols = F.array(*[F.struct(F.lit(k).alias("k"), F.lag("value", k).over(w).alias("v")) for k in lags])
    rows = panel.withColumn("_x", cols).select("series", "period", F.explode("_x").alias("_x"))
    return rows.select(F.when(F.col("_x.k") == 0, F.col("series")).otherwise(F.concat("series", F.lit("_lag"), F.col("_x.k").cast("string"))).alias("series"), "period", F.col("_x.v").alias("value"))
