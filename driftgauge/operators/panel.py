"""Panels in long form: (series, period, value), a DATE for the first day of the period, null for missing.

Scale: panels are aggregates, keyed by series; windows run by series, and every
operator here is a projection, a window by series or a grouped aggregate. The grid
of periods is made by exploding one row for each series, not by a join of all
periods with all series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as C

def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the plan itself: the optimiser knows its size, and so by itself whether to broadcast it."""

    def value(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"DATE '{v}'" if hasattr(v, "isoformat") else repr(v)

    text = ", ".join(f"({', '.join(map(value, r))})" for r in rows)
    names = [c.split()[0] for c in schema.split(",")]
    table = spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(names)})")
    return table.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(",")])


def by():
    """Rows of a series in order."""
    return Window.partitionBy("series").orderBy("period")


def whole():
    """All rows of a series."""
    return Window.partitionBy("series")


def observed(rows: DataFrame, series: Column, day: Column, value: Column, freq: str = "M") -> DataFrame:
    """Aggregate event rows to (series, period, value). ``value`` is an aggregate expression."""
    return rows.groupBy(series.alias("series"), C.start_of(day, freq).alias("period")).agg(value.alias("value"))


def regularise(obs: DataFrame, freq: str = "M") -> DataFrame:
    """All series on one contiguous grid, null where nothing was observed; repeated periods are refused by ``check``."""
    span = obs.agg(F.min("period").alias("_lo"), F.max("period").alias("_hi"))
    step = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "A": "interval 12 months"}[freq]
    grid = obs.select("series").distinct().crossJoin(span).select("series", F.explode(F.expr(f"sequence(_lo, _hi, {step})")).alias("period"))
    return grid.join(obs, ["series", "period"], "left")


def check(panel: DataFrame, base: str, frequencies: dict[str, str]) -> DataFrame:
    """Problems: repeated periods, and coarse values outside of their slot. Empty if the panel is sound."""
    twice = panel.groupBy("series", "period").count().where("count > 1").select("series", "period", F.lit("repeated").alias("problem"))
    freq = _of(frequencies, base)
    bad = F.lit(False)
    for f in set(frequencies.values()) - {base}:
        bad = bad | ((freq == f) & ~C.is_slot(F.col("period"), base, f))
    off = panel.where(F.col("value").isNotNull() & bad).select("series", "period", F.lit("not in its slot").alias("problem"))
    return twice.union(off)


def _of(frequencies: dict[str, str], base: str) -> Column:
    if not frequencies:
        return F.lit(base)
    table = F.create_map(*[F.lit(x) for kv in frequencies.items() for x in kv])
    return F.coalesce(F.element_at(table, F.col("series")), F.lit(base))


def with_slots(panel: DataFrame, base: str = "M", frequencies: dict[str, str] | None = None) -> DataFrame:
    """Adds ``slot``: a value can be there."""
    freq = _of(frequencies or {}, base)
    slot = F.lit(True)
    for f in set((frequencies or {}).values()) - {base}:
        slot = F.when(freq == f, C.is_slot(F.col("period"), base, f)).otherwise(slot)
    return panel.withColumn("slot", slot)


def place_at_period_end(native: DataFrame, base: str, freq: str) -> DataFrame:
    """Native values in the last base period of their native period."""
    return native.withColumn("period", C.start_of(C.end_of(F.col("period"), freq), base))


def masks(panel: DataFrame) -> DataFrame:
    """Adds observed, missing, leading, interior and ragged for panels with ``slot``.

    A series without any value is ragged everywhere and leading nowhere.
    """
    p = panel.withColumn("observed", F.col("value").isNotNull())
    first = F.min(F.when(F.col("observed"), F.col("period"))).over(whole())
    last = F.max(F.when(F.col("observed"), F.col("period"))).over(whole())
    p = p.withColumn("_first", first).withColumn("_last", last)
    missing = F.col("slot") & ~F.col("observed")
    return p.select(
        *panel.columns,
        "observed",
        missing.alias("missing"),
        F.coalesce(missing & (F.col("period") < F.col("_first")), F.lit(False)).alias("leading"),
        F.coalesce(missing & (F.col("period") > F.col("_first")) & (F.col("period") < F.col("_last")), F.lit(False)).alias("interior"),
        (missing & (F.col("_last").isNull() | (F.col("period") > F.col("_last")))).alias("ragged"),
    )


def summary(panel: DataFrame) -> DataFrame:
    """Per series: slots, observations, first and last observed period, share of missing slots."""
    seen = F.col("value").isNotNull()
    return panel.groupBy("series").agg(
        F.sum(F.col("slot").cast("long")).alias("n_slots"),
        F.sum(seen.cast("long")).alias("n_observations"),
        F.min(F.when(seen, F.col("period"))).alias("first_observed"),
        F.max(F.when(seen, F.col("period"))).alias("last_observed"),
        (F.sum((F.col("slot") & ~seen).cast("long")) / F.greatest(F.sum(F.col("slot").cast("long")), F.lit(1))).alias("missing_share"),
    )


def truncate(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of an inclusive range of periods."""
    if start is not None:
        panel = panel.where(F.col("period") >= F.lit(start).cast("date"))
    if end is not None:
        panel = panel.where(F.col("period") <= F.lit(end).cast("date"))
    return panel


def extend(panel: DataFrame, n: int, freq: str = "M") -> DataFrame:
    """n empty base periods after the last one."""
    last = panel.groupBy("series").agg(F.max("period").alias("_p"))
    new = last.select("series", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k"), "_p").select("series", C.shift(F.col("_p"), F.col("_k"), freq).alias("period"), F.lit(None).cast("double").alias("value"))
    return panel.select("series", "period", "value").union(new)


def infer_frequency(panel: DataFrame, base: str = "M", least: int = 2) -> DataFrame:
    """The coarsest frequency of which every observed cell is a period end; the base with fewer than ``least`` values."""
    coarser = [f for f in "AQM" if C.PER_YEAR[f] < C.PER_YEAR[base]]
    seen = panel.where(F.col("value").isNotNull())
    flags = seen.groupBy("series").agg(F.count("*").alias("n"), *[F.min(C.is_slot(F.col("period"), base, f)).alias(f) for f in coarser])
    pick = F.lit(base)
    for f in reversed(coarser):
        pick = F.when(F.col(f), F.lit(f)).otherwise(pick)
    return panel.select("series").distinct().join(flags, "series", "left").select("series", F.when(F.coalesce(F.col("n"), F.lit(0)) >= least, pick).otherwise(base).alias("frequency"))


def standardise_stats(panel: DataFrame) -> DataFrame:
    return panel.groupBy("series").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def standardise(panel: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / sample standard deviation; null where the deviation is 0 or unknown."""
    if stats is None:
        z = (F.col("value") - F.avg("value").over(whole())) / F.nullif(F.stddev_samp("value").over(whole()), F.lit(0.0))
        return panel.withColumn("value", z)
    return panel.join(stats, "series").withColumn("value", (F.col("value") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))).select(panel.columns)


def destandardise(panel: DataFrame, stats: DataFrame) -> DataFrame:
    return panel.join(stats, "series").withColumn("value", F.col("value") * F.col("std") + F.col("mean")).select(panel.columns)


def released_share(panel: DataFrame, native: Column, groups: DataFrame, delays: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Per native period and group (and their total): expected slots, released values and their share.

    groups (series, label) may name a series under several labels; the total counts it once.
    """
    p = panel.where("slot").withColumn("native", native)
    seen = F.col("value").isNotNull()
    if as_of is not None and delays is not None:
        p = p.join(delays, "series")
        seen = seen & (F.date_add(C.end_of(F.col("period"), "M"), F.col("delay")) <= F.lit(as_of).cast("date"))
    per = p.groupBy("native", "series").agg(F.sum(seen.cast("long")).alias("released"), F.count("*").alias("expected"))
    sums = [F.sum("released").alias("released"), F.sum("expected").alias("expected"), F.avg(F.col("released") / F.col("expected")).alias("share")]
    labelled = per.join(groups, "series").groupBy("native", "label").agg(*sums)
    return labelled.union(per.groupBy("native").agg(*sums).select("native", F.lit("total"), "released", "expected", "share"))


def pivot(panel: DataFrame, names: list[str]) -> DataFrame:
    """The wide view: one row for each period, one column for each of the named series."""
    return panel.groupBy("period").pivot("series", names).agg(F.first("value"))


def unpivot(wide: DataFrame, names: list[str]) -> DataFrame:
    return wide.unpivot("period", names, "series", "value")


def equals(a: DataFrame, b: DataFrame, tolerance: float = 1e-12) -> bool:
    """The same cells within the tolerance; missing equals missing."""
    x = a.select("series", "period", F.col("value").alias("x"), F.lit(1).alias("ina"))
    y = b.select("series", "period", F.col("value").alias("y"), F.lit(1).alias("inb"))
    j = x.join(y, ["series", "period"], "full")
    same = F.col("ina").isNotNull() & F.col("inb").isNotNull() & (F.col("x").eqNullSafe(F.col("y")) | (F.abs(F.col("x") - F.col("y")) <= tolerance))
    return j.where(~F.coalesce(same, F.lit(False))).isEmpty()
