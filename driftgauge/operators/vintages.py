"""Release calendars, as-of views, real-time stores and revisions.

Vintages are a column, not a loop: a panel is exploded over the vintages asked for,
and each as-of view is a grouped latest record. A store is keyed by series and
period, so its windows spread over all cells and none holds a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as C

CELL = ["series", "period"]


def schedule(panel: DataFrame, delays: DataFrame, explicit: DataFrame | None = None, freq: str = "M", observed_only: bool = False) -> DataFrame:
    """Adds ``release_date`` to every slot: an explicit date (series, period, date) or the period's end plus the delay (series, delay)."""
    p = panel.where("slot") if "slot" in panel.columns else panel
    p = p.where(F.col("value").isNotNull()) if observed_only else p
    p = p.join(delays, "series", "left")
    rule = F.date_add(C.end_of(F.col("period"), freq), F.col("delay"))
    if explicit is not None:
        p = p.join(explicit.withColumnRenamed("date", "_date"), CELL, "left")
        rule = F.coalesce(F.col("_date"), rule)
    return p.withColumn("release_date", rule).drop("delay", "_date")


def release_mask(scheduled: DataFrame, vintage: str | Column) -> DataFrame:
    """Pseudo real time: values released after the vintage are missing. The test is inclusive."""
    at = F.lit(vintage).cast("date") if isinstance(vintage, str) else vintage
    return scheduled.withColumn("value", F.when(F.col("release_date") <= at, F.col("value")))


def releases_between(scheduled: DataFrame, start: str, end: str) -> DataFrame:
    """Releases in (start, end]."""
    return scheduled.where((F.col("release_date") > F.lit(start).cast("date")) & (F.col("release_date") <= F.lit(end).cast("date")))


def available_at(scheduled: DataFrame, date: str) -> DataFrame:
    """Last released period of each series."""
    return scheduled.where(F.col("release_date") <= F.lit(date).cast("date")).groupBy("series").agg(F.max("period").alias("last_released"))


def vintage_grid(dates: DataFrame, start: str, end: str, step: int = 1) -> DataFrame:
    """Monthly vintages start, start + step, ... as multiples from the start, so month ends don't drift. dates: any one-row frame."""
    n = F.floor(F.months_between(F.lit(end).cast("date"), F.lit(start).cast("date")) / step).cast("int")
    return dates.select(F.explode(F.sequence(F.lit(0), n)).alias("k")).select(F.add_months(F.lit(start).cast("date"), F.col("k") * step).alias("vintage"))


def at_dates(rows: DataFrame, dates: DataFrame, holds) -> DataFrame:
    """Each row once for every date (``vintage``) for which ``holds`` (Column -> condition) is true.

    The dates, of which every output row has one anyway, travel as one array in one row; rows are exploded where they are.
    """
    one = dates.agg(F.sort_array(F.collect_set("vintage")).alias("_dates"))
    return rows.crossJoin(one).withColumn("vintage", F.explode(F.filter("_dates", holds))).drop("_dates")


def masked_vintages(scheduled: DataFrame, vintages: DataFrame, skip_unchanged: bool = False) -> DataFrame:
    """The panel at every vintage, released values only; ``skip_unchanged`` leaves out vintages without a release since the one before."""
    rows = at_dates(scheduled.where(F.col("value").isNotNull()), vintages, lambda v: F.col("release_date") <= v)
    if skip_unchanged:
        counts = rows.groupBy("vintage").agg(F.count("*").alias("_n"))
        w = Window.orderBy("vintage")
        fresh = counts.withColumn("_b", F.lag("_n").over(w)).where(F.col("_b").isNull() | (F.col("_b") != F.col("_n"))).select("vintage")
        rows = rows.join(fresh, "vintage")
    return rows.select("vintage", "series", "period", "value")


def as_of(store: DataFrame, date: str | Column) -> DataFrame:
    """Latest record of each cell with vintage <= date; a record without value withdraws the cell."""
    at = F.lit(date).cast("date") if isinstance(date, str) else date
    known = store.where(F.col("vintage") <= at).groupBy(*CELL).agg(F.max_by("value", "vintage").alias("value"), F.max("vintage").alias("vintage"))
    return known.where(F.col("value").isNotNull())


def repeated_records(store: DataFrame) -> DataFrame:
    """Records that share series, period and vintage; a sound store has none."""
    return store.groupBy(*CELL, "vintage").count().where("count > 1")


def vintage_matrix(store: DataFrame, series: str) -> DataFrame:
    """(period, vintage, value) of a series, each value carried forward to later vintages of the store."""
    own = store.where(F.col("series") == series)
    until = own.select("period", F.col("vintage").alias("_v"), "value", F.lead("vintage").over(Window.partitionBy("period").orderBy("vintage")).alias("_next"))
    rows = at_dates(until, own.select("vintage").distinct(), lambda v: (v >= F.col("_v")) & (F.col("_next").isNull() | (v < F.col("_next"))))
    return rows.select("period", "vintage", "value")


def revisions(store: DataFrame) -> DataFrame:
    """Records that changed their cell, numbered from 0, with the value before and the revision. A repeated value is none; missing equals missing."""
    w = Window.partitionBy(*CELL).orderBy("vintage")
    p = store.withColumn("_before", F.lag(F.struct("value")).over(w))
    changed = p.where(F.col("_before").isNull() | ~F.col("_before.value").eqNullSafe(F.col("value")))
    return changed.select(*CELL, "vintage", "value", (F.row_number().over(w) - 1).cast("long").alias("release_number"), F.col("_before.value").alias("previous_value"), (F.col("value") - F.col("_before.value")).alias("revision"))


def nth_release(store: DataFrame, n: int) -> DataFrame:
    """The n-th distinct value of each cell, from 0; negative n counts from the last."""
    r = revisions(store).withColumn("_max", F.max("release_number").over(Window.partitionBy(*CELL)))
    return r.where(F.col("release_number") == (F.lit(n) if n >= 0 else F.col("_max") + 1 + n)).select(*CELL, "vintage", "value")


def revision_summary(store: DataFrame, first: int = 0, last: int = -1) -> DataFrame:
    """Per series: periods, revised periods, and mean, mean absolute, root mean square, deviation and largest revision from one release to another, and noise to signal."""
    a = nth_release(store, first).select(*CELL, F.col("value").alias("a"))
    b = nth_release(store, last).select(*CELL, F.col("value").alias("b"))
    d = a.join(b, CELL).withColumn("r", F.col("b") - F.col("a"))
    return d.groupBy("series").agg(
        F.count("r").alias("n_periods"),
        F.sum((F.col("r") != 0).cast("long")).alias("n_revised"),
        F.avg("r").alias("mean_revision"),
        F.avg(F.abs("r")).alias("mean_absolute"),
        F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"),
        F.stddev_samp("r").alias("std_revision"),
        F.max(F.abs("r")).alias("max_absolute"),
        (F.stddev_samp("r") / F.nullif(F.stddev_samp("b"), F.lit(0.0))).alias("noise_to_signal"),
    )


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells that differ between two vintages: released, revised or removed."""
    j = old.select(*CELL, F.col("value").alias("old")).join(new.select(*CELL, F.col("value").alias("new")), CELL, "full")
    kind = F.when(F.col("old").isNull() & F.col("new").isNotNull(), "released").when(F.col("old").isNotNull() & F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "revised")
    return j.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*CELL, "kind", "old", "new", (F.col("new") - F.col("old")).alias("revision"))


def store_from_vintages(wide: DataFrame) -> DataFrame:
    """Records of successive vintages (vintage, series, period, value): unchanged cells are dropped, a cell that disappears is a record without value."""
    order = Window.orderBy("vintage")  # of the vintages, not of their cells
    dates = wide.select("vintage").distinct().select("vintage", F.row_number().over(order).alias("_k"), F.lead("vintage").over(order).alias("_after"))
    w = Window.partitionBy(*CELL).orderBy("_k")
    rows = wide.where(F.col("value").isNotNull()).join(dates, "vintage").withColumn("_was", F.lag(F.struct("_k", "value")).over(w)).withColumn("_then", F.lead("_k").over(w))
    changed = F.col("_was").isNull() | (F.col("_was._k") < F.col("_k") - 1) | (F.col("_was.value") != F.col("value"))
    gone = F.col("_after").isNotNull() & (F.col("_then").isNull() | (F.col("_then") > F.col("_k") + 1))
    record, removal = F.struct("vintage", "value"), F.struct(F.col("_after").alias("vintage"), F.lit(None).cast("double").alias("value"))
    found = F.filter(F.array(F.when(changed, record), F.when(gone, removal)), lambda x: x.isNotNull())
    return rows.select(*CELL, F.explode(found).alias("_x")).select(*CELL, "_x.vintage", "_x.value")


def store_from_calendar(scheduled: DataFrame) -> DataFrame:
    """Final values dated by their release."""
    return scheduled.where(F.col("value").isNotNull()).select(*CELL, F.col("release_date").alias("vintage"), "value")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def with_delays(delays: DataFrame, changes: DataFrame) -> DataFrame:
    """A table of delays with those of ``changes`` in place of its own, and new ones added."""
    c = changes.select("series", F.col("delay").alias("_new"))
    return delays.join(c, "series", "full").select("series", F.coalesce("_new", "delay").alias("delay"))


def coerce_delays(rows: DataFrame, least: int = -366) -> DataFrame:
    """Delays as whole days; a text that is no whole number, or one of a year and more before, ends the job with an error. Missing stays missing."""
    n = F.col("delay").try_cast("double")
    bad = F.col("delay").isNotNull() & (n.isNull() | (n != F.floor(n)) | (n <= least))
    stop = F.raise_error(F.concat(F.lit("no delay in days: "), "series", F.lit(" "), F.col("delay").cast("string")))
    return rows.select("series", F.when(bad, stop.cast("int")).otherwise(n.cast("int")).alias("delay"))


def select_series(store: DataFrame, names: list[str]) -> DataFrame:
    """The records of some series; those of a partitioned store are pruned at the scan."""
    return store.where(F.col("series").isin(*names))


def explicit_releases(series: DataFrame, dates: DataFrame) -> DataFrame:
    """(series, period, date) for a legend (series, calendar) and a calendar's dates (calendar, period, date): series that are published together share a calendar."""
    return series.select("series", "calendar").join(dates, "calendar").select("series", "period", "date")
