"""Panels, real-time stores and result tables as files."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C


def period_of(text: Column) -> Column:
    """A date from a date or from a text: 2000-01-31, 2000-01, 2000M1, 2000Q1 or 2000; null where it is none of them."""
    t = F.upper(F.trim(text.cast("string")))
    part = lambda i: F.regexp_extract(t, r"^(\d{4})-?([QM]?)-?(\d{1,2})?$", i)
    year, kind, k = part(1), part(2), part(3)
    month = F.when(k == "", F.lit(1)).when(kind == "Q", 3 * k.try_cast("int") - 2).otherwise(k.try_cast("int"))
    short = F.when(year != "", F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01")))
    return F.coalesce(short.try_cast("date"), F.substring(t, 1, 10).try_cast("date"))


def read_wide(spark: SparkSession, path: str, period: str = "period", format: str = "csv", base: str = "M") -> DataFrame:
    """A wide file, one column a series, as a long panel. What isn't a number is missing; periods are dates or texts of dates."""
    raw = spark.read.option("header", True).csv(path) if format == "csv" else spark.read.format(format).load(path)
    names = [c for c in raw.columns if c != period]
    wide = raw.select(C.start_of(period_of(F.col(period)), base).alias("period"), *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in names])
    return wide.unpivot("period", names, "series", "value").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_long(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    schema = "series string, period date, value double"
    return spark.read.schema(schema).option("header", True).csv(path) if format == "csv" else spark.read.schema(schema).format(format).load(path)


def write_panel(panel: DataFrame, path: str, format: str = "parquet") -> None:
    w = panel.select("series", "period", "value").write.mode("overwrite")
    w.option("header", True).csv(path) if format == "csv" else w.format(format).save(path)


STORE = "series string, period date, vintage date, value double"


def write_store(store: DataFrame, path: str, format: str = "parquet") -> None:
    """Records by series, so that a reader of some series prunes the others' folders."""
    rows = store.select("series", "period", "vintage", "value")
    if format == "csv":
        rows.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        rows.write.mode("overwrite").partitionBy("series").format(format).save(path)


def read_store(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    if format == "csv":
        return spark.read.schema(STORE).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    return spark.read.schema(STORE).format(format).load(path).select("series", "period", "vintage", "value")


def join_legend(panel: DataFrame, legend: DataFrame) -> DataFrame:
    """Metadata columns (series, frequency, transform, delay, category, blocks as a;b) beside the values."""
    blocks = F.filter(F.transform(F.split(F.coalesce("blocks", F.lit("")), ";"), F.trim), lambda b: b != F.lit(""))
    return panel.join(legend.withColumn("blocks", blocks), "series", "left")


def combine(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Separate (period, value) series as one panel; equal repeats collapse, others are told apart by ``conflicts``."""
    out = None
    for df, name in zip(parts, names):
        p = df.select(F.lit(name).alias("series"), "period", "value")
        out = p if out is None else out.union(p)
    return out.distinct()


def conflicts(panel: DataFrame) -> DataFrame:
    """Cells with several values."""
    return panel.groupBy("series", "period").agg(F.count_distinct("value").alias("n")).where("n > 1")


def fingerprint(df: DataFrame) -> str:
    """Digest of a frame's rows, whatever their order or partitions."""
    cols = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    got = df.select(row.alias("h")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.sum(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 31))).alias("s")).first()
    return hashlib.sha256(f"{cols}|{got['n']}|{got['x']}|{got['s']}".encode()).hexdigest()


def write_metadata(legend: list[dict], path: str) -> None:
    """Descriptions of series as YAML, in their own order of keys."""
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"series": legend}, f, sort_keys=False, allow_unicode=True)


def read_metadata(path: str) -> list[dict]:
    import yaml

    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f)
    if not isinstance(got, dict) or not all("series" in r or "name" in r for r in got.get("series", [])):
        raise ValueError(f"{path}: a mapping with a list of series, each with a name, is expected")
    return got["series"]


#: Categories of series.
CATEGORIES = ("hard", "soft", "financial", "other")


def check_legend(legend: DataFrame) -> DataFrame:
    """Problems of a legend (series, frequency, category, ...): repeated names, unknown frequencies or categories."""
    twice = legend.groupBy("series").count().where("count > 1").select("series", F.lit("repeated").alias("problem"))
    out = twice
    if "category" in legend.columns:
        out = out.union(legend.where(F.col("category").isNotNull() & ~F.lower("category").isin(*CATEGORIES)).select("series", F.lit("unknown category")))
    if "frequency" in legend.columns:
        known = [a for names in C.ALIASES.values() for a in names]
        out = out.union(legend.where(~F.lower(F.regexp_replace("frequency", "(?i)-[a-z]{3}$", "")).isin(*known)).select("series", F.lit("unknown frequency")))
    return out


def series_by_frequency(legend: DataFrame) -> DataFrame:
    """(frequency, series) with the sorted names of each frequency, finest first."""
    order = F.element_at(F.create_map(*[F.lit(x) for kv in {"D": 0, "W": 1, "M": 2, "Q": 3, "A": 4}.items() for x in kv]), F.col("frequency"))
    return legend.groupBy("frequency").agg(F.sort_array(F.collect_set("series")).alias("series")).orderBy(order)


def with_frequency(legend: DataFrame, frequency: str) -> DataFrame:
    return legend.where(F.col("frequency") == C.parse_frequency(frequency)).select("series")


def block_members(legend: DataFrame) -> DataFrame:
    """(series, block) of a legend whose blocks are joined by semicolons."""
    return legend.select("series", F.explode(F.split("blocks", ";")).alias("block")).select("series", F.trim("block").alias("block")).where("block <> ''").distinct()


def block_matrix(legend: DataFrame, blocks: list[str]) -> DataFrame:
    """A row for each series, a column for each block: true or false."""
    m = block_members(legend)
    return legend.select("series").distinct().join(m, "series", "left").groupBy("series").agg(*[F.coalesce(F.bool_or(F.col("block") == b), F.lit(False)).alias(b) for b in blocks])


def with_data(panel: DataFrame, values: DataFrame) -> DataFrame:
    """The panel's cells and further columns with other values; cells without one are missing."""
    return panel.drop("value").join(values.select("series", "period", "value"), ["series", "period"], "left").select(*panel.columns)


def single_values(rows: DataFrame) -> DataFrame:
    """(series, period, value) with equal repeats collapsed; a cell with several values ends the job with an error."""
    g = rows.groupBy("series", "period").agg(F.max("value").alias("value"), F.count_distinct("value").alias("_n"))
    stop = F.raise_error(F.concat(F.lit("several values: "), "series", F.lit(" "), F.col("period").cast("string")))
    return g.select("series", "period", F.when(F.col("_n") > 1, stop.cast("double")).otherwise(F.col("value")).alias("value"))
