"""Specification searches and comparisons: every (specification, vintage) pair is a task.

A search's checkpoint is a Parquet table of finished specifications under a digest of
settings and data, so a rerun evaluates only what is missing.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators.selection import spec_key, weighted_score
from ..sources.files import fingerprint

def evaluate(scheduled: DataFrame, target: str, names: list[str], specs: list[dict], vintages: DataFrame) -> DataFrame:
    """Forecasts of every specification ({method, n_factors, lags, without: [...]}) at every vintage."""
    from .nowcasting import backtest

    models = [{"method": "em", **s, "label": json.dumps(s, sort_keys=True)} for s in specs]
    return backtest(scheduled, target, names, models, vintages).where(F.col("forecast").isNotNull()).select(F.col("model").alias("spec"), "vintage", "period", "horizon", "forecast")


def search(scheduled: DataFrame, target: str, names: list[str], specs: list[dict], vintages: DataFrame, weights: dict[str, float], checkpoint: str | None = None) -> DataFrame:
    """(spec, score), lowest first. weights: of the RMSFE by horizon, keys h1, h2, ...; specifications of a checkpoint aren't evaluated again."""
    spark = scheduled.sparkSession
    done, path = None, None
    if checkpoint:
        mark = hashlib.sha256(f"{target}|{names}|{sorted(weights)}|{fingerprint(scheduled.select('series', 'period', 'value', 'release_date'))}".encode()).hexdigest()[:16]
        path = f"{checkpoint}/{mark}"
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            done = spark.read.schema("spec string, metric string, loss double").parquet(path)
            known = {r["spec"] for r in done.select("spec").distinct().collect()}  # names of specifications
            specs = [s for s in specs if json.dumps(s, sort_keys=True) not in known]
    losses = done
    if specs:
        actual = scheduled.where(F.col("series") == target).select("period", F.col("value").alias("actual"))
        f = evaluate(scheduled, target, names, specs, vintages).join(actual, "period").withColumnRenamed("spec", "model").withColumn("previous", F.lit(None).cast("double"))
        new = E.accuracy(f).select(F.col("model").alias("spec"), F.concat(F.lit("h"), F.col("horizon").cast("string")).alias("metric"), F.col("rmsfe").alias("loss"))
        if path:
            new.write.mode("append").parquet(path)
            new = spark.read.schema("spec string, metric string, loss double").parquet(path)
        losses = new if done is None or path else new.union(done)
    return weighted_score(losses.where(F.col("metric").isin(*weights)), weights, "relative").orderBy("score", "spec")


def without_groups(groups: dict[str, list[str]], base: dict | None = None) -> list[dict]:
    """The base specification, and one without each group of predictors."""
    return [dict(base or {}), *({**(base or {}), "without": sorted(v)} for v in groups.values())]


def comparison(results: DataFrame) -> DataFrame:
    """Per period: base, least, greatest, median and mean forecast over specifications, and their spread."""
    return results.groupBy("vintage", "period").agg(
        F.max(F.when(~F.col("spec").contains("without"), F.col("forecast"))).alias("base"),
        F.min("forecast").alias("least"),
        F.max("forecast").alias("greatest"),
        F.percentile("forecast", 0.5).alias("median"),
        F.avg("forecast").alias("mean"),
        (F.max("forecast") - F.min("forecast")).alias("spread"),
        F.count("*").alias("n_models"),
    )


__all__ = ["comparison", "evaluate", "search", "spec_key", "without_groups"]
