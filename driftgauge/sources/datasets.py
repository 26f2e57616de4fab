"""A folder of datasets: each has a YAML description, a panel and, at will, a legend, release dates and vintages.

Files are checked against the digests that their description gives before they are read.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def sha256_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    return h.hexdigest()


@dataclass
class Dataset:
    name: str
    info: dict
    panel: DataFrame
    legend: DataFrame | None = None
    store: DataFrame | None = None

    def select(self, names: list[str]) -> Dataset:
        keep = F.col("series").isin(*names)
        return Dataset(self.name, self.info, self.panel.where(keep), self.legend and self.legend.where(keep), self.store and self.store.where(keep))


class Catalogue:
    def __init__(self, root: str):
        self.root = root

    def names(self) -> list[str]:
        return sorted(f[:-5] for f in os.listdir(self.root) if f.endswith(".yaml"))

    def info(self, name: str) -> dict:
        import yaml

        with open(os.path.join(self.root, f"{name}.yaml"), encoding="utf-8") as f:
            return yaml.safe_load(f)

    def verify(self, name: str) -> list[str]:
        """Files whose digest isn't the one described."""
        return [f for f, digest in (self.info(name).get("sha256") or {}).items() if sha256_file(os.path.join(self.root, f)) != digest]

    def load(self, spark: SparkSession, name: str) -> Dataset:
        if bad := self.verify(name):
            raise ValueError(f"{name}: files differ from their description: {', '.join(bad)}")
        info = self.info(name)
        at = lambda key: os.path.join(self.root, info[key])
        legend = spark.read.option("header", True).csv(at("legend")) if "legend" in info else None
        store = files.read_store(spark, at("vintages"), "csv") if "vintages" in info else None
        return Dataset(name, info, files.read_wide(spark, at("panel")), legend, store)

    # Typical contents of such a folder, each described by its own YAML file

    def panel(self, spark: SparkSession, name: str, columns: list[str] | None = None, start: str | None = None, end: str | None = None, flag: str | None = None) -> DataFrame:
        """A dataset's panel, of some series, some periods, or the series that a column of its legend marks."""
        d = self.load(spark, name)
        p = d.panel
        if columns is not None:
            unknown = sorted(set(columns) - {r["series"] for r in p.select("series").distinct().collect()})
            if unknown:
                raise ValueError(f"{name} has no series {', '.join(unknown)}")
            p = p.where(F.col("series").isin(*columns))
        if flag is not None:
            if d.legend is None or flag not in d.legend.columns:
                raise ValueError(f"the legend of {name} has no column {flag}")
            p = p.join(d.legend.where(F.lower(F.col(flag).cast("string")).isin("true", "1", "yes")).select("series"), "series", "left_semi")
        p = p if start is None else p.where(F.col("period") >= F.lit(start).cast("date"))
        return p if end is None else p.where(F.col("period") <= F.lit(end).cast("date"))

    def releases(self, spark: SparkSession, name: str) -> DataFrame:
        """(period, date) of the releases that a dataset lists."""
        info = self.info(name)
        raw = spark.read.option("header", True).csv(os.path.join(self.root, info["releases"]))
        return raw.select(files.period_of(F.col("period")).alias("period"), F.col("date").try_cast("date").alias("date"))

    def calendar(self, spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame | None]:
        """Delays (series, delay) of a dataset's legend, and explicit dates (series, period, date) of the series that have its listed releases."""
        legend = self.load(spark, name).legend
        delays = legend.select("series", F.col("delay").try_cast("int").alias("delay"))
        info = self.info(name)
        if "releases" not in info:
            return delays, None
        own = legend.where(F.col("series").isin(*info.get("released", []))).select("series")
        return delays, own.crossJoin(self.releases(spark, name))  # one calendar for the few series that share it

    def vintages(self, spark: SparkSession, name: str, series: list[str] | None = None) -> DataFrame:
        """A dataset's real-time records."""
        store = self.load(spark, name).store
        if store is None:
            raise ValueError(f"{name} has no vintages")
        return store if series is None else store.where(F.col("series").isin(*series))


def read_coded_table(spark: SparkSession, path: str, date_format: str = "M/d/yyyy") -> tuple[DataFrame, dict[str, int]]:
    """A monthly database whose second line holds transform codes (its first column says so), as a panel and the codes."""
    raw = spark.read.option("header", True).csv(path)
    date, *names = raw.columns
    first = raw.where(F.lower(F.trim(F.col(f"`{date}`"))).startswith("transform")).select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in names]).first()
    wide = raw.select(F.try_to_date(F.col(f"`{date}`"), date_format).alias("_d"), *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in names]).where("_d IS NOT NULL")
    panel = wide.select(F.trunc("_d", "month").alias("period"), *[f"`{c}`" for c in names]).unpivot("period", names, "series", "value")
    return panel, {} if first is None else {c: int(first[c]) for c in names if first[c] is not None}
