"""Versioned results: a table of runs and tables by run, in one folder that all executors share."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Snapshots:
    """Result tables of runs. A run becomes visible when its row in ``runs`` is committed, after its tables."""

    spark: SparkSession
    root: str

    def write(self, run: str, created: str, tables: dict[str, DataFrame], settings: dict | None = None) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/tables/{name}/run={run}")
        row = [(run, created, json.dumps(settings or {}, sort_keys=True), sorted(tables))]
        self.spark.createDataFrame(row, "run string, created string, settings string, tables array<string>").write.mode("append").parquet(f"{self.root}/runs")

    def runs(self) -> DataFrame:
        return self.spark.read.schema("run string, created string, settings string, tables array<string>").parquet(f"{self.root}/runs")

    def resolve(self, name: str = "latest") -> str:
        """A run's id from itself, a unique prefix, latest, or latest~k."""
        rows = [r["run"] for r in self.runs().orderBy(F.col("created").desc(), F.col("run").desc()).select("run").collect()]
        if name.startswith("latest"):
            return rows[int(name.partition("~")[2] or 0)]
        found = [r for r in rows if r == name] or [r for r in rows if r.startswith(name)]
        if len(found) != 1:
            raise KeyError(f"{name!r} names {len(found)} runs")
        return found[0]

    def table(self, name: str, run: str = "latest") -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/tables/{name}/run={self.resolve(run)}")

    def history(self, name: str) -> DataFrame:
        """A table of all committed runs, with run and creation time."""
        df = self.spark.read.option("basePath", f"{self.root}/tables/{name}").parquet(f"{self.root}/tables/{name}")
        return df.withColumn("run", F.col("run").cast("string")).join(self.runs().select("run", "created"), "run")

    def diff(self, name: str, keys: list[str], value: str, old: str = "latest~1", new: str = "latest") -> DataFrame:
        a = self.table(name, old).select(*keys, F.col(value).alias("old"))
        b = self.table(name, new).select(*keys, F.col(value).alias("new"))
        return a.join(b, keys, "full").where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", F.col("new") - F.col("old"))
