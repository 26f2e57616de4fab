"""Workbooks as panels, where openpyxl is installed. A workbook is read on the driver: it is a small file by its nature."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SHEETS = {"monthly": "M", "quarterly": "Q", "annual": "A"}


def _need() -> None:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("workbooks need openpyxl") from e


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Sheets monthly, quarterly and annual, first column the period: (series, period, value, frequency)."""
    _need()
    parts = []
    for name, sheet in pd.read_excel(path, sheet_name=None).items():
        if (freq := SHEETS.get(name.lower())) is None:
            continue
        long = sheet.rename(columns={sheet.columns[0]: "period"}).melt("period", var_name="series", value_name="value")
        long["value"] = pd.to_numeric(long["value"], errors="coerce")
        long["period"] = pd.to_datetime(long["period"]).dt.date
        parts.append(long.dropna().assign(frequency=freq)[["series", "period", "value", "frequency"]])
    schema = "series string, period date, value double, frequency string"
    return spark.createDataFrame(pd.concat(parts), schema) if parts else spark.createDataFrame([], schema)


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """Result tables as sheets."""
    _need()
    with pd.ExcelWriter(path) as w:
        for name, df in tables.items():
            df.toPandas().to_excel(w, sheet_name=name[:31], index=False)
