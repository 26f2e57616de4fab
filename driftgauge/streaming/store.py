"""Real-time records as a stream.

Records (series, period, vintage, value) arrive late and out of order. The as-of view
is a grouped latest record; revisions need the cell's last value, which is keyed
state of one small row a cell, kept in the state store and restored after a loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import STORE

REVISION = "series string, period date, vintage date, value double, previous_value double, release_number long"


def read_records(spark, path: str, format: str = "parquet", files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(STORE).option("maxFilesPerTrigger", files_a_batch).format(format).load(path)


def latest(records: DataFrame) -> DataFrame:
    """The latest record of each cell; for complete or update output. A record without value withdraws the cell."""
    return records.groupBy("series", "period").agg(F.max_by("value", "vintage").alias("value"), F.max("vintage").alias("vintage"))


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Sums and counts of events by key in windows of event time; rows later than the delay are dropped by the watermark."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("window"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def revisions(records: DataFrame) -> DataFrame:
    """A row for each record that changes its cell. Records of a batch are taken by vintage; one dated before the cell's last is late and changes nothing."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, vintage, value = state.get if state.exists else (-1, None, None)
        rows = pd.concat(list(batches)).sort_values("vintage")
        out = []
        for v, x in zip(rows["vintage"], rows["value"]):
            x, stamp = None if pd.isna(x) else float(x), str(v)
            if vintage is not None and stamp <= vintage:
                continue
            if number < 0 or x != value:
                number += 1
                out.append((*key, v, x, value, number))
            vintage, value = stamp, x
        state.update((number, vintage, value))
        yield pd.DataFrame(out, columns=["series", "period", "vintage", "value", "previous_value", "release_number"])

    return records.groupBy("series", "period").applyInPandasWithState(run, REVISION, "number long, vintage string, value double", "append", GroupStateTimeout.NoTimeout)
