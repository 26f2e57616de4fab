"""What the training-data operators share: tables, the shared folder, crc32 folds."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word definitions here: space and U+0009 to U+000D.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the
    master is local (tests on one machine) a new temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftgauge-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Within it, the shuffle files of a job are deleted when the job has ended, not when the driver collects garbage."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows, unless the session has a setting of its own.

    Texts are long: the default of 10,000 rows is tens of megabytes a batch, several times over, outside of the heap
    and in each worker, and what is once allocated there stays.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and the table survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    small_batches(spark)
    with _shuffles_end(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(spark: SparkSession) -> None:
    """Free what ended jobs broadcast.

    Their relations stay in the executors' memory until the driver's JVM collects its garbage, which a mostly idle
    driver does when it needs memory itself, not when they do. An operator of many jobs asks for it at its end.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            at = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: A key is hot where it holds this part of all rows, so at most as many keys are.
HOT_PART = 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int, spread: list[str], drop: tuple[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Left join of ``left`` with ``right`` on ``key``, in which no task gets a hot key.

    ``right`` has one row for each key, ``n`` of which says how many of the ``total``
    rows of ``left`` have that key. Those of the hot keys, ``HOT_PART`` rows at most,
    are broadcast. Rows of ``left`` that find theirs there go through the exchange of
    the others under a salt from their ``spread`` columns, which matches nothing. Null
    keys match nothing and are dealt likewise. The result has the columns of ``left``
    and ``found``, the row of ``right`` as a struct or null. ``drop`` (name, condition
    on ``found``) sets a column null before the exchange where the condition holds.
    """
    is_hot = F.col(n) * HOT_PART >= F.lit(total)
    values = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    hot = right.where(is_hot).select(F.col(key).alias("_hot_key"), values.alias("_hot"))
    cold = right.where(~is_hot).select(F.col(key).alias("_cold_key"), values.alias("_cold"), F.when(F.col(n) >= 0, F.lit(-1)).cast("long").alias("_cold_salt"))  # no literal: the optimiser would take it out of the keys of the exchange
    rows = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    if drop is not None:
        rows = rows.withColumn(drop[0], F.when(F.col("_hot").isNotNull() & drop[1](F.col("_hot")), F.lit(None)).otherwise(F.col(drop[0])))
    dealt = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    rows = rows.withColumn("_salt", F.when(dealt, F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).otherwise(F.lit(-1)).cast("long"))
    joined = rows.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], F.coalesce("_hot", "_cold").alias("found"))


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_of(col: str = "text") -> Column:
    """The whole text; null is empty, ill-formed UTF-8 is replaced by U+FFFD."""
    return F.make_valid_utf8(F.coalesce(F.col(col), F.lit("")))
