"""Operator 1, token counts with a digest cache.

Texts are keyed by the digest of their normalised content (null is empty,
ill-formed UTF-8 is replaced: nothing else may change, for the count is exact) and
by a digest of the tokenizer's file and version. The keys are joined to the stored
counts; only distinct missing contents are encoded, once each, and appended to the
cache. Counts then reach all rows by a join on the small keys, never on texts.

Scale: a small table of keys (id, digest, length) is written first. The distinct
misses are found with a map-side combine, so a text that a third of all rows repeat
is one row for each map task before the shuffle. In the last join, of some fifty bytes
a document, the counts of hot digests are broadcast (ten thousand rows at most) and
their documents dealt by a salt. The cache is a Parquet table, partitioned by
tokenizer; an append is one committed job, so a lost executor's task is only run
again. Two runs that append the same digest at once do no harm: readers take one row
for each key, and ``compact`` rewrites a cache of many small appends.

Edge cases: null and empty texts have 0 tokens; repeated rows and ties each get
their own row back; a text of any length is one digest and is encoded whole; rows
without id keep their null; empty input gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .common import materialise, scratch, spread_join, table, text_of

JSON, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def read_cache(spark: SparkSession, cache: str, tokenizer_digest: str) -> DataFrame:
    """One row for each content digest of this tokenizer version."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content_digest binary, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer_digest") == tokenizer_digest)
    return rows.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode(json_name: str, ranks_name: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocab.byte_bpe(json_name, ranks_name)
        for b in batches:
            counts = [len(bpe.packed(t)) // 4 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, cache: str, id_col: str = "doc_id", text_col: str = "text", json_name: str = JSON, ranks_name: str | None = RANKS, limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row; the cache holds all their counts afterwards."""
    spark = docs.sparkSession
    key = vocab.tokenizer_digest(vocab.path(json_name))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.select("_id", "_text", F.unhex(F.sha2("_text", 256)).alias("content_digest"))
    keys = materialise(rows.select("_id", "content_digest", F.octet_length("_text").cast("long").alias("n_bytes")), "token-keys")
    distinct = rows.groupBy("content_digest").agg(F.first("_text").alias("_text"))  # before the join, so that copies meet before the shuffle
    misses = distinct.join(read_cache(spark, cache, key).select("content_digest"), "content_digest", "left_anti")
    counted = misses.mapInArrow(_encode(json_name, ranks_name), "content_digest binary, n_tokens long")
    counted.select("content_digest", F.lit(key).alias("tokenizer_digest"), "n_tokens").write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    copies = keys.groupBy("content_digest").agg(F.count("*").alias("copies"))
    counts = materialise(copies.join(read_cache(spark, cache, key), "content_digest"), "token-found")
    found = spread_join(keys, counts, "content_digest", "copies", keys.count(), ["_id"])
    n = F.col("found.n_tokens")
    return found.select(F.col("_id").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def compact(spark: SparkSession, cache: str, out: str) -> None:
    """Write the cache to a new path with one row for each key; the caller puts it in place of the old one."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).groupBy("tokenizer_digest", "content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows.select("content_digest", "tokenizer_digest", "n_tokens").write.partitionBy("tokenizer_digest").parquet(out)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call has a cache of its own, so every text counts as missing once."""
    return token_counts(table(spark, sf_dir, "documents"), scratch(spark, "token-cache"))
