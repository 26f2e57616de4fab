"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of their input, for the rows they keep.
Edge cases are those of the operators; a stage on an empty table returns an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, language_id, packing, rule_quality
from .common import release, table, text_of

#: A text whose leading language has a smaller share has no language of its own.
LEAST_SHARE = 0.4
#: Near duplicates: five-word shingles, similarity 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def whole_row(docs: DataFrame) -> Column:
    """The row as a struct, so that no name of a further column clashes."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language: texts without a letter, or without a leading language, go.

    A model that learned nothing (no row has a lang, or none of those a letter) can't tell: all rows stay.
    """
    release(spark)
    model = language_id.train(docs)
    if not model.learned:
        return docs
    found = docs.select(whole_row(docs), language_id.language(docs, model).alias("found"))
    return found.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_SHARE)).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on labelled rows of this input, scores at its threshold or above.

    A model that learned nothing (no label meets a row, or those of one class only, or
    no rule tells the classes apart) gives every row one score: all rows stay.
    """
    release(spark)
    model = rule_quality.train(docs, table(spark, sf_dir, "labels"))
    if not model.rules:
        return docs
    return rule_quality.scored(docs, model).where(F.col("score") >= rule_quality.THRESHOLD).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, that with the smallest id; texts without words stay.

    A row is known by its id and the digest of its text, whatever ``docs`` is read from
    and however often; of rows equal in both, which are linked, one stays. Such rows meet
    before the exchange, so not even a third of all rows alike is a hot key. Rows without
    id come last in their group, in order of their digests.
    """
    rows = docs.select(whole_row(docs), text_of("text").alias("text"), F.col("doc_id").alias("id"))
    key = F.struct(F.col("id").isNull().alias("none"), "id", F.unhex(F.md5("text")).alias("digest")).alias("key")
    worded = F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    keyed = rows.where(worded).select("row", "text", key)
    found = jaccard_join.jaccard_components(keyed.select("key", "text"), "key", "text", NEAR_WORDS, NEAR_PERCENT)
    kept = found.where(F.col("component_id") == F.col("key")).select("key").distinct()
    once = keyed.groupBy("key").agg(F.first("row").alias("row"))
    return once.join(kept, "key", "left_semi").select("row.*").unionByName(rows.where(~worded).select("row.*"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens and their places in sequences."""
    release(spark)
    return packing.pack(docs)
