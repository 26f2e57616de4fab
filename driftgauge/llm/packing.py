"""Operator 8, bulk-synchronous best-fit packing.

Documents become pieces of at most ``capacity`` tokens. Pieces are sorted by size,
largest first, and placed in supersteps, one for each size class:

1. *Range-sort.* Spark counts the pieces of every size and ranks each piece within
   its size. A size class that holds a third of all pieces is ranked in buckets of a
   hash of the id, whose counts are summed up to offsets, so no task sees a whole class.
2. *Successor sweep.* The class is swept over the open gaps, sorted by size, from the
   smallest gap that is large enough.
3. *Conflicts by rank.* Pieces that want the same gaps get them by rank: as many
   as gaps of that size hold, the others go on to the next larger gap. A gap that
   holds several of a class is filled with them before the next is begun.
4. *Update.* What is left of a gap is a smaller one in the next sweep; pieces that no gap
   holds open new sequences. Repeat with the next size.

Sizes are whole numbers up to the capacity and pieces of one size are alike, so the
sweep works on runs (gap, first sequence, number of sequences) rather than on single
gaps: its state is bounded by the capacity (each class ends with at most two split
runs more), whatever the number of pieces. It is exactly best-fit decreasing. What the
sweeps match is a table of rank intervals; every piece finds its sequence in it by
its size and rank, in one distributed pass. Token ids never leave the worker.

Edge cases: a null or empty text is the end token alone; a piece of full capacity is
a sequence of its own; repeated rows are packed each; an empty table gives none;
extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocab
from .common import materialise, table, text_of
from .token_counts import JSON, RANKS

CAPACITY = 2048
BUCKET_ROWS = 50_000
_PIECE = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, json_name: str = JSON, ranks_name: str | None = RANKS) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece of every document."""
    end = int(end_id).to_bytes(4, "little")
    own = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocab.byte_bpe(json_name, ranks_name)
        for b in batches:
            at: list[int] = []
            cols: list[list[int]] = [[], [], [], []]
            for row, text in enumerate(b.column(1).to_pylist()):
                data = memoryview(bpe.packed(text) + end)
                for k, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                    at.append(row)
                    for c, v in zip(cols, (k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(cols, _PIECE))], [id_col, *(n for n, _ in _PIECE)])

    return docs.select(id_col, text_of(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {own.dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Supersteps over the size classes: (size, first rank, first sequence, offset) of each matched run, and so on to the next."""
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first sequence, number)
    gaps: list[int] = []
    matched: list[tuple[int, int, int, int]] = []
    opened = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            k = bisect.bisect_left(gaps, size)
            if k == len(gaps):
                n = -(-left // (capacity // size))
                free(capacity, opened, n)
                opened += n
                continue
            gap = gaps[k]
            first, n = runs[gap].pop()
            # A gap that holds several is filled before the next one: it is the smallest as soon as it has a piece.
            each = min(gap // size, left)
            take = min(n, left // each)
            if take < n:
                runs[gap].append((first + take, n - take))
            if not runs[gap]:
                del runs[gap], gaps[k]
            for _ in range(each):
                matched.append((size, rank, first, capacity - gap))
                gap, rank, left = gap - size, rank + take, left - take
            free(gap, first, take)
    return matched


def best_fit(items: DataFrame, key_cols: list[str], size_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``items`` with sequence_id and offset. Sizes are 1 to capacity; the key columns, which identify a row, place it in a bucket and order it there."""
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = items.groupBy(F.col(size_col).alias("size")).agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    total = sum(r["n"] for r in sizes)
    plan = sweep({r["size"]: r["n"] for r in sizes}, capacity)
    shift = np.int64(1 << 48)
    order = sorted(plan)
    starts = np.array([s * int(shift) + r for s, r, _, _ in order], np.int64)
    first = np.array([q - r for _, r, q, _ in order], np.int64)
    offset = np.array([o for *_, o in order], np.int64)
    shared = items.sparkSession.sparkContext.broadcast((starts, first, offset))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        starts, first, offset = shared.value
        for size, rank in batches:
            r = rank.to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, size.to_numpy(zero_copy_only=False) * shift + r, "right") - 1
            yield pa.StructArray.from_arrays([pa.array(first[at] + r), pa.array(offset[at])], ["sequence_id", "offset"])

    buckets = max(tasks, -(-total // BUCKET_ROWS))
    rows = items.withColumn("_bucket", F.pmod(F.xxhash64(*key_cols), F.lit(buckets)))
    before = Window.partitionBy(size_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(size_col, "_bucket").agg(F.count("*").alias("_n")).select(size_col, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(size_col, "_bucket").orderBy(*key_cols)).cast("long") - 1)
    placed = ranked.join(offsets, [size_col, "_bucket"]).withColumn("_at", place(F.col(size_col).cast("long"), F.col("_rank") + F.col("_before")))
    return placed.select(*items.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places. The pieces are written to the shared folder first: texts are encoded once.

    Each is written with a number of its own, which tells repeated rows apart and deals them over the buckets.
    """
    cut_up = pieces(docs, id_col, text_col, capacity)
    names = cut_up.columns
    cut_up = materialise(cut_up.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return best_fit(cut_up, [id_col, "piece", "ids_crc32", "_row"], "length", capacity).select(*names, "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
