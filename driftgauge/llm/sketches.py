"""Operator 4, bottom-k sketches of documents; DataFrame functions only.

A sketch is the sorted array of the k smallest 64-bit hashes of a text's distinct
five-word shingles (fewer words: of the whole sequence). Of two sketches, the k
smallest of their union are a uniform sample of the union of the shingle sets, from
which resemblance, containment and the number of distinct shingles follow. With
fewer than k shingles the sketch is the whole set, and all three are exact.
Sketches of parts merge into that of the whole.

Scale: a sketch is a function of its row. The next document by descending id is found
without a global sort in one task: the order of ids is cut at approximate quantiles
into ranges of some ``RANGE_BYTES`` of text, each is a task of its own, a range's first
row is also sent to the range before it, and a window runs in each range. So each text
is shuffled once. The cuts are the only thing on the driver: ``MAX_RANGES`` at most, and
beyond ``MAX_RANGES * RANGE_BYTES`` of text the ranges grow instead. A range of ids is
not a key, so copies and hot sources don't meet in one; rows without id and rows that
repeat one id are cut by the hash of their text.

Edge cases: ids are whole numbers; null and empty texts have an empty sketch; two empty
sketches are alike (1.0), an empty and another aren't (0.0); rows without id come last
in the order; equal ids (ties) and rows without id are ordered by the hash of their text
and then by text, also in a table without any id; the last row's next is the first; a
single row is its own next; rows equal in id and text are each a row, next to each other;
a text of any length is sketched whole; an empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of

K = 128
WORDS = 5
RANGE_BYTES, MAX_RANGES = 16 << 20, 50_000
#: Rows of the fine ranges, neighbours of which are put together to ranges.
FINE_ROWS = 2_000
_LEAST = -(1 << 63)
SPLIT = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """64-bit hashes of the n-word shingles, with repeats."""
    words = F.filter(F.split(text, SPLIT), lambda w: w != F.lit(""))
    return _let(
        words,
        lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n))))
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>")),
    )


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, n))), 1, k)


def union_sketch(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    u = union_sketch(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / F.size(u))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k."""
    place = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    joint = resemblance(a, b, k) * distinct_shingles(union_sketch(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), joint / distinct_shingles(a, k)))


def merge_sketches(parts: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key. Repeats and ranks beyond k go before the shuffle, so a hot key is k rows for each task."""
    hashes = parts.select(*keys, F.explode(sketch_col).alias("_h")).distinct()
    ranked = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def fingerprint(a: Column) -> Column:
    """The sketch as text: base64 of its hashes, eight bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


Start = tuple[bool, int, int]  # (without id, ~id, least hash of the text)


def _place(id_col: str = "id", text_col: str = "text") -> Column:
    """What rows are ordered by, ascending: descending id, rows without id last, then the hash of the text."""
    missing = F.col(id_col).isNull()
    return F.struct(missing.alias("none"), F.when(missing, F.lit(0).cast("long")).otherwise(F.bitwise_not(F.col(id_col).cast("long"))).alias("o"), F.xxhash64(text_col).alias("h"))


def _literal(starts: list, nested: bool) -> Column:
    kind = "struct<none:boolean,o:bigint,h:bigint>"
    names = ("none", "o", "h")
    rows = [[dict(zip(names, s)) for s in g] for g in starts] if nested else [dict(zip(names, s)) for s in starts]
    text = json.dumps(rows)
    return F.from_json(F.lit(text), f"array<array<{kind}>>" if nested else f"array<{kind}>")


def _within(rows: DataFrame, starts: list[Start]) -> DataFrame:
    """rows, which have ``_k``, with the number of their range and ``_in``, the starts among which it was found: two look-ups in lists as long as the root of their number."""
    wide = math.isqrt(max(0, len(starts) - 1)) + 1
    groups = [starts[i : i + wide] for i in range(0, len(starts), wide)]

    def upto(a: Column) -> Column:
        return F.greatest(F.size(F.filter(a, lambda s: s <= F.col("_k"))), F.lit(1))

    rows = rows.withColumn("_head", upto(_literal([g[0] for g in groups], False)))
    rows = rows.withColumn("_in", F.element_at(_literal(groups, True), F.col("_head")))
    return rows.withColumn("_range", ((F.col("_head") - 1) * wide + upto(F.col("_in")) - 1).cast("int")).drop("_head")


def ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES, fine_rows: int = FINE_ROWS) -> list[Start]:
    """The starts of the ranges, in order; the first is that of the first row."""
    o = F.bitwise_not(F.col("id").cast("long"))
    got = docs.agg(F.count("*").alias("n"), F.min(o).alias("top"), F.count("id").alias("ids")).first()  # ids only are read
    if not got["n"]:
        return []
    m = min(4 * MAX_RANGES, -(-got["ids"] // fine_rows))
    cuts = docs.where("id IS NOT NULL").agg(F.percentile_approx(o, F.lit([i / m for i in range(1, m)]), F.lit(max(10_000, 10 * m)))).first()[0] if m > 1 else []
    fine = [(False, v, _LEAST) for v in sorted({got["top"], *cuts})] if got["ids"] else []
    if got["ids"] < got["n"]:
        fine.append((True, 0, _LEAST))
    keyed = docs.select(_place().alias("_k"), F.octet_length("text").cast("long").alias("bytes"))
    size = {r["_range"]: r["bytes"] for r in _within(keyed, fine).groupBy("_range").agg(F.sum("bytes").alias("bytes")).collect()}
    most = max(range_bytes, sum(size.values()) // MAX_RANGES)
    starts, held = [], most
    large = [i for i in range(len(fine)) if size.get(i, 0) > most]
    for i, start in enumerate(fine):
        if held + size.get(i, 0) > most:
            starts.append(start)
            held = 0
        held += size.get(i, 0)
    if large:  # perhaps one id holds so much: it is cut by the hash of the text
        of = _within(keyed, fine).where(F.col("_range").isin(large)).select("_k.none", "_k.o", "_k.h", "bytes")
        heavy = of.groupBy("none", "o").agg(F.sum("bytes").alias("held")).where(F.col("held") > most)  # at most total / most ids
        slices = of.join(F.broadcast(heavy), ["none", "o"])
        part = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("held") / most))
        found = [(r["none"], r["o"], r["h"]) for r in slices.groupBy("none", "o", part).agg(F.min("h").alias("h")).collect()]
        cut = {s[:2] for s in found}
        starts = [s for s in starts if s[:2] not in cut] + found
    return sorted(starts)


def with_next(docs: DataFrame, added, range_bytes: int = RANGE_BYTES, fine_rows: int = FINE_ROWS) -> DataFrame:
    """docs has id and text. Adds the columns that ``added`` (name -> Column) gives and, as next_*, those of the next row by descending id."""
    starts = ranges(docs.select("id", "text"), range_bytes, fine_rows) or [(False, 0, _LEAST)]
    rows = _within(docs.withColumn("_k", _place()), starts)
    k = F.col("_k")
    first = F.exists("_in", lambda s: (s["none"] == k["none"]) & (s["o"] == k["o"]) & s["h"].isin(F.lit(_LEAST), k["h"]))
    before = F.when(F.col("_range") == 0, F.lit(len(starts) - 1)).otherwise(F.col("_range") - 1)
    no_copy, copy = F.struct(F.col("_range").alias("range"), F.lit(0).alias("copy")), F.struct(before.alias("range"), F.lit(1).alias("copy"))
    rows = rows.withColumn("_at", F.explode(F.when(first, F.array(no_copy, copy)).otherwise(F.array(no_copy))))
    dealt = rows.select(*docs.columns, "_k", F.col("_at.range").alias("_range"), F.col("_at.copy").alias("_copy")).repartitionById(len(starts), F.col("_range"))
    dealt = dealt.withColumns(added)
    w = Window.partitionBy("_range").orderBy("_copy", "_k", "text")
    names = ["text", *added]
    out = dealt.withColumns({f"next_{c}": F.coalesce(F.lead(c).over(w), F.col(c)) for c in names})
    return out.where("_copy = 0").drop("_range", "_copy", "_k")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    rows = with_next(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), {"sketch": sketch(F.col("text"), k)})
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.select("id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("_edited"))
    rows = rows.select("id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("_edited"), k).alias("_other"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("_other")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("_other"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("_other"), k).alias("contained_in_edited"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
