"""Operator 3, repetition coverage.

Words are runs of characters other than space and U+0009 to U+000D. For each of
several n-gram lengths a polynomial hash of every window of word hashes is rolled
in numpy (modulo 2^64), windows that occur twice or more are marked, and the
characters of the words they cover are summed, first occurrences included. Lines
that equal an earlier one are measured alike. A text is not kept if it fails the
base rules, or if the covered share of its word characters passes a length's limit.

A document is worked on alone, so nothing is shuffled and a hot group costs nothing;
memory is a few arrays as long as the longest text's words.

Edge cases: null and empty texts have no words and fail the base rule; a text with
fewer words than a length has no window of it; ties and repeated rows are
independent; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table, text_of

#: n-gram length -> the largest share of word characters inside repeated n-grams (documented parameters).
LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: The largest share of word characters in lines that repeat an earlier line.
LINE_LIMIT = 0.30
SYMBOLS = "#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES.encode())] = True
FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("dup_line_chars", pa.int64()), ("repeat_chars", pa.list_(pa.int64())), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
TYPE = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,dup_line_chars:long,repeat_chars:array<long>,base_failed:boolean,kept:boolean>"


def _covered(windows: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Mask of words inside windows that occur twice or more."""
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    same = s[1:] == s[:-1]
    edge = np.zeros(n_words + 1, np.int64)
    if same.any():
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = order[twice]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str, limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> tuple:
    data = text.encode()
    words = data.split()  # bytes.split() splits at exactly the six ASCII white-space characters
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    n_dup_lines = dup_line_chars = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                n_dup_lines += 1
                dup_line_chars += len(line) - sum(map(line.count, SPACES))
            elif line.strip(SPACES):
                seen.add(line)
    lengths = sorted({5, *limits})
    repeat_words, covered = 0, [0] * len(lengths)
    if n > lengths[0]:
        ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        rolled, k, chars = ids, 1, None
        for i, length in enumerate(lengths):
            while k < length and len(rolled) > 1:
                rolled = rolled[:-1] * _BASE + ids[k:]
                k += 1
            if k < length or len(rolled) < 2:
                break
            if chars is None:
                s = np.sort(rolled)
                if not (s[1:] == s[:-1]).any():
                    break  # no repeated window, so no longer one either
                chars = _word_chars(data)
            mask = _covered(rolled, length, n)
            covered[i] = int(chars[mask].sum())
            if length == 5:
                repeat_words = int(mask.sum())
    base_failed = n < 10 or 100 * repeat_words > 20 * n
    over = any(covered[i] > limits[x] * word_chars for i, x in enumerate(lengths) if x in limits) or dup_line_chars > line_limit * word_chars
    return n, word_chars, n_symbols, n_dup_lines, repeat_words, dup_line_chars, covered, base_failed, not (base_failed or over)


def _word_chars(data: bytes) -> np.ndarray:
    """Code points of each word: bytes that don't continue a code point."""
    b = np.frombuffer(data, np.uint8)
    space = _IS_SPACE[b]
    inside = np.concatenate(([False], ~space, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    return points[edges[1::2]] - points[edges[::2]]


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """id and one column for each measure; repeat_chars lists the covered characters by n-gram length, ascending."""

    @F.arrow_udf(TYPE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            cols = list(zip(*(measure(t, limits, line_limit) for t in b.to_pylist()))) or [()] * len(FIELDS)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS)], [n for n, _ in FIELDS])

    return docs.select(F.col(id_col), run(text_of(text_col)).alias("_r")).select(id_col, "_r.*")


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    return repetition(table(spark, sf_dir, "documents")).select(*columns)


def _length_sql(n: int) -> tuple[str, str]:
    """Common table expressions that sum the characters and words inside repeated windows of n words."""
    k = f"""k{n} AS (SELECT doc_id, i, word, CASE WHEN i <= n - {n - 1} THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS g FROM w),
f{n} AS (SELECT doc_id, i, word, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS twice FROM k{n}),
c{n} AS (SELECT doc_id, word, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM f{n}),
s{n} AS (SELECT doc_id, sum(CASE WHEN inside = 1 THEN length(word) ELSE 0 END) AS chars{n}, CAST(sum(inside) AS BIGINT) AS words{n} FROM c{n} GROUP BY 1)"""
    return k, f"LEFT JOIN s{n} USING (doc_id)"


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
dup AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, sum((n - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS line_chars FROM l GROUP BY 1),
{", ".join(_length_sql(n)[0] for n in LIMITS)},
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(words5, 0) AS n_repeat_words,
  coalesce(line_chars, 0) AS line_chars, {", ".join(f"coalesce(chars{n}, 0) AS chars{n}" for n in LIMITS)}
  FROM d LEFT JOIN dup USING (doc_id) {" ".join(_length_sql(n)[1] for n in LIMITS)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR line_chars > CAST({LINE_LIMIT} AS DOUBLE) * word_chars OR {" OR ".join(f"chars{n} > CAST({v} AS DOUBLE) * word_chars" for n, v in LIMITS.items())}) AS kept
FROM m
"""
