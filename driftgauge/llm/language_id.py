"""Operator 2, multilingual mixture inference.

A text's letters, lower-cased, become character trigrams over words; each trigram
is hashed to one of 2^15 slots. Every language has a distribution over the slots.
Expectation-maximisation estimates the shares of the languages of which a text is a
mixture, until no share moves by more than ``TOLERANCE``. Nested sets of languages
start with the one that is likeliest alone and add the others by their share of the
whole mixture; a set grows while its log-likelihood gains more than a penalty for the
further language. The predicted language has the largest share in the chosen set; the
score is the share.

The distributions are learned from a bounded sample of labelled rows: at most
``per_language`` distinct rows of each language on average, chosen by a hash of id and
text, so a source that holds a third of all rows, a frequent language, or rows without
id cost no more. The counts are summed by Spark with a map-side combine, and the
model has a bounded size: languages x 2^15 floats.

Edge cases: a null text or one without a letter is ``und`` with score 0; null labels
aren't learned from; without any labelled row every text is ``und``; ties go to the
language that comes first by name; rows equal in id, text and language are learned from
once and predicted each; a text of any length is counted whole; an empty table gives
none; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, small_batches, table, text_of

SLOTS = 1 << 15
PER_LANGUAGE = 1000
#: Log-likelihood that one more language must gain, times the logarithm of the trigram count.
PENALTY = 4.0
#: EM has converged when no share moves by more; its steps shrink, and this many end it in any case.
TOLERANCE, ROUNDS = 1e-4, 1000
_LETTERS = re.compile(r"[^\W\d_]+")
TYPE = "struct<lang_pred:string,score:double,languages:array<string>,shares:array<double>>"


def slots(text: str) -> np.ndarray | None:
    """The hashed trigrams of a text; None if it has no letter."""
    words = _LETTERS.findall(text.lower())
    if not any(map(str.isalpha, words)) and not any(map(str.isalpha, text)):  # a word may hold signs such as a superscript
        return None
    c = np.frombuffer(f"  {' '.join(words)}  ".encode("utf-32-le"), np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 15)


@dataclass
class Model:
    languages: list[str]
    p: np.ndarray  # slot x language
    prior: np.ndarray

    @property
    def learned(self) -> bool:
        """Whether any trigram was counted."""
        return bool(self.languages) and bool(np.ptp(self.p) > 0)

    def infer(self, text: str) -> tuple[str, float, list[str], list[float]]:
        s = slots(text) if self.languages else None
        if s is None:
            return "und", 0.0, [], []
        counts = np.bincount(s, minlength=SLOTS)
        at = np.flatnonzero(counts)
        c = counts[at].astype(np.float64)
        p, n = self.p[at], c.sum()
        best = int(np.argmax(c @ np.log(p)))
        rest = np.argsort(-mixture(p, c, self.prior)[0], kind="stable")
        order = [best, *(k for k in rest.tolist() if k != best)]
        chosen, shares, reached = [best], np.ones(1), -np.inf
        for k in range(1, len(order) + 1):
            own = sorted(order[:k])
            x, likelihood = mixture(p[:, own], c, self.prior[own])
            value = likelihood - PENALTY * np.log(n + 1) * (k - 1)
            if value <= reached:
                break
            chosen, shares, reached = own, x, value
        top = int(np.argmax(shares))
        return self.languages[chosen[top]], float(min(1.0, shares[top])), [self.languages[i] for i in chosen], shares.tolist()


def mixture(p: np.ndarray, c: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares and log-likelihood of a mixture of fixed distributions; the prior weighs as one trigram."""
    share = prior = prior / prior.sum()
    for _ in range(ROUNDS if len(prior) > 1 else 0):
        w = p * share
        new = (c / w.sum(1)) @ w + prior
        new /= new.sum()
        moved = np.abs(new - share).max()
        share = new
        if moved <= TOLERANCE:
            break
    return share, float(c @ np.log(p @ share))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if (s := slots(text)) is not None:
                found.setdefault(lang, np.zeros(SLOTS, np.int64))
                found[lang] += np.bincount(s, minlength=SLOTS)
    for lang, counts in found.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at])], ["lang", "slot", "n"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn the distributions from a bounded sample of the labelled rows."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    totals = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((SLOTS, 0)), np.zeros(0))
    # A row's place in [0, 1) comes from its id and text; each language takes the places below its own share.
    place = F.pmod(F.xxhash64(F.lit("language sample"), F.col(id_col), F.col(text_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    sample = rows.select(F.col(lang_col).alias("lang"), text_of(text_col).alias("text"), place.alias("place")).where(F.col("place") < share[F.col("lang")])
    sample = sample.groupBy("lang", "place").agg(F.first("text").alias("text"))  # copies of one row meet before the shuffle
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    index = {k: i for i, k in enumerate(languages)}
    p = np.full((SLOTS, len(languages)), 0.5)
    p[counts["slot"].to_numpy(), [index[k] for k in counts["lang"].to_pylist()]] += counts["n"].to_numpy()
    prior = np.array([totals[k] for k in languages], float)
    return Model(languages, p / p.sum(0), prior / prior.sum())


def language(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct column: lang_pred, score, languages, shares."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(TYPE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            cols = list(zip(*map(shared.value.infer, b.to_pylist()))) or [()] * 4
            types = pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["lang_pred", "score", "languages", "shares"])

    return run(text_of(text_col))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), language(docs, model).alias("_r")).select("doc_id", "held_out", "_r.*")
