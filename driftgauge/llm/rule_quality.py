"""Operator 6, quality classifier: a sparse rule ensemble.

Statistics of a text are Spark columns. On a bounded sample of labelled rows,
boosted shallow trees are grown in numpy; every path from a root to a node is a
rule, a conjunction of comparisons; logistic regression with a lasso penalty gives
most rules no weight. The others are compiled into one Spark column expression, so
scoring is a projection without Python, shuffle or state.

The sample has ``per_class`` ids of each label on average, chosen by a hash of the
id; it is the only thing broadcast or collected, and its bound is that parameter, for
an id counts once for each label, however often ``labels`` or ``docs`` repeat it.

Edge cases: null and empty texts have all statistics 0 and get a score like any
other; labels other than 0 and 1, or null, and null ids aren't learned from; without
labels, or with labels of one class only, every score is the smoothed share of label 1;
of rows with one id the smallest statistics are learned from; a text of any length is
measured whole; an empty table gives none; extra columns, also of the statistics'
names, are kept apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table, text_of
from .sketches import SPLIT

PER_CLASS = 5000
TREES, DEPTH, BINS, SHRINK = 40, 3, 32, 0.3
LASSO = 0.001
THRESHOLD = 0.7

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, True for > and False for <=, threshold)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_statistics(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with a column ``_stats``: the array of statistics, in the order of NAMES. The text column is consumed."""
    kept = [c for c in rows.columns if c != text_col]
    t, w, n = F.col(text_col), F.col("_words"), F.col("_n")
    df = rows.withColumn("_words", F.filter(F.split(t, SPLIT), lambda x: x != F.lit("")))
    df = df.withColumn("_n", F.size(w)).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x != F.lit("")))
    df = df.withColumn("_bare", F.regexp_replace(t, r"\P{L}+", "")).withColumn("_lower", F.lower("_bare"))
    letters = F.length("_bare")
    stats = {
        "log_chars": F.log1p(F.length(t)),
        "log_words": F.log1p(n),
        "word_length": _share(F.length(t).cast("double"), n),
        "distinct_words": _share(F.size(F.array_distinct(w)), n),
        "adjacent_repeats": F.when(n > 1, F.size(F.filter(F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(1))), F.slice(w, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)) / n).otherwise(0.0),
        "letters": _share(letters, F.length(t)),
        "upper": _share(F.length(F.regexp_replace("_bare", r"\P{Lu}+", "")), letters),
        "digits": _share(_without(t, "0123456789"), F.length(t)),
        "symbols": _share(_without(t, "#*$%&<>"), F.length(t)),
        "bars": _share(_without(t, "|"), F.length(t)),
        "marks": _share(_without(t, "!?"), F.length(t)),
        "stops": _share(_without(t, "."), n),
        "words_a_line": _share(n.cast("double"), F.size("_lines")),
        "distinct_lines": _share(F.size(F.array_distinct("_lines")), F.size("_lines")),
    }
    assert list(stats) == NAMES
    return df.select(*kept, F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in stats.values()]).alias("_stats"))


NAMES = ["log_chars", "log_words", "word_length", "distinct_words", "adjacent_repeats", "letters", "upper", "digits", "symbols", "bars", "marks", "stops", "words_a_line", "distinct_lines"]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self, stats: Column) -> Column:
        """The score as a Spark expression over the statistics."""
        total: Column = F.lit(self.intercept)
        for rule, weight in self.rules:
            held = F.lit(True)
            for i, above, at in rule:
                held = held & ((stats[i] > at) if above else (stats[i] <= at))
            total = total + F.when(held, F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{NAMES[i]} {'>' if a else '<='} {t:.4g}" for i, a, t in r) for r, w in self.rules]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, at in rule:
        out &= (x[:, i] > at) if above else (x[:, i] <= at)
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> list[Rule]:
    """Boosted trees of logistic loss; returns the distinct paths to their nodes."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    raw, rules = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        if np.abs(g).mean() < 1e-3:
            break

        def node(at: np.ndarray, path: Rule, g=g, h=h) -> None:
            best, where = 1e-6, None
            if len(path) < depth and len(at) >= 20:
                whole = g[at].sum() ** 2 / (h[at].sum() + 1)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    a, b, n = (np.bincount(binned[at, j], v, len(c) + 1).cumsum()[:-1] for v in (g[at], h[at], np.ones(len(at))))
                    gain = a**2 / (b + 1) + (g[at].sum() - a) ** 2 / (h[at].sum() - b + 1) - whole
                    gain[(n < 5) | (n > len(at) - 5)] = 0
                    if gain.max() > best:
                        best, where = gain.max(), (j, int(gain.argmax()))
            if where is None:
                raw[at] += SHRINK * g[at].sum() / (h[at].sum() + 1)
                return
            j, k = where
            low = binned[at, j] <= k
            for above, part in ((False, at[low]), (True, at[~low])):
                longer = tuple(sorted({*path, (j, above, float(cuts[j][k]))}))
                rules[longer] = None
                node(part, longer)

        node(np.arange(len(y)), ())
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of logistic loss with an L1 penalty, by accelerated proximal gradient."""
    n, m = z.shape
    full = np.hstack([z, np.ones((n, 1))])
    v = np.ones(m + 1)
    for _ in range(20):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(np.linalg.norm(full.T @ (full @ v)))
    w = np.zeros(m + 1)
    w[m] = math.log(y.mean() / (1 - y.mean()))
    look, t = w.copy(), 1.0
    for _ in range(rounds):
        grad = full.T @ (1 / (1 + np.exp(-(full @ look))) - y) / n
        new = look - step * grad
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * penalty, 0)
        t, was = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        look, w = new + (was - 1) / t * (new - w), new
    return float(w[m]), w[:m]


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return RuleModel(math.log(share / (1 - share)), [])
    rules = grow(x, y)
    if not rules:
        return RuleModel(math.log(y.mean() / (1 - y.mean())), [])
    b, w = lasso(np.stack([holds(r, x) for r in rules], 1).astype(np.float64), y)
    return RuleModel(b, [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> RuleModel:
    """Fit on a bounded sample of the labelled rows."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull()).distinct()
    totals = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit("quality sample"), "_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.when(F.col("_y") == 1, min(1.0, per_class / max(1, totals.get(1, 1)))).otherwise(min(1.0, per_class / max(1, totals.get(0, 1))))
    sample = known.where(place < share)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    got = with_statistics(rows, "_text").groupBy("_id", "_y").agg(F.min("_stats").alias("_stats")).toPandas()
    x = np.array(got["_stats"].tolist(), float).reshape(len(got), len(NAMES))
    order = np.lexsort((*x.T, got["_y"].to_numpy())) if len(got) else np.arange(0)  # the fit doesn't depend on the order of rows
    return fit(x[order], got["_y"].to_numpy(float)[order])


def scored(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """(row, score): the input's row as a struct, so that no column name clashes, and its score."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(text_col).alias("_text"))
    return with_statistics(rows, "_text").select("row", model.column(F.col("_stats")).alias("score"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select(F.col("row.doc_id").alias("doc_id"), (fold(F.col("row.doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
