"""Transforms of series: lags and scalar maths as windows by series on a regular grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panel import by

#: Codes of the common transforms, as lists of steps.
CODES = {0: "level", 1: "pct", 2: "diff", 3: "pct:year|diff", 4: "diff:year|diff", 5: "diff:year", 6: "pct:year", 7: "pct:quarter"}
STEPS = {"level", "log", "diff", "pct", "scale", "dlog"}


def lag_of(word: str, freq: str = "M") -> int:
    """Periods of a lag: a number, or year, quarter, month at the series' frequency."""
    if word.lstrip("-").isdigit():
        return int(word)
    per_year = {"D": 365, "W": 52, "M": 12, "Q": 4, "A": 1}[freq]
    if freq == "D" and word != "year":
        raise ValueError(f"a lag of a {word} isn't whole at frequency D")
    k = per_year / {"year": 1, "quarter": 4, "month": 12}[word]
    if k != int(k) or k < 1:
        raise ValueError(f"a lag of a {word} isn't whole at frequency {freq}")
    return int(k)


def parse(spec: str | int, freq: str = "M") -> list[tuple[str, float]]:
    """Steps of a transform: a code 0 to 7, or step[:argument] joined by |."""
    text = CODES[spec] if isinstance(spec, int) else spec
    steps = []
    for part in text.split("|"):
        name, _, argument = part.partition(":")
        if name == "dlog":
            steps += [("log", 0.0), ("diff", float(lag_of(argument or "1", freq)))]
            continue
        if name not in STEPS:
            raise ValueError(f"unknown transform step: {part!r}")
        steps.append((name, float(argument) if name == "scale" else float(lag_of(argument or "1", freq)) if name in ("diff", "pct") else 0.0))
    return steps


def n_lags(spec: str | int, freq: str = "M") -> int:
    return sum(int(a) for s, a in parse(spec, freq) if s in ("diff", "pct"))


def apply(panel: DataFrame, spec: str | int, freq: str = "M") -> DataFrame:
    """Transform the values. The grid must be regular: a lag counts rows. Logs of non-positive values and a zero base are missing."""
    for name, argument in parse(spec, freq):
        v: Column = F.col("value")
        if name == "log":
            v = F.when(v > 0, F.log(v))
        elif name == "scale":
            v = v * argument
        elif name == "diff":
            v = v - F.lag(v, int(argument)).over(by())
        elif name == "pct":
            base = F.lag(v, int(argument)).over(by())
            v = F.when(base != 0, (v - base) / base)
        panel = panel.withColumn("value", v)
    return panel


def apply_each(panel: DataFrame, specs: dict[str, str | int], freq: str = "M") -> DataFrame:
    """A transform for each series; others stay as they are."""
    parts = [panel.where(~F.col("series").isin(*specs))] if specs else [panel]
    by_spec: dict[str | int, list[str]] = {}
    for series, spec in specs.items():
        by_spec.setdefault(spec, []).append(series)
    parts += [apply(panel.where(F.col("series").isin(*names)), spec, freq) for spec, names in by_spec.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def invert_steps(values: list[float | None], history: list[float | None], steps: list[tuple[str, float]]) -> list[float | None]:
    """Levels of a series from transformed values; known history wins. Pure Python, for grouped maps and tests."""
    if not steps:
        return [h if h is not None else v for v, h in zip(values, history)]
    name, argument = steps[-1]
    before = history
    for s, a in steps[:-1]:
        before = forward(before, s, a)
    k, out = int(argument), []
    for t, (y, h) in enumerate(zip(values, before)):
        if h is not None:
            out.append(h)
        elif y is None:
            out.append(None)
        elif name == "log":
            out.append(math.exp(y))
        elif name == "scale":
            out.append(y / argument)
        elif name in ("diff", "pct"):
            base = out[t - k] if t >= k else None
            out.append(None if base is None else base + y if name == "diff" else base * (1 + y))
        else:
            out.append(y)
    return invert_steps(out, history, steps[:-1])


def forward(x: list[float | None], name: str, argument: float) -> list[float | None]:
    k = int(argument)
    if name == "log":
        return [math.log(v) if v is not None and v > 0 else None for v in x]
    if name == "scale":
        return [None if v is None else v * argument for v in x]
    if name in ("diff", "pct"):
        pairs = [(v, x[t - k] if t >= k else None) for t, v in enumerate(x)]
        if name == "diff":
            return [None if v is None or b is None else v - b for v, b in pairs]
        return [None if v is None or not b else (v - b) / b for v, b in pairs]
    return x


def invert(transformed: DataFrame, history: DataFrame, spec: str | int, freq: str = "M") -> DataFrame:
    """Rebuild levels recursively from the history: where it is missing, x_t = x_{t-k} (+ or *) y_t. One task for each series."""
    steps = parse(spec, freq)
    joined = transformed.select("series", "period", F.col("value").alias("y")).join(history.select("series", "period", F.col("value").alias("h")), ["series", "period"], "left")

    def run(pdf):
        pdf = pdf.sort_values("period")
        clean = lambda c: [None if v is None or v != v else float(v) for v in pdf[c]]
        values = invert_steps(clean("y"), clean("h"), steps)
        return pdf.assign(value=[float("nan") if v is None else v for v in values])[["series", "period", "value"]]

    out = joined.groupBy("series").applyInPandas(run, "series string, period date, value double")
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
