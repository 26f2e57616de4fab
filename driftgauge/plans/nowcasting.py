"""One-call nowcasts and pseudo real-time backtests.

The plan: cells are scheduled, exploded over the vintages asked for and masked by
their release date in one pass of relational operators; each vintage's block is then
a small panel that one grouped map estimates, by all models asked for. More vintages
are more groups. Vintages between two refits share a group, for they share parameters.

A quarterly series of a monthly panel has its values in the third months. A quarterly
target is estimated at its own frequency, or by models that know how it aggregates.
What can't be estimated is missing, with a note that says why; a block never fails for
a series that has no value yet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formula import resolve
from ..operators import vintages as V

METHODS = ("em", "two_step", "ar", "rw", "mean", "bridge", "bvar")
#: A series with fewer values isn't used.
LEAST = 8


@dataclass
class Estimate:
    """The target on every row asked for, its deviation where the method has one, what to say about it, and the fitted model."""

    values: np.ndarray
    std: np.ndarray
    note: str | None = None
    model: object = None


def quarterly_columns(x: np.ndarray, months: np.ndarray) -> np.ndarray:
    """Series with several values, all of them in third months of quarters."""
    seen = ~np.isnan(x)
    return (seen.sum(0) >= 3) & ~seen[months % 3 != 0].any(0)


def quarterly_means(x: np.ndarray, months: np.ndarray) -> np.ndarray:
    """In each third month the mean of the quarter's months, missing where one of them is."""
    out = np.full(x.shape, np.nan)
    for t in np.flatnonzero(months % 3 == 0):
        if t >= 2:
            out[t] = x[t - 2 : t + 1].mean(0)
    return out


def estimate(x: np.ndarray, method: str, n_factors: int = 1, lags: int = 1, horizon: int = 1, quarterly: np.ndarray | None = None) -> np.ndarray:
    """Column 0 of the panel, estimated on all rows and ``horizon`` more. Missing cells are NaN."""
    n = len(x) + horizon
    months = np.arange(1, n + 1)
    q = np.zeros(x.shape[1], bool) if quarterly is None else quarterly
    return estimate_block(np.vstack([x, np.full((horizon, x.shape[1]), np.nan)]), months, method, q, n_factors=n_factors, lags=lags).values


def estimate_block(x: np.ndarray, months: np.ndarray, method: str, quarterly: np.ndarray, n_factors: int = 1, lags: int = 1, max_iter: int = 500, tolerance: float = 1e-4, idiosyncratic: str = "white", names: list[str] | None = None, blocks: dict[str, list[str]] | None = None, trends: tuple[str, ...] = (), fitted: object = None) -> Estimate:
    """Estimate column 0 of a block on all its rows; ``months`` are those of the rows, 1 to 12 or running. ``fitted``: a model whose parameters are kept.

    For ``em``, ``blocks`` are the groups of series that have factors of their own (a series may be in several) and ``trends``
    the series with a slow mean; both go by ``names``, those of the columns. Series that aren't used are left out of them.
    """
    from ..operators import mixed

    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    nothing = np.full(len(x), np.nan)
    count = (~np.isnan(x)).sum(0)
    if count[0] < LEAST:
        return Estimate(nothing, nothing, f"the target has {count[0]} values, fewer than {LEAST}")
    spread = np.array([np.nanstd(c) if n else 0.0 for c, n in zip(x.T, count)])
    use = (count >= LEAST) & (spread > 0)
    use[0] = True
    note = f"without {int((~use).sum())} series of fewer than {LEAST} values or no variation" if not use.all() else None
    x, quarterly = x[:, use], quarterly[use]
    kept = [n for n, u in zip(names or map(str, range(len(use))), use) if u]
    loads = np.array([[n in b for b in blocks.values()] for n in kept]) if blocks else np.ones((len(kept), 1), bool)
    loads = loads[:, loads.any(0)]
    try:
        if method == "em":
            same = isinstance(fitted, mixed.Results) and fitted.layout.n == x.shape[1]
            m = fitted.update(x) if same else mixed.fit(x, [min(n_factors, int(k)) for k in loads.sum(0)], lags, quarterly, loads, idiosyncratic, tuple(i for i, n in enumerate(kept) if n in trends), max_iter=max_iter, tolerance=tolerance)
            return Estimate(m.fitted()[:, 0], m.deviations()[:, 0], note, m)
        if method in ("ar", "rw", "mean"):
            return Estimate(_alone(x[:, 0], months, method, bool(quarterly[0]), lags), nothing, note)
        if x.shape[1] == 1:
            return Estimate(nothing, nothing, "no other series to estimate from")
        by = {"two_step": _two_step, "bridge": _bridge, "bvar": _bvar}[method]
        return Estimate(by(x, months, quarterly, n_factors, lags), nothing, note)
    except (ValueError, np.linalg.LinAlgError, IndexError) as e:
        return Estimate(nothing, nothing, f"{method}: {e}")


def _check_names(names: list[str], options: dict) -> None:
    """Blocks and slow means name series that are there."""
    unknown = {*options.get("trends", ()), *(n for b in (options.get("blocks") or {}).values() for n in b)} - {*names}
    if unknown:
        raise ValueError(f"blocks or trends name unknown series: {sorted(unknown)}")


def _alone(y: np.ndarray, months: np.ndarray, method: str, quarterly: bool, lags: int) -> np.ndarray:
    """A univariate forecast at the series' own frequency, placed in its slots."""
    from ..operators import forecasters as B

    slots = np.flatnonzero(months % 3 == 0) if quarterly else np.arange(len(y))
    own = y[slots]
    last = int(np.flatnonzero(~np.isnan(own)).max())
    seen, ahead = own[: last + 1], len(own) - 1 - last
    f = {"ar": lambda: B.ar_forecast(seen, ahead, lags), "rw": lambda: B.random_walk(seen, ahead), "mean": lambda: B.historical_mean(seen, ahead)}[method]()
    out = np.full(len(y), np.nan)
    out[slots] = np.concatenate([seen, f])
    return out


def _completed(x: np.ndarray, lags: int) -> np.ndarray:
    """Monthly series, each extended after its last value by its own autoregression."""
    from ..operators import forecasters as B

    out = x.copy()
    for j in range(x.shape[1]):
        end = int(np.flatnonzero(~np.isnan(x[:, j])).max())
        if end + 1 < len(x):
            out[end + 1 :, j] = B.ar_forecast(x[: end + 1, j], len(x) - 1 - end, lags)
    return out


def _regressed(y: np.ndarray, X: np.ndarray) -> np.ndarray:
    """y where it is known, else its regression on X with a constant."""
    from ..operators import forecasters as B

    out = y.copy()
    for t in np.flatnonzero(np.isnan(y) & ~np.isnan(X).any(1)):
        out[t] = B.bridge(y, X, X[t])["prediction"]
    return out


def _bridge(x, months, quarterly, n_factors, lags):
    monthly = _completed(x[:, 1:][:, ~quarterly[1:]], lags)
    return _regressed(x[:, 0], quarterly_means(monthly, months) if quarterly[0] else monthly)


def _two_step(x, months, quarterly, n_factors, lags):
    from ..operators import factors as X

    if not quarterly[0] and not quarterly[1:].any():
        return X.two_step(x, min(n_factors, x.shape[1]), lags).common()[:, 0]
    monthly = x[:, ~quarterly] if not quarterly[0] else x[:, 1:][:, ~quarterly[1:]]
    f = X.two_step(monthly, min(n_factors, monthly.shape[1]), lags).factors
    return _regressed(x[:, 0], quarterly_means(f, months) if quarterly[0] else f)


def _bvar(x, months, quarterly, n_factors, lags):
    from ..operators import blocked
    from ..operators import forecasters as B

    if quarterly.any():
        first = int(np.flatnonzero(months % 3 == 1)[0])  # quarters begin with their first month
        m = blocked.fit_blocked(x[first:], ~quarterly, lags=max(1, lags))
        return np.concatenate([np.full(first, np.nan), m.months()[: len(x) - first, 0]])
    last = int(np.flatnonzero(~np.isnan(x[:, 0])).max())
    known = x[: last + 1]
    known = known[~np.isnan(known).any(1)]
    if len(known) < LEAST + lags:
        raise ValueError(f"{len(known)} complete rows are too few")
    return np.concatenate([x[: last + 1, 0], B.conditional_forecast(known, B.bvar(known, max(1, lags)), x[last + 1 :])[:, 0]])


def _wide(pdf: pd.DataFrame, target: str, names: list[str], horizon: int, window: int | None = None) -> tuple[pd.DataFrame, np.ndarray]:
    """Months x series from the first to the last month, and on until ``horizon`` periods of the target are beyond the last."""
    wide = pdf.pivot(index="period", columns="series", values="value").reindex(columns=[target, *names]).astype(float)
    wide.index = pd.PeriodIndex(pd.to_datetime(wide.index), freq="M")
    first, last = wide.index.min(), wide.index.max()
    months = np.array([p.month for p in pd.period_range(first, last, freq="M")])
    wide = wide.reindex(pd.period_range(first, last, freq="M"))
    quarterly = quarterly_columns(wide.to_numpy(float), months)
    end = last + horizon if not quarterly[0] else last + (-last.month) % 3 + 3 * (horizon - (1 if last.month % 3 else 0))
    wide = wide.reindex(pd.period_range(first if window is None else max(first, last - window + 1), max(end, last), freq="M"))
    return wide, quarterly


def _frame(wide: pd.DataFrame, quarterly: np.ndarray, target: str, e: Estimate) -> pd.DataFrame:
    months = np.array([p.month for p in wide.index])
    observed = wide[target].to_numpy(float)
    slot = months % 3 == 0 if quarterly[0] else np.ones(len(wide), bool)
    seen = ~np.isnan(observed)
    return pd.DataFrame({"period": wide.index.to_timestamp().date, "observed": observed, "in_sample": np.where(seen & slot, e.values, np.nan), "out_of_sample": np.where(seen | ~slot, np.nan, e.values), "std": np.where(slot, e.std, np.nan), "note": e.note})[slot]


SCHEMA = "vintage date, period date, observed double, in_sample double, out_of_sample double, std double, note string"


def _clean(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c, t in df.dtypes if t == "double"})


def nowcast(panel: DataFrame, target: str, method: str = "em", vintage: str = "2100-01-01", names: list[str] | None = None, horizon: int = 1, **options) -> DataFrame:
    """(vintage, period, observed, in_sample, out_of_sample, std, note) of the target, given by name or formula, in its own periods."""
    names = names or sorted(r["series"] for r in panel.select("series").distinct().collect())  # the names of one block's series
    y, xs = resolve(target, names)
    _check_names([y, *xs], options)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide, quarterly = _wide(pdf, y, xs, horizon)
        e = estimate_block(wide.to_numpy(float), np.array([p.month for p in wide.index]), method, quarterly, names=[y, *xs], **options)
        return _frame(wide, quarterly, y, e).assign(vintage=pdf["vintage"].iloc[0])[[c.split()[0] for c in SCHEMA.split(", ")]]

    rows = panel.where(F.col("series").isin(y, *xs)).select(F.lit(vintage).cast("date").alias("vintage"), "series", "period", "value")
    return _clean(rows.groupBy("vintage").applyInPandas(run, SCHEMA))


def first_nowcast(results: DataFrame, period: str | None = None) -> DataFrame:
    """The estimate of one period; by default of the first after the last observed one."""
    if period is not None:
        return results.where(F.col("period") == F.lit(period).cast("date"))
    last = F.max(F.when(F.col("observed").isNotNull(), F.col("period"))).over(Window.partitionBy("vintage"))
    later = results.withColumn("_l", last).where(F.col("_l").isNull() | (F.col("period") > F.col("_l")))
    return later.withColumn("_r", F.row_number().over(Window.partitionBy("vintage").orderBy("period"))).where("_r = 1").drop("_l", "_r")


def add_density(results: DataFrame, std: Column | None = None, levels: tuple[float, ...] = (0.68, 0.9)) -> DataFrame:
    """Bands about the estimates outside of the sample, from the deviation of the model or another one."""
    from ..functions.distributions import normal_ppf

    s = F.col("std") if std is None else std
    bands = [(f"{side}_{round(100 * q)}", F.col("out_of_sample") + sign * normal_ppf((1 + q) / 2) * s) for q in levels for side, sign in (("lower", -1), ("upper", 1))]
    return results.withColumn("std", s).withColumns(dict(bands))


def default_periods(results: DataFrame) -> DataFrame:
    """Periods that a density can be given for: outside of the sample, with a deviation."""
    return results.where("out_of_sample IS NOT NULL AND std > 0").select("vintage", "period")


def save_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)


def load_results(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    found = spark.read.parquet(path)
    missing = [c.split()[0] for c in schema.split(", ") if c.split()[0] not in found.columns]
    if missing:
        raise ValueError(f"{path} is no table of results: without {', '.join(missing)}")
    return found


def in_sample_metrics(results: DataFrame) -> DataFrame:
    """Root mean square and mean absolute error and R2 of the estimates within the sample, by vintage."""
    e = F.col("observed") - F.col("in_sample")
    rows = results.where("observed IS NOT NULL AND in_sample IS NOT NULL")
    return rows.groupBy("vintage").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop("observed") * F.count("observed"), F.lit(0.0))).alias("r2"))


def select_n_factors(x: np.ndarray, rmax: int = 8, criterion: str = "ic2") -> int:
    """By an information criterion on the complete rows; one at least."""
    from ..operators import factors as X

    full = x[~np.isnan(x).any(1)]
    full = full[:, full.std(0) > 0]
    if min(full.shape) < 3:
        return 1
    z, _, _ = X.standardised(full)
    rows = X.bai_ng(z, min(rmax, min(z.shape) - 1))
    return max(1, min(rows, key=lambda r: r[criterion])["r"])


TABLE = "model string, vintage date, period date, horizon long, forecast double, std double, previous double, before double, note string"


def backtest(scheduled: DataFrame, target: str, names: list[str], methods: list, vintages: DataFrame, horizon: int = 1, refit_every: int = 1, window: int | None = None, **options) -> DataFrame:
    """A forecast table of every model at every vintage.

    ``methods`` are names, or mappings with ``method``, options and perhaps ``label``. Parameters are estimated at every
    ``refit_every``-th vintage and kept in between by models that can; ``window`` is the number of months estimated on.
    Columns: model, vintage, period, horizon, forecast, std, previous (the target's last value), before (the model's
    forecast of the period at the vintage before, within a group), note, actual, kind, days_to_end, days_to_release.
    """
    specs = [{"method": m} if isinstance(m, str) else dict(m) for m in methods]
    for spec in specs:
        _check_names([target, *names], {**options, **spec})
    cells = V.at_dates(scheduled.where(F.col("series").isin(target, *names)), vintages, lambda v: F.col("period") <= v)
    cells = V.release_mask(cells, F.col("vintage")).select("vintage", "series", "period", "value")
    order = Window.orderBy("vintage")  # of the vintages, not of their cells
    blocks = vintages.select("vintage").distinct().select("vintage", F.floor((F.row_number().over(order) - 1) / refit_every).alias("_block"))
    cells = cells.join(blocks, "vintage")

    names_of = [c.split()[0] for c in TABLE.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, kept, last = [], {}, {}
        for vintage in sorted(pdf["vintage"].unique()):
            wide, quarterly = _wide(pdf[pdf["vintage"] == vintage], target, names, horizon, window)
            months = np.array([p.month for p in wide.index])
            seen = wide[target].dropna()
            for spec in specs:
                spec = {**options, **spec}
                method, label = spec.pop("method"), spec.pop("label", None)
                label = label or method
                without = set(spec.pop("without", ()))
                cols = [c for c in wide.columns if c not in without]
                at = [wide.columns.get_loc(c) for c in cols]
                e = estimate_block(wide[cols].to_numpy(float), months, method, quarterly[at], names=cols, fitted=kept.get(label), **spec)
                kept[label] = e.model
                f = _frame(wide[cols], quarterly[at], target, e)
                f = f[f["observed"].isna() & (pd.PeriodIndex(pd.to_datetime(f["period"]), freq="M") > (seen.index[-1] if len(seen) else pd.Period("1000-01", "M")))].reset_index(drop=True)
                f = f.rename(columns={"out_of_sample": "forecast"}).assign(model=label, vintage=vintage, horizon=np.arange(1, len(f) + 1), previous=float(seen.iloc[-1]) if len(seen) else np.nan)
                f["before"] = [last.get((label, p), np.nan) for p in f["period"]]
                last.update({(label, p): v for p, v in zip(f["period"], f["forecast"])})
                if len(f):
                    out.append(f[names_of])
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in names_of})

    f = _clean(cells.groupBy("_block").applyInPandas(run, TABLE))
    actual = scheduled.where(F.col("series") == target).select("period", F.col("value").alias("actual"), F.col("release_date").alias("_released"))
    return labelled(f.join(actual, "period", "left")).drop("_released")


def labelled(table: DataFrame) -> DataFrame:
    """Adds kind (backcast, nowcast, forecast of the month), days to the end of the period and to the release of its value."""
    end = F.last_day("period")
    kind = F.when(end < F.col("vintage"), "backcast").when(F.trunc("period", "month") <= F.col("vintage"), "nowcast").otherwise("forecast")
    return table.withColumns({"kind": kind, "days_to_end": F.datediff(end, "vintage"), "days_to_release": F.datediff("_released", "vintage")})


def write_backtest(table: DataFrame, path: str) -> None:
    """A forecast table as files by model."""
    table.write.mode("overwrite").partitionBy("model").parquet(path)


#: The quarters of the pandemic that evaluations leave out.
COVID_WINDOW = ("2020-01-01", "2021-12-31")


def covid_periods(window: tuple[str, str] = COVID_WINDOW) -> dict[str, list[tuple[str | None, str | None]]]:
    """Sub-periods for ``evaluation.sub_periods``: before, during, after, and all but during."""
    from datetime import date, timedelta

    lo, hi = (date.fromisoformat(d) for d in window)
    before, after = str(lo - timedelta(days=1)), str(hi + timedelta(days=1))
    return {"pre": [(None, before)], "during": [window], "post": [(after, None)], "ex": [(None, before), (after, None)]}


#: Keys of a short specification; ``spec`` has the long form with sections.
KEYS = {"data", "target", "method", "transform", "vintage", "prepare", "options"}


def load_spec(source: str | dict) -> dict:
    """A short specification from a mapping or YAML text; all problems are named together."""
    import yaml

    spec = yaml.safe_load(source) if isinstance(source, str) else dict(source)
    if not isinstance(spec, dict):
        raise ValueError("a specification is a mapping")
    problems = [f"unknown key: {k}" for k in sorted(set(spec) - KEYS)] + [f"missing key: {k}" for k in ("data", "target") if k not in spec]
    if spec.get("method", "em") not in METHODS:
        problems.append(f"method: unknown {spec['method']!r}")
    if problems:
        raise ValueError("; ".join(problems))
    return {"method": "em", "transform": 0, "vintage": "2100-01-01", "prepare": False, "options": {}} | spec


def run_spec(spark: SparkSession, source: str | dict) -> DataFrame:
    """The nowcast of a short specification: data, transform, preparation and model."""
    from . import spec as long

    s = load_spec(source)
    whole = long.NowcastSpec(long.DataSpec(**s["data"]), s["target"], str(s["vintage"]), long.PreprocessingSpec(bool(s["prepare"]), s["transform"]), long.ModelSpec(s["method"]))
    panel = long.preprocess(long.read_panel(spark, whole), whole)
    return nowcast(panel, s["target"], s["method"], str(s["vintage"]), **s["options"])
