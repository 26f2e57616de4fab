"""Models as objects: parameters, fitting, updating, and benchmarks at the target's own frequency.

A model is fitted in a grouped map and travels as bytes in a column, so a table of
blocks (vintages, regions, specifications) gives a table of models, which a later
table of blocks updates without fitting again. One block is the case of one row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import resolve
from .nowcasting import METHODS, _clean, _frame, _wide, estimate_block

MODELS = "block string, model binary, note string"
ESTIMATES = "block string, period date, observed double, in_sample double, out_of_sample double, std double, note string"


class Params:
    """Settings of a dataclass: read, set, and copied; those of a part as part__name."""

    def get_params(self, deep: bool = True) -> dict:
        out = {f.name: getattr(self, f.name) for f in fields(self)}
        for name, value in list(out.items()) if deep else ():
            if isinstance(value, Params):
                out |= {f"{name}__{k}": v for k, v in value.get_params().items()}
        return out

    def set_params(self, **params):
        for name, value in params.items():
            part, _, rest = name.partition("__")
            if part not in {f.name for f in fields(self)}:
                raise ValueError(f"{type(self).__name__} has no setting {part}")
            getattr(self, part).set_params(**{rest: value}) if rest else setattr(self, part, value)
        return self

    def clone(self):
        return type(self)(**{f.name: v.clone() if isinstance(v := getattr(self, f.name), Params) else v for f in fields(self)})


@dataclass
class Nowcaster(Params):
    """A method of ``nowcasting`` with its settings."""

    method: str = "em"
    n_factors: int = 1
    lags: int = 1
    horizon: int = 1
    max_iter: int = 500
    tolerance: float = 1e-4
    idiosyncratic: str = "white"

    def validate(self) -> None:
        problems = [f"method: unknown {self.method!r}"] if self.method not in METHODS else []
        problems += [f"{k}: at least 1" for k in ("n_factors", "lags", "horizon", "max_iter") if getattr(self, k) < 1]
        if problems:
            raise ValueError("; ".join(problems))

    def _options(self) -> dict:
        return {k: getattr(self, k) for k in ("n_factors", "lags", "max_iter", "tolerance", "idiosyncratic")}

    def fit(self, blocks: DataFrame, target: str, names: list[str]) -> DataFrame:
        """(block, model, note) of a table (block, series, period, value); methods without parameters to keep have a null model."""
        self.validate()
        y, xs = resolve(target, names)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            wide, quarterly = _wide(pdf, y, xs, self.horizon)
            e = estimate_block(wide.to_numpy(float), np.array([p.month for p in wide.index]), self.method, quarterly, names=list(wide.columns), **self._options())
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "model": [None if e.model is None else pickle.dumps(e.model)], "note": [e.note]})

        return blocks.where(F.col("series").isin(y, *xs)).groupBy("block").applyInPandas(run, MODELS)

    def update(self, models: DataFrame, blocks: DataFrame, target: str, names: list[str]) -> DataFrame:
        """Estimates of newer blocks under the parameters of fitted models; blocks without a model are estimated."""
        y, xs = resolve(target, names)

        def run(key, pdf: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf):
                return pd.DataFrame({c.split()[0]: [] for c in ESTIMATES.split(", ")})
            model = pickle.loads(fitted["model"].iloc[0]) if len(fitted) and fitted["model"].iloc[0] is not None else None
            wide, quarterly = _wide(pdf, y, xs, self.horizon)
            e = estimate_block(wide.to_numpy(float), np.array([p.month for p in wide.index]), self.method, quarterly, names=list(wide.columns), fitted=model, **self._options())
            return _frame(wide, quarterly, y, e).assign(block=key[0])[[c.split()[0] for c in ESTIMATES.split(", ")]]

        own = blocks.where(F.col("series").isin(y, *xs))
        return _clean(own.groupBy("block").cogroup(models.groupBy("block")).applyInPandas(run, ESTIMATES))


class Forecaster(Protocol):
    """What a benchmark is: fitted to a history at its own frequency, asked for the next values."""

    def fit(self, y: np.ndarray, X: np.ndarray | None = None): ...

    def predict(self, horizon: int, X: np.ndarray | None = None) -> np.ndarray: ...


@dataclass
class Benchmark(Params):
    """A benchmark of one series: ar (lags by a criterion where 0), random_walk, drift or mean."""

    kind: str = "ar"
    lags: int = 0
    window: int | None = None

    def fit(self, y: np.ndarray, X: np.ndarray | None = None):
        self.history_ = np.asarray(y, float)[-self.window :] if self.window else np.asarray(y, float)
        return self

    def predict(self, horizon: int, X: np.ndarray | None = None) -> np.ndarray:
        from ..operators import forecasters as B

        y = self.history_
        if self.kind == "ar":
            return B.ar_forecast(y, horizon, self.lags or B.ar_order(y))
        if self.kind == "mean":
            return B.historical_mean(y, horizon)
        return B.random_walk(y, horizon, self.kind == "drift")


@dataclass
class EstimatorBenchmark(Params):
    """Any estimator with fit(X, y) and predict(X), on indicators at the target's frequency and lags of the target."""

    make: Callable | None = None
    target_lags: int = 1

    def _design(self, y: np.ndarray, X: np.ndarray) -> np.ndarray:
        lagged = [np.concatenate([np.full(k, np.nan), y[: len(X) - k]]) if len(y) >= len(X) - k else np.concatenate([np.full(k, np.nan), y, np.full(len(X) - k - len(y), np.nan)]) for k in range(1, self.target_lags + 1)]
        return np.column_stack([X, *lagged])

    def fit(self, y: np.ndarray, X: np.ndarray | None = None):
        if X is None or self.make is None:
            raise ValueError("an estimator and indicators are needed")
        self.history_, self.estimator_ = np.asarray(y, float), self.make()
        D = self._design(self.history_, X[: len(y)])
        ok = ~np.isnan(np.column_stack([D, self.history_])).any(1)
        self.estimator_.fit(D[ok], self.history_[ok])
        return self

    def predict(self, horizon: int, X: np.ndarray | None = None) -> np.ndarray:
        """X: indicators of the periods ahead. Further periods use the forecasts of nearer ones as lags."""
        path = self.history_
        for h in range(horizon):
            lagged = path[::-1][: self.target_lags]
            path = np.append(path, float(self.estimator_.predict(np.concatenate([X[h], lagged])[None])[0]))
        return path[len(self.history_) :]


@dataclass
class Ridge:
    """A least-squares estimator with a penalty, for ``EstimatorBenchmark`` where no other library is there."""

    alpha: float = 1.0

    def fit(self, X: np.ndarray, y: np.ndarray):
        self.mean_, self.centre_ = X.mean(0), y.mean()
        Z = X - self.mean_
        self.coef_ = np.linalg.solve(Z.T @ Z + self.alpha * np.eye(Z.shape[1]), Z.T @ (y - self.centre_))
        return self

    def predict(self, X: np.ndarray) -> np.ndarray:
        return self.centre_ + (X - self.mean_) @ self.coef_


def clone_estimator(estimator):
    """An unfitted copy: by its own clone, its parameters, or its constructor."""
    if isinstance(estimator, Params):
        return estimator.clone()
    if hasattr(estimator, "get_params"):
        return type(estimator)(**estimator.get_params(deep=False))
    kept = {k: v for k, v in vars(estimator).items() if not k.endswith("_")}
    return type(estimator)(**kept)


def benchmark_table(series: DataFrame, makers: dict[str, Callable[[], Forecaster]], horizon: int = 1, start: int = 24) -> DataFrame:
    """A forecast table (model, vintage, period, horizon, forecast, previous, actual) of benchmarks: each is fitted on every history of at least ``start`` values.

    ``series``: series, period, value at the target's frequency; series are spread over tasks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period").dropna(subset=["value"])
        y, when = pdf["value"].to_numpy(float), pdf["period"].tolist()
        out = []
        for t in range(start, len(y)):
            for name, make in makers.items():
                f = make().fit(y[:t]).predict(horizon)
                out += [(pdf["series"].iloc[0], name, when[t - 1], when[t + h], h + 1, float(f[h]), float(y[t - 1]), float(y[t + h])) for h in range(min(horizon, len(y) - t))]
        return pd.DataFrame(out, columns=["series", "model", "vintage", "period", "horizon", "forecast", "previous", "actual"])

    return series.groupBy("series").applyInPandas(run, "series string, model string, vintage date, period date, horizon long, forecast double, previous double, actual double")


@dataclass
class SpecifiedModel(Params):
    """A model with its sample: a first period, and the best predictors of a ranking made anew at each vintage."""

    model: Nowcaster | None = None
    start: str | None = None
    n_series: int | None = None
    ranking: str = "sis"

    def prepare(self, panel: DataFrame, target: str) -> DataFrame:
        from ..operators.selection import funnel

        p = panel if self.start is None else panel.where(F.col("period") >= F.lit(self.start).cast("date"))
        return p if self.n_series is None else funnel(p, target, self.n_series, self.ranking)

    def nowcast(self, panel: DataFrame, target: str, vintage: str = "2100-01-01") -> DataFrame:
        from .nowcasting import nowcast

        m = self.model or Nowcaster()
        m.validate()
        return nowcast(self.prepare(panel, target), target, m.method, vintage, horizon=m.horizon, **m._options())
