"""Declarative runs: a specification of sections, read from YAML or a mapping, checked as a whole, and run.

Each section is a dataclass; a mapping becomes it with every unknown key and wrong value
named at once. A run is a set of DataFrames by name; they are planned, not computed,
until they are written.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass
from typing import get_args, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .nowcasting import METHODS, add_density, backtest, first_nowcast, in_sample_metrics, nowcast


class SpecError(ValueError):
    """All problems of a specification."""


@dataclass
class ConnectorSeries:
    """A series that a connector fetches, with what is known of it."""

    name: str = ""
    source: str = ""
    code: str = ""
    frequency: str = "M"
    delay: int | None = None
    transform: str = "level"
    category: str = "other"
    blocks: list = field(default_factory=list)
    options: dict = field(default_factory=dict)


@dataclass
class DataSpec:
    path: str = ""
    format: str = "csv"
    layout: str = "wide"
    period: str = "period"
    delays: dict = field(default_factory=dict)
    series: list = field(default_factory=list)


@dataclass
class PreprocessingSpec:
    enabled: bool = False
    transform: str | int = "level"
    threshold: float = 4.0
    window: int = 3
    most_missing: float = 1 / 3
    fill: bool = True
    edges: bool = False


@dataclass
class ModelSpec:
    method: str = "em"
    n_factors: int = 1
    lags: int = 1
    horizon: int = 1
    max_iter: int = 500
    tolerance: float = 1e-4
    idiosyncratic: str = "white"

    def options(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("method", "horizon")}


@dataclass
class PreselectSpec:
    method: str = "sis"
    k: int = 10
    start: str | None = None


@dataclass
class SearchSpec:
    space: dict = field(default_factory=dict)
    n_draws: int | None = None
    weights: dict = field(default_factory=lambda: {"h1": 1.0})
    checkpoint: str | None = None
    seed: int = 0


@dataclass
class SelectionSpec:
    preselect: PreselectSpec | None = None
    search: SearchSpec | None = None


@dataclass
class BacktestSpec:
    start: str = ""
    end: str = ""
    step: int = 1
    models: list = field(default_factory=lambda: ["ar", "rw"])
    horizon: int = 1
    window: int | None = None
    refit_every: int = 1


@dataclass
class OutputsSpec:
    density: list = field(default_factory=list)
    backtest: bool = False
    empirical_bands: list = field(default_factory=list)
    report: bool = False
    tables: str | None = None


@dataclass
class NowcastSpec:
    data: DataSpec = field(default_factory=DataSpec)
    target: str = ""
    vintage: str = "2100-01-01"
    preprocessing: PreprocessingSpec = field(default_factory=PreprocessingSpec)
    model: ModelSpec = field(default_factory=ModelSpec)
    selection: SelectionSpec = field(default_factory=SelectionSpec)
    backtest: BacktestSpec | None = None
    outputs: OutputsSpec = field(default_factory=OutputsSpec)


def _section(kind: type, value, at: str, problems: list[str]):
    """A mapping as a section; what is wrong goes to ``problems``."""
    if not isinstance(value, dict):
        problems.append(f"{at or 'specification'}: a mapping is expected")
        return kind()
    hints, out = get_type_hints(kind), {}
    for key in value:
        if key not in hints:
            problems.append(f"{at + '.' if at else ''}{key}: unknown key")
    for key, hint in hints.items():
        if key not in value:
            continue
        v, where = value[key], f"{at + '.' if at else ''}{key}"
        kinds = [t for t in (get_args(hint) or (hint,))]
        nested = next((t for t in kinds if is_dataclass(t)), None)
        if nested and v is not None:
            out[key] = _section(nested, v, where, problems)
            continue
        if hasattr(v, "isoformat"):
            v = v.isoformat()
        plain = tuple(getattr(t, "__origin__", t) for t in kinds)
        if not (v is None and type(None) in plain or isinstance(v, plain) or float in plain and isinstance(v, int)) or isinstance(v, bool) and bool not in plain:
            problems.append(f"{where}: {v!r} is no {' or '.join(t.__name__ for t in plain)}")
            continue
        out[key] = v
    return kind(**out)


def load_spec(source) -> NowcastSpec:
    """A specification from YAML text, the path of a YAML file, or a mapping."""
    import yaml

    if isinstance(source, str):
        if "\n" not in source and source.endswith((".yaml", ".yml")):
            with open(source, encoding="utf-8") as f:
                source = f.read()
        source = yaml.safe_load(source)
    problems: list[str] = []
    spec = _section(NowcastSpec, source, "", problems)
    problems += [f"{k}: missing" for k, v in (("data.path", spec.data.path or spec.data.series), ("target", spec.target)) if not v]
    if spec.model.method not in METHODS:
        problems.append(f"model.method: unknown {spec.model.method!r}; there are {', '.join(METHODS)}")
    if spec.data.layout not in ("wide", "long"):
        problems.append(f"data.layout: wide or long, not {spec.data.layout!r}")
    if spec.outputs.backtest and spec.backtest is None:
        problems.append("outputs.backtest: there is no section backtest")
    if (spec.selection.search or spec.outputs.empirical_bands) and spec.backtest is None:
        problems.append("a search, or empirical bands, need a section backtest")
    if spec.backtest is not None and not (spec.backtest.start and spec.backtest.end):
        problems.append("backtest: start and end are needed")
    if spec.data.series:
        rows = [_section(ConnectorSeries, s, f"data.series[{i}]", problems) for i, s in enumerate(spec.data.series)]
        spec.data.series = rows
    if problems:
        raise SpecError("; ".join(problems))
    return spec


@dataclass
class PipelineRun:
    """The tables of a run by name."""

    spec: NowcastSpec
    tables: dict[str, DataFrame]
    chosen: dict

    def write(self, folder: str, format: str = "parquet") -> None:
        for name, df in self.tables.items():
            w = df.write.mode("overwrite")
            w.option("header", True).csv(f"{folder}/{name}") if format == "csv" else w.format(format).save(f"{folder}/{name}")


def read_panel(spark: SparkSession, spec: NowcastSpec, fetch=None) -> DataFrame:
    """The panel of a specification: a file, or series that ``fetch`` (ConnectorSeries -> rows of date and value) gets."""
    from ..operators.panel import regularise
    from ..sources import files

    d = spec.data
    if d.series:
        if fetch is None:
            raise SpecError("data.series: a function that fetches them is needed")
        rows = [(s.name, day, v) for s in d.series for day, v in fetch(s)]
        return regularise(files.single_values(spark.createDataFrame(rows, "series string, period date, value double")))
    return regularise(files.read_wide(spark, d.path, d.period, d.format) if d.layout == "wide" else files.read_long(spark, d.path, d.format))


def preprocess(panel: DataFrame, spec: NowcastSpec) -> DataFrame:
    from ..operators import cleaning, transforms

    p = spec.preprocessing
    if not p.enabled:
        return transforms.apply(panel, p.transform) if p.transform not in ("level", 0) else panel
    return cleaning.prepare(panel, p.transform, p.threshold, p.window, p.most_missing, (spec.target.split("~")[0].strip(),), fill=p.fill, edges=p.edges)


def run_preselection(panel: DataFrame, spec: NowcastSpec) -> list[str]:
    """The predictors that the funnel lets through, best first."""
    from ..operators.selection import preselect_ranking

    s = spec.selection.preselect
    seen = panel if s.start is None else panel.where(F.col("period") >= F.lit(s.start).cast("date"))
    return preselect_ranking(seen, spec.target.split("~")[0].strip(), s.method).names[: s.k]


def run_spec(spark: SparkSession, source, fetch=None) -> PipelineRun:
    """Data, preparation, selection, nowcast, and the outputs asked for."""
    from ..functions.formula import resolve
    from ..operators import density, evaluation
    from ..operators import vintages as V
    from ..operators.panel import literal
    from ..operators.selection import ParameterSpace
    from .experiments import search

    spec = source if isinstance(source, NowcastSpec) else load_spec(source)
    panel = preprocess(read_panel(spark, spec, fetch), spec)
    names = sorted(r["series"] for r in panel.select("series").distinct().collect())  # the names of one panel's series
    target, xs = resolve(spec.target, names)
    tables: dict[str, DataFrame] = {"panel": panel}
    delays = {**{s.name: s.delay for s in spec.data.series if s.delay is not None}, **spec.data.delays}
    scheduled = V.schedule(panel, literal(spark, [(n, int(delays.get(n, 0))) for n in names], "series string, delay int"))
    known = V.release_mask(scheduled, spec.vintage).select("series", "period", "value") if delays else panel
    if spec.selection.preselect is not None:
        xs = [x for x in run_preselection(known, spec) if x in xs]
        tables["preselection"] = literal(spark, [(k, x) for k, x in enumerate(xs, 1)], "place int, series string")
    options, method, chosen = spec.model.options(), spec.model.method, {}
    b = spec.backtest
    if b is not None:
        grid = V.vintage_grid(panel.agg(F.count("*").alias("n")), b.start, b.end, b.step)
        if spec.selection.search is not None:
            s = spec.selection.search
            space = ParameterSpace(**s.space)
            ranking = search(scheduled, target, xs, space.draw(s.n_draws, s.seed) if s.n_draws else space.grid(), grid, s.weights, s.checkpoint)
            tables["search"] = ranking
            import json

            chosen = json.loads(ranking.orderBy("score", "spec").first()["spec"])
            method, options = chosen.get("method", method), options | {k: v for k, v in chosen.items() if k != "method"}
        own = {"method": method, "label": "model", **options}
        table = backtest(scheduled, target, xs, [own, *b.models], grid, b.horizon, b.refit_every, b.window)
        if spec.outputs.backtest:
            tables["backtest"] = table
            tables["accuracy"] = evaluation.accuracy(table)
        if spec.outputs.empirical_bands:
            tables["empirical_bands"] = density.empirical_bands(evaluation.errors(table).select("model", "horizon", "vintage", "period", "forecast", "actual", "error"), spec.outputs.empirical_bands, least=4)
    result = nowcast(known, target, method, spec.vintage, [target, *xs], spec.model.horizon, **options)
    if spec.outputs.density:
        result = add_density(result, levels=tuple(spec.outputs.density))
    tables["nowcast"] = result
    tables["headline"] = first_nowcast(result)
    tables["in_sample"] = in_sample_metrics(result)
    return PipelineRun(spec, tables, chosen)


TEMPLATES = os.path.join(os.path.dirname(__file__), "templates")


def list_templates() -> list[str]:
    return sorted(f[:-5] for f in os.listdir(TEMPLATES) if f.endswith(".yaml"))


def template_path(name: str = "minimal") -> str:
    if name not in list_templates():
        raise ValueError(f"no template {name!r}; there are {', '.join(list_templates())}")
    return os.path.join(TEMPLATES, f"{name}.yaml")


def template_text(name: str = "minimal") -> str:
    with open(template_path(name), encoding="utf-8") as f:
        return f.read()


def build_parser():
    import argparse

    parser = argparse.ArgumentParser(description="Declarative nowcasts on Spark")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a specification and write its tables")
    run.add_argument("spec")
    run.add_argument("out")
    sub.add_parser("validate", help="name the problems of a specification").add_argument("spec")
    sub.add_parser("template", help="print a template").add_argument("name", nargs="?", default="minimal")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "template":
        print(template_text(args.name))
        return 0
    with open(args.spec, encoding="utf-8") as f:
        text = f.read()
    try:
        spec = load_spec(text)
    except ValueError as e:
        print(e)
        return 2
    if args.command == "run":
        done = run_spec(SparkSession.builder.getOrCreate(), spec)
        done.write(args.out, spec.outputs.tables or "parquet")
        if spec.outputs.report:
            from .report import page

            shown = {k: v for k, v in done.tables.items() if k != "panel"}
            with open(os.path.join(args.out, "report.html"), "w", encoding="utf-8") as f:
                f.write(page(spec.target, shown))
    return 0
