"""Small conversions of settings: to JSON, to plain YAML, by column; and registries of plots and themes."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, is_dataclass

import numpy as np


def jsonable(value, most: int = 10_000):
    """A copy that JSON can hold: what isn't finite is null, arrays are lists; longer arrays are named by shape."""
    if is_dataclass(value) and not isinstance(value, type):
        value = asdict(value)
    if isinstance(value, dict):
        return {str(k): jsonable(v, most) for k, v in value.items()}
    if isinstance(value, np.ndarray):
        return f"array {value.shape}" if value.size > most else jsonable(value.tolist(), most)
    if isinstance(value, (list, tuple, set, frozenset)):
        return [jsonable(v, most) for v in (sorted(value, key=repr) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if value is None or isinstance(value, (bool, int, str)):
        return value
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)


def plain(value):
    """A copy of plain lists, mappings and scalars for YAML; dates stay dates."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    if isinstance(value, np.generic):
        return value.item()
    return asdict(value) if is_dataclass(value) and not isinstance(value, type) else value


def per_series(spec, columns: list[str], what: str, default=None) -> dict:
    """One value for each column, from a scalar, a list in their order or a mapping by name."""
    if isinstance(spec, dict):
        unknown = sorted(set(spec) - set(columns))
        if unknown:
            raise ValueError(f"{what}: unknown series {', '.join(unknown)}")
        return {c: spec.get(c, default) for c in columns}
    if isinstance(spec, (list, tuple)):
        if len(spec) != len(columns):
            raise ValueError(f"{what}: {len(spec)} values for {len(columns)} series")
        return dict(zip(columns, spec))
    return {c: default if spec is None else spec for c in columns}


def positional_or_named(values, columns: list[str], what: str) -> dict:
    """Values of columns, in order or by name; every column has one."""
    out = per_series(values, columns, what) if isinstance(values, (dict, list, tuple)) else None
    if out is None or any(v is None for v in out.values()):
        raise ValueError(f"{what}: a value for each of {', '.join(columns)} is expected")
    return out


def coerce_delay(value, series: str = "") -> int | None:
    """Days between a period's end and its release; None where there are none."""
    if value is None or value == "" or isinstance(value, float) and math.isnan(value):
        return None
    try:
        days = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"{series}: {value!r} is no delay in days") from None
    if isinstance(value, bool) or days != int(days) or days <= -366:
        raise ValueError(f"{series}: {value!r} is no delay in days")
    return int(days)


def configured(factory: Callable, params: dict | None = None, **base):
    """A new object of a factory with its settings and others over them; nested ones as a__b."""
    flat, nested = dict(base), {}
    for k, v in (params or {}).items():
        outer, _, inner = k.partition("__")
        if inner:
            nested.setdefault(outer, {})[inner] = v
        else:
            flat[k] = v
    for k, v in nested.items():
        flat[k] = {**(flat.get(k) or {}), **v}
    return factory(**flat)


PLOTS: dict[tuple[str, str], Callable] = {}


def register_plot(kind: str, results: str = "nowcast") -> Callable[[Callable], Callable]:
    """A renderer for a kind of table; the engine draws nothing itself."""

    def put(f: Callable) -> Callable:
        if (results, kind) in PLOTS and PLOTS[results, kind] is not f:
            raise ValueError(f"there is a plot {kind} of {results}")
        PLOTS[results, kind] = f
        return f

    return put


def register_news_plot(kind: str) -> Callable[[Callable], Callable]:
    return register_plot(kind, "news")


def plot(kind: str, results: str = "nowcast") -> Callable:
    if (results, kind) not in PLOTS:
        raise ValueError(f"no plot {kind} of {results}; there are {', '.join(k for r, k in sorted(PLOTS) if r == results) or 'none'}")
    return PLOTS[results, kind]


@dataclass
class Theme:
    """Colours and sizes for renderers and HTML reports."""

    name: str
    colours: list[str] = field(default_factory=lambda: ["#1f4e79", "#c55a11", "#548235", "#7f6000"])
    positive: str = "#548235"
    negative: str = "#c00000"
    background: str = "#ffffff"
    text: str = "#222222"
    grid: str = "#cccccc"
    font: str = "sans-serif"
    font_size: int = 13

    def css(self) -> str:
        return f"body{{font:{self.font_size}px {self.font};color:{self.text};background:{self.background}}}table{{border-collapse:collapse}}td,th{{border:1px solid {self.grid};padding:2px 6px}}h1,h2{{color:{self.colours[0]}}}"


THEMES: dict[str, Theme] = {"light": Theme("light"), "dark": Theme("dark", background="#1e1e1e", text="#e0e0e0", grid="#555555")}


def register_theme(theme: Theme, overwrite: bool = False) -> Theme:
    if theme.name in THEMES and not overwrite:
        raise ValueError(f"there is a theme {theme.name}")
    THEMES[theme.name] = theme
    return theme
