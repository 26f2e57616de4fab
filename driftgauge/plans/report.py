"""A run as one HTML page of tables. Only result tables are rendered."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

from ..functions.plain import THEMES, Theme

ROWS = 500


def table(df: DataFrame, title: str, rows: int | None = ROWS) -> str:
    """A result table; with ``rows`` a longer one says how many it shows (a report is for reading), without it is shown whole."""
    got = df.collect() if rows is None else df.limit(rows + 1).collect()
    shown = got if rows is None else got[:rows]
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{'' if v is None else escape(f'{v:.4g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in shown)
    more = f"<p>The first {rows} rows.</p>" if len(got) > len(shown) else ""
    return f"<h2>{escape(title)}</h2>{more}<table><tr>{head}</tr>{body}</table>"


def page(title: str, tables: dict[str, DataFrame], rows: int | None = ROWS, theme: str | Theme = "light") -> str:
    style = (THEMES[theme] if isinstance(theme, str) else theme).css()
    parts = "".join(table(df, name, rows) for name, df in tables.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1>{parts}</body></html>"
