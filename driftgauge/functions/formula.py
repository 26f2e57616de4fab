"""Formulas of a target and its regressors: y ~ x1 + . - x2, with backquotes for odd names."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(`[^`]*`|[A-Za-z_][\w.]*|[.+\-~])")


def is_formula(text: str) -> bool:
    return "~" in re.sub(r"`[^`]*`", "", text)


def parse(text: str, columns: list[str]) -> tuple[str, list[str]]:
    """Target and regressors; a dot is every other column."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected text in formula at {at}: {text[at:]!r}")
        tokens.append(m[1])
        at = m.end()
    if tokens.count("~") != 1 or tokens[1:2] != ["~"]:
        raise ValueError("a formula is target ~ terms")
    target, chosen, sign = tokens[0].strip("`"), [], "+"
    for tok in tokens[2:]:
        if tok in "+-":
            sign = tok
            continue
        names = [c for c in columns if c != target] if tok == "." else [tok.strip("`")]
        unknown = [n for n in names if n not in columns]
        if unknown:
            raise ValueError(f"unknown column: {unknown[0]}")
        chosen = [c for c in chosen if c not in names] if sign == "-" else chosen + [n for n in names if n not in chosen]
    return target, chosen


def resolve(text: str, columns: list[str]) -> tuple[str, list[str]]:
    """From a formula, or a target's name with all other columns."""
    if is_formula(text):
        return parse(text, columns)
    if text not in columns:
        raise ValueError(f"unknown column: {text}")
    return text, [c for c in columns if c != text]
