"""Completion of indicators after their last value, by name: a registry of functions (history, horizon) -> values."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import forecasters as B

Extrapolator = Callable[[np.ndarray, int], np.ndarray]
_REGISTRY: dict[str, Extrapolator] = {}


def register(name: str) -> Callable[[Extrapolator], Extrapolator]:
    def put(f: Extrapolator) -> Extrapolator:
        _REGISTRY[name] = f
        return f

    return put


def available() -> list[str]:
    return sorted(_REGISTRY)


def make(name: str | Extrapolator) -> Extrapolator:
    if callable(name):
        return name
    if name not in _REGISTRY:
        raise ValueError(f"unknown extrapolator: {name}; there are {', '.join(available())}")
    return _REGISTRY[name]


@register("ar")
def _ar(y: np.ndarray, h: int) -> np.ndarray:
    return B.ar_forecast(y, h, B.ar_order(y))


@register("mean")
def _mean(y: np.ndarray, h: int) -> np.ndarray:
    return B.historical_mean(y, h)


@register("rw")
def _rw(y: np.ndarray, h: int) -> np.ndarray:
    return B.random_walk(y, h)


@register("drift")
def _drift(y: np.ndarray, h: int) -> np.ndarray:
    return B.random_walk(y, h, True)


def complete(x: np.ndarray, how: str | Extrapolator = "ar") -> np.ndarray:
    """Each column's missing tail, from its own history."""
    out, f = x.copy(), make(how)
    for j in range(x.shape[1]):
        seen = np.flatnonzero(~np.isnan(x[:, j]))
        if len(seen) and seen[-1] + 1 < len(x):
            out[seen[-1] + 1 :, j] = f(x[: seen[-1] + 1, j], len(x) - 1 - seen[-1])
    return out


def complete_jointly(x: np.ndarray, lags: int = 1, tightness: float = 0.2) -> np.ndarray:
    """The ragged edge by a Bayesian VAR: what some series already know conditions the others."""
    full = ~np.isnan(x).any(1)
    last = int(np.flatnonzero(full).max())
    known = x[: last + 1][full[: last + 1]]
    out = x.copy()
    if last + 1 < len(x):
        out[last + 1 :] = B.conditional_forecast(known, B.bvar(known, lags, tightness), x[last + 1 :])
    return out
