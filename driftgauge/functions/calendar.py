"""Frequencies, periods and storage slots.

A period is a DATE, its first day; a frequency is one of D, W, M, Q, A. A week
belongs to the month or quarter that holds its last day. A value of a coarser
frequency is stored in the last base period of its native period.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Periods in a year, finest first.
PER_YEAR = {"D": 365, "W": 52, "M": 12, "Q": 4, "A": 1}
#: Fixed numbers of fine periods in a coarse one; other pairs depend on the calendar.
FIXED = {("D", "W"): 7, ("M", "Q"): 3, ("M", "A"): 12, ("Q", "A"): 4}
#: Most fine periods that a coarse one can hold, where the calendar decides.
MOST = {("D", "M"): 31, ("D", "Q"): 92, ("D", "A"): 366, ("W", "M"): 5, ("W", "Q"): 14, ("W", "A"): 53}
ALIASES = {
    "D": ("d", "day", "daily"),
    "W": ("w", "week", "weekly"),
    "M": ("m", "month", "monthly", "me", "ms", "12"),
    "Q": ("q", "quarter", "quarterly", "qe", "qs", "4"),
    "A": ("a", "y", "year", "yearly", "annual", "ye", "ys", "1"),
}
UNIT = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "A": "year"}


def parse_frequency(value: str | int) -> str:
    """D, W, M, Q or A from a name, an alias, an anchored alias such as W-SUN, or periods a year."""
    text = re.sub(r"-[a-z]{3}$", "", str(value).strip().lower())
    for code, names in ALIASES.items():
        if text in names:
            return code
    if text in ("365", "366"):
        return "D"
    if text in ("52", "53"):
        return "W"
    raise ValueError(f"unknown frequency: {value!r}")


def ratio(high: str, low: str) -> int:
    """Fine periods in a coarse one, where that is fixed."""
    high, low = parse_frequency(high), parse_frequency(low)
    if high == low:
        return 1
    if (high, low) not in FIXED:
        raise ValueError(f"the number of {high} periods in a {low} period depends on the calendar")
    return FIXED[high, low]


def is_fixed(high: str, low: str) -> bool:
    return high == low or (high, low) in FIXED


def most_periods(high: str, low: str) -> int:
    return 1 if high == low else FIXED.get((high, low)) or MOST[high, low]


def start_of(day: Column, freq: str) -> Column:
    """First day of the period that holds the day."""
    return F.trunc(day, UNIT[freq]) if freq != "D" else F.to_date(day)


def end_of(period: Column, freq: str) -> Column:
    """Last day of a period."""
    if freq == "D":
        return period
    if freq == "W":
        return F.date_add(period, 6)
    months = {"M": 1, "Q": 3, "A": 12}[freq]
    return F.date_sub(F.add_months(start_of(period, freq), months), 1)


def shift(period: Column, k: int | Column, freq: str) -> Column:
    """The period k later. Months are counted from the given one, so month ends don't drift."""
    k = F.lit(k) if isinstance(k, int) else k
    if freq in "DW":
        return F.date_add(period, k * (7 if freq == "W" else 1))
    return F.add_months(period, k * {"M": 1, "Q": 3, "A": 12}[freq])


def native_of(period: Column, base: str, freq: str) -> Column:
    """The native period that a base period's last day falls in."""
    return start_of(end_of(period, base), freq)


def is_slot(period: Column, base: str, freq: str) -> Column:
    """The base period is the last of its native period."""
    return native_of(period, base, freq) != native_of(shift(period, 1, base), base, freq)


def position(period: Column, base: str, freq: str) -> Column:
    """0-based place of a base period in its native period."""
    first = native_of(period, base, freq)
    if base == "M":
        return F.months_between(period, first).cast("int")
    if base == "Q":
        return (F.months_between(period, first) / 3).cast("int")
    if base == "D":
        return F.datediff(period, first)
    return F.floor(F.datediff(end_of(period, base), first) / 7).cast("int")


def native_length(period: Column, base: str, freq: str) -> Column:
    """Base periods in the native period that a base period is in."""
    if is_fixed(base, freq):
        return F.lit(ratio(base, freq))
    first = native_of(period, base, freq)
    last = end_of(first, freq)
    if base == "D":
        return F.datediff(last, first) + 1
    before = lambda d: F.floor(F.datediff(d, F.lit("1970-01-04").cast("date")) / 7)  # noqa: E731  Sundays up to a day
    return (before(last) - before(F.date_sub(first, 1))).cast("int")


def growth_weights(n: int) -> list[float]:
    """Triangular weights 1..n..1, which turn fine growth rates into a coarse one."""
    return [float(min(i, 2 * n - i)) for i in range(1, 2 * n)]


def aggregation_weights(kind: str, n: int, normalise: bool = False) -> list[float]:
    """Weights of an aggregation, most recent first: flow, stock, average or growth."""
    w = {"flow": [1.0] * n, "stock": [1.0] + [0.0] * (n - 1), "average": [1.0 / n] * n, "growth": growth_weights(n)}[kind]
    return [x / n for x in w] if normalise and kind == "growth" else w


def growth_weights_by_calendar(n_current: int, n_previous: int) -> list[float]:
    """Growth weights, most recent first, for a period of n_current fine periods after one of n_previous."""
    return [j / n_current for j in range(1, n_current + 1)] + [(n_previous - j) / n_previous for j in range(1, n_previous)]
