"""Series of public statistics services: requests as text, answers as rows.

No network is used here: ``get`` is a function from a URL to the answer's text, so
any client, cache or fixture serves. ``cached`` and ``retrying`` wrap one.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterable
from urllib.parse import urlencode

Get = Callable[[str], str]
Row = tuple[dt.date, float | None]


def windows(start: dt.date, end: dt.date, years: int = 10) -> list[tuple[dt.date, dt.date]]:
    """Consecutive windows of so many years."""
    out = []
    while start <= end:
        nxt = start.replace(year=start.year + years, day=min(start.day, 28))
        out.append((start, min(end, nxt - dt.timedelta(days=1))))
        start = nxt
    return out


def number(text: str | float | None, missing: Iterable[str] = ("", ".", "..", "...", "-", "NA", "NaN")) -> float | None:
    if text is None or str(text).strip() in missing:
        return None
    return float(str(text).replace(",", "."))


def central_bank(code: int, start: dt.date, end: dt.date, get: Get, years: int = 10) -> list[Row]:
    """A central bank's time-series service: JSON rows of data (dd/mm/yyyy) and valor, ten years a request."""
    rows: list[Row] = []
    for a, b in windows(start, end, years):
        url = f"https://api.bcb.gov.br/dados/serie/bcdata.sgs.{code}/dados?" + urlencode({"formato": "json", "dataInicial": a.strftime("%d/%m/%Y"), "dataFinal": b.strftime("%d/%m/%Y")})
        rows += [(dt.datetime.strptime(r["data"], "%d/%m/%Y").date(), number(r["valor"])) for r in json.loads(get(url) or "[]")]
    return rows


def fred(series: str, key: str, get: Get, vintage: str | None = None) -> list[Row]:
    """A reserve bank's observations; with a vintage, as they were known that day."""
    q = {"series_id": series, "api_key": key, "file_type": "json"}
    if vintage:
        q |= {"realtime_start": vintage, "realtime_end": vintage}
    got = json.loads(get("https://api.stlouisfed.org/fred/series/observations?" + urlencode(q)))
    return [(dt.date.fromisoformat(r["date"]), number(r["value"])) for r in got["observations"]]


def odata(code: str, get: Get, territory: str | None = None) -> list[Row]:
    """An OData service of economic series; its rows must be of a single territory."""
    got = json.loads(get(f"http://www.ipeadata.gov.br/api/odata4/ValoresSerie(SERCODIGO='{code}')"))["value"]
    if territory is not None:
        got = [r for r in got if r.get("TERCODIGO", "") == territory]
    if len({(r.get("NIVNOME"), r.get("TERCODIGO")) for r in got}) > 1:
        raise ValueError(f"{code}: rows of several territories")
    return [(dt.date.fromisoformat(r["VALDATA"][:10]), number(r["VALVALOR"])) for r in got]


def statistics_office_path(table: int, variable: int | str = "all", periods: str = "all", level: str = "n1/all", classifications: dict[int, str] | None = None) -> str:
    tail = "".join(f"/c{k}/{v}" for k, v in (classifications or {}).items())
    return f"https://apisidra.ibge.gov.br/values/t/{table}/{level}/v/{variable}/p/{periods}{tail}"


def statistics_office_period(code: str, freq: str | None = None) -> tuple[dt.date, str]:
    """First day and frequency of YYYY, YYYYMM or, where the table is quarterly (``freq`` Q), YYYY0Q."""
    if len(code) == 4:
        return dt.date(int(code), 1, 1), "A"
    year, part = int(code[:4]), int(code[4:])
    if freq == "Q":
        if not 1 <= part <= 4:
            raise ValueError(f"{code} is no quarter")
        return dt.date(year, 3 * part - 2, 1), "Q"
    return dt.date(year, part, 1), "M"


def statistics_office(url: str, get: Get, period: str = "D3C", dash: float | None = 0.0, freq: str | None = None) -> list[tuple[str, dt.date, float | None]]:
    """(label, period, value): the first row of the answer is a header; a dash means zero unless said otherwise.

    Codes of quarters look like months; they are told by the header, which names the dimension, or by ``freq``.
    """
    head, *rows = json.loads(get(url))
    if freq is None and re.search(r"(?i)trimestre|quarter", str(head.get(period, "")) + str(head.get(period[:-1] + "N", ""))):
        freq = "Q"
    labels = [k for k in head if k.endswith("N") and k != period[:-1] + "N" and len({r[k] for r in rows}) > 1]
    return [("|".join(r[k] for k in labels) or "value", statistics_office_period(r[period], freq)[0], dash if r["V"] == "-" else number(r["V"])) for r in rows]


def odata_metadata(code: str, get: Get) -> dict:
    """What an OData service says about a series."""
    got = json.loads(get(f"http://www.ipeadata.gov.br/api/odata4/Metadados('{code}')"))["value"]
    if not got:
        raise ValueError(f"{code}: no such series")
    return got[0]


def api_key(key: str | None = None, variable: str = "FRED_API_KEY") -> str:
    """The key given, else that of the environment."""
    found = key or os.environ.get(variable)
    if not found:
        raise ValueError(f"give a key or set {variable}")
    return found


def codes_by_name(codes, default: Callable[[object], str] = str) -> dict[str, object]:
    """{name: code} from a code, a list of codes or a mapping; names are unique."""
    if isinstance(codes, dict):
        return {str(k): v for k, v in codes.items()}
    many = list(codes) if isinstance(codes, (list, tuple)) else [codes]
    out = {default(c): c for c in many}
    if len(out) < len(many):
        raise ValueError("a code occurs twice")
    return out


def describe_url(url: str, params: dict | None = None, secret: tuple[str, ...] = ("api_key",)) -> str:
    """The address for messages and caches, without secrets."""
    q = urlencode({k: "***" if k in secret else v for k, v in (params or {}).items()})
    return f"{url}?{q}" if q else url


class Status(OSError):
    """An answer with an HTTP status that isn't success."""

    def __init__(self, code: int, wait: float | None = None):
        super().__init__(f"status {code}")
        self.code, self.wait = code, wait


#: Statuses after which a request is made again.
RETRIED = (429, 500, 502, 503, 504)


def web(timeout: float = 60.0) -> Get:
    """A client over the standard library."""

    def run(url: str) -> str:
        from urllib.error import HTTPError
        from urllib.request import urlopen

        try:
            with urlopen(url, timeout=timeout) as answer:
                return answer.read().decode("utf-8")
        except HTTPError as e:
            wait = e.headers.get("Retry-After", "")
            raise Status(e.code, float(wait) if wait.isdigit() else None) from e

    return run


def get_text(url: str, get: Get, params: dict | None = None, tries: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer's text. Lost connections and ``RETRIED`` statuses are tried again, after the time the server names or twice as long each time."""
    full = url + ("?" + urlencode(params) if params else "")
    for k in range(tries):
        try:
            return get(full)
        except OSError as e:
            if k == tries - 1 or isinstance(e, Status) and e.code not in RETRIED:
                raise RuntimeError(f"{describe_url(url, params)}: {e}") from e
            sleep(e.wait if isinstance(e, Status) and e.wait is not None else wait * 2**k)
    raise AssertionError


def get_json(url: str, get: Get, params: dict | None = None, tries: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The decoded answer; one that isn't JSON, such as a page that says the service is busy, is asked for again."""
    for k in range(tries):
        text = get_text(url, get, params, tries, wait, sleep)
        try:
            return json.loads(text)
        except ValueError as e:
            if k == tries - 1:
                raise RuntimeError(f"{describe_url(url, params)}: the answer is no JSON: {text[:80]!r}") from e
            sleep(wait * 2**k)
    raise AssertionError


def with_cache(get: Get, cache: str | bool | Callable[[Get], Get] | None) -> Get:
    """``get`` behind a cache: a folder, True for the user's, a wrapper, or none."""
    if cache is None or cache is False:
        return get
    if callable(cache):
        return cache(get)
    return cached(get, os.path.join(os.path.expanduser("~"), ".cache", "driftgauge") if cache is True else cache)


def build_series(dates: list, values: list, missing: tuple[str, ...] = ("",), freq: str | None = None) -> list[Row]:
    """Rows in order, from dates or texts of dates, quarters or months, and values or texts of them.

    Equal repeats of a period collapse; repeats that differ are an error.
    """
    out: dict[dt.date, float | None] = {}
    for d, v in zip(dates, values, strict=True):
        day = d if isinstance(d, dt.date) else parse_period(str(d))
        if freq in ("M", "Q", "A"):
            day = day.replace(day=1, month={"M": day.month, "Q": 3 * ((day.month - 1) // 3) + 1, "A": 1}[freq])
        x = number(v, missing) if isinstance(v, str) else None if v is None or v != v else float(v)
        if day in out and out[day] != x:
            raise ValueError(f"{day}: several values, {out[day]} and {x}")
        out[day] = x
    return sorted(out.items())


def parse_period(text: str) -> dt.date:
    """First day of 2000, 2000Q1, 2000-01, 2000M1 or 2000-01-31."""
    text = text.strip()
    if m := re.fullmatch(r"(\d{4})", text):
        return dt.date(int(m[1]), 1, 1)
    if m := re.fullmatch(r"(?i)(\d{4})-?Q([1-4])", text):
        return dt.date(int(m[1]), 3 * int(m[2]) - 2, 1)
    if m := re.fullmatch(r"(?i)(\d{4})(?:-|M)(\d{1,2})", text):
        return dt.date(int(m[1]), int(m[2]), 1)
    return dt.date.fromisoformat(text[:10])


def cached(get: Get, folder: str, seconds: float = 86_400) -> Get:
    """Answers kept as files under the digest of their URL; written whole, then renamed."""

    def run(url: str) -> str:
        path = os.path.join(folder, hashlib.sha256(url.encode()).hexdigest() + ".json")
        if os.path.exists(path) and time.time() - os.path.getmtime(path) < seconds:
            with open(path, encoding="utf-8") as f:
                return json.load(f)["text"]
        text = get(url)
        os.makedirs(folder, exist_ok=True)
        with open(path + f".{os.getpid()}", "w", encoding="utf-8") as f:
            json.dump({"url": url.partition("api_key=")[0], "text": text}, f)
        os.replace(path + f".{os.getpid()}", path)
        return text

    return run


def retrying(get: Get, tries: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Get:
    """Try again after OSError, each time twice as long later."""

    def run(url: str) -> str:
        for k in range(tries):
            try:
                return get(url)
            except OSError:
                if k == tries - 1:
                    raise
                sleep(wait * 2**k)
        raise AssertionError

    return run
