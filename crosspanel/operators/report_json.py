"""Valuation reports as JSON text, read in Arrow batches: each text is parsed once, to figures, maps of years and reasons.

Texts are read as functions.coerce.parse_amount and Spark's casts read them; of a key that is written twice the first counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa

from crosspanel.operators.reports import GROWTH, NOL_USE, TAX, YEARS

HISTORY = ["revenue", "ebit", "da", "capex", "nwc"]
DRIVERS = ["revenue_growth", "ebit_margin", "da_pct_sales", "capex_pct_sales", "nwc_pct_sales"]
#: Figures of a report, and whether they are ratios.
FIGURES = {
    "tax_rate": True, "wacc": True, "terminal_growth": True, "terminal_exit_ebitda_multiple": False, "cash": False, "debt": False, "net_debt_override": False, "investments": False,
    "minority_interest": False, "preferred_equity": False, "diluted_shares": False, "current_price": False, "target_ebit_margin": True, "nol_balance": False, "nol_utilization_pct": True,
}
#: What a base report without the figure is taken to say; other figures stay null.
DEFAULTS = {"tax_rate": TAX, "terminal_growth": GROWTH, "nol_utilization_pct": NOL_USE, **dict.fromkeys(["wacc", "cash", "debt", "investments", "minority_interest", "preferred_equity", "diluted_shares", "nol_balance"], 0.0)}
METHODS = ["average", "exit_multiple", "gordon_growth"]
# Texts that stand for a missing figure, and others that are no number.
MISSING = {"", "na", "n/a", "none", "null", "-"}
NO_NUMBER = {"nan", "--"}

_PLACE = {f: i for i, f in enumerate(sorted(FIGURES, key=lambda f: not FIGURES[f]))}  # reasons tell ratios first
#: Texts of the first length at most recur, so that their values are looked up first; those of the second or more are not kept.
_SHORT, _LONG = 6, 64
_NONE: dict = {}
_SIDES = [("bull", "scenarios.bull."), ("bear", "scenarios.bear.")]
_BEFORE_COLON = ['" ', '"\t', '"\n', '"\r']
_SPACE = " \t\n\x0b\f\r"
_DROPPED = str.maketrans("", "", f",_${_SPACE}€£¥()%")
_CONTROL = "".join(map(chr, range(33)))
_PERCENT = re.compile(rf"%[{_SPACE}]*\)?(?:\r\n|[\n\r\x85\u2028\u2029])?\Z")
_PLAIN = re.compile(r"-?[0-9]+(?:\.[0-9]+)?").fullmatch
_NUMBER = re.compile(r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)[df]?")
_HEX = re.compile(r"([+-]?0x(?:[0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)p[+-]?[0-9]+)[df]?")
_WORD = re.compile(r"[+-]?inf(?:inity)?|nan")
_YEAR = re.compile(r"\+?0*([0-9]{4})")
# Strings, and what the JSON reader of Spark takes besides: single quotes, other names of infinity.
_LOOSE = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|[+-]INF\b|\+Infinity\b', re.DOTALL)
_INNER = re.compile(r'\\(.)|"', re.DOTALL)


class _Twice(dict):
    """An object in which a key is written twice: the first of each, and all as pairs."""

    def __init__(self, pairs: list):
        super().__init__(reversed(pairs))
        self.pairs = pairs


def _object(pairs: list) -> dict:
    d = dict(pairs)
    return d if len(d) == len(pairs) else _Twice(pairs)


_TEXTS = {"parse_float": str, "parse_int": str, "parse_constant": str}
_plain, _decode = json.JSONDecoder(**_TEXTS).raw_decode, json.JSONDecoder(object_pairs_hook=_object, **_TEXTS).raw_decode


def _double_quoted(m: re.Match) -> str:
    inner = m[0][1:-1] if m[0][0] in "\"'" else m[0]
    return '"' + _INNER.sub(lambda q: "'" if q[1] == "'" else q[0] if q[1] else '\\"', inner) + '"'


def loads(text: str | None):
    """The JSON value at the start of text, numbers as their texts; None where there is none."""
    if text is None:
        return None
    text = text.lstrip(" \t\n\r")
    try:
        return _decode(text)[0]
    except (ValueError, RecursionError):
        pass
    try:
        return _decode(_LOOSE.sub(_double_quoted, text))[0]
    except (ValueError, RecursionError):
        return None


def number(text: str) -> float | None:
    """A lower-case text as Spark's cast to double reads it."""
    text = text.strip(_CONTROL)
    if m := _NUMBER.fullmatch(text):
        return float(m[1])
    if _WORD.fullmatch(text):
        return float(text)
    if m := _HEX.fullmatch(text):
        try:
            return float.fromhex(m[1])
        except OverflowError:
            return float("-inf" if m[1][0] == "-" else "inf")
    return None


def amount(text, ratio: bool) -> float | bool | None:
    """functions.coerce.parse_amount of a leaf; None for a missing figure, False for what is no number."""
    if text.__class__ is not str:
        return None if text is None else False
    if len(text) > _SHORT and _PLAIN(text):
        value = float(text)
        return value / 100 if ratio and not -1 <= value <= 1 else value
    return _written(text, ratio) if len(text) < _LONG else _written.__wrapped__(text, ratio)


@lru_cache(1 << 16)
def _written(text: str, ratio: bool) -> float | bool | None:
    text = text.strip(" ").lower()
    if text in MISSING:
        return None
    value = None if text in NO_NUMBER else number(text.translate(_DROPPED).removesuffix("x"))
    if value is None:
        return False
    percent = _PERCENT.search(text) is not None or ratio and not abs(value) <= 1
    if text.startswith("(") and text.endswith(")"):
        value = -abs(value)
    return value / 100 if percent else value


@lru_cache(1 << 12)
def year(key: str) -> int | None:
    """A year of 1900 to 2500."""
    m = _YEAR.fullmatch(key.strip(_CONTROL + "\x7f"))
    return int(m[1]) if m and 1900 <= int(m[1]) <= 2500 else None


def _child(parent: dict, name: str, path: str, wrong: list[str], sizes: list[int]) -> dict:
    """The object called name, which may be JSON in a text; empty without one. sizes takes its number of keys."""
    x = parent.get(name)
    if x.__class__ is dict:
        sizes.append(len(x))
        return x
    if x is None:
        return _NONE
    if x.__class__ is str:
        x = loads(x)
    if isinstance(x, dict):
        sizes.append(len(x))
        return x
    wrong.append(f"not_an_object:{path}{name}")
    return _NONE


def series(parent: dict, names: list[str], path: str, ratio: bool, wrong: list[str], sizes: list[int], named: set | None = None) -> list[dict]:
    """Values by year of each of names, of a year that is written twice the first; named takes all years."""
    out = [_NONE] * len(names)
    for i, name in enumerate(names) if parent else ():
        if name not in parent:
            continue
        data = _child(parent, name, path, wrong, sizes)
        values, empty, bad = {}, [], []
        for key, text in data.pairs if data.__class__ is _Twice else data.items():
            y = year(key)
            if y is None:
                wrong.append(f"bad_year:{path}{name}.{key}")
                continue
            v = amount(text, ratio)
            if v.__class__ is float:
                if y not in values:
                    values[y] = v
                continue
            empty.append(y)
            if v is False:
                bad.append(f"bad_number:{path}{name}.{key}")
        wrong += bad
        if named is not None:
            named.update(values, empty)
        out[i] = values
    return out


def figures(data: dict, path: str, wrong: list[str]) -> dict:
    """The figures and the terminal method that the object has."""
    values, bad = {}, []
    for name, text in data.items():
        ratio = FIGURES.get(name)
        if ratio is None:
            continue
        v = amount(text, ratio)
        if v.__class__ is float:
            values[name] = v
        elif v is False:
            bad.append(name)
    if bad:
        wrong += [f"bad_number:{path}.{name}" for name in sorted(bad, key=_PLACE.__getitem__)]
    method = data.get("terminal_method")
    if method is not None:
        method = method.strip(" ").lower() if method.__class__ is str else "?"
        if method in METHODS:
            values["terminal_method"] = method
        elif method not in MISSING:
            wrong.append(f"bad_terminal_method:{path}")
    return values


def _latest_ratio(part: dict, whole: dict) -> float:
    common = part.keys() & whole.keys() if part else ()
    if not common:
        return 0.0
    at = max(common)
    return part[at] / whole[at] if whole[at] else 0.0


def _filled(values: dict, years: list[int], last: float) -> list[float]:
    if not values:
        return [last] * len(years)
    out = []
    for y in years:
        last = values.get(y, last)
        out.append(last)
    return out


def _merged(own: list[dict], years: list[int], forecast: list[list[float]]) -> tuple[list[int], list[list[float]]]:
    """Years and forecast of a scenario: own over the base report's, which is carried on to years of own."""
    if not any(own):
        return years, forecast
    extra = set().union(*own).difference(years)
    if extra:
        full, at, place = sorted(extra.union(years)), [], -1
        for y in full:
            place += y not in extra
            at.append(max(place, 0))
        years, forecast = full, [[b[i] for i in at] for b in forecast]
    return years, [[o.get(y, v) for y, v in zip(years, b, strict=True)] if o else b for o, b in zip(own, forecast, strict=True)]


def read(payload: str | None) -> tuple:
    """(historical, reasons, None, None) or, without reasons, (historical, [], figures of base, bull and bear, years and forecast of each)."""
    try:
        top = _plain(payload)[0]
    except (TypeError, ValueError, RecursionError):
        return _read(loads(payload), [])
    sizes: list[int] = []
    found = _read(top, sizes)
    # No key is written twice where all keys of the text are in the objects that were read; others are decoded with that in view.
    if isinstance(top, dict) and payload.count('":') == len(top) + sum(sizes) and not any(x in payload for x in _BEFORE_COLON):
        return found
    return _read(loads(payload), [])


def _read(top, sizes: list[int]) -> tuple:
    wrong: list[str] = []
    if not isinstance(top, dict):
        wrong.append("not_an_object")
        top = _NONE
    h, f, a, s = [_child(top, n, "", wrong, sizes) for n in ("historical", "forecast", "assumptions", "scenarios")]
    sides = [(path, _child(s, m, "scenarios.", wrong, sizes)) for m, path in _SIDES]
    parts = [(path, _child(side, "forecast", path, wrong, sizes), _child(side, "assumptions", path, wrong, sizes)) for path, side in sides]
    declared = amount(top.get("forecast_years"), False)
    if declared is False:
        wrong.append("bad_number:forecast_years")
    inside: list[str] = []
    named: set[int] = set()
    past = series(h, HISTORY, "historical.", False, inside, sizes)
    given = series(f, DRIVERS, "forecast.", True, inside, sizes, named)
    found = figures(a, "assumptions", inside)
    own = [(series(forecast, DRIVERS, path + "forecast.", True, inside, sizes), figures(assumptions, path + "assumptions", inside)) for path, forecast, assumptions in parts]
    revenue, ebit, *others = past
    common = revenue.keys() & ebit.keys()
    if not revenue:
        wrong.append("missing_historical_revenue")
    if not ebit:
        wrong.append("missing_historical_ebit")
    if revenue and ebit and not common:
        wrong.append("no_common_year")
    # NaN is above all numbers in Spark.
    if found.get("wacc", 0.0) <= 0:
        wrong.append("missing_wacc")
    if found.get("diluted_shares", 0.0) <= 0:
        wrong.append("missing_diluted_shares")
    wrong += inside
    if wrong:
        return past, wrong, None, None
    if named:
        years = sorted(named)
    else:
        last, n = max(common), round(declared or 0.0) or YEARS
        if abs(n) >= 1 << 31:
            raise OverflowError(f"forecast_years: {n}")  # as the cast to int
        years = list(range(last + 1, last + max(n, 1) + 1))
    margin = found["target_ebit_margin"] if not given[1] and "target_ebit_margin" in found else _latest_ratio(ebit, revenue)
    starts = [0.0, margin, *[_latest_ratio(x, revenue) for x in others]]
    filled = [_filled(g, years, start) for g, start in zip(given, starts, strict=True)]
    return past, wrong, (found, *[x[1] for x in own]), ((years, filled), *[_merged(x[0], years, filled) for x in own])


_FIGURES_TYPE = ", ".join([*[f"{f}: double" for f in FIGURES], "terminal_method: string"])
_FORECAST_TYPE = ", ".join(f"{d}: map<int,double>" for d in DRIVERS)
_SCENARIO_TYPE = f"struct<years: array<int>, forecast: struct<{_FORECAST_TYPE}>, base: struct<{_FIGURES_TYPE}>>"
#: Columns of read_batch.
COLUMNS = {
    "historical": f"struct<{', '.join(f'{n}: struct<values: map<int,double>>' for n in HISTORY)}>", "years": "array<int>", "forecast": f"struct<{_FORECAST_TYPE}>", "base": f"struct<{_FIGURES_TYPE}>",
    "bull": _SCENARIO_TYPE, "bear": _SCENARIO_TYPE, "flags": "array<string>", "reasons": "array<string>"}


class _Maps:
    """Maps of one set of keys, for several columns."""

    def __init__(self, columns: int):
        self.ends, self.keys, self.values = [0], [], [[] for _ in range(columns)]

    def add(self, keys: Iterable[int], values: list[Iterable[float]]) -> None:
        self.keys += keys
        self.ends.append(len(self.keys))
        for column, more in zip(self.values, values, strict=True):
            column += more

    def skip(self) -> None:
        self.ends.append(len(self.keys))

    def arrays(self, missing: pa.Array | None = None) -> tuple[pa.Array, list[pa.Array]]:
        """The keys as lists, and a map for each column."""
        ends, keys = pa.array(self.ends, pa.int32()), pa.array(self.keys, pa.int32())
        return pa.ListArray.from_arrays(ends, keys, mask=missing), [pa.MapArray.from_arrays(ends, keys, pa.array(v, pa.float64())) for v in self.values]


def _struct(columns: dict[str, pa.Array], missing: pa.Array | None = None) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns), mask=missing)


def _typed(columns: dict[str, list]) -> dict[str, pa.Array]:
    return {f: pa.array(x, pa.string() if f == "terminal_method" else pa.float64()) for f, x in columns.items()}


def read_batch(payloads: list[str | None]) -> list[pa.Array]:
    """The arrays of COLUMNS; those after historical are null for reports with reasons, except these."""
    n = len(payloads)
    past, scenarios = [_Maps(1) for _ in HISTORY], [_Maps(len(DRIVERS)) for _ in range(3)]
    base = {f: [DEFAULTS.get(f)] * n for f in FIGURES} | {"terminal_method": ["average"] * n}
    changed: list[list[tuple]] = [[], []]
    missing, flags, reasons = [False] * n, [None] * n, [[]] * n
    for i, payload in enumerate(payloads):
        history, wrong, found, forecasts = read(payload)
        for m, d in zip(past, history, strict=True):
            m.add(d, [d.values()]) if d else m.skip()
        if wrong:
            missing[i], reasons[i] = True, [w.encode("utf-8", "replace").decode() for w in wrong]
            for m in scenarios:
                m.skip()
            continue
        for m, (years, forecast) in zip(scenarios, forecasts, strict=True):
            m.add(years, forecast)
        flags[i] = [f"default_{f}" for f in ("tax_rate", "terminal_growth") if f not in found[0]]
        for f, x in found[0].items():
            base[f][i] = x
        for side, own in zip(changed, found[1:], strict=True):
            side += [(f, i, x) for f, x in own.items()]
    gone, figures = pa.array(missing, pa.bool_()), [_typed(base)]
    for side in changed:
        own = {f: list(base[f]) for f in {c[0] for c in side}}
        for f, i, x in side:
            own[f][i] = x
        figures.append(figures[0] | _typed(own))
    three = []
    for m, f in zip(scenarios, figures, strict=True):
        years, drivers = m.arrays(gone)
        three.append({"years": years, "forecast": _struct(dict(zip(DRIVERS, drivers, strict=True)), gone), "base": _struct(f, gone)})
    historical = _struct({name: _struct({"values": m.arrays()[1][0]}) for name, m in zip(HISTORY, past, strict=True)})
    return [historical, *three[0].values(), *[_struct(x, gone) for x in three[1:]], pa.array(flags, pa.list_(pa.string())), pa.array(reasons, pa.list_(pa.string()))]


def reader(payload: str):
    """Function for mapInArrow: COLUMNS behind those of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = read_batch(batch.column(payload).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *COLUMNS])

    return run
