"""The built-in scalar functions: their types and their columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtflow.errors import QueryError
from adtflow.functions import arithmetic as A
from adtflow.functions.literals import offset
from adtflow.lang.parser import MODES
from adtflow.types import BOOL, BYTES, DATE, DURATION, FLOAT, INT, TEXT, TIMESTAMP, UUID, Decimal, List, Map, Option, Registry, Scalar, Tuple, Type

FIRST, LAST = dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999)
TRUNCATIONS = ("year", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond")


@dataclass
class Typed:
    """A column with its type."""

    type: Type
    col: Column


@dataclass(frozen=True)
class Function:
    """takes: types of the arguments, where None means any type; literals: how many literal arguments follow them."""

    takes: tuple[Type | None, ...]
    build: Callable[..., Typed]
    literals: int = 0


def micros(x: Column) -> Column:
    """Microseconds of an interval of days to seconds, as a long."""
    return F.call_function("div", (F.extract(F.lit("DAY"), x).cast("long") * 24 + F.extract(F.lit("HOUR"), x)) * 3600 + F.extract(F.lit("MINUTE"), x) * 60, F.lit(1)).cast("long") * 1_000_000 + (
        F.extract(F.lit("SECOND"), x).cast("decimal(18,6)") * 1_000_000
    ).cast("long")


def interval(us: Column) -> Column:
    """An interval of so many microseconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0)) + F.lit(dt.timedelta(microseconds=1)) * us


def in_range(t: Column) -> Column:
    """A timestamp of the years 1 to 9999, or an error."""
    return A.checked((t >= F.lit(FIRST).cast("timestamp_ntz")) & (t <= F.lit(LAST).cast("timestamp_ntz")), "E_ARITH: the timestamp is out of range", t)


def shift(us: int) -> Column:
    return F.lit(dt.timedelta(microseconds=us))


def sequence_length(t: Type, x: Column) -> Column:
    if t == TEXT:
        return F.char_length(x).cast("long")
    return (F.octet_length(x) if t == BYTES else F.size(x)).cast("long")


def _substring(s: Column, a: Column, b: Column) -> Column:
    ok = (a >= 0) & (a <= b) & (b <= F.char_length(s))
    return A.checked(ok, "E_TEXT_RANGE: the range is outside of the text", F.substring(s, (a + 1).cast("int"), (b - a).cast("int")))


def _trim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def _float_text(x: pd.Series) -> pd.Series:
    """The shortest text that reads back as the same float, with a point or an exponent."""

    def one(v: float) -> str | None:
        if pd.isna(v):
            return None
        s = repr(float(v) + 0.0)
        if "e" in s:
            base, _, exponent = s.partition("e")
            return f"{base}e{int(exponent)}"
        return s

    return x.map(one, na_action="ignore")


def to_text(t: Type, x: Column) -> Column:
    if t == FLOAT:
        return _float_text(x)
    if t == BYTES:
        return F.lower(F.hex(x))
    if t == TIMESTAMP:
        fraction = F.date_format(x, "SSSSSS")
        return F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), F.rtrim(fraction, F.lit("0")))), F.lit("Z"))
    if t == DURATION:
        us = micros(x)
        out = F.concat(us.cast("string"), F.lit("microseconds"))
        for name, unit in (("milliseconds", 1000), ("seconds", 10**6), ("minutes", 6 * 10**7), ("hours", 36 * 10**8), ("days", 864 * 10**8), ("weeks", 6048 * 10**8)):
            out = F.when((us != 0) & (us % unit == 0), F.concat(F.call_function("div", us, F.lit(unit)).cast("string"), F.lit(name))).otherwise(out)
        return out
    return x.cast("string")


def _parsed(pattern: str, x: Column, value: Column, what: str) -> Column:
    return A.checked(x.rlike(pattern), f"E_CAST_FORMAT: the text is no {what}", F.when(x.rlike(pattern), value))


def _parse_timestamp(x: Column) -> Column:
    pattern = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"
    local = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(x, r"([Zz]|[+-]\d\d:\d\d)$", ""), "T", " ")).cast("timestamp_ntz")
    sign = F.regexp_extract(x, r"([+-])\d\d:\d\d$", 1)
    minutes = F.regexp_extract(x, r"[+-](\d\d):\d\d$", 1), F.regexp_extract(x, r"[+-]\d\d:(\d\d)$", 1)
    us = (F.nullif(minutes[0], F.lit("")).cast("long") * 60 + F.nullif(minutes[1], F.lit("")).cast("long")) * 60_000_000
    out = local - interval(F.coalesce(F.when(sign == "-", -us).otherwise(us), F.lit(0).cast("long")))
    ok = x.rlike(pattern) & ~x.endswith("-00:00") & local.isNotNull()
    return F.when(x.isNull(), F.lit(None).cast("timestamp_ntz")).when(ok, out).otherwise(A.fail("E_CAST_FORMAT: the text is no timestamp with an offset"))


def _parse_duration(x: Column) -> Column:
    from adtflow.lang.lexer import UNITS

    unit = F.regexp_extract(x, r"^-?\d+([a-z]+?)s?$", 1)
    number = F.regexp_extract(x, r"^(-?\d+)[a-z]+$", 1)
    factor = F.coalesce(*(F.when(unit == k, F.lit(v).cast("long")) for k, v in UNITS.items()))
    ok = x.rlike(r"^-?\d{1,18}[a-z]+$") & factor.isNotNull()
    return F.when(x.isNull(), F.lit(None).cast("interval day to second")).when(ok, interval(F.nullif(number, F.lit("")).cast("long") * factor)).otherwise(A.fail("E_CAST_FORMAT: the text is no duration"))


def _truncate(t: Column, unit: str, off: int) -> Column:
    local = t + shift(off) if off else t
    cut = F.date_trunc(unit, local).cast("timestamp_ntz")
    return in_range(cut - shift(off) if off else cut)


def _of(t: Type, build: Callable[..., Column]) -> Callable[..., Typed]:
    return lambda _, *xs: Typed(t, build(*(x.col for x in xs)))


def _scalar(r: Registry, x: Typed) -> Type:
    t = r.resolve(x.type)
    if not isinstance(t, (Scalar, Decimal)):
        raise QueryError("E_TYPE", f"{x.type!r} is no scalar")
    return t


def _length(r: Registry, x: Typed) -> Typed:
    t = r.resolve(x.type)
    if t not in (TEXT, BYTES) and not isinstance(t, (List, Map)):
        raise QueryError("E_TYPE", f"{x.type!r} has no length")
    return Typed(INT, sequence_length(t, x.col))


def decimal_type(p: Any, s: Any) -> Decimal:
    if not (isinstance(p, int) and isinstance(s, int) and 1 <= p <= 38 and 0 <= s <= p):
        raise QueryError("E_DECIMAL_TYPE", f"no decimal has precision {p!r} and scale {s!r}")
    return Decimal(p, s)


def mode_of(x: Any, code: str = "E_TYPE") -> str:
    if x not in MODES:
        raise QueryError(code, f"unknown rounding mode {x!r}")
    return x


def _decimal(r: Registry, x: Typed) -> Decimal:
    t = r.resolve(x.type)
    if not isinstance(t, Decimal):
        raise QueryError("E_TYPE", f"{x.type!r} is no decimal")
    return t


def _decimal_two(run: Callable[..., Column]) -> Callable[..., Typed]:
    def build(r: Registry, a: Typed, b: Typed, p: Any, s: Any, mode: Any) -> Typed:
        t = decimal_type(p, s)
        return Typed(t, run(a.col, _decimal(r, a), b.col, _decimal(r, b), t, mode_of(mode)))

    return build


def _decimal_round(r: Registry, x: Typed, p: Any, s: Any, mode: Any) -> Typed:
    _decimal(r, x)
    t = decimal_type(p, s)
    return Typed(t, A.round_decimal(x.col, t, mode_of(mode)))


def _decimal_rescale(r: Registry, x: Typed, p: Any, s: Any) -> Typed:
    _decimal(r, x)
    t = decimal_type(p, s)
    return Typed(t, A.round_decimal(x.col, t, "exact"))


def _decimal_parse(r: Registry, x: Typed, p: Any, s: Any) -> Typed:
    t = decimal_type(p, s)
    pattern = rf"^-?\d{{1,{max(1, p - s)}}}" + (rf"(\.\d{{1,{s}}})?$" if s else "$")
    return Typed(t, _parsed(pattern, x.col, A.cast_decimal(F.when(x.col.rlike(pattern), x.col).cast(r.spark(t)), t), f"Decimal<{p}, {s}>"))


def _int_to_decimal(r: Registry, x: Typed, p: Any, s: Any) -> Typed:
    t = decimal_type(p, s)
    return Typed(t, A.cast_decimal(x.col.cast("decimal(19,0)"), t, "E_DECIMAL_RANGE"))


def _float_to_int(r: Registry, x: Typed, mode: Any) -> Typed:
    return Typed(INT, A.float_to_int(x.col, mode_of(mode, "E_CAST_MODE")))


def _date_of(r: Registry, x: Typed, off: Any) -> Typed:
    us = offset(off if isinstance(off, str) else repr(off))
    return Typed(DATE, (x.col + shift(us) if us else x.col).cast("date"))


def _timestamp_trunc(r: Registry, x: Typed, unit: Any, off: Any) -> Typed:
    if unit not in TRUNCATIONS:
        raise QueryError("E_TYPE", f"unknown unit {unit!r}")
    return Typed(TIMESTAMP, _truncate(x.col, unit, offset(off if isinstance(off, str) else repr(off))))


def _map(r: Registry, x: Typed) -> Map:
    t = r.resolve(x.type)
    if not isinstance(t, Map):
        raise QueryError("E_TYPE", f"{x.type!r} is no map")
    return t


def _get(r: Registry, m: Typed, k: Typed) -> Typed:
    t = _map(r, m)
    inner = r.resolve(t.of)
    at = F.get(F.filter(m.col, lambda e: e["key"] == k.col), F.lit(0))
    return Typed(Option(t.of), F.when(at.isNotNull(), F.struct(at["value"].alias("v"))) if isinstance(inner, Option) else at["value"])


# The language's function names. Arguments of any type are checked by the builder.
FUNCTIONS: dict[str, Function] = {
    "length": Function((None,), _length),
    "lower": Function((TEXT,), _of(TEXT, F.lower)),
    "upper": Function((TEXT,), _of(TEXT, F.upper)),
    "trim": Function((TEXT,), _of(TEXT, _trim)),
    "concat": Function((TEXT, TEXT), _of(TEXT, F.concat)),
    "substring": Function((TEXT, INT, INT), _of(TEXT, _substring)),
    "starts_with": Function((TEXT, TEXT), _of(BOOL, F.startswith)),
    "ends_with": Function((TEXT, TEXT), _of(BOOL, F.endswith)),
    "contains_text": Function((TEXT, TEXT), _of(BOOL, F.contains)),
    "int_to_float": Function((INT,), _of(FLOAT, A.int_to_float)),
    "float_to_int": Function((FLOAT,), _float_to_int, 1),
    "int_to_decimal": Function((INT,), _int_to_decimal, 2),
    "decimal_parse": Function((TEXT,), _decimal_parse, 2),
    "decimal_rescale": Function((None,), _decimal_rescale, 2),
    "decimal_round": Function((None,), _decimal_round, 3),
    "decimal_mul": Function((None, None), _decimal_two(A.multiply_decimal), 3),
    "decimal_div": Function((None, None), _decimal_two(A.divide_decimal), 3),
    "to_text": Function((None,), lambda r, x: Typed(TEXT, to_text(_scalar(r, x), x.col))),
    "uuid_parse": Function((TEXT,), _of(UUID, lambda x: _parsed(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", x, F.lower(x), "UUID"))),
    "bytes_parse_hex": Function((TEXT,), _of(BYTES, lambda x: _parsed(r"^([0-9a-fA-F]{2})*$", x, F.unhex(x), "even number of hex digits"))),
    "date_parse": Function((TEXT,), _of(DATE, lambda x: _parsed(r"^(?!0000)\d{4}-\d\d-\d\d$", x, x.cast("date"), "date"))),
    "timestamp_parse": Function((TEXT,), _of(TIMESTAMP, _parse_timestamp)),
    "duration_parse": Function((TEXT,), _of(DURATION, _parse_duration)),
    "date_of": Function((TIMESTAMP,), _date_of, 1),
    "timestamp_trunc": Function((TIMESTAMP,), _timestamp_trunc, 2),
    "contains_key": Function((None, TEXT), lambda r, m, k: Typed(BOOL, F.exists(m.col, lambda e: e["key"] == k.col)) if _map(r, m) else None),
    "get": Function((None, TEXT), _get),
    "keys": Function((None,), lambda r, m: Typed(List(TEXT), F.transform(m.col, lambda e: e["key"])) if _map(r, m) else None),
    "values": Function((None,), lambda r, m: Typed(List(_map(r, m).of), F.transform(m.col, lambda e: e["value"]))),
    "entries": Function((None,), lambda r, m: Typed(List(Tuple((TEXT, _map(r, m).of))), F.transform(m.col, lambda e: F.struct(e["key"].alias("_1"), e["value"].alias("_2"))))),
}
