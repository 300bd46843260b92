"""Checked arithmetic: errors instead of infinities, lost digits or silent overflow."""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtflow.types import Decimal


def fail(message: str) -> Column:
    return F.raise_error(F.lit(message))


def checked(condition: Column, message: str, value: Column) -> Column:
    """value where condition holds, an error where it is false; nulls pass."""
    return F.when(~condition, fail(message)).otherwise(value)


def finite(x: Column) -> Column:
    """x unless it is infinite or no number; negative zero becomes zero."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return checked(~bad, "E_ARITH: the result isn't finite", x + F.lit(0.0))


def int_divide(a: Column, b: Column) -> Column:
    """Truncating division of longs; Spark raises on zero and on overflow."""
    return F.call_function("div", a, b)


def int_to_float(x: Column) -> Column:
    """Exact only; compared as decimals, since casting the float back may overflow."""
    f = x.cast("double")
    return checked(f.cast("decimal(38,0)") == x.cast("decimal(38,0)"), "E_CAST_PRECISION: the float isn't exact", f)


def rounded_float(x: Column, mode: str) -> Column:
    whole = {
        "exact": F.rint(x),
        "toward_zero": F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)),
        "away_from_zero": F.when(x < 0, F.floor(x)).otherwise(F.ceil(x)),
        "floor": F.floor(x),
        "ceil": F.ceil(x),
        "half_even": F.rint(x),
    }
    if mode == "half_up":
        down = F.when(x < 0, -F.floor(-x).cast("double")).otherwise(F.floor(x).cast("double"))
        return F.when(F.abs(x) >= 2.0**52, x).otherwise(F.when(F.abs(x - down) >= 0.5, down + F.signum(x)).otherwise(down))
    return F.when(F.abs(x) >= 2.0**52, x).otherwise(whole[mode].cast("double"))


def float_to_int(x: Column, mode: str) -> Column:
    r = rounded_float(x, mode)
    if mode == "exact":
        r = checked(r == x, "E_CAST_PRECISION: the float has a fraction", r)
    return checked((r >= -(2.0**63)) & (r < 2.0**63), "E_CAST_RANGE: the integer is out of range", r.cast("long"))


def cast_decimal(x: Column, t: Decimal, code: str = "E_ARITH") -> Column:
    """x, which has no more digits after the point than t, as t; an error where it has more before it."""
    limit = decimal.Decimal(10) ** (t.precision - t.scale)
    whole = T.DecimalType(min(38, t.precision - t.scale + 1), 0)
    fits = F.lit(True) if t.precision - t.scale >= 38 else F.abs(x) < F.lit(limit).cast(whole)
    return checked(fits, f"{code}: the decimal doesn't fit Decimal<{t.precision}, {t.scale}>", x.cast(T.DecimalType(t.precision, t.scale)))


def round_decimal(x: Column, t: Decimal, mode: str, code: str = "E_ARITH") -> Column:
    s = F.lit(t.scale)
    if mode in ("half_up", "exact"):
        r = F.round(x, t.scale)
    elif mode == "half_even":
        r = F.bround(x, t.scale)
    elif mode == "floor":
        r = F.floor(x, s)
    elif mode == "ceil":
        r = F.ceil(x, s)
    elif mode == "toward_zero":
        r = F.when(x < 0, F.ceil(x, s)).otherwise(F.floor(x, s))
    else:
        r = F.when(x < 0, F.floor(x, s)).otherwise(F.ceil(x, s))
    if mode == "exact":
        r = checked(r == x, f"{code}: rounding would lose digits", r)
    return cast_decimal(r, t, code)


_ROUNDING = {
    "half_up": decimal.ROUND_HALF_UP,
    "half_even": decimal.ROUND_HALF_EVEN,
    "floor": decimal.ROUND_FLOOR,
    "ceil": decimal.ROUND_CEILING,
    "toward_zero": decimal.ROUND_DOWN,
    "away_from_zero": decimal.ROUND_UP,
    "exact": decimal.ROUND_DOWN,
}


def _exact(op: str, t: Decimal, mode: str):
    """A pandas function for results beyond 38 digits, rounded once."""

    def one(a: decimal.Decimal | None, b: decimal.Decimal | None) -> decimal.Decimal | None:
        if a is None or b is None:
            return None
        with decimal.localcontext(prec=160):
            if op == "/":
                if b == 0:
                    raise ValueError("E_ARITH: division by zero")
                n, d = (a * decimal.Decimal(10) ** t.scale).as_integer_ratio(), b.as_integer_ratio()
                num, den = n[0] * d[1], n[1] * d[0]
                if den < 0:
                    num, den = -num, -den
                q, r = divmod(abs(num), den)
                # the rest alone decides ties, so a half stands for any rest on its side
                extra = decimal.Decimal(0) if not r else decimal.Decimal(5 if 2 * r == den else 3 if 2 * r < den else 7) / 10
                x = (decimal.Decimal(q) + extra) * (-1 if num < 0 else 1)
                rounded = x.to_integral_value(_ROUNDING[mode])
                if mode == "exact" and rounded != x:
                    raise ValueError("E_ARITH: rounding would lose digits")
                out = rounded.scaleb(-t.scale)
            else:
                x = a * b
                out = x.quantize(decimal.Decimal(1).scaleb(-t.scale), _ROUNDING[mode])
                if mode == "exact" and out != x:
                    raise ValueError("E_ARITH: rounding would lose digits")
            if abs(out) >= decimal.Decimal(10) ** (t.precision - t.scale):
                raise ValueError(f"E_ARITH: the decimal doesn't fit Decimal<{t.precision}, {t.scale}>")
            return out

    @F.pandas_udf(T.DecimalType(t.precision, t.scale))
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return run


def multiply_decimal(a: Column, at: Decimal, b: Column, bt: Decimal, t: Decimal, mode: str) -> Column:
    """Exact product, rounded once: in the JVM where the product has at most 38 digits."""
    if at.precision + bt.precision + 1 <= 38:
        return round_decimal(a * b, t, mode)
    return _exact("*", t, mode)(a, b)


def divide_decimal(a: Column, at: Decimal, b: Column, bt: Decimal, t: Decimal, mode: str) -> Column:
    """Quotient of integers, rounded once by its rest: in the JVM where numerator and denominator have at most 28 digits."""
    up = t.scale + bt.scale - at.scale
    top, bottom = at.precision + max(0, up), bt.precision + max(0, -up)
    if top > 28 or bottom > 28:
        return _exact("/", t, mode)(a, b)
    whole = T.DecimalType(28, 0)
    n = (a.cast(T.DecimalType(38, at.scale)) * F.lit(decimal.Decimal(10) ** (at.scale + max(0, up))).cast(whole) if at.scale + max(0, up) else a).cast(whole)
    d = (b.cast(T.DecimalType(38, bt.scale)) * F.lit(decimal.Decimal(10) ** (bt.scale + max(0, -up))).cast(whole) if bt.scale + max(0, -up) else b).cast(whole)
    d = checked(d != 0, "E_ARITH: division by zero", d)
    r = n % d
    q = ((n - r) / d).cast(T.DecimalType(32, 0))
    step = F.when((n < 0) == (d < 0), 1).otherwise(-1).cast(T.DecimalType(32, 0))
    none, twice = r == 0, F.abs(r) * 2
    odd = F.abs(q) % 2 == 1
    away = {
        "exact": F.lit(False),
        "toward_zero": F.lit(False),
        "away_from_zero": ~none,
        "floor": ~none & (step < 0),
        "ceil": ~none & (step > 0),
        "half_up": twice >= F.abs(d),
        "half_even": (twice > F.abs(d)) | (twice == F.abs(d)) & odd,
    }[mode]
    out = F.when(away, q + step).otherwise(q)
    if mode == "exact":
        out = checked(none, "E_ARITH: rounding would lose digits", out)
    unit = F.lit(decimal.Decimal(1).scaleb(-t.scale)).cast(T.DecimalType(t.scale + 1 if t.scale < 38 else 38, t.scale))
    limit = decimal.Decimal(10) ** min(t.precision, 32)
    fits = F.abs(out) < F.lit(limit).cast(T.DecimalType(38, 0)) if t.precision <= 32 else F.lit(True)
    small = T.DecimalType(min(t.precision + 1, 32), 0)
    return checked(fits, f"E_ARITH: the decimal doesn't fit Decimal<{t.precision}, {t.scale}>", (out.cast(small) * unit).cast(T.DecimalType(t.precision, t.scale)))
