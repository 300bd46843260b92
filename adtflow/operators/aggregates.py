"""Aggregates with their types, typed empty results and checked sums."""

from __future__ import annotations

import decimal
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtflow.errors import QueryError
from adtflow.functions import arithmetic as A
from adtflow.functions.scalars import Typed, decimal_type, interval, micros, mode_of
from adtflow.types import DURATION, FLOAT, INT, Decimal, Option, Registry


def _average(r: Registry, x: Typed) -> Typed:
    own = r.resolve(x.type)
    if own == INT:
        return Typed(Option(FLOAT), F.avg(x.col.cast("double")))
    if own == FLOAT:
        mean = F.avg(x.col)
        return Typed(Option(x.type), F.when(mean.isNotNull(), A.finite(mean)))
    if own == DURATION:
        total = F.sum(micros(x.col).cast("decimal(38,0)"))
        n = F.count(x.col)
        # the rest has the sign of the total, so that the quotient is truncated
        whole = ((total - total % n.cast("decimal(20,0)")).cast("decimal(28,0)") / n.cast("decimal(20,0)")).cast("long")
        return Typed(Option(x.type), F.when(n > 0, interval(whole)))
    raise QueryError("E_TYPE", f"{x.type!r} has no average")


def _sum(r: Registry, x: Typed) -> Typed:
    own = r.resolve(x.type)
    if own == INT:
        return Typed(x.type, F.coalesce(F.sum(x.col), F.lit(0).cast("long")))
    if own == FLOAT:
        return Typed(x.type, A.finite(F.coalesce(F.sum(x.col), F.lit(0.0))))
    if own == DURATION:
        # summed as decimals: partial sums can't overflow, and the end result is checked
        total = F.coalesce(F.sum(micros(x.col).cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)"))
        return Typed(x.type, interval(A.checked(F.abs(total) < F.lit(decimal.Decimal(2**63)).cast("decimal(38,0)"), "E_ARITH: the duration is out of range", total.cast("long"))))
    if isinstance(own, Decimal):
        total = F.coalesce(F.sum(x.col), F.lit(0).cast(T.DecimalType(own.precision, own.scale)))
        return Typed(x.type, A.cast_decimal(total, own))
    raise QueryError("E_TYPE", f"{x.type!r} has no sum")


def _extreme(r: Registry, x: Typed, function: Any) -> Typed:
    if isinstance(r.resolve(x.type), Option):  # None takes part as the least value
        return Typed(Option(x.type), F.when(F.count(F.lit(1)) > 0, F.struct(function(F.struct(x.col.alias("v")))["v"].alias("v"))))
    return Typed(Option(x.type), function(x.col))


def _decimal_average(r: Registry, x: Typed, extra: tuple) -> Typed:
    own = r.resolve(x.type)
    if not isinstance(own, Decimal):
        raise QueryError("E_TYPE", f"{x.type!r} is no decimal")
    t, mode = decimal_type(extra[0], extra[1]), mode_of(extra[2])
    wide = Decimal(min(38, own.precision + 10), own.scale)
    mean = A.divide_decimal(F.sum(x.col).cast(T.DecimalType(wide.precision, wide.scale)), wide, F.count(x.col).cast("decimal(19,0)"), Decimal(19, 0), t, mode)
    return Typed(Option(t), F.when(F.count(x.col) > 0, mean))


def build(r: Registry, function: str, x: Typed | None, extra: tuple) -> Typed:
    """The aggregate as a column with its result's type."""
    if function == "count":
        return Typed(INT, F.count(F.lit(1)))
    assert x is not None
    if function == "count_distinct":  # in a struct, so that None counts as a value
        return Typed(INT, F.count_distinct(F.struct(x.col)))
    if function == "decimal_avg":
        return _decimal_average(r, x, extra)
    if function == "avg":
        return _average(r, x)
    if function == "sum":
        return _sum(r, x)
    return _extreme(r, x, F.min if function == "min" else F.max)


