"""Errors with the codes that queries may raise."""

from __future__ import annotations


class QueryError(Exception):
    """code is stable, for example E_TYPE or E_ARITH; place is the 1-based line and column where one is known."""

    def __init__(self, code: str, message: str, place: tuple[int, int] | None = None):
        super().__init__(f"{code}: {message}" + (f" (line {place[0]}, column {place[1]})" if place else ""))
        self.code, self.message, self.place = code, message, place


#: Spark's own error classes that stand for one of the codes.
_SPARK = {"ARITHMETIC_OVERFLOW": "E_ARITH", "DIVIDE_BY_ZERO": "E_ARITH", "NUMERIC_VALUE_OUT_OF_RANGE": "E_ARITH", "INTERVAL_ARITHMETIC_OVERFLOW": "E_ARITH", "DATETIME_OVERFLOW": "E_ARITH", "CAST_OVERFLOW": "E_CAST_RANGE"}


def from_spark(error: Exception) -> QueryError | None:
    """The query error behind a failed Spark job, if there is one."""
    import re

    text = str(error)
    if m := re.search(r"\b(E_[A-Z_]+): ([^\n]*)", text):
        return QueryError(m[1], m[2].strip())
    return next((QueryError(code, name.lower().replace("_", " ")) for name, code in _SPARK.items() if name in text), None)
