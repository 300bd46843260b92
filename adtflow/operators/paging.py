"""Keyset pages: the rows after or before a boundary in a unique order, with signed cursors."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import hashlib
import hmac
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from adtflow.errors import QueryError


MAX_CURSOR = 8192


def _plain(x: Any) -> Any:
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if isinstance(x, (dt.datetime, dt.date)):
        return {type(x).__name__: x.isoformat()}
    if isinstance(x, dt.timedelta):
        return {"us": (x.days * 86400 + x.seconds) * 10**6 + x.microseconds}
    if isinstance(x, decimal.Decimal):
        return {"decimal": str(x)}
    if isinstance(x, (bytes, bytearray)):
        return {"bytes": bytes(x).hex()}
    return {"items": [_plain(v) for v in x]}


def _value(x: Any) -> Any:
    if not isinstance(x, dict):
        return x
    (kind, v), = x.items()
    make = {"datetime": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "us": lambda u: dt.timedelta(microseconds=u), "decimal": decimal.Decimal, "bytes": bytes.fromhex, "items": lambda xs: tuple(map(_value, xs))}
    return make[kind](v)


def encode(secret: bytes, query: str, boundary: list[Any]) -> str:
    """An opaque cursor that only this query accepts."""
    body = json.dumps([hashlib.sha256(query.encode()).hexdigest()[:16], [_plain(x) for x in boundary]], separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, "sha256").digest()[:16] + body).decode()


def decode(secret: bytes, query: str, cursor: str) -> list[Any]:
    if len(cursor) > MAX_CURSOR:
        raise QueryError("E_CURSOR_LIMIT", f"a cursor has at most {MAX_CURSOR} characters")
    try:
        raw = base64.urlsafe_b64decode(cursor.encode())
        tag, body = raw[:16], raw[16:]
        if not hmac.compare_digest(tag, hmac.new(secret, body, "sha256").digest()[:16]):
            raise ValueError("signature")
        digest, boundary = json.loads(body)
    except ValueError as e:
        raise QueryError("E_CURSOR_CODEC", "the cursor is damaged") from e
    if digest != hashlib.sha256(query.encode()).hexdigest()[:16]:
        raise QueryError("E_CURSOR_QUERY", "the cursor belongs to another query")
    return [_value(x) for x in boundary]


def beyond(keys: list[tuple[Column, Column, bool]], after: bool) -> Column:
    """Whether a row comes after (or before) the boundary: keys are (row's value, boundary's value, descending).

    The leading key's bound is stated on its own as well, as Spark can push that one down to the files.
    """
    test: Column | None = None
    for value, bound, down in reversed(keys):
        v, b = F.struct(value.alias("v")), F.struct(bound.alias("v"))
        ahead = v > b if after != down else v < b
        test = ahead if test is None else ahead | (value.eqNullSafe(bound) & test)
    assert test is not None
    value, bound, down = keys[0]
    lead = value >= bound if after != down else value <= bound
    return test & (lead | value.isNull() | bound.isNull())
