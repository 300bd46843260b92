"""Pipelines over streams, and results as streams of JSON lines."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame

from adtflow.engine import Engine, Result
from adtflow.errors import QueryError
from adtflow.lang import nodes as N
from adtflow.lang.parser import parse_query

#: Stages that work row by row, or by a group that Spark keeps as state.
STREAMABLE = (N.Let, N.Filter, N.Derive, N.Select, N.Aggregate)


def over_stream(engine: Engine, name: str, stream: DataFrame, query: str, required: str | tuple[str, ...] = (), watermark: tuple[str, str] | None = None, **params: Any) -> Result:
    """A query over a streaming DataFrame, to be written with writeStream.

    Stages that need all rows (sort, take, page, windows, sets, lookups) are refused. With a watermark (column, delay) late rows are
    dropped and the state of groups by event time is bounded.
    """
    if not stream.isStreaming:
        raise QueryError("E_STREAM", f"{name} is no stream")
    node = parse_query(query)
    for s in node.stages:
        if not isinstance(s, STREAMABLE):
            raise QueryError("E_STREAM", f"{type(s).__name__.lower()} needs all rows of the stream", s.place)
    if sum(isinstance(s, N.Aggregate) for s in node.stages) > 1:
        raise QueryError("E_STREAM", "a stream is aggregated once")
    engine.register(name, stream.withWatermark(*watermark) if watermark else stream, required)
    return engine.query(node, **params)


def _json(x: Any) -> Any:
    if isinstance(x, (dt.datetime, dt.date)):
        return x.isoformat() + ("Z" if isinstance(x, dt.datetime) else "")
    if isinstance(x, dt.timedelta):
        return {"microseconds": x // dt.timedelta(microseconds=1)}
    if isinstance(x, decimal.Decimal):
        return str(x)
    if isinstance(x, (bytes, bytearray)):
        return base64.b64encode(x).decode()
    raise TypeError(type(x))


def json_lines(result: Result, cancelled: Callable[[], bool] = lambda: False) -> Iterator[str]:
    """A header with the columns, a line for each row as partitions arrive, and a trailer with the count.

    cancelled is asked before each row; once it is true the rest isn't computed and the trailer says so. A page's trailer has its cursors.
    """
    yield json.dumps({"columns": [{"name": n, "type": repr(t)} for n, t in result.columns.items()]})
    if result.page is not None:
        rows, before, after = result.paged()
        for row in rows:
            yield json.dumps({"row": row}, default=_json, ensure_ascii=False)
        yield json.dumps({"rows": len(rows), "before": before, "after": after})
        return
    n = 0
    for row in result.stream():
        if cancelled():
            yield json.dumps({"cancelled": True, "rows": n})
            return
        yield json.dumps({"row": row}, default=_json, ensure_ascii=False)
        n += 1
    yield json.dumps({"rows": n})
