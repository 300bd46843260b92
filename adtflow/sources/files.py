"""Parquet tables as typed sources."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtflow.errors import QueryError
from adtflow.plans.expressions import column
from adtflow.plans.pipeline import Index, Source
from adtflow.types import Field, Option, Record, from_spark_type


def _widened(x: Any, d: T.DataType, nullable: bool) -> Any:
    """A column in the encoding of its type: wide numbers, times without zone, maps as sorted entries."""
    if isinstance(d, (T.ByteType, T.ShortType, T.IntegerType)):
        return x.cast("long")
    if isinstance(d, T.FloatType):
        return x.cast("double")
    if isinstance(d, T.TimestampType):
        return x.cast("timestamp_ntz")
    if isinstance(d, T.ArrayType) and _changes(d.elementType):
        return F.transform(x, lambda e: _widened(e, d.elementType, d.containsNull))
    if isinstance(d, T.StructType) and _changes(d):
        s = F.struct(*(_widened(x[f.name], f.dataType, f.nullable).alias(f.name) for f in d.fields))
        return F.when(x.isNotNull(), s) if nullable else s
    if isinstance(d, T.MapType):
        return F.transform(F.array_sort(F.map_entries(x)), lambda e: F.struct(e["key"].alias("key"), _widened(e["value"], d.valueType, d.valueContainsNull).alias("value")))
    return x


def _changes(d: T.DataType) -> bool:
    if isinstance(d, T.StructType):
        return any(_changes(f.dataType) for f in d.fields)
    return isinstance(d, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.TimestampType, T.MapType)) or isinstance(d, T.ArrayType) and _changes(d.elementType)


def from_frame(name: str, frame: DataFrame, required: Sequence[str] | str = (), key: str | None = None, indexes: Sequence[Sequence[str]] = ()) -> Source:
    """A DataFrame as a table. Nullable columns are options, but for the required ones ('all': every column).

    What is declared required isn't scanned to prove it; where a null occurs, it is an error of the query that meets it only in so
    far as conditions on it aren't true. from_parquet(verify=True) proves it once.
    """
    cols, types = [], {}
    for f in frame.schema.fields:
        must = required == "all" or f.name in required
        types[f.name] = from_spark_type(f.dataType, f.nullable and not must)
        x = column(f.name)
        new = _widened(x, f.dataType, f.nullable)
        cols.append(x if new is x else new.alias(f.name))
    built = frame.select(*cols)
    row = Record(tuple(Field(k, v) for k, v in types.items()))
    return Source(name, types, lambda: built, row, key, [Index(tuple((c, False) for c in i)) for i in indexes])


def from_parquet(spark: SparkSession, path: str, name: str = "data", required: Sequence[str] | str = (), key: str | None = None, verify: bool = False) -> Source:
    """A Parquet file or folder as a table; Spark prunes columns and pushes filters by itself."""
    frame = spark.read.parquet(path)
    source = from_frame(name, frame, required, key)
    if verify:
        must = [f.name for f in frame.schema.fields if f.nullable and not isinstance(source.columns[f.name], Option)]
        counts = frame.agg(*(F.count_if(column(c).isNull()).alias(c) for c in must)).first() if must else {}
        bad = [c for c in must if counts[c]]
        if bad:
            raise QueryError("E_CONSTRAINT", f"required column {bad[0]} has {counts[bad[0]]} nulls")
    return source


def preview(spark: SparkSession, path: str, columns: Sequence[str] = (), offset: int = 0, limit: int = 20) -> DataFrame:
    """Some rows and columns of a Parquet table, at most 1000 rows."""
    if not 0 <= limit <= 1000:
        raise QueryError("E_LIMIT", "a preview has at most 1000 rows")
    frame = spark.read.parquet(path)
    if unknown := set(columns) - set(frame.columns):
        raise QueryError("E_FIELD", f"unknown column {sorted(unknown)[0]}")
    return (frame.select(*map(column, columns)) if columns else frame).offset(offset).limit(limit)


def metadata(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """Name and type of every column."""
    return [{"name": f.name, "type": repr(from_spark_type(f.dataType, f.nullable)), "nullable": f.nullable} for f in spark.read.parquet(path).schema.fields]


