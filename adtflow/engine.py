"""The engine: declared types, tables and queries over a Spark session."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from adtflow.errors import QueryError, from_spark
from adtflow.lang import nodes as N
from adtflow.lang.parser import parse
from adtflow.operators import paging
from adtflow.plans.expressions import Binder, column
from adtflow.plans.pipeline import Lowering, PageInfo, Plan, Source
from adtflow.shipping import ship_package
from adtflow.sources.files import from_frame, from_parquet
from adtflow.types import Registry, Type


@dataclass
class Result:
    """A query that is bound but not run: columns are known, frame is lazy."""

    frame: DataFrame
    columns: dict[str, Type]
    registry: Registry
    page: PageInfo | None = None
    secret: bytes = b""
    affected: int | None = None
    actions: list[str] | None = None

    def raw(self) -> list[Row]:
        try:
            return self.frame.collect()
        except Exception as e:
            found = from_spark(e)
            raise (found or e) from (e if found else None)

    def rows(self) -> list[dict[str, Any]]:
        """Decoded rows by column; of a page without the row that only tells whether there is more."""
        return self.paged()[0]

    def paged(self) -> tuple[list[dict[str, Any]], str | None, str | None]:
        """Rows, the cursor of the page before and of the page after."""
        raw = self.raw()
        before = after = None
        if self.page is not None:
            p, more = self.page, len(raw) > self.page.size
            raw = raw[: p.size]
            if p.direction == "before":
                raw.reverse()
            cursor = lambda row: paging.encode(self.secret, p.query, [row[f"__key{i}"] for i in range(len(p.keys))])
            if raw:
                after = cursor(raw[-1]) if more or p.direction == "before" else None
                before = cursor(raw[0]) if p.direction == "after" or p.direction == "before" and more else None
        names = list(self.columns)
        return [{n: self.registry.decode(t, row[n]) for n, t in zip(names, self.columns.values())} for row in raw], before, after

    def stream(self) -> Iterator[dict[str, Any]]:
        """Rows one partition at a time."""
        for row in self.frame.toLocalIterator():
            yield {n: self.registry.decode(t, row[n]) for n, t in self.columns.items()}


@dataclass
class Prepared:
    """A bound query with the types of its parameters; it is refused after a change of the tables' types."""

    engine: Engine
    text: str
    params: dict[str, Type]
    columns: dict[str, Type]
    identity: str

    def run(self, **values: Any) -> Result:
        if self.engine.identity() != self.identity:
            raise QueryError("E_SCHEMA_CHANGED", "the schema has changed since the query was prepared")
        if extra := set(values) - set(self.params):
            raise QueryError("E_PARAM", f"unknown parameter ${sorted(extra)[0]}")
        return self.engine.query(self.text, **values)


class Engine:
    def __init__(self, spark: SparkSession, secret: bytes = b"adtflow", ordered_sets: bool = False):
        """ordered_sets: unions and the like give rows in the order of their first occurrence, at the price of a sort."""
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", 1001)  # the largest lookup's ranks are cut before the shuffle too
        ship_package(spark)
        self.spark, self.secret, self.ordered_sets = spark, secret, ordered_sets
        self.registry = Registry()
        self.sources: dict[str, Source] = {}

    # tables
    def add(self, source: Source) -> Engine:
        self.sources[source.name] = source
        return self

    def register(self, name: str, frame: DataFrame, required: Sequence[str] | str = (), key: str | None = None, indexes: Sequence[Sequence[str]] = ()) -> Engine:
        return self.add(from_frame(name, frame, required, key, indexes))

    def parquet(self, path: str, name: str = "data", required: Sequence[str] | str = (), key: str | None = None, verify: bool = False) -> Engine:
        return self.add(from_parquet(self.spark, path, name, required, key, verify))

    def identity(self) -> str:
        """Changes whenever a table's or a declared type's shape does."""
        tables = {n: [(c, repr(t)) for c, t in s.columns.items()] for n, s in self.sources.items()}
        return json.dumps([tables, {k: repr(t) for k, t in self.registry.types.items()}], sort_keys=True)

    # queries
    def _one(self, query: str | N.Node) -> tuple[N.Node, str]:
        if not isinstance(query, str):
            return query, repr(query)
        statements = parse(query)
        if len(statements) != 1:
            raise QueryError("E_QUERY", "expected one statement")
        return statements[0], _cursor_free(statements[0])

    def plan(self, query: str | N.Node, params: dict[str, Any] | None = None, preparing: bool = False) -> tuple[Plan, Binder]:
        node, text = self._one(query)
        if not isinstance(node, N.Pipeline):
            raise QueryError("E_QUERY", "expected a query")
        b = Binder(self.registry, params, preparing)
        return Lowering(self.registry, self.sources, b, self.secret, text, self.ordered_sets).pipeline(node), b

    def query(self, query: str | N.Node, **params: Any) -> Result:
        """Binds a query; nothing is read before the result's rows are asked for."""
        plan, b = self.plan(query, params)
        if extra := set(params) - set(b.param_types):
            raise QueryError("E_PARAM", f"unknown parameter ${sorted(extra)[0]}")
        frame = plan.frame if plan.page else plan.frame.select(*map(column, plan.columns))
        return Result(frame, plan.columns, self.registry, plan.page, self.secret)

    def prepare(self, text: str) -> Prepared:
        plan, b = self.plan(text, preparing=True)
        return Prepared(self, text, dict(b.param_types), plan.columns, self.identity())

    def explain(self, query: str | N.Node, analyze: bool = False, **params: Any) -> dict[str, Any]:
        """Stages, columns and Spark's plan; with analyze also counts of a run whose rows are thrown away."""
        node, _ = self._one(query)
        if isinstance(node, N.Explain):
            node, analyze = node.pipeline, node.analyze
        plan, _ = self.plan(node, params)
        out: dict[str, Any] = {
            "stages": plan.stages,
            "columns": [{"name": n, "type": repr(t)} for n, t in plan.columns.items()],
            "plan": plan.frame._jdf.queryExecution().toString(),
        }
        if analyze:
            from pyspark.sql import Observation

            seen = Observation()
            try:
                plan.frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            except Exception as e:
                found = from_spark(e)
                raise (found or e) from (e if found else None)
            out["rows"] = seen.get["rows"]
        return out

    def describe(self, text: str) -> dict[str, Any]:
        """A query's contract: parameters, columns and how many rows it can have."""
        p = self.prepare(text)
        node, _ = self._one(text)
        return {"params": {k: repr(t) for k, t in p.params.items()}, "columns": {k: repr(t) for k, t in p.columns.items()}, "cardinality": cardinality(node, self.sources)}

    def fetch_by_key(self, table: str, keys: Sequence[Any]) -> list[dict[str, Any] | None]:
        """Rows of a table by its key, aligned with keys; None where there is no row.

        The keys are joined as a table, so that their number is bounded by memory on the driver alone.
        """
        src = self.sources.get(table)
        if src is None or src.key is None:
            raise QueryError("E_TABLE", f"{table} has no key")
        frame = self.fetch_frame(table, keys)
        out: list[dict[str, Any] | None] = []
        for row in frame.orderBy("__position").collect():
            out.append({c: self.registry.decode(t, row[c]) for c, t in src.columns.items()} if row["__found"] else None)
            if row["__found"] and row["__found"] > 1:
                raise QueryError("E_CONSTRAINT", f"the key {keys[row['__position']]!r} occurs twice")
        return out

    def typed_fetch_by_key(self, table: str, keys: Sequence[Any], cls: type) -> list[Any]:
        """fetch_by_key with each row as an instance of a dataclass that has the fields and types of the table's row."""
        from adtflow.sources.schema import struct_of

        src = self.sources.get(table)
        if src is None or struct_of(cls, self.registry) != self.registry.resolve(src.row):
            raise QueryError("E_TYPE", f"{cls.__name__} isn't the row of {table}")
        return [None if row is None else cls(**row) for row in self.fetch_by_key(table, keys)]

    def fetch_frame(self, table: str, keys: Sequence[Any]) -> DataFrame:
        src = self.sources[table]
        kind = self.registry.spark(src.columns[src.key])
        wanted = self.spark.createDataFrame([(i, self.registry.encode(src.columns[src.key], k)) for i, k in enumerate(keys)], f"__position long, __key {kind.simpleString()}")
        rows = src.frame().select(column(src.key).alias("__match"), F.struct(*map(column, src.columns)).alias("__row"))
        joined = wanted.join(rows, F.col("__key") == F.col("__match"), "left").groupBy("__position").agg(F.count("__match").alias("__found"), F.first("__row").alias("__row"))
        return joined.select("__position", "__found", "__row.*")


def _cursor_free(node: N.Node) -> str:
    """A query's text for its cursors: the same for every page of it."""
    if isinstance(node, N.Pipeline):
        node = replace(node, stages=[N.Page(s.size) if isinstance(s, N.Page) else s for s in node.stages])
    return repr(node)


def cardinality(node: N.Node, sources: dict[str, Source]) -> str:
    """'one', 'at most one' or 'many' rows."""
    if not isinstance(node, N.Pipeline):
        return "many"
    out = "many"
    for s in node.stages:
        if isinstance(s, N.Aggregate):
            out = "one" if s.keys is None else out
        elif isinstance(s, N.Take):
            out = "at most one" if s.count <= 1 or out == "one" else out
        elif isinstance(s, (N.Filter, N.Exists)) and out == "one":
            out = "at most one"
        elif isinstance(s, N.SetOperation):
            out = "many"
        if isinstance(s, N.Filter) and out == "many" and isinstance(c := s.condition, N.Binary) and c.op == "==" and isinstance(c.left, N.Path):
            key = sources[node.source].key if node.source in sources else None
            if c.left.parts == (key,):
                out = "at most one"
    return out
