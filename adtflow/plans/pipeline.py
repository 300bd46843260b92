"""Pipelines lowered stage by stage to DataFrames; all checks happen here, before anything is read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtflow.errors import QueryError
from adtflow.lang import nodes as N
from adtflow.operators import aggregates, paging, relational
from adtflow.plans.expressions import Binder, Local, Scope, column, may_raise
from adtflow.types import INT, Decimal, Enum, List, Option, Record, Registry, Scalar, Type

INNER = "__inner_"
MAX_PAGE_KEYS = 16


@dataclass
class Index:
    """Declared for the checks of lookup, exists and page; Spark needs no physical index."""

    components: tuple[tuple[str, bool], ...]
    unique: bool = False
    partial: bool = False
    predicate: Any = None


@dataclass
class Source:
    """A table as a query sees it. indexed: whether only declared indexes may be looked up by."""

    name: str
    columns: dict[str, Type]
    frame: Callable[[], DataFrame]
    row: Type
    key: str | None = None
    indexes: list[Index] = field(default_factory=list)
    checked: bool = False


@dataclass
class PageInfo:
    size: int
    direction: str | None
    keys: list[tuple[str, bool]]
    query: str


@dataclass
class Plan:
    columns: dict[str, Type]
    frame: DataFrame
    stages: list[dict[str, Any]]
    page: PageInfo | None = None


class Lowering:
    def __init__(self, registry: Registry, sources: dict[str, Source], binder: Binder, secret: bytes = b"adtflow", text: str = "", ordered_sets: bool = False):
        self.r, self.sources, self.b, self.secret, self.text, self.ordered_sets = registry, sources, binder, secret, text, ordered_sets

    def source(self, name: str, place: N.Place) -> Source:
        if name not in self.sources:
            raise QueryError("E_TABLE", f"unknown table {name}", place)
        return self.sources[name]

    def pipeline(self, p: N.Pipeline, nested: bool = False) -> Plan:
        src = self.source(p.source, p.place)
        plan = Plan(dict(src.columns), src.frame(), [{"stage": "from", "table": p.source}])
        scope = Scope(plan.columns)
        # origin: by column, the source's column whose values it holds unchanged; fixed: the source's fields that equal one value
        state = {"origin": {c: c for c in src.columns}, "fixed": set(), "source": src, "nested": nested, "last_sort": _page_shape(p)}
        for stage in p.stages:
            kind = type(stage).__name__.lower()
            if isinstance(stage, N.Let):
                if stage.params is None:  # checked where it stands, as far as its names are known
                    self.b.bind(stage.body, replace(scope, columns=plan.columns), stage.type)
                local = Local(stage.params, stage.type, stage.body, replace(scope, columns=plan.columns, locals=dict(scope.locals)))
                scope = replace(scope, locals={**scope.locals, stage.name: local})
            else:
                plan = getattr(self, f"_{kind}")(stage, plan, replace(scope, columns=plan.columns), state)
            plan.stages.append({"stage": kind})
        return plan

    def field(self, p: N.Path, plan: Plan, s: Scope) -> tuple[Column, Type, str]:
        x = self.b.path(p, Scope(plan.columns, s.prefix))
        return x.col, x.type, ".".join(p.parts)

    # stages
    def _filter(self, n: N.Filter, plan: Plan, s: Scope, state: dict) -> Plan:
        for part in _conjuncts(n.condition):
            if isinstance(part, N.Binary) and part.op == "==" and isinstance(part.left, N.Path) and isinstance(part.right, (N.Literal, N.Param, N.Constructor)):
                state["fixed"].add(_origin(state, ".".join(part.left.parts)))
        return replace(plan, frame=plan.frame.filter(self.b.condition(n.condition, s)))

    def _exists(self, n: N.Exists, plan: Plan, s: Scope, state: dict) -> Plan:
        target = self.source(n.pipeline.source, n.place)
        if "outer" in target.columns:
            raise QueryError("E_EXISTS", f"{target.name} has a field outer", n.place)
        inner = Scope(target.columns, INNER, outer=s, locals={})
        condition, correlated = None, False
        for stage in n.pipeline.stages:
            if not isinstance(stage, N.Filter):
                raise QueryError("E_EXISTS", "only filters may stand inside exists", stage.place)
            c = self.b.condition(stage.condition, inner)
            sure = []
            for part in _conjuncts(stage.condition):
                sides = (part.left, part.right) if isinstance(part, N.Binary) and part.op == "==" else ()
                paths = [x for x in sides if isinstance(x, N.Path)]
                if len(paths) == 2 and (paths[0].parts[0] == "outer") != (paths[1].parts[0] == "outer"):
                    own, other = reversed(paths) if paths[0].parts[0] == "outer" else paths
                    if not target.checked or _leads(target, ".".join(own.parts)):
                        correlated = True
                    sure.append(self.wrapped_key(own, other, inner))
                elif not may_raise(part):
                    sure.append(self.b.condition(part, inner))
            if may_raise(stage.condition):  # c guards what can fail by what stands before it, which Spark joins and filters by only beside it
                c = reduce(and_, [*sure, c])
            condition = c if condition is None else condition & c
        if not correlated:
            raise QueryError("E_EXISTS", "exists needs an equality of an indexed field with outer", n.place)
        renamed = target.frame().select(*(column(c).alias(INNER + c) for c in target.columns))
        return replace(plan, frame=relational.keep_matching(plan.frame, renamed, condition, n.negated))

    def wrapped_key(self, own: N.Path, other: N.Path, s: Scope) -> Column:
        """True where two paths are equal, as a join key beside a guarded condition, which has the last word.

        Were the key two plain columns, Spark would put one for the other in that condition, and so ask it of rows without a match.
        """
        x, y = self.b.path(own, s), self.b.path(other, s)
        same = F.struct(x.col.alias("v")) == F.struct(y.col.alias("v"))
        return same & x.col.isNotNull() if isinstance(self.r.resolve(x.type), (Scalar, Decimal)) else same

    def _derive(self, n: N.Derive, plan: Plan, s: Scope, state: dict) -> Plan:
        frame, columns = plan.frame, dict(plan.columns)
        for name, value in n.fields:
            x = self.b.bind(value, replace(s, columns=columns))
            frame = frame.withColumn(name, x.col)
            columns[name] = x.type
            state["origin"].pop(name, None)
        return replace(plan, frame=frame, columns=columns)

    def _lookup(self, n: N.Lookup, plan: Plan, s: Scope, state: dict) -> Plan:
        if n.name in plan.columns:
            raise QueryError("E_LOOKUP", f"{n.name} is a field already", n.place)
        if not 1 <= n.limit <= 1000:
            raise QueryError("E_LOOKUP", "a lookup takes 1 to 1000 rows", n.place)
        target = self.source(n.table, n.place)
        t = self.b.path(n.target, Scope(target.columns))
        x = self.b.path(n.source, s)
        self.b.unify(x.type, t.type, n.place)
        name = ".".join(n.target.parts)
        if target.checked and not _leads(target, name):
            raise QueryError("E_LOOKUP", f"no index of {n.table} starts with {name}", n.place)
        order = [column(target.key)] if target.key else [F.struct(*(column(c) for c in target.columns))]
        item = F.struct(*(column(c).alias(c) for c in target.columns))
        safe = isinstance(self.r.resolve(t.type), Option)
        frame = relational.lookup(plan.frame, target.frame(), n.name, t.col, x.col, n.limit, order, item, safe)
        return replace(plan, frame=frame, columns={**plan.columns, n.name: List(target.row)})

    def _aggregate(self, n: N.Aggregate, plan: Plan, s: Scope, state: dict) -> Plan:
        out, cols = {}, []
        keys = [self.field(k, plan, s) for k in n.keys or ()]
        for name, function, arg, extra in n.fields:
            try:
                x = aggregates.build(self.r, function, None if arg is None else self.b.bind(arg, s), extra)
            except QueryError as e:
                raise e if e.place else QueryError(e.code, e.message, n.place) from e
            out[name] = x.type
            cols.append(x.col.alias(name))
        if n.keys is None:
            frame = plan.frame.agg(*cols)
        else:
            frame = plan.frame.groupBy(*(c.alias(name) for c, _, name in keys)).agg(*cols)
        state["origin"] = {}
        return replace(plan, frame=frame, columns={**{name: t for _, t, name in keys}, **out})

    def _window(self, n: N.Window, plan: Plan, s: Scope, state: dict) -> Plan:
        for name, _ in n.fields:
            if name in plan.columns:
                raise QueryError("E_WINDOW", f"{name} is a field already", n.place)
        partition = [self.field(p, plan, s)[0] for p in n.partition]
        frame = relational.rank(plan.frame, partition, self.order(n.sort, plan, s), n.fields)
        return replace(plan, frame=frame, columns={**plan.columns, **{name: INT for name, _ in n.fields}})

    def order(self, keys: list[tuple[N.Path, bool]], plan: Plan, s: Scope) -> list[Column]:
        return [(c.desc_nulls_last() if down else c.asc_nulls_first()) for (p, down) in keys for c in [self.field(p, plan, s)[0]]]

    def _setoperation(self, n: N.SetOperation, plan: Plan, s: Scope, state: dict) -> Plan:
        if state["nested"]:
            raise QueryError("E_SET", "set operations can't be nested", n.place)
        if any(isinstance(x, N.Page) for x in n.pipeline.stages):
            raise QueryError("E_PAGE_SHAPE", "no page may stand in a set operation", n.place)
        right = self.pipeline(n.pipeline, nested=True)
        if list(right.columns.items()) != list(plan.columns.items()):
            raise QueryError("E_SET", "both sides need the same fields, types and order", n.place)
        state["origin"] = {}
        return replace(plan, frame=relational.combine(plan.frame.select(*map(column, plan.columns)), right.frame.select(*map(column, right.columns)), n.kind, self.ordered_sets))

    def _select(self, n: N.Select, plan: Plan, s: Scope, state: dict) -> Plan:
        cols, columns, origin = [], {}, {}
        for f in n.fields:
            if isinstance(f, tuple):
                x = self.b.bind(f[1], s)
                col, t, name = x.col, x.type, f[0]
            else:
                col, t, name = self.field(f, plan, s)
            same = f[1] if isinstance(f, tuple) else f
            if isinstance(same, N.Path) and len(same.parts) == 1 and same.parts[0] in state["origin"]:
                origin[name] = state["origin"][same.parts[0]]
            cols.append(col.alias(name))
            columns[name] = t
        state["origin"] = origin
        cols += [column(f"__key{i}") for i in range(len(state.get("key_types", ())))]  # for the cursors
        return replace(plan, frame=plan.frame.select(*cols), columns=columns)

    def _sort(self, n: N.Sort, plan: Plan, s: Scope, state: dict) -> Plan:
        frame, order = plan.frame, self.order(n.keys, plan, s)
        if n is state["last_sort"]:  # the page's keys are the values sorted by, whatever a later select calls by their names
            keys = [self.field(p, plan, s) for p, _ in n.keys]
            state["key_types"] = [t for _, t, _ in keys]
            state["sorted"] = [(_origin(state, name), down) for (_, _, name), (_, down) in zip(keys, n.keys)]
            frame = frame.withColumns({f"__key{i}": c for i, (c, _, _) in enumerate(keys)})
        return replace(plan, frame=frame.orderBy(*order))

    def _take(self, n: N.Take, plan: Plan, s: Scope, state: dict) -> Plan:
        frame = plan.frame.offset(n.offset) if n.offset else plan.frame
        return replace(plan, frame=frame.limit(n.count))

    def _page(self, n: N.Page, plan: Plan, s: Scope, state: dict) -> Plan:
        src, keys = state["source"], state["sorted"]
        if not 1 <= len(keys) <= MAX_PAGE_KEYS:
            raise QueryError("E_PAGE_ORDER", f"a page's sort has 1 to {MAX_PAGE_KEYS} keys", n.place)
        if (src.key is None or keys[-1][0] != src.key) and not _unique_order(src, [k for k, _ in keys], state["fixed"]):
            raise QueryError("E_PAGE_ORDER", "the sort must end in the unchanged key or in the rest of a unique index", n.place)
        frame, before = plan.frame, n.direction == "before"
        own = [column(f"__key{i}") for i in range(len(keys))]
        if n.cursor is not None:
            values = paging.decode(self.secret, self.text, n.cursor)
            bound = [(c, _raw(self.b, self.r, v, t), down) for c, t, v, (_, down) in zip(own, state["key_types"], values, keys, strict=True)]
            frame = frame.filter(paging.beyond(bound, after=not before))
        if before:
            frame = frame.orderBy(*(c.asc_nulls_first() if down else c.desc_nulls_last() for c, (_, down) in zip(own, keys)))
        elif n.cursor is not None:
            frame = frame.orderBy(*(c.desc_nulls_last() if down else c.asc_nulls_first() for c, (_, down) in zip(own, keys)))
        return replace(plan, frame=frame.limit(n.size + 1), page=PageInfo(n.size, n.direction, keys, self.text))


def _page_shape(p: N.Pipeline) -> N.Sort | None:
    """The sort that the pipeline's page follows, after checks of what may stand beside a page; None without a page."""
    pages = [i for i, x in enumerate(p.stages) if isinstance(x, N.Page)]
    if not pages:
        return None
    at, place = pages[0], p.stages[pages[0]].place
    before, after = p.stages[:at], p.stages[at + 1 :]
    if len(pages) > 1:
        raise QueryError("E_PAGE_SHAPE", "a query has one page", place)
    if any(isinstance(x, N.Lookup) for x in before):
        raise QueryError("E_PAGE_SHAPE", "a lookup follows the page", place)
    for x in after:
        if not isinstance(x, (N.Lookup, N.Select, N.Let)):
            raise QueryError("E_PAGE_SHAPE", f"no {type(x).__name__.lower()} may follow a page", x.place)
    for x in before:
        if isinstance(x, (N.Take, N.Aggregate, N.Window, N.SetOperation)):
            raise QueryError("E_PAGE_SHAPE", f"no {type(x).__name__.lower()} may stand beside a page", x.place)
    sorts = [i for i, x in enumerate(before) if isinstance(x, N.Sort)]
    if not sorts:
        raise QueryError("E_PAGE_ORDER", "a page follows a sort", place)
    for x in before[sorts[-1] + 1 :]:
        if not isinstance(x, (N.Select, N.Let)):
            raise QueryError("E_PAGE_SHAPE", f"no {type(x).__name__.lower()} may stand between the sort and the page", x.place)
    return before[sorts[-1]]


def _origin(state: dict, name: str) -> str | None:
    """The source's field that a column's field holds unchanged."""
    top, dot, rest = name.partition(".")
    own = state["origin"].get(top)
    return None if own is None else own + dot + rest


def _raw(b: Binder, r: Registry, value: Any, t: Type) -> Column:
    """A collected value as a column of its type."""
    if isinstance(r.resolve(t), (Enum, Record)) or isinstance(value, tuple):
        from pyspark.sql import types as T

        def build(v: Any, d: Any) -> Column:
            if v is None:
                return F.lit(None).cast(d)
            if isinstance(d, T.StructType):
                return F.struct(*(build(x, f.dataType).alias(f.name) for x, f in zip(v, d.fields)))
            if isinstance(d, T.ArrayType):
                return F.array(*(build(x, d.elementType) for x in v)).cast(d)
            return F.lit(v).cast(d)

        return build(value, r.spark(t))
    return b.constant(value, t).col


def _conjuncts(n: N.Node) -> list[N.Node]:
    return [*_conjuncts(n.left), *_conjuncts(n.right)] if isinstance(n, N.Binary) and n.op == "&&" else [n]


def _leads(src: Source, name: str) -> bool:
    return src.key == name or any(i.components[0][0] == name and not i.partial for i in src.indexes)


def _unique_order(src: Source, keys: list[str], fixed: set[str]) -> bool:
    """Whether a unique index is made of fixed fields followed by the last keys."""
    for i in src.indexes:
        names = [c for c, _ in i.components]
        if i.unique and not i.partial and all(n in fixed or n in keys for n in names) and (rest := [n for n in names if n not in fixed]) and keys[-len(rest) :] == rest:
            return True
    return False
