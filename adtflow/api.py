"""A fluent builder for the syntax tree that the text form is parsed to; both share the binder."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable
from typing import Any

from adtflow.errors import QueryError
from adtflow.lang import nodes as N
from adtflow.lang.parser import Parser


class E:
    """An expression; operators build larger ones. Comparisons and & | ~ give conditions."""

    __slots__ = ("node",)
    __hash__ = None  # type: ignore[assignment]

    def __init__(self, node: N.Node):
        self.node = node

    def _with(self, op: str, other: Any, turned: bool = False) -> E:
        a, b = (expr(other), self.node) if turned else (self.node, expr(other))
        return E(N.Binary(op, a, b))

    def __add__(self, x: Any) -> E:
        return self._with("+", x)

    def __radd__(self, x: Any) -> E:
        return self._with("+", x, True)

    def __sub__(self, x: Any) -> E:
        return self._with("-", x)

    def __rsub__(self, x: Any) -> E:
        return self._with("-", x, True)

    def __mul__(self, x: Any) -> E:
        return self._with("*", x)

    def __rmul__(self, x: Any) -> E:
        return self._with("*", x, True)

    def __truediv__(self, x: Any) -> E:
        return self._with("/", x)

    def __rtruediv__(self, x: Any) -> E:
        return self._with("/", x, True)

    def __neg__(self) -> E:
        return E(Parser._minus(self.node, None))

    def __eq__(self, x: Any) -> E:  # type: ignore[override]
        return self._with("==", x)

    def __ne__(self, x: Any) -> E:  # type: ignore[override]
        return self._with("!=", x)

    def __lt__(self, x: Any) -> E:
        return self._with("<", x)

    def __le__(self, x: Any) -> E:
        return self._with("<=", x)

    def __gt__(self, x: Any) -> E:
        return self._with(">", x)

    def __ge__(self, x: Any) -> E:
        return self._with(">=", x)

    def __and__(self, x: Any) -> E:
        return self._with("&&", x)

    def __or__(self, x: Any) -> E:
        return self._with("||", x)

    def __invert__(self) -> E:
        return E(N.Unary("!", self.node))

    def is_in(self, items: Any) -> E:
        return E(N.Membership(self.node, expr(items), False))

    def not_in(self, items: Any) -> E:
        return E(N.Membership(self.node, expr(items), True))

    def any(self, test: Callable[[E], E], name: str = "x") -> E:
        return E(N.Quantifier(False, self.node, name, expr(test(E(N.Path((name,)))))))

    def all(self, test: Callable[[E], E], name: str = "x") -> E:
        return E(N.Quantifier(True, self.node, name, expr(test(E(N.Path((name,)))))))

    def __getattr__(self, name: str) -> E:
        if name.startswith("_") or not isinstance(self.node, N.Path):
            raise AttributeError(name)
        return E(N.Path((*self.node.parts, name)))


def field(path: str) -> E:
    """A field by its dotted path."""
    return E(N.Path(tuple(path.split("."))))


def param(name: str) -> E:
    return E(N.Param(name))


def fn(name: str, *args: Any) -> E:
    """A call of a scalar function or a local one."""
    return E(N.Call(name, [expr(a) for a in args]))


def match(path: str, *arms: tuple[str, Any]) -> E:
    """Arms of a pattern as text and an expression, whose names are fields."""
    return E(N.Match(N.Path(tuple(path.split("."))), [(Parser(p).pattern(), expr(v)) for p, v in arms]))


def expr(x: Any) -> N.Node:
    """A Python value or expression as syntax; a string is a text literal."""
    if isinstance(x, E):
        return x.node
    if isinstance(x, N.Node):
        return x
    if isinstance(x, bool):
        return N.Literal("bool", x)
    if isinstance(x, dt.datetime):
        return N.Literal("timestamp", (x if x.tzinfo else x.replace(tzinfo=dt.timezone.utc)).isoformat())
    if isinstance(x, dt.timedelta):
        return N.Literal("duration", x // dt.timedelta(microseconds=1))
    for kind, name, value in ((int, "int", x), (float, "float", x), (str, "text", x), (dt.date, "date", str(x)), (decimal.Decimal, "decimal", str(x)), (bytes, "bytes", x.hex() if isinstance(x, bytes) else x)):
        if isinstance(x, kind):
            return N.Literal(name, value)
    if isinstance(x, list):
        return N.ListValue([expr(v) for v in x])
    if isinstance(x, tuple):
        return N.TupleValue([expr(v) for v in x])
    if isinstance(x, dict):
        return N.RecordValue([(k, expr(v)) for k, v in x.items()])
    raise QueryError("E_TYPE", f"{x!r} is no value of the language")


def _paths(names: tuple[str, ...]) -> list[N.Path]:
    return [N.Path(tuple(n.split("."))) for n in names]


def _keys(names: tuple[str, ...]) -> list[tuple[N.Path, bool]]:
    return [(N.Path(tuple(n.removeprefix("-").split("."))), n.startswith("-")) for n in names]


def count() -> tuple[str, None, tuple]:
    return "count", None, ()


def agg(function: str, of: Any, *extra: Any) -> tuple[str, N.Node, tuple]:
    return function, expr(of), extra


class Q:
    """A pipeline under construction; each method returns a new one."""

    def __init__(self, source: str, stages: tuple[N.Node, ...] = ()):
        self.source, self.stages = source, stages

    @property
    def node(self) -> N.Pipeline:
        return N.Pipeline(self.source, list(self.stages))

    def _and(self, stage: N.Node) -> Q:
        return Q(self.source, (*self.stages, stage))

    def let(self, name: str, value: Any, *params: str) -> Q:
        return self._and(N.Let(name, [(p, None) for p in params] or None, None, expr(value)))

    def filter(self, condition: Any) -> Q:
        return self._and(N.Filter(expr(condition)))

    def exists(self, inner: Q) -> Q:
        return self._and(N.Exists(inner.node, False))

    def not_exists(self, inner: Q) -> Q:
        return self._and(N.Exists(inner.node, True))

    def derive(self, **fields: Any) -> Q:
        return self._and(N.Derive([(k, expr(v)) for k, v in fields.items()]))

    def lookup(self, name: str, table: str, target: str, source: str, take: int) -> Q:
        return self._and(N.Lookup(name, table, *_paths((target, source)), take))

    def aggregate(self, **fields: tuple[str, N.Node | None, tuple]) -> Q:
        return self._and(N.Aggregate(None, [(k, *v) for k, v in fields.items()]))

    def group(self, *keys: str, **fields: tuple[str, N.Node | None, tuple]) -> Q:
        return self._and(N.Aggregate(_paths(keys), [(k, *v) for k, v in fields.items()]))

    def window(self, sort: tuple[str, ...] | str, partition: tuple[str, ...] | str = (), **fields: str) -> Q:
        one = lambda x: (x,) if isinstance(x, str) else x
        return self._and(N.Window(_paths(one(partition)), _keys(one(sort)), list(fields.items())))

    def union(self, other: Q) -> Q:
        return self._and(N.SetOperation("union", other.node))

    def intersect(self, other: Q) -> Q:
        return self._and(N.SetOperation("intersect", other.node))

    def except_(self, other: Q) -> Q:
        return self._and(N.SetOperation("except", other.node))

    def select(self, *paths: str, **computed: Any) -> Q:
        return self._and(N.Select([*_paths(paths), *((k, expr(v)) for k, v in computed.items())]))

    def sort(self, *keys: str) -> Q:
        return self._and(N.Sort(_keys(keys)))

    def take(self, count: int, offset: int = 0) -> Q:
        return self._and(N.Take(offset, count))

    def page(self, size: int, after: str | None = None, before: str | None = None) -> Q:
        return self._and(N.Page(size, "after" if after else "before" if before else None, after or before))


def from_(table: str) -> Q:
    return Q(table)
