"""Expressions bound to types and built as columns in one walk; nothing is read while this happens."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtflow.errors import QueryError
from adtflow.functions import arithmetic as A
from adtflow.functions.literals import fitted, python_value
from adtflow.functions.scalars import FUNCTIONS, Typed, in_range
from adtflow.lang import nodes as N
from adtflow.lang.parser import constant as constant_value
from adtflow.plans import patterns
from adtflow.recursion import closed, opened
from adtflow.types import BOOL, BYTES, DATE, DURATION, FLOAT, INT, TEXT, TIMESTAMP, UUID, Decimal, Enum, List, Map, Named, Option, Record, Registry, Scalar, Tuple, Type

LITERAL_TYPES = {"int": INT, "float": FLOAT, "bool": BOOL, "text": TEXT, "uuid": UUID, "date": DATE, "timestamp": TIMESTAMP, "duration": DURATION, "bytes": BYTES}
MAX_DEPTH = 64


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Local:
    params: list[tuple[str, Type | None]] | None
    type: Type | None
    body: N.Node
    scope: Scope


@dataclass
class Scope:
    """What names stand for: columns of the rows, names bound by patterns and lambdas, local definitions, the outer row."""

    columns: dict[str, Type]
    prefix: str = ""
    bound: dict[str, Typed] = field(default_factory=dict)
    locals: dict[str, Local] = field(default_factory=dict)
    outer: Scope | None = None
    arm: bool = False

    def child(self, bound: dict[str, Typed], arm: bool = False) -> Scope:
        return Scope({} if arm else self.columns, self.prefix, bound if arm else {**self.bound, **bound}, self.locals, None if arm else self.outer, arm or self.arm)


class Binder:
    """params: values by name; None while a query is prepared, when their types are gathered in param_types."""

    def __init__(self, registry: Registry, params: dict[str, Any] | None = None, preparing: bool = False):
        self.r, self.params, self.preparing = registry, params or {}, preparing
        self.param_types: dict[str, Type] = {}
        self.depth = 0

    # names
    def path(self, p: N.Path, s: Scope) -> Typed:
        parts = p.parts
        if s.outer is not None and parts[0] == "outer":
            if len(parts) == 1:
                raise QueryError("E_QUERY", "outer needs a field", p.place)
            return self.path(N.Path(parts[1:], place=p.place), s.outer)
        if parts[0] in s.bound:
            x, rest = s.bound[parts[0]], parts[1:]
        elif parts[0] in s.locals and s.locals[parts[0]].params is None:
            x, rest = self.local(s.locals[parts[0]], [], None, p.place), parts[1:]
        else:
            for n in range(len(parts), 0, -1):
                name = ".".join(parts[:n])
                if name in s.columns:
                    x, rest = Typed(s.columns[name], column(s.prefix + name)), parts[n:]
                    break
            else:
                raise QueryError("E_MATCH" if s.arm else "E_FIELD", f"unknown field {'.'.join(parts)}" + (" in a match arm" if s.arm else ""), p.place)
        for name in rest:
            t = self.r.resolve(x.type)
            f = t.get(name) if isinstance(t, Record) else None
            if f is None:
                raise QueryError("E_FIELD", f"{x.type!r} has no field {name}", p.place)
            x = Typed(f.type, opened(self.r, x).getField(name))
        return x

    def local(self, d: Local, args: list[Typed], expected: Type | None, place: N.Place) -> Typed:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise QueryError("E_LIMIT", "local definitions are nested too deeply", place)
        x = self.bind(d.body, d.scope.child({p: a for (p, _), a in zip(d.params or (), args)}), d.type or expected)
        self.depth -= 1
        if d.type is not None:
            self.unify(x.type, d.type, place)
        return x

    # types
    def unify(self, have: Type, want: Type, place: N.Place) -> None:
        if have != want:
            raise QueryError("E_TYPE", f"expected {want!r}, found {have!r}", place)

    def fit(self, x: Typed, want: Type | None, place: N.Place) -> Typed:
        if want is not None:
            self.unify(x.type, want, place)
        return x

    def null(self, t: Type) -> Column:
        return F.lit(None).cast(self.r.spark(t))

    # literals and values
    def constant(self, value: Any, t: Type, place: N.Place = None) -> Typed:
        """A Python value, as Registry.encode takes it, as a column."""
        if self.r.recursive(t):
            return Typed(t, F.lit(bytes(self.r.encode(t, value))))
        own = self.r.resolve(t)
        if isinstance(own, Option):
            if value is None:
                return Typed(t, self.null(t))
            if isinstance(value, tuple) and len(value) == 2 and value[0] == "Some":
                value = value[1]
            inner = self.constant(value, own.of, place)
            return Typed(t, F.struct(inner.col.alias("v")) if isinstance(self.r.resolve(own.of), Option) else inner.col)
        if value is None:
            raise QueryError("E_TYPE", f"a value of {t!r} is missing", place)
        if isinstance(own, List):
            return Typed(t, F.array(*(self.constant(x, own.of, place).col for x in value)).cast(self.r.spark(own)))
        if isinstance(own, Map):
            pairs = sorted(value.items(), key=lambda kv: kv[0].encode())
            return Typed(t, F.array(*(F.struct(F.lit(k).alias("key"), self.constant(v, own.of, place).col.alias("value")) for k, v in pairs)).cast(self.r.spark(own)))
        if isinstance(own, Tuple):
            return Typed(t, F.struct(*(self.constant(v, x, place).col.alias(f"_{i + 1}") for i, (x, v) in enumerate(zip(own.items, value, strict=True)))))
        if isinstance(own, Record):
            if unknown := set(value) - {f.name for f in own.fields}:
                raise QueryError("E_TYPE", f"unknown field {sorted(unknown)[0]}", place)
            return self.record(own, t, {k: self.constant(v, f.type, place) for k, v in value.items() if (f := own.get(k))}, place)
        if isinstance(own, Enum):
            name, payload = value if isinstance(value, tuple) else (value, None)
            at = own.index(name)
            if at is None:
                raise QueryError("E_TYPE", f"unknown variant {name}", place)
            inner = own.variants[at].payload
            if (inner is None) != (payload is None):
                raise QueryError("E_TYPE", f"{name} has another payload", place)
            return self.variant(own, t, at, None if inner is None else self.constant(payload, inner, place).col)
        return Typed(t, self.scalar(value, own, place))

    def scalar(self, value: Any, t: Type, place: N.Place) -> Column:
        ok = {
            INT: lambda v: type(v) is int and -(2**63) <= v < 2**63,
            FLOAT: lambda v: type(v) in (int, float) and v == v and abs(v) != float("inf") and float(v) == v,
            BOOL: lambda v: type(v) is bool,
            TEXT: lambda v: type(v) is str,
            UUID: lambda v: type(v) is str,
            DATE: lambda v: type(v) is dt.date,
            TIMESTAMP: lambda v: type(v) is dt.datetime,
            DURATION: lambda v: type(v) is dt.timedelta,
            BYTES: lambda v: isinstance(v, (bytes, bytearray)),
        }
        if isinstance(t, Decimal):
            if type(v := value) not in (int, decimal.Decimal):
                raise QueryError("E_TYPE", f"{value!r} is no {t!r}", place)
            return F.lit(fitted(decimal.Decimal(v), t.precision, t.scale, place)).cast(self.r.spark(t))
        if not isinstance(t, Scalar) or not ok[t](value):
            raise QueryError("E_TYPE", f"{value!r} is no {t!r}", place)
        if t == FLOAT:
            value = float(value) + 0.0
        if t == TIMESTAMP:
            if value.tzinfo is not None:
                value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
            return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(value).cast(self.r.spark(t)) if t in (INT, FLOAT) else F.lit(value)

    def literal(self, n: N.Literal, want: Type | None) -> Typed:
        value = python_value(n)
        own = self.r.resolve(want) if want is not None else None
        if n.kind == "decimal":
            if not isinstance(own, Decimal):
                if own is not None:
                    raise QueryError("E_TYPE", f"expected {want!r}, found a decimal", n.place)
                scale = max(0, -value.as_tuple().exponent)
                own = want = Decimal(max(len(value.as_tuple().digits), scale, 1), scale)
            return Typed(want, self.scalar(value, own, n.place))
        t = LITERAL_TYPES[n.kind]
        if n.kind == "int" and own == FLOAT:
            return Typed(want, self.scalar(value, FLOAT, n.place))
        if own is not None and own != t:
            raise QueryError("E_TYPE", f"expected {want!r}, found {t!r}", n.place)
        return Typed(want or t, self.scalar(value, t, n.place))

    def record(self, own: Record, t: Type, given: dict[str, Typed], place: N.Place) -> Typed:
        cols = []
        for f in own.fields:
            if f.name in given:
                cols.append(given[f.name].col.cast(self.r.spark(f.type)).alias(f.name))
            elif f.has_default:
                cols.append(self.constant(f.default, f.type, place).col.cast(self.r.spark(f.type)).alias(f.name))
            else:
                raise QueryError("E_TYPE", f"field {f.name} is missing", place)
        return Typed(t, closed(self.r, t, F.struct(*cols)))

    def variant(self, own: Enum, t: Type, at: int, payload: Column | None) -> Typed:
        """A value of an enum: every other variant's slot is a typed null."""
        cols = [F.lit(at).alias("tag")]
        for i, v in enumerate(own.variants):
            if v.payload is not None:
                cols.append((payload if i == at else self.null(v.payload)).cast(self.r.spark(v.payload)).alias(v.name))
        return Typed(t, closed(self.r, t, F.struct(*cols)))

    def values(self, items: list[N.Node], s: Scope, want: Type | None, place: N.Place) -> tuple[Type, list[Typed]]:
        """Items of one type: the expected one, or that of the first item that has a type of its own."""
        of = want
        if of is None:
            for x in items:
                try:
                    of = self.bind(x, s, None).type
                    break
                except QueryError as e:
                    if e.code != "E_INFER":
                        raise
            else:
                raise QueryError("E_INFER", "the type of the list isn't known", place)
        return of, [self.bind(x, s, of) for x in items]

    def constructor(self, n: N.Constructor, s: Scope, want: Type | None) -> Typed:
        own = self.r.resolve(want) if want is not None else None
        if n.type_name is None and n.variant in ("None", "Some") and (own is None or isinstance(own, Option)):
            if n.variant == "None":
                if own is None:
                    raise QueryError("E_INFER", "the type of None isn't known", n.place)
                return Typed(want, self.null(want))
            if not isinstance(n.payload, N.TupleValue) or len(n.payload.items) != 1:
                raise QueryError("E_TYPE", "Some takes one value", n.place)
            inner = self.bind(n.payload.items[0], s, own.of if own is not None else None)
            t = want if want is not None else Option(inner.type)
            return Typed(t, F.struct(inner.col.alias("v")) if isinstance(self.r.resolve(inner.type), Option) else inner.col)
        if isinstance(own, Option):  # a bare constructor in the place of an option isn't wrapped
            raise QueryError("E_TYPE", f"expected {want!r}; write Some({n.variant})", n.place)
        if n.type_name is not None:
            t: Type = Named(n.type_name)
            if want is not None:
                self.unify(t, want, n.place)
            own = self.r.resolve(t)
        elif own is None:
            owners = [k for k, v in self.r.types.items() if isinstance(v, Enum) and v.index(n.variant) is not None]
            if isinstance(n.payload, N.RecordValue) and isinstance(self.r.types.get(n.variant), Record):
                return self.bind(n.payload, s, Named(n.variant))
            if len(owners) != 1:
                raise QueryError("E_INFER", f"{n.variant} is {'ambiguous' if owners else 'unknown'}", n.place)
            t = Named(owners[0])
            own = self.r.resolve(t)
        else:
            t = want
        if isinstance(own, Record) and isinstance(n.payload, N.RecordValue) and n.variant == repr(t):
            return self.bind(n.payload, s, t)
        if not isinstance(own, Enum):
            raise QueryError("E_TYPE", f"expected {t!r}, found the constructor {n.variant}", n.place)
        at = own.index(n.variant)
        if at is None:
            raise QueryError("E_TYPE", f"{t!r} has no variant {n.variant}", n.place)
        payload = own.variants[at].payload
        if payload is None or n.payload is None:
            if payload is None and n.payload is not None or payload is not None and not (isinstance(payload, Record) and all(f.has_default for f in payload.fields)):
                raise QueryError("E_TYPE", f"{n.variant} takes {'no' if payload is None else 'a'} payload", n.place)
            return self.variant(own, t, at, None if payload is None else self.record(payload, payload, {}, n.place).col)
        if isinstance(payload, Tuple) and isinstance(n.payload, N.TupleValue):
            if len(payload.items) != len(n.payload.items):
                raise QueryError("E_TYPE", f"{n.variant} takes {len(payload.items)} values", n.place)
            cols = [self.bind(x, s, k).col.alias(f"_{i + 1}") for i, (x, k) in enumerate(zip(n.payload.items, payload.items))]
            return self.variant(own, t, at, F.struct(*cols))
        return self.variant(own, t, at, self.bind(n.payload, s, payload).col)

    # expressions
    def bind(self, n: N.Node, s: Scope, want: Type | None = None) -> Typed:
        """n as a column; want is the type that its place asks for, which literals and constructors take on."""
        if isinstance(n, (N.Constructor, N.RecordValue)):
            t = Named(n.type_name) if isinstance(n, N.Constructor) and n.type_name else want
            if t is not None and (want is None or t == want) and not (isinstance(t, Named) and t.name not in self.r.types) and self.r.recursive(t):
                try:
                    return self.constant(constant_value(n), t, n.place)
                except QueryError:  # not made of literals alone, or wrong, which what follows says better
                    pass
        return getattr(self, f"_{type(n).__name__.lower()}")(n, s, want)

    def condition(self, n: N.Node, s: Scope) -> Column:
        return self.bind(n, s, BOOL).col

    def _literal(self, n: N.Literal, s: Scope, want: Type | None) -> Typed:
        return self.literal(n, want)

    def _path(self, n: N.Path, s: Scope, want: Type | None) -> Typed:
        return self.fit(self.path(n, s), want, n.place)

    def _param(self, n: N.Param, s: Scope, want: Type | None) -> Typed:
        if want is None:
            want = self.param_types.get(n.name)
        if want is None:
            raise QueryError("E_INFER", f"the type of ${n.name} isn't known", n.place)
        if self.param_types.setdefault(n.name, want) != want:
            raise QueryError("E_PARAM", f"${n.name} is used as {self.param_types[n.name]!r} and {want!r}", n.place)
        if self.preparing:
            return Typed(want, self.null(want))
        if n.name not in self.params:
            raise QueryError("E_PARAM", f"${n.name} is missing", n.place)
        return self.constant(self.params[n.name], want, n.place)

    def _listvalue(self, n: N.ListValue, s: Scope, want: Type | None) -> Typed:
        own = self.r.resolve(want) if want is not None else None
        if own is not None and not isinstance(own, List):
            raise QueryError("E_TYPE", f"expected {want!r}, found a list", n.place)
        of, items = self.values(n.items, s, own.of if own is not None else None, n.place)
        return Typed(want or List(of), F.array(*(x.col for x in items)).cast(self.r.spark(List(of))))

    def _tuplevalue(self, n: N.TupleValue, s: Scope, want: Type | None) -> Typed:
        own = self.r.resolve(want) if want is not None else None
        if own is not None and (not isinstance(own, Tuple) or len(own.items) != len(n.items)):
            raise QueryError("E_TYPE", f"expected {want!r}, found a tuple", n.place)
        items = [self.bind(x, s, own.items[i] if own is not None else None) for i, x in enumerate(n.items)]
        return Typed(want or Tuple(tuple(x.type for x in items)), F.struct(*(x.col.alias(f"_{i + 1}") for i, x in enumerate(items))))

    def _mapvalue(self, n: N.MapValue, s: Scope, want: Type | None) -> Typed:
        own = self.r.resolve(want) if want is not None else None
        if own is not None and not isinstance(own, Map):
            raise QueryError("E_TYPE", f"expected {want!r}, found a map", n.place)
        if len({k for k, _ in n.entries}) < len(n.entries):
            raise QueryError("E_TYPE", "a key occurs twice", n.place)
        of, items = self.values([v for _, v in n.entries], s, own.of if own is not None else None, n.place)
        pairs = sorted(zip((k for k, _ in n.entries), items), key=lambda x: x[0].encode())
        return Typed(want or Map(of), F.array(*(F.struct(F.lit(k).alias("key"), v.col.alias("value")) for k, v in pairs)).cast(self.r.spark(Map(of))))

    def _recordvalue(self, n: N.RecordValue, s: Scope, want: Type | None) -> Typed:
        own = self.r.resolve(want) if want is not None else None
        if own is None:
            raise QueryError("E_INFER", "the type of the record isn't known", n.place)
        if isinstance(own, Map) and not n.fields:
            return Typed(want, F.array().cast(self.r.spark(own)))
        if not isinstance(own, Record):
            raise QueryError("E_TYPE", f"expected {want!r}, found a record", n.place)
        given = {}
        for name, value in n.fields:
            f = own.get(name)
            if f is None:
                raise QueryError("E_TYPE", f"unknown field {name}", n.place)
            given[name] = self.bind(value, s, f.type)
        return self.record(own, want, given, n.place)

    def _constructor(self, n: N.Constructor, s: Scope, want: Type | None) -> Typed:
        return self.constructor(n, s, want)

    def _unary(self, n: N.Unary, s: Scope, want: Type | None) -> Typed:
        if n.op == "!":
            return self.fit(Typed(BOOL, ~self.condition(n.of, s)), want, n.place)
        x = self.bind(n.of, s, want)
        own = self.r.resolve(x.type)
        if own not in (INT, FLOAT, DURATION) and not isinstance(own, Decimal):
            raise QueryError("E_TYPE", f"{x.type!r} has no minus", n.place)
        return Typed(x.type, -x.col + F.lit(0.0) if own == FLOAT else -x.col)

    def pair(self, a: N.Node, b: N.Node, s: Scope, want: Type | None) -> tuple[Typed, Typed]:
        """Two operands of one type; a side without a type of its own takes the other's."""
        try:
            left = self.bind(a, s, want) if not _plain(a) or want is not None or _plain(b) else None
        except QueryError as e:
            if e.code != "E_INFER":
                raise
            left = None
        if left is None:
            right = self.bind(b, s, want)
            return self.bind(a, s, right.type), right
        if isinstance(self.r.resolve(left.type), Decimal) and isinstance(a, N.Literal) and isinstance(b, N.Literal):
            return left, self.bind(b, s, None)
        return left, self.bind(b, s, left.type)

    def _binary(self, n: N.Binary, s: Scope, want: Type | None) -> Typed:
        if n.op in ("&&", "||"):
            a, b = self.condition(n.left, s), self.condition(n.right, s)
            if may_raise(n.right):  # evaluated only where the left side doesn't decide
                out = F.when(a, b).otherwise(F.lit(False)) if n.op == "&&" else F.when(a, F.lit(True)).otherwise(b)
            else:
                out = a & b if n.op == "&&" else a | b
            return self.fit(Typed(BOOL, out), want, n.place)
        if n.op in ("+", "-", "*", "/"):
            return self.arithmetic(n, s, want)
        a, b = self.pair(n.left, n.right, s, None)
        return self.fit(Typed(BOOL, self.compare(n.op, a, b)), want, n.place)

    def compare(self, op: str, a: Typed, b: Typed) -> Column:
        own = self.r.resolve(a.type)
        plain = isinstance(own, (Scalar, Decimal))
        if op in ("==", "!="):
            same = a.col == b.col if plain else a.col.eqNullSafe(b.col)
            return same if op == "==" else ~same
        x, y = (a.col, b.col) if plain else (F.struct(a.col.alias("v")), F.struct(b.col.alias("v")))
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def arithmetic(self, n: N.Binary, s: Scope, want: Type | None) -> Typed:
        time = self._time_arithmetic(n, s)
        if time is not None:
            return self.fit(time, want, n.place)
        a, b = self.pair(n.left, n.right, s, want)
        own, op = self.r.resolve(a.type), n.op
        if own == INT:
            col = {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col, "/": lambda: A.int_divide(a.col, b.col)}[op]()
        elif own == FLOAT:
            if op == "/":
                col = A.finite(A.checked(b.col != 0, "E_ARITH: division by zero", a.col / b.col))
            else:
                col = A.finite({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op])
        elif isinstance(own, Decimal) and op in "+-":
            col = A.cast_decimal(a.col + b.col if op == "+" else a.col - b.col, own)
        elif own == DURATION and op in "+-":
            col = a.col + b.col if op == "+" else a.col - b.col
        else:
            raise QueryError("E_TYPE", f"{a.type!r} has no {op}", n.place)
        return Typed(a.type, col)

    def _time_arithmetic(self, n: N.Binary, s: Scope) -> Typed | None:
        if n.op not in "+-" or _plain(n.left) and not isinstance(n.left, N.Literal):
            return None
        try:
            a = self.bind(n.left, s, None)
        except QueryError as e:
            if e.code != "E_INFER":
                raise
            return None
        if self.r.resolve(a.type) != TIMESTAMP:
            return None
        if n.op == "-":
            try:
                b = self.bind(n.right, s, None)
                if self.r.resolve(b.type) == TIMESTAMP:
                    return Typed(DURATION, (a.col - b.col).cast("interval day to second"))
            except QueryError as e:
                if e.code != "E_INFER":
                    raise
        b = self.bind(n.right, s, DURATION)
        return Typed(a.type, in_range(a.col + b.col if n.op == "+" else a.col - b.col))

    def _membership(self, n: N.Membership, s: Scope, want: Type | None) -> Typed:
        if isinstance(n.of, N.ListValue):
            if _plain(n.item) and n.of.items:
                item = self.bind(n.item, s, self.values(n.of.items, s, None, n.place)[0])
            else:
                item = self.bind(n.item, s, None)
            options = [self.bind(x, s, item.type) for x in n.of.items]
            if not options:
                found = F.lit(False)
            elif isinstance(self.r.resolve(item.type), (Scalar, Decimal)):
                found = item.col.isin(*(x.col for x in options))
            else:
                found = item.col.eqNullSafe(options[0].col)
                for x in options[1:]:
                    found = found | item.col.eqNullSafe(x.col)
        else:
            found = self.contains(n.of, n.item, s, n.place)
        return self.fit(Typed(BOOL, ~found if n.negated else found), want, n.place)

    def contains(self, of: N.Node, item: N.Node, s: Scope, place: N.Place) -> Column:
        xs = self.bind(of, s, None)
        own = self.r.resolve(xs.type)
        if own == BYTES:
            y = self.bind(item, s, xs.type)
            return (F.octet_length(y.col) == 0) | (F.call_function("position", y.col, xs.col) > 0)
        if not isinstance(own, List):
            raise QueryError("E_TYPE", f"{xs.type!r} contains nothing", place)
        y = self.bind(item, s, own.of)
        return F.exists(xs.col, lambda x: x.eqNullSafe(y.col))

    def _quantifier(self, n: N.Quantifier, s: Scope, want: Type | None) -> Typed:
        xs = self.bind(n.of, s, None)
        own = self.r.resolve(xs.type)
        if not isinstance(own, List):
            raise QueryError("E_TYPE", f"{xs.type!r} is no list", n.place)
        test = lambda x: self.condition(n.body, s.child({n.name: Typed(own.of, x)}))
        return self.fit(Typed(BOOL, (F.forall if n.every else F.exists)(xs.col, test)), want, n.place)

    def _call(self, n: N.Call, s: Scope, want: Type | None) -> Typed:
        if n.name in s.locals:
            d = s.locals[n.name]
            if d.params is None or len(d.params) != len(n.args):
                raise QueryError("E_QUERY", f"{n.name} takes {len(d.params or ())} arguments", n.place)
            args = [self.bind(a, s, t) for a, (_, t) in zip(n.args, d.params)]
            return self.fit(self.local(d, args, want, n.place), want, n.place)
        if n.name in ("is_some", "is_none"):
            self._arity(n, 1)
            x = self.bind(n.args[0], s, None)
            if not isinstance(self.r.resolve(x.type), Option):
                raise QueryError("E_TYPE", f"{x.type!r} is no option", n.place)
            return self.fit(Typed(BOOL, x.col.isNotNull() if n.name == "is_some" else x.col.isNull()), want, n.place)
        if n.name == "contains":
            self._arity(n, 2)
            return self.fit(Typed(BOOL, self.contains(n.args[0], n.args[1], s, n.place)), want, n.place)
        f = FUNCTIONS.get(n.name)
        if f is None:
            raise QueryError("E_FUNCTION", f"unknown function {n.name}", n.place)
        self._arity(n, len(f.takes) + f.literals)
        fixed = [a.value if isinstance(a, N.Literal) else a for a in n.args[len(f.takes) :]]
        try:
            if n.name in ("decimal_mul", "decimal_div"):
                args = [self.bind(a, s, None) for a in n.args[:2]]
            else:
                args = []
                for a, t in zip(n.args, f.takes):
                    x = self.bind(a, s, t if _plain(a) else None)
                    if t is not None and self.r.resolve(x.type) != t:
                        raise QueryError("E_TYPE", f"{n.name} takes {t!r}, found {x.type!r}", n.place)
                    args.append(x)
            out = f.build(self.r, *args, *fixed)
        except QueryError as e:
            raise e if e.place else QueryError(e.code, e.message, n.place) from e
        if want is not None and isinstance(want, Named) and self.r.resolve(want) == out.type:
            return Typed(want, out.col)  # a fresh result takes on a nominal scalar
        return self.fit(out, want, n.place)

    def _arity(self, n: N.Call, k: int) -> None:
        if len(n.args) != k:
            raise QueryError("E_FUNCTION", f"{n.name} takes {k} arguments, found {len(n.args)}", n.place)

    def _match(self, n: N.Match, s: Scope, want: Type | None) -> Typed:
        x = self.path(n.source, s)
        if not isinstance(self.r.resolve(x.type), (Enum, Option)):
            raise QueryError("E_MATCH", f"{x.type!r} is neither an enum nor an option", n.place)
        patterns.check(self.r, [p for p, _ in n.arms], x.type, n.place)
        scopes = []
        for p, body in n.arms:
            conditions, bound = patterns.lower(self.r, p, x)
            scopes.append((conditions, s.child(bound, arm=True), body))
        if want is None:
            for _, scope, body in scopes:
                try:
                    want = self.bind(body, scope, None).type
                    break
                except QueryError as e:
                    if e.code != "E_INFER":
                        raise
            else:
                raise QueryError("E_INFER", "no arm has a type of its own", n.place)
        kind = self.r.spark(want)
        arms = []
        for c, scope, body in scopes:
            col = self.bind(body, scope, want).col
            arms.append((c, col.cast(kind) if not isinstance(kind, (T.LongType, T.DoubleType, T.BooleanType, T.StringType)) else col))
        return Typed(want, patterns.chain(arms))


def _plain(n: N.Node) -> bool:
    """Whether a node takes its type from where it stands."""
    return isinstance(n, (N.Literal, N.Param, N.Constructor, N.ListValue, N.RecordValue, N.TupleValue, N.MapValue)) or isinstance(n, N.Unary) and n.op == "-" and _plain(n.of)


def may_raise(n: N.Node) -> bool:
    """Whether evaluating n can fail: arithmetic and checked functions."""
    if isinstance(n, N.Binary):
        return n.op in ("+", "-", "*", "/") or may_raise(n.left) or may_raise(n.right)
    if isinstance(n, N.Call):
        return n.name not in ("length", "lower", "upper", "trim", "starts_with", "ends_with", "contains_text", "is_some", "is_none", "contains", "contains_key") or any(map(may_raise, n.args))
    if isinstance(n, N.Unary):
        return n.op == "-" and not isinstance(n.of, N.Literal) or may_raise(n.of)
    if isinstance(n, N.Quantifier):
        return may_raise(n.body) or may_raise(n.of)
    if isinstance(n, N.Membership):
        return may_raise(n.item) or may_raise(n.of)
    return isinstance(n, N.Match) and any(may_raise(b) for _, b in n.arms)
