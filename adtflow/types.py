"""The type algebra and its encoding in Spark types.

Options are nullable columns (an option of an option is a nullable struct with one field v), enums are structs of a tag and one
nullable struct for each variant with a payload, maps are arrays of entries sorted by key. With these encodings Spark's own
equality and order of structs and arrays are those of the algebra.
"""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from adtflow.errors import QueryError


class Type:
    """Base of all types; equal types unify, and nominal types are equal only to themselves."""

    def __repr__(self) -> str:
        return show(self)


@dataclass(frozen=True, repr=False)
class Scalar(Type):
    name: str


INT, FLOAT, BOOL, TEXT, UUID, DATE, TIMESTAMP, DURATION, BYTES = map(Scalar, ("int", "float", "bool", "text", "uuid", "date", "timestamp", "duration", "bytes"))
SCALARS = {t.name: t for t in (INT, FLOAT, BOOL, TEXT, UUID, DATE, TIMESTAMP, DURATION, BYTES)}


@dataclass(frozen=True, repr=False)
class Decimal(Type):
    precision: int
    scale: int


@dataclass(frozen=True, repr=False)
class Option(Type):
    of: Type


@dataclass(frozen=True, repr=False)
class List(Type):
    of: Type


@dataclass(frozen=True, repr=False)
class Map(Type):
    of: Type


@dataclass(frozen=True, repr=False)
class Tuple(Type):
    items: tuple[Type, ...]


@dataclass(frozen=True, repr=False)
class Field:
    name: str
    type: Type
    default: Any = field(default=None, compare=False)
    has_default: bool = field(default=False, compare=False)


@dataclass(frozen=True, repr=False)
class Record(Type):
    fields: tuple[Field, ...]

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


@dataclass(frozen=True, repr=False)
class Variant:
    """payload: None for a unit variant, a Record for named fields, a Tuple for positional ones."""

    name: str
    payload: Record | Tuple | None = None


@dataclass(frozen=True, repr=False)
class Enum(Type):
    variants: tuple[Variant, ...]

    def index(self, name: str) -> int | None:
        return next((i for i, v in enumerate(self.variants) if v.name == name), None)


@dataclass(frozen=True, repr=False)
class Named(Type):
    """A nominal type; what it stands for is in the registry, so that types can refer to themselves."""

    name: str


class Registry:
    """Declared types by name."""

    def __init__(self) -> None:
        self.types: dict[str, Type] = {}

    def define(self, name: str, of: Type) -> Named:
        if name in self.types:
            raise QueryError("E_TYPE", f"type {name} is already declared")
        self.types[name] = of
        return Named(name)

    def resolve(self, t: Type) -> Type:
        """What a nominal type stands for, through chains of names."""
        while isinstance(t, Named):
            if t.name not in self.types:
                raise QueryError("E_TYPE", f"unknown type {t.name}")
            t = self.types[t.name]
        return t

    def is_recursive(self, name: str) -> bool:
        def inside(t: Type, seen: frozenset[str]) -> bool:
            if isinstance(t, Named):
                return t.name == name or t.name not in seen and inside(self.types.get(t.name, INT), seen | {t.name})
            return any(inside(x, seen) for x in children(t))

        return inside(self.types[name], frozenset({name}))

    def recursive(self, t: Type) -> bool:
        """Whether values of t are columns of bytes, as its type contains itself."""
        return isinstance(t, Named) and (self.is_recursive(t.name) or self.recursive(self.types[t.name]))

    def spark(self, t: Type, depth: int = 0) -> T.DataType:
        """The Spark type of a type; nullability is decided by the field that holds it."""
        if self.recursive(t):
            return T.BinaryType()
        t = self.resolve(t)
        if isinstance(t, Scalar):
            return _SPARK[t.name]
        if isinstance(t, Decimal):
            return T.DecimalType(t.precision, t.scale)
        if isinstance(t, Option):
            inner = self.resolve(t.of)
            return T.StructType([T.StructField("v", self.spark(inner), True)]) if isinstance(inner, Option) else self.spark(t.of)
        if isinstance(t, List):
            return T.ArrayType(self.spark(t.of), True)  # Spark can't cast an array to one that promises no nulls
        if isinstance(t, Map):
            return T.ArrayType(T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", self.spark(t.of), True)]), True)
        if isinstance(t, Tuple):
            return T.StructType([T.StructField(f"_{i + 1}", self.spark(x), True) for i, x in enumerate(t.items)])
        if isinstance(t, Record):
            return T.StructType([T.StructField(f.name, self.spark(f.type), True) for f in t.fields])
        if isinstance(t, Enum):
            return T.StructType([T.StructField("tag", T.IntegerType(), True), *(T.StructField(v.name, self.spark(v.payload), True) for v in t.variants if v.payload is not None)])
        raise QueryError("E_TYPE", f"no column encoding for {t!r}")

    def encode(self, t: Type, value: Any, depth: int = 0) -> Any:
        """A Python value as Spark's createDataFrame takes it.

        Enums are (variant name, payload) with a dict or tuple as payload; None is an empty option, Some values of nested options
        are wrapped as ('Some', value); records are dicts, whose missing fields take their defaults. Of recursive types the bytes.
        """
        if self.recursive(t):
            from adtflow.recursion import MAX_DEPTH, Packer

            if depth > MAX_DEPTH:
                raise QueryError("E_LIMIT", f"a value is nested more than {MAX_DEPTH} deep")
            own = self.resolve(t)
            if isinstance(own, Record) and isinstance(value, tuple) and len(value) == 2 and value[0] == show(t):
                value = value[1]
            return bytearray(Packer(self).pack(own, self.encode(own, value, depth + 1)))
        name, t = t, self.resolve(t)
        if isinstance(t, Option):
            if value is None:
                return None
            inner = self.resolve(t.of)
            if isinstance(inner, Option):
                return (self.encode(t.of, value[1], depth),)
            return self.encode(t.of, value[1] if isinstance(value, tuple) and len(value) == 2 and value[0] == "Some" else value, depth)
        if value is None:
            raise QueryError("E_TYPE", f"a value of {t!r} is missing")
        if isinstance(t, List):
            return [self.encode(t.of, x, depth) for x in value]
        if isinstance(t, Map):
            return [(k, self.encode(t.of, value[k], depth)) for k in sorted(value, key=lambda k: k.encode())]
        if isinstance(t, Tuple):
            if len(value) != len(t.items):
                raise QueryError("E_TYPE", f"{t!r} has {len(t.items)} items")
            return tuple(self.encode(x, v, depth) for x, v in zip(t.items, value))
        if isinstance(t, Record):
            if isinstance(value, tuple) and len(value) == 2 and value[0] == show(name):
                value = value[1]
            if not isinstance(value, dict):
                raise QueryError("E_TYPE", f"{value!r} is no {show(name)}")
            if unknown := set(value) - {f.name for f in t.fields}:
                raise QueryError("E_TYPE", f"unknown field {sorted(unknown)[0]}")
            out = []
            for f in t.fields:
                if f.name not in value and not f.has_default:
                    raise QueryError("E_TYPE", f"field {f.name} is missing")
                out.append(self.encode(f.type, value.get(f.name, f.default), depth))
            return tuple(out)
        if isinstance(t, Enum):
            name, payload = value if isinstance(value, tuple) else (value, None)
            at = t.index(name)
            if at is None:
                raise QueryError("E_TYPE", f"unknown variant {name}")
            own = t.variants[at]
            if payload is None and isinstance(own.payload, Record) and all(f.has_default for f in own.payload.fields):
                payload = {}
            if (payload is None) != (own.payload is None):
                raise QueryError("E_TYPE", f"variant {name} takes {'no' if own.payload is None else 'a'} payload")
            return (at, *(self.encode(v.payload, payload, depth) if v is own else None for v in t.variants if v.payload is not None))
        return scalar_value(t, value)

    def decode(self, t: Type, value: Any) -> Any:
        """The inverse of encode for collected values."""
        if self.recursive(t) and isinstance(value, (bytes, bytearray)):
            from adtflow.recursion import Packer

            return self.decode(self.resolve(t), Packer(self).unpack(t, bytes(value))[0])
        t = self.resolve(t)
        if value is None:
            return None
        if isinstance(t, Option):
            inner = self.resolve(t.of)
            return ("Some", self.decode(t.of, value[0])) if isinstance(inner, Option) else self.decode(t.of, value)
        if isinstance(t, List):
            return [self.decode(t.of, x) for x in value]
        if isinstance(t, Map):
            return {x[0]: self.decode(t.of, x[1]) for x in value}
        if isinstance(t, Tuple):
            return tuple(self.decode(x, v) for x, v in zip(t.items, value))
        if isinstance(t, Record):
            return {f.name: self.decode(f.type, value[i]) for i, f in enumerate(t.fields)}
        if isinstance(t, Enum):
            v = t.variants[value[0]]
            at = 1 + sum(x.payload is not None for x in t.variants[: value[0]])
            return v.name if v.payload is None else (v.name, self.decode(v.payload, value[at]))
        if isinstance(t, Scalar) and t.name == "bytes":
            return bytes(value)
        return value


def scalar_value(t: Type, value: Any) -> Any:
    """value as a scalar type holds it; integers fit floats and decimals where nothing is lost."""
    if isinstance(t, Decimal) and type(value) in (int, decimal.Decimal):
        out = decimal.Decimal(value)
        with decimal.localcontext(prec=100):
            fitted = out.quantize(decimal.Decimal(1).scaleb(-t.scale))
            if fitted == out and abs(out) < decimal.Decimal(10) ** (t.precision - t.scale):
                return fitted
    elif t == FLOAT and type(value) in (int, float) and value == value and abs(value) != float("inf") and float(value) == value:
        return float(value) + 0.0
    elif t == INT and type(value) is int and -(2**63) <= value < 2**63:
        return value
    elif t == TIMESTAMP and type(value) is dt.datetime:
        return value if value.tzinfo is None else value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    elif t == UUID and type(value) is str:
        return value.lower()
    elif t == BYTES and isinstance(value, (bytes, bytearray)):
        return bytearray(value)
    elif isinstance(t, Scalar) and type(value) is {"bool": bool, "text": str, "date": dt.date, "duration": dt.timedelta}.get(t.name):
        return value
    raise QueryError("E_TYPE", f"{value!r} is no {t!r}")


_SPARK = {
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "text": T.StringType(),
    "uuid": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "duration": T.DayTimeIntervalType(0, 3),
    "bytes": T.BinaryType(),
}


def children(t: Type) -> list[Type]:
    if isinstance(t, (Option, List, Map)):
        return [t.of]
    if isinstance(t, Tuple):
        return list(t.items)
    if isinstance(t, Record):
        return [f.type for f in t.fields]
    if isinstance(t, Enum):
        return [v.payload for v in t.variants if v.payload is not None]
    return []


def show(t: Type) -> str:
    """A type as it is written in the language."""
    if isinstance(t, (Scalar, Named)):
        return t.name
    if isinstance(t, Decimal):
        return f"Decimal<{t.precision}, {t.scale}>"
    if isinstance(t, (Option, List)):
        return f"{type(t).__name__}<{show(t.of)}>"
    if isinstance(t, Map):
        return f"Map<text, {show(t.of)}>"
    if isinstance(t, Tuple):
        return "(" + ", ".join(map(show, t.items)) + ("," if len(t.items) == 1 else "") + ")"
    if isinstance(t, Record):
        return "{" + ", ".join(f"{f.name}: {show(f.type)}" for f in t.fields) + "}"
    if isinstance(t, Enum):
        return " | ".join(v.name + ("" if v.payload is None else f" {show(v.payload)}") for v in t.variants)
    return type(t).__name__


def from_spark_type(d: T.DataType, nullable: bool) -> Type:
    """The type of a Parquet column: integers are int, nullable ones options, timestamps UTC."""
    if isinstance(d, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        t: Type = INT
    elif isinstance(d, (T.FloatType, T.DoubleType)):
        t = FLOAT
    elif isinstance(d, T.DecimalType):
        t = Decimal(d.precision, d.scale)
    elif isinstance(d, T.ArrayType):
        t = List(from_spark_type(d.elementType, d.containsNull))
    elif isinstance(d, T.MapType) and isinstance(d.keyType, T.StringType):
        t = Map(from_spark_type(d.valueType, d.valueContainsNull))
    elif isinstance(d, T.StructType):
        t = Record(tuple(Field(f.name, from_spark_type(f.dataType, f.nullable)) for f in d.fields))
    else:
        t = next((SCALARS[k] for k, v in _SPARK.items() if k != "uuid" and type(v) is type(d)), None)
        if isinstance(d, T.TimestampType):
            t = TIMESTAMP
        if t is None:
            raise QueryError("E_TYPE", f"unsupported column type {d.simpleString()}")
    return Option(t) if nullable else t
