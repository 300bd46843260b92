"""Values of recursive types as bytes whose order is the values' order.

Spark has no recursive column types, so a value of a recursive type is a binary column: its parts one after another, each written so
that no value's bytes begin another's and that comparing bytes compares values. Spark's own equality, order, grouping and joins then
hold. A query that looks into a value opens one level of it; recursive parts stay bytes, which are the same inside and outside.
"""

from __future__ import annotations

import datetime as dt
import decimal
import struct
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtflow.types import Decimal, Enum, List, Map, Named, Option, Record, Registry, Scalar, Tuple, Type

MAX_DEPTH = 64
_DECIMAL_BIAS = 1 << 127
_EPOCH, _FIRST_DAY = dt.datetime(1970, 1, 1), dt.date(1970, 1, 1)


def _text(raw: bytes) -> bytes:
    return raw.replace(b"\0", b"\0\xff") + b"\0\0"


def _scalar(name: str, v: Any) -> bytes:
    if name in ("text", "uuid"):
        return _text(v.encode())
    if name == "bytes":
        return _text(bytes(v))
    if name == "bool":
        return b"\1" if v else b"\0"
    if name == "float":
        (n,) = struct.unpack(">Q", struct.pack(">d", v + 0.0))
        return struct.pack(">Q", n ^ ((1 << 64) - 1) if n >> 63 else n | 1 << 63)
    if name == "date":
        v = (v - _FIRST_DAY).days
    elif name == "timestamp":
        v = (v - _EPOCH) // dt.timedelta(microseconds=1)
    elif name == "duration":
        v = v // dt.timedelta(microseconds=1)
    return struct.pack(">Q", v + (1 << 63))


class Packer:
    """Packs and opens the encoded values (as Registry.encode makes them) of a registry's types."""

    def __init__(self, registry: Registry):
        self.r = Registry()
        self.r.types = dict(registry.types)

    def pack(self, t: Type, v: Any) -> bytes:
        if self.r.recursive(t) and isinstance(v, (bytes, bytearray)):
            return bytes(v)
        own = self.r.resolve(t)
        if isinstance(own, Option):
            inner = self.r.resolve(own.of)
            return b"\0" if v is None else b"\1" + self.pack(own.of, v[0] if isinstance(inner, Option) else v)
        if isinstance(own, List):
            return b"".join(b"\1" + self.pack(own.of, x) for x in v) + b"\0"
        if isinstance(own, Map):
            return b"".join(b"\1" + _text(k.encode()) + self.pack(own.of, x) for k, x in v) + b"\0"
        if isinstance(own, (Tuple, Record)):
            kinds = own.items if isinstance(own, Tuple) else [f.type for f in own.fields]
            return b"".join(self.pack(k, x) for k, x in zip(kinds, v, strict=True))
        if isinstance(own, Enum):
            at = [i for i, x in enumerate(own.variants) if x.payload is not None]
            payload = own.variants[v[0]].payload
            return struct.pack(">H", v[0]) + (b"" if payload is None else self.pack(payload, v[1 + at.index(v[0])]))
        if isinstance(own, Decimal):
            return (int(v.scaleb(own.scale, decimal.Context(prec=60))) + _DECIMAL_BIAS).to_bytes(16, "big")
        assert isinstance(own, Scalar)
        return _scalar(own.name, v)

    def unpack(self, t: Type, b: bytes, at: int = 0, whole: bool = True) -> tuple[Any, int]:
        """The encoded value at a place, and where it ends. Not whole: recursive parts are left as bytes."""
        own = self.r.resolve(t)
        step = lambda k, at: self.part(k, b, at) if not whole else self.unpack(k, b, at)
        if isinstance(own, Option):
            if b[at] == 0:
                return None, at + 1
            v, at = step(own.of, at + 1)
            return ((v,) if isinstance(self.r.resolve(own.of), Option) else v), at
        if isinstance(own, (List, Map)):
            out = []
            while b[at]:
                at += 1
                if isinstance(own, Map):
                    k, at = self._until(b, at)
                    v, at = step(own.of, at)
                    out.append((k.decode(), v))
                else:
                    v, at = step(own.of, at)
                    out.append(v)
            return out, at + 1
        if isinstance(own, (Tuple, Record)):
            out = []
            for k in own.items if isinstance(own, Tuple) else [f.type for f in own.fields]:
                v, at = step(k, at)
                out.append(v)
            return tuple(out), at
        if isinstance(own, Enum):
            (tag,) = struct.unpack_from(">H", b, at)
            payload, value = own.variants[tag].payload, None
            at += 2
            if payload is not None:
                value, at = step(payload, at)
            return (tag, *(value if i == tag else None for i, x in enumerate(own.variants) if x.payload is not None)), at
        if isinstance(own, Decimal):
            return decimal.Decimal(int.from_bytes(b[at : at + 16], "big") - _DECIMAL_BIAS).scaleb(-own.scale, decimal.Context(prec=60)), at + 16
        name = own.name
        if name in ("text", "uuid", "bytes"):
            raw, at = self._until(b, at)
            return (bytearray(raw) if name == "bytes" else raw.decode()), at
        if name == "bool":
            return b[at] == 1, at + 1
        (n,) = struct.unpack_from(">Q", b, at)
        if name == "float":
            return struct.unpack(">d", struct.pack(">Q", n & ((1 << 63) - 1) if n >> 63 else n ^ ((1 << 64) - 1)))[0], at + 8
        n -= 1 << 63
        made = {"date": lambda: _FIRST_DAY + dt.timedelta(days=n), "timestamp": lambda: _EPOCH + dt.timedelta(microseconds=n), "duration": lambda: dt.timedelta(microseconds=n)}
        return made.get(name, lambda: n)(), at + 8

    def part(self, t: Type, b: bytes, at: int) -> tuple[Any, int]:
        """As unpack, but a value of a recursive type stays bytes."""
        if self.r.recursive(t):
            end = self.unpack(t, b, at, whole=False)[1]
            return b[at:end], end
        return self.unpack(t, b, at, whole=False)

    @staticmethod
    def _until(b: bytes, at: int) -> tuple[bytes, int]:
        end = at
        while True:
            end = b.index(b"\0", end)
            if b[end + 1] == 0:
                return b[at:end].replace(b"\0\xff", b"\0"), end + 2
            end += 2


def _arrow(d: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(d)


def _named(d: T.DataType, v: Any) -> Any:
    """An encoded value with its structs as dicts."""
    if v is None:
        return None
    if isinstance(d, T.StructType):
        return {f.name: _named(f.dataType, x) for f, x in zip(d.fields, v)}
    if isinstance(d, T.ArrayType):
        return [_named(d.elementType, x) for x in v]
    return v


def _plain(d: T.DataType, v: Any) -> Any:
    """The inverse of _named."""
    if v is None:
        return None
    if isinstance(d, T.StructType):
        return tuple(_plain(f.dataType, v[f.name]) for f in d.fields)
    if isinstance(d, T.ArrayType):
        return [_plain(d.elementType, x) for x in v]
    if isinstance(d, T.TimestampNTZType) and getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def opened(r: Registry, value: Any) -> Column:
    """A typed value's column; of a recursive type the struct of one level, in which recursive parts are bytes, by Arrow batches."""
    t, x = value.type, value.col
    if not r.recursive(t):
        return x
    packer, own = Packer(r), r.resolve(t)
    kind = r.spark(own)

    @F.arrow_udf(kind)
    def open_level(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else _named(kind, packer.unpack(own, v, 0, whole=False)[0]) for v in values.to_pylist()], _arrow(kind))

    return open_level(x)


def closed(r: Registry, t: Type, x: Column) -> Column:
    """A struct as a value of t: its bytes, if t is recursive."""
    if not r.recursive(t):
        return x
    packer, own = Packer(r), r.resolve(t)
    kind = r.spark(own)

    @F.arrow_udf(T.BinaryType())
    def close_level(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else packer.pack(own, _plain(kind, v)) for v in values.to_pylist()], pa.binary())

    return close_level(x)


def has_finite_values(types: dict[str, Type], name: str) -> bool:
    """Whether a type has a value that ends: an enum needs one such variant, a record only such fields; lists may be empty."""

    def ends(t: Type, seen: frozenset[str]) -> bool:
        if isinstance(t, Named):
            return t.name not in seen and (t.name not in types or ends(types[t.name], seen | {t.name}))
        if isinstance(t, (Option, List, Map)):
            return True
        if isinstance(t, Enum):
            return any(v.payload is None or ends(v.payload, seen) for v in t.variants)
        if isinstance(t, Tuple):
            return all(ends(x, seen) for x in t.items)
        return not isinstance(t, Record) or all(ends(f.type, seen) for f in t.fields)

    return ends(types[name], frozenset({name}))
