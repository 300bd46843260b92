"""Schema migrations: each step changes the declared types; the tables' rows are rebuilt once, in one projection, at the end."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from adtflow.errors import QueryError
from adtflow.functions.scalars import Typed
from adtflow.lang import nodes as N
from adtflow.lang.parser import constant
from adtflow.plans.expressions import Binder, Scope, column
from adtflow.recursion import Packer
from adtflow.types import Enum, Field, List, Map, Named, Option, Record, Registry, Tuple, Type


@dataclass
class Edits:
    """Where new names come from: fields and variants by (type, new name), types by new name; converters of changed fields."""

    fields: dict[tuple[str, str], str] = field(default_factory=dict)
    convert: dict[tuple[str, str], tuple[str, N.Node]] = field(default_factory=dict)
    variants: dict[tuple[str, str], str] = field(default_factory=dict)
    #: by type and variant's name, which a dropped one keeps: the name of the old payload and the expression of the new payload or value
    payloads: dict[tuple[str, str], tuple[str, N.Node]] = field(default_factory=dict)
    dropped: dict[tuple[str, str], tuple[str, N.Node]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)


class Rebuild:
    """Values of old types as values of new ones, at any depth."""

    def __init__(self, old: Registry, new: Registry, edits: Edits):
        self.old, self.new, self.e = old, new, edits
        self.b = Binder(new)

    def value(self, x: Column, a: Type, b: Type) -> Column:
        name = b.name if isinstance(b, Named) else ""
        own, to = self.old.resolve(a), self.new.resolve(b)
        if repr(own) == repr(to) and not self.touched(a, frozenset()):
            return x
        if self.old.recursive(a) or self.new.recursive(b):
            if not (self.old.recursive(a) and self.new.recursive(b)):
                raise QueryError("E_MIGRATION", f"{a!r} and {b!r} aren't both recursive; drop the field and add it")
            return self.repacked(x, a, b)
        if isinstance(to, Option):
            if not isinstance(own, Option):
                inner = self.value(x, a, to.of)
                return F.struct(inner.alias("v")) if isinstance(self.new.resolve(to.of), Option) else inner
            if isinstance(self.new.resolve(to.of), Option):
                return F.when(x.isNotNull(), F.struct(self.value(x.getField("v"), own.of, to.of).alias("v")))
            return F.when(x.isNotNull(), self.value(x, own.of, to.of))
        if isinstance(to, List) and isinstance(own, List):
            return F.transform(x, lambda v: self.value(v, own.of, to.of))
        if isinstance(to, Map) and isinstance(own, Map):
            return F.transform(x, lambda e: F.struct(e["key"].alias("key"), self.value(e["value"], own.of, to.of).alias("value")))
        if isinstance(to, Tuple) and isinstance(own, Tuple) and len(to.items) == len(own.items):
            return F.struct(*(self.value(x.getField(f"_{i + 1}"), p, q).alias(f"_{i + 1}") for i, (p, q) in enumerate(zip(own.items, to.items))))
        if isinstance(to, Record) and isinstance(own, Record):
            return F.struct(*(c.alias(f.name) for f, c in zip(to.fields, self.fields(lambda n: x.getField(n), own, to, name))))
        if isinstance(to, Enum) and isinstance(own, Enum):
            return self.enum(x, own, to, name)
        raise QueryError("E_MIGRATION", f"{a!r} doesn't become {b!r} by itself; change the field with using")

    def repacked(self, x: Column, a: Type, b: Type) -> Column:
        """A column of a recursive type's bytes in the new type: every value is taken apart and built again, by Arrow batches."""
        old, new = Packer(self.old), Packer(self.new)
        rebuilt = self.plan(a, b, {})

        @F.arrow_udf("binary")
        def repack(values: pa.Array) -> pa.Array:
            return pa.array([None if v is None else new.pack(b, rebuilt[0](old.unpack(a, v)[0])) for v in values.to_pylist()], pa.binary())

        return repack(x)

    def plan(self, a: Type, b: Type, known: dict[tuple[str, str], list]) -> list:
        """A list of one function from encoded old values to new ones; a list, as a type's function needs itself."""
        mark = (repr(a), repr(b))
        if isinstance(a, Named) and mark in known:
            return known[mark]
        out: list = []
        if isinstance(a, Named):
            known[mark] = out
        name = b.name if isinstance(b, Named) else ""
        own, to = self.old.resolve(a), self.new.resolve(b)
        if isinstance(own, Option) and isinstance(to, Option):
            inner = self.plan(own.of, to.of, known)
            double = isinstance(self.old.resolve(own.of), Option)
            out.append(lambda v: None if v is None else (inner[0](v[0]),) if double else inner[0](v))
        elif isinstance(own, List) and isinstance(to, List):
            inner = self.plan(own.of, to.of, known)
            out.append(lambda v: [inner[0](x) for x in v])
        elif isinstance(own, Map) and isinstance(to, Map):
            inner = self.plan(own.of, to.of, known)
            out.append(lambda v: [(k, inner[0](x)) for k, x in v])
        elif isinstance(own, Tuple) and isinstance(to, Tuple) and len(own.items) == len(to.items):
            parts = [self.plan(p, q, known) for p, q in zip(own.items, to.items)]
            out.append(lambda v: tuple(f[0](x) for f, x in zip(parts, v)))
        elif isinstance(own, Record) and isinstance(to, Record):
            sources: list[tuple[int, Any]] = []
            for f in to.fields:
                if (name, f.name) in self.e.convert:
                    raise QueryError("E_MIGRATION", f"{f.name} lies in a recursive type, whose fields can't be computed")
                at = next((i for i, g in enumerate(own.fields) if g.name == self.e.fields.get((name, f.name), f.name)), None)
                if at is None and not f.has_default:
                    raise QueryError("E_MIGRATION", f"the new field {f.name} needs a default")
                sources.append((-1, self.new.encode(f.type, f.default)) if at is None else (at, self.plan(own.fields[at].type, f.type, known)))
            out.append(lambda v: tuple(x if i < 0 else x[0](v[i]) for i, x in sources))
        elif isinstance(own, Enum) and isinstance(to, Enum):
            if any(owner == name for owner, _ in [*self.e.payloads, *self.e.dropped]):
                raise QueryError("E_MIGRATION", f"{name} is recursive, whose variants can't be computed")
            slots = [i for i, v in enumerate(own.variants) if v.payload is not None]
            ways: dict[int, tuple[int, list | None]] = {}
            for i, v in enumerate(to.variants):
                at = own.index(self.e.variants.get((name, v.name), v.name))
                if at is not None:
                    ways[at] = (i, None if v.payload is None else self.plan(own.variants[at].payload, v.payload, known))
            held = [i for i, v in enumerate(to.variants) if v.payload is not None]

            def variant(v: tuple) -> tuple:
                if v[0] not in ways:
                    raise ValueError("E_MIGRATION: a row holds a dropped variant")
                tag, part = ways[v[0]]
                return (tag, *(part[0](v[1 + slots.index(v[0])]) if part and i == tag else None for i in held))

            out.append(variant)
        elif repr(own) == repr(to):
            out.append(lambda v: v)
        else:
            raise QueryError("E_MIGRATION", f"{a!r} doesn't become {b!r} by itself")
        return out

    def carried(self, x: Column, t: Type) -> Typed:
        """An old value for an expression, in which types have their new names."""
        new = t
        for to, was in self.e.types.items():
            new = _renamed(new, was, to)
        return Typed(new, self.value(x, t, new))

    def touched(self, t: Type, seen: frozenset[str]) -> bool:
        """Whether a type's values can have changed below their own shape."""
        from adtflow.types import children

        if isinstance(t, Named):
            if t.name in seen:
                return False
            new = self.new.types.get(next((k for k, v in self.e.types.items() if v == t.name), t.name))
            return repr(new) != repr(self.old.types[t.name]) or self.touched(self.old.types[t.name], seen | {t.name})
        return any(self.touched(c, seen) for c in children(t))

    def fields(self, get: Callable[[str], Column], own: Record, to: Record, name: str) -> list[Column]:
        out = []
        for f in to.fields:
            source = self.e.fields.get((name, f.name), f.name)
            before = own.get(source)
            if (name, f.name) in self.e.convert:
                param, body = self.e.convert[name, f.name]
                assert before is not None
                col = self.b.bind(body, Scope({}, bound={param: self.carried(get(source), before.type)}), f.type).col
            elif before is not None:
                col = self.value(get(source), before.type, f.type)
            elif f.has_default:
                col = self.b.constant(f.default, f.type).col
            else:
                raise QueryError("E_MIGRATION", f"the new field {f.name} needs a default")
            out.append(col.cast(self.new.spark(f.type)))
        return out

    def enum(self, x: Column, own: Enum, to: Enum, name: str) -> Column:
        """Each variant's rows get their new tag and payload; those of dropped variants the value that their expression gives."""
        tag, slots, whole = None, [], self.new.spark(to)
        nothing = lambda v: F.lit(None).cast(self.new.spark(v.payload)).alias(v.name)
        for i, v in enumerate(to.variants):
            at = own.index(self.e.variants.get((name, v.name), v.name))
            if at is not None and (name, v.name) not in self.e.dropped:
                tag = F.when(x.getField("tag") == at, i) if tag is None else tag.when(x.getField("tag") == at, i)
            if v.payload is None:
                continue
            kind = self.new.spark(v.payload)
            before = own.variants[at].payload if at is not None else None
            if (name, v.name) in self.e.payloads and at is not None:
                value = self.computed(self.e.payloads[name, v.name], x, own, at, v.payload)
                slots.append(F.when(x.getField("tag") == at, value).cast(kind).alias(v.name))
            elif before is None:
                slots.append(nothing(v))
            else:
                slot = x.getField(own.variants[at].name)
                slots.append(F.when(slot.isNotNull(), self.value(slot, before, v.payload)).cast(kind).alias(v.name))
        if tag is None:
            raise QueryError("E_MIGRATION", f"no variant of {name} is left")
        out = F.struct(tag.otherwise(F.raise_error(F.lit("E_MIGRATION: a row holds a dropped variant"))).alias("tag"), *slots)
        for (owner, gone), using in self.e.dropped.items():
            if owner == name:
                at = own.index(self.e.variants.get((name, gone), gone))
                out = F.when(x.getField("tag") == at, self.computed(using, x, own, at, Named(name)).cast(whole)).otherwise(out.cast(whole))
        return out

    def computed(self, using: tuple[str, N.Node], x: Column, own: Enum, at: int, to: Type) -> Column:
        """What an expression makes of the payload of a value's variant; its items are a tuple, unless there is one."""
        param, body = using
        payload = own.variants[at].payload
        if payload is None:
            old = Typed(Tuple(()), F.lit(None))
        else:
            slot = x.getField(own.variants[at].name)
            single = isinstance(payload, Tuple) and len(payload.items) == 1
            old = self.carried(slot.getField("_1") if single else slot, payload.items[0] if single else payload)
        if isinstance(to, Tuple) and len(to.items) == 1:
            return F.struct(self.b.bind(body, Scope({}, bound={param: old}), to.items[0]).col.alias("_1"))
        return self.b.bind(body, Scope({}, bound={param: old}), to).col


def _carried(t: Record, owner: str, r: Registry, e: Edits) -> Record:
    """t with the defaults that it had before written in the new names of fields and variants."""

    def value(v: Any, t: Type) -> Any:
        name = t.name if isinstance(t, Named) else ""
        own = r.resolve(t)
        if isinstance(own, Option):
            return v if v is None else ("Some", value(v[1], own.of)) if isinstance(v, tuple) and v[0] == "Some" else value(v, own.of)
        if isinstance(own, List) and isinstance(v, list):
            return [value(x, own.of) for x in v]
        if isinstance(own, Tuple) and isinstance(v, tuple):
            return tuple(value(x, k) for x, k in zip(v, own.items))
        if isinstance(own, Record):
            v = v[1] if isinstance(v, tuple) else v
            sources = {f.name: e.fields.get((name, f.name), f.name) for f in own.fields}
            return {f.name: value(v[sources[f.name]], f.type) for f in own.fields if sources[f.name] in v}
        if isinstance(own, Enum):
            was, payload = v if isinstance(v, tuple) else (v, None)
            to = next((x for x in own.variants if e.variants.get((name, x.name), x.name) == was), None)
            return v if to is None else to.name if payload is None or to.payload is None else (to.name, value(payload, to.payload))
        return v

    old = lambda f: f.has_default and e.fields.get((owner, f.name)) != ""
    return Record(tuple(replace(f, default=value(f.default, f.type)) if old(f) else f for f in t.fields))


def _renamed(t: Type, old: str, new: str) -> Type:
    """t with the type old called new."""
    if isinstance(t, Named):
        return Named(new) if t.name == old else t
    if isinstance(t, (Option, List, Map)):
        return type(t)(_renamed(t.of, old, new))
    if isinstance(t, Tuple):
        return Tuple(tuple(_renamed(x, old, new) for x in t.items))
    if isinstance(t, Record):
        return Record(tuple(replace(f, type=_renamed(f.type, old, new)) for f in t.fields))
    if isinstance(t, Enum):
        return Enum(tuple(replace(v, payload=None if v.payload is None else _renamed(v.payload, old, new)) for v in t.variants))
    return t


def apply(work: Any, n: N.Migration) -> None:
    """Applies a migration's steps to a candidate state and writes the tables that they touch."""
    state, before, edits = work.state, copy.deepcopy(work.state), Edits()
    old = Registry()
    old.types = before.types
    types = state.types
    origin = {name: name for name in state.tables}

    def record(name: str) -> Record:
        if not isinstance(types.get(name), Record):
            raise QueryError("E_MIGRATION", f"{name} is no struct", n.place)
        return types[name]

    def enum(name: str) -> Enum:
        if not isinstance(types.get(name), Enum):
            raise QueryError("E_MIGRATION", f"{name} is no enum", n.place)
        return types[name]

    def table(name: str) -> Any:
        if name not in state.tables:
            raise QueryError("E_MIGRATION", f"unknown table {name}", n.place)
        return state.tables[name]

    def uses(owner: str, name: str) -> None:
        for t in state.tables.values():
            if t.row == owner and (t.key == name or any(c.split(".")[0] == name for i in t.indexes for c, _ in i.components)):
                raise QueryError("E_MIGRATION", f"{name} is a key or part of an index", n.place)

    late: list[Callable[[], None]] = []  # checks of rows, which are rebuilt first
    for what, args in n.steps:
        if what == "add sequence":
            work.sequencedecl(N.SequenceDecl(*args, place=n.place), None)
        elif what in ("drop sequence", "rename sequence"):
            if args[0] not in state.sequences or what == "rename sequence" and args[1] in state.sequences:
                raise QueryError("E_SEQUENCE", f"there is no sequence {args[0]}, or one has the new name", n.place)
            users = [(t, f) for t in state.tables.values() for f, how in t.generated.items() if how == f"next {args[0]}"]
            if what == "drop sequence":
                if users:
                    raise QueryError("E_SEQUENCE", f"sequence {args[0]} is in use", n.place)
                state.sequences.pop(args[0])
            else:
                state.sequences[args[1]] = state.sequences.pop(args[0])
                for t, f in users:
                    t.generated[f] = f"next {args[1]}"
        elif what == "change generator":
            t = table(args[0])
            if record(t.row).get(args[1]) is None:
                raise QueryError("E_MIGRATION", f"no field {args[1]}", n.place)
            work.generator(record(t.row), args[1], args[2], n.place)
            t.generated[args[1]] = args[2]
        elif what == "add index":
            late.append(lambda d=args[0]: work.indexdecl(d, None))
        elif what == "drop index":
            d = args[0]
            t = table(d.table)
            shape = tuple((".".join(p.parts), down) for p, down in d.components)
            predicate = None if d.predicate is None else work.atoms(d.predicate)
            found = [i for i in t.indexes if i.components == shape and i.predicate == predicate]
            if not found:
                raise QueryError("E_INDEX", f"{d.table} has no such index", n.place)
            if any(r.target == d.table and r.target_fields == tuple(c for c, _ in shape) and r.target_fields != (t.key,) for r in state.references):
                raise QueryError("E_INDEX", "a reference needs the index", n.place)
            t.indexes.remove(found[0])
        elif what == "add reference":
            late.append(lambda d=args[0]: work.referencedecl(d, None))
        elif what == "drop reference":
            work.dropreference(N.DropReference(args[0], place=n.place), None)
        elif what == "add type":
            if args[0] in types:
                raise QueryError("E_MIGRATION", f"type {args[0]} exists", n.place)
            types[args[0]] = args[1]
        elif what == "drop type":
            if any(args[0] in repr(t).replace("<", " ").replace(">", " ").replace(",", " ").split() for k, t in types.items() if k != args[0]) or any(t.row == args[0] for t in state.tables.values()):
                raise QueryError("E_MIGRATION", f"type {args[0]} is in use", n.place)
            types.pop(args[0])
        elif what == "rename type":
            a, b = args
            if a not in types or b in types:
                raise QueryError("E_MIGRATION", f"{a} can't be called {b}", n.place)
            renamed = {(b if k == a else k): _renamed(t, a, b) for k, t in types.items()}
            types.clear()
            types.update(renamed)
            edits.types[b] = edits.types.pop(a, a)
            for m in (edits.fields, edits.convert, edits.variants, edits.payloads, edits.dropped):
                for k in [k for k in m if k[0] == a]:
                    m[b, k[1]] = m.pop(k)
            for t in state.tables.values():
                t.row = b if t.row == a else t.row
        elif what == "add table":
            work.tabledecl(N.TableDecl(*args, place=n.place), None)
        elif what == "drop table":
            table(args[0])
            if any(args[0] in (r.source, r.target) for r in state.references):
                raise QueryError("E_MIGRATION", f"{args[0]} has references", n.place)
            state.tables.pop(args[0])
            origin.pop(args[0], None)
        elif what == "rename table":
            state.tables[args[1]] = table(args[0])
            del state.tables[args[0]]
            origin[args[1]] = origin.pop(args[0], args[0])
            for r in state.references:
                r.source, r.target = (args[1] if x == args[0] else x for x in (r.source, r.target))
        elif what == "set key":
            t = table(args[0])
            if record(t.row).get(args[1]) is None:
                raise QueryError("E_MIGRATION", f"no field {args[1]}", n.place)
            t.key = args[1]
        elif what == "drop key":
            table(args[0]).key = None
        elif what == "add field":
            owner, name, t, default = args
            if record(owner).get(name) is not None:
                raise QueryError("E_MIGRATION", f"{owner}.{name} exists", n.place)
            new = Field(name, t) if default is None else Field(name, t, constant(default), True)
            types[owner] = Record((*record(owner).fields, new))
            edits.fields[owner, name] = ""
        elif what in ("drop field", "rename field", "change field", "change default", "drop default"):
            owner, name = args[:2]
            f = record(owner).get(name)
            if f is None:
                raise QueryError("E_MIGRATION", f"no field {owner}.{name}", n.place)
            if what != "rename field" and what not in ("change default", "drop default"):
                uses(owner, name)
            source = edits.fields.pop((owner, name), name) if what == "rename field" else None
            if what == "drop field":
                now: Field | None = None
            elif what == "rename field":
                now = replace(f, name=args[2])
                edits.fields[owner, args[2]] = source or name
                for t in state.tables.values():
                    if t.row == owner:
                        t.key = args[2] if t.key == name else t.key
                        for i in t.indexes:
                            i.components = tuple((args[2] + c[len(name) :] if c.split(".")[0] == name else c, d) for c, d in i.components)
                for r in state.references:
                    for side, at in (("source", r.source), ("target", r.target)):
                        if at in state.tables and state.tables[at].row == owner:
                            setattr(r, f"{side}_fields", tuple(args[2] if c == name else c for c in getattr(r, f"{side}_fields")))
            elif what == "change field":
                now = Field(name, args[2])
                edits.convert[owner, name] = (args[3], args[4])
            elif what == "change default":
                now = replace(f, default=constant(args[2]), has_default=True)
            else:
                now = Field(name, f.type)
            types[owner] = Record(tuple(x for g in record(owner).fields for x in ([now] if g.name == name else [g]) if x is not None))
        elif what == "add variant":
            types[args[0]] = Enum((*enum(args[0]).variants, args[1]))
        elif what == "change variant":
            owner, v = args[:2]
            if enum(owner).index(v.name) is None:
                raise QueryError("E_MIGRATION", f"no variant {owner}::{v.name}", n.place)
            edits.payloads[owner, v.name] = args[2:]
            types[owner] = Enum(tuple(v if x.name == v.name else x for x in enum(owner).variants))
        elif what in ("rename variant", "drop variant"):
            owner, name = args[:2]
            if enum(owner).index(name) is None:
                raise QueryError("E_MIGRATION", f"no variant {owner}::{name}", n.place)
            if what == "rename variant":
                edits.variants[owner, args[2]] = edits.variants.pop((owner, name), name)
                if (owner, name) in edits.payloads:
                    edits.payloads[owner, args[2]] = edits.payloads.pop((owner, name))
            elif len(args) > 2:
                edits.dropped[owner, name] = args[2:]
            types[owner] = Enum(tuple(replace(v, name=args[2]) if v.name == name and what == "rename variant" else v for v in enum(owner).variants if v.name != name or what == "rename variant"))
        else:
            raise QueryError("E_MIGRATION", f"unknown step {what}", n.place)

    new = work.registry()
    for owner, t in types.items():
        if isinstance(t, Record):
            types[owner] = _carried(t, owner, new, edits)
        elif isinstance(t, Enum):
            types[owner] = Enum(tuple(replace(v, payload=_carried(v.payload, "", new, edits)) if isinstance(v.payload, Record) else v for v in t.variants))
    new = work.registry()
    rebuild = Rebuild(old, new, edits)
    for name, t in state.tables.items():
        if name not in origin:
            continue
        was = before.tables[origin[name]]
        a, b = old.resolve(Named(was.row)), new.resolve(Named(t.row))
        key_changed = t.key is not None and t.key != was.key and edits.fields.get((t.row, t.key)) != was.key
        if t.segments and (repr(a) != repr(b) or rebuild.touched(Named(was.row), frozenset())):
            source = _Before(work, before).frame(origin[name])
            cols = rebuild.fields(column, a, b, t.row)
            t.segments = [work.write(source.select(*(c.alias(f.name) for f, c in zip(b.fields, cols)), "__row_id"))]
        if key_changed:
            work._unique(name, work.frame(name), work.frame(name).limit(0))
    for check in late:
        check()


class _Before:
    """Tables as they were before the migration."""

    def __init__(self, work: Any, state: Any):
        from adtflow.sources.store import _Work

        self.work = _Work(work.store, state, work.dry)

    def frame(self, name: str) -> Any:
        return self.work.frame(name)
