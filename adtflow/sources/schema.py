"""Schemas as portable JSON, their differences as migrations, Python classes for rows, and backups of stores."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from functools import reduce
from typing import Any

from adtflow.errors import QueryError
from adtflow.lang import nodes as N
from adtflow.lang.formatter import constant, declared, generator, index, kind, table, variant
from adtflow.sources.store import State, Store, condition, dump_type
from adtflow.types import Enum, List, Map, Named, Option, Record, Registry, Tuple, Type, show


def portable(state: State) -> dict[str, Any]:
    """Types, tables, keys, indexes and references, with a hash that is the same for equal schemas."""
    body = {
        "types": {k: dump_type(t) for k, t in sorted(state.types.items())},
        "tables": {n: {"row": t.row, "key": t.key, "generated": t.generated, "indexes": [[list(i.components), i.unique, i.predicate] for i in t.indexes]} for n, t in sorted(state.tables.items())},
        "references": sorted([r.source, list(r.source_fields), r.target, list(r.target_fields)] for r in state.references),
    }
    return {"version": 1, "hash": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest(), **body}


def difference(old: State, new: State, name: str = "next") -> str | None:
    """A migration from one schema to another, or None if they are alike.

    A field or variant under another name is a drop and an add, as a rename can't be told from them. What a migration can't do by
    itself (a field whose type changes, a new field without a default) is an error. References and indexes go before fields do and
    come after all else; sequences come first and go last.
    """
    with declared({**old.types, **new.types}):
        return _difference(old, new, name)


def _index(table: str, i: Any) -> str:
    d = N.IndexDecl(table, [(N.Path(tuple(c.split("."))), down) for c, down in i.components], i.unique, None)
    if i.predicate is not None:
        d.predicate = reduce(lambda a, b: N.Binary("&&", a, b), map(condition, i.predicate))
    return index(d)


def _reference(r: Any) -> str:
    return f"reference {r.source} ({', '.join(r.source_fields)}) references {r.target} ({', '.join(r.target_fields)})"


def _indexes(s: State) -> dict[str, str]:
    return {text: n for n, t in s.tables.items() for i in t.indexes for text in [_index(n, i)]}


def _difference(old: State, new: State, name: str) -> str | None:
    steps = [f"add sequence {k} start {v}" for k, v in new.sequences.items() if k not in old.sequences]
    steps += [f"drop {_reference(r)}" for r in old.references if r not in new.references]
    before_indexes, after_indexes = _indexes(old), _indexes(new)
    steps += [f"drop {text}" for text, n in before_indexes.items() if text not in after_indexes and n in new.tables]
    for k, t in new.types.items():
        if k not in old.types:
            if isinstance(t, Record):
                steps.append(f"add struct {k} {kind(t)}")
            elif isinstance(t, Enum):
                steps.append(f"add enum {k} {{{', '.join(map(variant, t.variants))}}}")
            else:
                raise QueryError("E_MIGRATION", f"an alias can't be added: {k}")
            continue
        was = old.types[k]
        if isinstance(t, Record) and isinstance(was, Record):
            for f in was.fields:
                if t.get(f.name) is None:
                    steps.append(f"drop field {k}.{f.name}")
            for f in t.fields:
                before = was.get(f.name)
                if before is None:
                    if not f.has_default:
                        raise QueryError("E_MIGRATION", f"the new field {k}.{f.name} needs a default")
                    steps.append(f"add field {k}.{f.name}: {show(f.type)} = {constant(f.default, f.type)}")
                elif before.type != f.type:
                    raise QueryError("E_MIGRATION", f"{k}.{f.name} changes from {before.type!r} to {f.type!r}; write a change with using")
                elif f.has_default and (not before.has_default or before.default != f.default):
                    steps.append(f"change default {k}.{f.name} to {constant(f.default, f.type)}")
                elif before.has_default and not f.has_default:
                    steps.append(f"drop default {k}.{f.name}")
        elif isinstance(t, Enum) and isinstance(was, Enum):
            steps += [f"drop variant {k}.{v.name}" for v in was.variants if t.index(v.name) is None]
            for v in t.variants:
                at = was.index(v.name)
                if at is None:
                    steps.append(f"add variant {k}.{variant(v)}")
                elif repr(was.variants[at].payload) != repr(v.payload):
                    raise QueryError("E_MIGRATION", f"the payload of {k}::{v.name} changes")
        elif t != was:
            raise QueryError("E_MIGRATION", f"{k} becomes another kind of type")
    for n, t in new.tables.items():
        if n not in old.tables:
            steps.append(f"add {table(n, t.row, t.key, t.generated)}")
            continue
        for f, how in t.generated.items():
            if old.tables[n].generated.get(f) != how:
                steps.append(f"change default {n}.{f} to {generator(how)}")
        if set(old.tables[n].generated) - set(t.generated):
            raise QueryError("E_MIGRATION", f"a generated default of {n} can't be dropped")
        if old.tables[n].row != t.row:
            raise QueryError("E_MIGRATION", f"table {n} gets another row type")
        elif old.tables[n].key != t.key:
            steps.append(f"set key {n} {t.key}" if t.key else f"drop key {n}")
    steps += [f"drop table {n}" for n in old.tables if n not in new.tables]
    steps += [f"drop type {k}" for k in old.types if k not in new.types]
    steps += [f"add {text}" for text in after_indexes if text not in before_indexes]
    steps += [f"add {_reference(r)}" for r in new.references if r not in old.references]
    steps += [f"drop sequence {k}" for k in old.sequences if k not in new.sequences]
    if not steps:
        return None
    parent = f"  parent {old.migrations[-1]['name']}\n" if old.migrations else ""
    return f"migration {name} {{\n{parent}" + "".join(f"  {s}\n" for s in steps) + "}"


def python_classes(registry: Registry) -> str:
    """Source of a dataclass for each struct and each variant, and of a union for each enum."""
    kinds = {"int": "int", "float": "float", "bool": "bool", "text": "str", "uuid": "str", "date": "date", "timestamp": "datetime", "duration": "timedelta", "bytes": "bytes"}

    def name(t: Type) -> str:
        if isinstance(t, Named):
            return t.name
        if isinstance(t, Option):
            return f"{name(t.of)} | None"
        if isinstance(t, List):
            return f"list[{name(t.of)}]"
        if isinstance(t, Map):
            return f"dict[str, {name(t.of)}]"
        if isinstance(t, Tuple):
            return f"tuple[{', '.join(map(name, t.items))}]"
        return kinds.get(show(t), "Decimal")

    def fields(t: Record | Tuple | None) -> list[str]:
        if t is None:
            return ["pass"]
        pairs = [(f.name, f.type) for f in t.fields] if isinstance(t, Record) else [(f"_{i + 1}", x) for i, x in enumerate(t.items)]
        return [f"{k}: {name(x)}" for k, x in pairs] or ["pass"]

    out = ["from __future__ import annotations", "", "from dataclasses import dataclass", "from datetime import date, datetime, timedelta", "from decimal import Decimal", ""]
    for k, t in registry.types.items():
        if isinstance(t, Enum):
            for v in t.variants:
                out += ["", "@dataclass(frozen=True)", f"class {k}_{v.name}:", *(f"    {x}" for x in fields(v.payload)), ""]
            out += ["", f"{k} = " + " | ".join(f"{k}_{v.name}" for v in t.variants), ""]
        elif isinstance(t, Record):
            out += ["", "@dataclass(frozen=True)", f"class {k}:", *(f"    {x}" for x in fields(t)), ""]
        else:
            out += ["", f"{k} = {name(t)}", ""]
    return "\n".join(out)


def struct_of(cls: type, registry: Registry) -> Record:
    """The struct of a dataclass with plain field types; options are written X | None."""
    import datetime as dt
    import types as pytypes
    import typing

    from adtflow.types import BOOL, BYTES, DATE, DURATION, FLOAT, INT, TEXT, TIMESTAMP, Field

    plain = {int: INT, float: FLOAT, bool: BOOL, str: TEXT, bytes: BYTES, dt.date: DATE, dt.datetime: TIMESTAMP, dt.timedelta: DURATION}

    def of(t: Any) -> Type:
        origin, args = typing.get_origin(t), typing.get_args(t)
        if origin in (typing.Union, pytypes.UnionType) and len(args) == 2 and type(None) in args:
            return Option(of(next(a for a in args if a is not type(None))))
        if origin is list:
            return List(of(args[0]))
        if origin is dict and args[0] is str:
            return Map(of(args[1]))
        if origin is tuple:
            return Tuple(tuple(map(of, args)))
        if t in plain:
            return plain[t]
        if getattr(t, "__name__", "") in registry.types:
            return Named(t.__name__)
        raise QueryError("E_TYPE", f"{t!r} has no type here")

    hints = typing.get_type_hints(cls)
    return Record(tuple(Field(f.name, of(hints[f.name]), f.default, True) if f.default is not dataclasses.MISSING else Field(f.name, of(hints[f.name])) for f in dataclasses.fields(cls)))


def backup(store: Store, target: str) -> dict[str, Any]:
    """Copies a store's published segments and then its manifest to a folder; returns what was copied.

    Segments never change, so that a folder that holds an earlier revision of the same store gets the new ones alone. Opening the
    folder as a store restores it; backing up that store to another folder puts it elsewhere.
    """
    from adtflow.sources.store import Store as Opened
    from adtflow.sources.store import _manifest

    jvm, target = store.spark.sparkContext._jvm, target.rstrip("/")
    conf = store.spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    to = path(target).getFileSystem(conf)
    before = Opened(store.spark, target).state
    there = {s for t in before.tables.values() for s in t.segments}
    if before.revision and (before.identity != store.state.identity or before.revision > store.state.revision):
        raise QueryError("E_BACKUP", f"{target} holds another store, or a later revision")
    missing = [s for t in store.state.tables.values() for s in t.segments if s not in there]
    for s in missing:
        source = path(f"{store.root}/{s}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, to, path(f"{target}/{s}"), False, conf)
    if before.revision != store.state.revision:
        out = to.create(path(f"{target}/{_manifest(store.state.revision)}"), False)
        out.write(bytearray(store.state.dump().encode()))
        out.close()
    return {"revision": store.state.revision, "segments": len(missing), "schema": portable(store.state)["hash"]}
