"""Managed tables: versioned Parquet segments and a manifest, changed by scripts that apply whole or not at all.

A table is a list of immutable segments. Inserts add one; updates and deletes write those anew that hold changed rows; migrations write
a new one. Nothing is seen by readers until the next revision's manifest, which names the segments, is made in one step; segments of a
failed script are left behind unseen.
"""

from __future__ import annotations

import atexit
import copy
import datetime as dt
import decimal
import hashlib
import json
import re
import secrets
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtflow.engine import Engine, Result
from adtflow.errors import QueryError
from adtflow.lang import nodes as N
from adtflow.lang.parser import constant, parse
from adtflow.plans.expressions import Binder, Scope, column
from adtflow.plans.pipeline import Index, Lowering, Plan, Source
from adtflow.recursion import has_finite_values
from adtflow.types import INT, TIMESTAMP, UUID, Decimal, Enum, Field, List, Map, Named, Option, Record, Registry, Scalar, Tuple, Type, Variant

ROW_ID = "__row_id"
MAX_STATEMENTS = 4096
MAX_ROWS = 100_000
KEPT_MANIFESTS = 16
_MANIFEST = re.compile(r"manifest-([0-9]{12})\.json")


def _manifest(revision: int) -> str:
    return f"manifest-{revision:012}.json"


# JSON forms
def dump_value(v: Any) -> Any:
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    kinds: list[tuple[type, Callable[[Any], Any]]] = [
        (dt.datetime, lambda x: x.isoformat()),
        (dt.date, lambda x: x.isoformat()),
        (dt.timedelta, lambda x: x // dt.timedelta(microseconds=1)),
        (decimal.Decimal, str),
        (bytes, lambda x: x.hex()),
        (tuple, lambda x: [dump_value(i) for i in x]),
        (dict, lambda x: {k: dump_value(i) for k, i in x.items()}),
        (list, lambda x: [dump_value(i) for i in x]),
    ]
    for kind, to in kinds:
        if isinstance(v, kind):
            return {kind.__name__: to(v)}
    raise TypeError(type(v))


def load_value(v: Any) -> Any:
    if not isinstance(v, dict):
        return v
    ((kind, x),) = v.items()
    return {
        "datetime": dt.datetime.fromisoformat,
        "date": dt.date.fromisoformat,
        "timedelta": lambda u: dt.timedelta(microseconds=u),
        "Decimal": decimal.Decimal,
        "bytes": bytes.fromhex,
        "tuple": lambda xs: tuple(map(load_value, xs)),
        "dict": lambda d: {k: load_value(i) for k, i in d.items()},
        "list": lambda xs: list(map(load_value, xs)),
    }[kind](x)


def dump_type(t: Type | None) -> Any:
    if t is None:
        return None
    if isinstance(t, Scalar):
        return t.name
    if isinstance(t, Named):
        return {"named": t.name}
    if isinstance(t, Decimal):
        return {"decimal": [t.precision, t.scale]}
    if isinstance(t, (Option, List, Map)):
        return {type(t).__name__.lower(): dump_type(t.of)}
    if isinstance(t, Tuple):
        return {"tuple": [dump_type(x) for x in t.items]}
    if isinstance(t, Record):
        return {"record": [{"name": f.name, "type": dump_type(f.type), **({"default": dump_value(f.default)} if f.has_default else {})} for f in t.fields]}
    assert isinstance(t, Enum)
    return {"enum": [{"name": v.name, "payload": dump_type(v.payload)} for v in t.variants]}


def load_type(x: Any) -> Any:
    if x is None:
        return None
    if isinstance(x, str):
        return Scalar(x)
    ((kind, v),) = x.items()
    if kind == "named":
        return Named(v)
    if kind == "decimal":
        return Decimal(*v)
    if kind in ("option", "list", "map"):
        return {"option": Option, "list": List, "map": Map}[kind](load_type(v))
    if kind == "tuple":
        return Tuple(tuple(map(load_type, v)))
    if kind == "record":
        return Record(tuple(Field(f["name"], load_type(f["type"]), load_value(f.get("default")), "default" in f) for f in v))
    return Enum(tuple(Variant(e["name"], load_type(e["payload"])) for e in v))


def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="adtflow-store-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@dataclass
class Table:
    row: str
    key: str | None
    generated: dict[str, str] = field(default_factory=dict)
    indexes: list[Index] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)
    next_id: int = 1


@dataclass
class Reference:
    source: str
    source_fields: tuple[str, ...]
    target: str
    target_fields: tuple[str, ...]


@dataclass
class State:
    types: dict[str, Type] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)
    references: list[Reference] = field(default_factory=list)
    sequences: dict[str, int] = field(default_factory=dict)
    migrations: list[dict[str, Any]] = field(default_factory=list)
    receipts: dict[str, Any] = field(default_factory=dict)
    revision: int = 0
    #: tells a store from others, through all its revisions and copies
    identity: str = field(default_factory=lambda: uuid.uuid4().hex)

    def dump(self) -> str:
        tables = {
            n: {
                "row": t.row,
                "key": t.key,
                "generated": t.generated,
                "segments": t.segments,
                "next_id": t.next_id,
                "indexes": [{"components": i.components, "unique": i.unique, "predicate": i.predicate} for i in t.indexes],
            }
            for n, t in self.tables.items()
        }
        return json.dumps(
            {
                "revision": self.revision,
                "identity": self.identity,
                "types": {k: dump_type(t) for k, t in self.types.items()},
                "tables": tables,
                "references": [vars(r) for r in self.references],
                "sequences": self.sequences,
                "migrations": self.migrations,
                "receipts": self.receipts,
            }
        )

    @staticmethod
    def load(text: str) -> State:
        x = json.loads(text)
        tables = {
            n: Table(
                t["row"],
                t["key"],
                t["generated"],
                [Index(tuple((c, d) for c, d in i["components"]), i["unique"], i["predicate"] is not None, i["predicate"]) for i in t["indexes"]],
                t["segments"],
                t["next_id"],
            )
            for n, t in x["tables"].items()
        }
        references = [Reference(r["source"], tuple(r["source_fields"]), r["target"], tuple(r["target_fields"])) for r in x["references"]]
        return State({k: load_type(t) for k, t in x["types"].items()}, tables, references, x["sequences"], x["migrations"], x["receipts"], x["revision"], x["identity"])


@dataclass
class Changed:
    """What a statement did: affected rows, their images for returning, actions of upserts."""

    affected: int
    rows: list[dict[str, Any]] | None = None
    actions: list[str] | None = None
    columns: dict[str, Type] | None = None


class Store:
    """Managed tables under a folder that all executors share: root, or else one in spark.checkpoint.dir, or in local mode a temporary one."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not shared and not spark.sparkContext.master.startswith("local["):
            raise QueryError("E_STORE", "a store on a cluster needs a root or spark.checkpoint.dir")
        self.root = (root or (f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}" if shared else f"file://{_temporary()}")).rstrip("/")
        text = self._read()
        self.state = State.load(text) if text else State()

    # manifests: one file for each revision, made once and never changed; the highest holds
    def _fs(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _revisions(self) -> list[int]:
        _, path, fs = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(m[1]) for m in map(_MANIFEST.fullmatch, names) if m)

    def _read(self) -> str | None:
        found = self._revisions()
        if not found:
            return None
        jvm, path, fs = self._fs(_manifest(found[-1]))
        stream = fs.open(path)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _publish(self, state: State) -> None:
        """Makes the next revision's manifest, which only one writer can: the others are refused."""
        state.revision = self.state.revision + 1
        jvm, draft, fs = self._fs(f"draft-{uuid.uuid4().hex}")
        _, path, _ = self._fs(_manifest(state.revision))
        out = fs.create(draft, True)
        out.write(bytearray(state.dump().encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a link, since renames of local files replace what is there
                jvm.java.nio.file.Files.createLink(jvm.java.io.File(path.toUri().getPath()).toPath(), jvm.java.io.File(draft.toUri().getPath()).toPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, path, none)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise QueryError("E_CONFLICT", "another script has changed the store") from e
        finally:
            fs.delete(draft, False)
        self.state = state
        for old in self._revisions():  # readers of these have long read them
            if old <= state.revision - KEPT_MANIFESTS:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{_manifest(old)}"), False)

    # reading
    def engine(self) -> Engine:
        """An engine over the published tables."""
        return _Work(self, self.state).engine()

    def query(self, text: str, **params: Any) -> Result:
        return self.engine().query(text, **params)

    # scripts
    def run(self, text: str, idempotency: str | None = None, **params: Any) -> list[Any]:
        """All statements of a script in order, published together. With a key, a script that ran before isn't run again."""
        statements = parse(text)
        if len(statements) > MAX_STATEMENTS:
            raise QueryError("E_LIMIT", f"more than {MAX_STATEMENTS} statements")
        digest = hashlib.sha256(json.dumps([text, {k: repr(v) for k, v in sorted(params.items())}]).encode()).hexdigest()
        if idempotency is not None and (seen := self.state.receipts.get(idempotency)):
            if seen["digest"] != digest:
                raise QueryError("E_IDEMPOTENCY", "the key was used for another script")
            return [Changed(**{k: load_value(v) for k, v in r.items()}) for r in seen["results"]]
        work = _Work(self, copy.deepcopy(self.state))
        out = [work.statement(s, params) for s in statements]
        if idempotency is not None:
            work.state.receipts[idempotency] = {"digest": digest, "results": [{"affected": r.affected, "rows": dump_value(r.rows), "actions": dump_value(r.actions)} for r in out if isinstance(r, Changed)]}
        if work.dirty or idempotency is not None:
            self._publish(work.state)
        return out

    def load(self, table: str, frame: DataFrame) -> int:
        """Appends a DataFrame that has a table's fields as columns, in parallel; returns the number of rows.

        All constraints are checked as for inserted rows. Columns may stand in any order; missing or further ones are refused.
        """
        work = _Work(self, copy.deepcopy(self.state))
        n = work.append(table, frame)
        self._publish(work.state)
        return n

    def preflight(self, migrations: str, queries: dict[str, str]) -> dict[str, dict[str, Any]]:
        """How each query binds now and after the migrations, which aren't applied: its columns and parameters, or the error's code."""
        work = _Work(self, copy.deepcopy(self.state), dry=True)
        for n in parse(migrations):
            if not isinstance(n, N.Migration):
                raise QueryError("E_MIGRATION", "only migrations can be tried", n.place)
            work.statement(n, {})

        def bound(e: Engine, text: str) -> dict[str, Any]:
            try:
                p = e.prepare(text)
            except QueryError as err:
                return {"error": err.code, "place": err.place}
            return {"columns": {k: repr(t) for k, t in p.columns.items()}, "params": {k: repr(t) for k, t in p.params.items()}}

        now, then = _Work(self, self.state, dry=True).engine(), work.engine()
        out = {}
        for name in sorted(queries):
            a, b = bound(now, queries[name]), bound(then, queries[name])
            out[name] = {"now": a, "after": b, "changed": a != b, "valid": "error" not in b}
        return out

    def explain_change(self, text: str) -> dict[str, Any]:
        """What a changing statement would check and touch, without running it."""
        (node,) = parse(text)
        if isinstance(node, N.Explain):
            node = node.pipeline
        work = _Work(self, copy.deepcopy(self.state))
        table = work.table(node.table, node.place)
        checks = [f"unique {', '.join(c for c, _ in i.components)}" for i in table.indexes if i.unique]
        checks += [f"key {table.key}"] if table.key else []
        checks += [f"reference to {r.target}" for r in self.state.references if r.source == node.table] + [f"reference from {r.source}" for r in self.state.references if r.target == node.table]
        if isinstance(node, N.Update):
            work.images(node, {}, preparing=True)
        return {"statement": type(node).__name__.lower(), "table": node.table, "checks": checks}


class _Work:
    """A candidate state that a script works on."""

    def __init__(self, store: Store, state: State, dry: bool = False):
        """dry: only types and names are checked; no rows are read or written."""
        self.store, self.state, self.spark, self.dirty, self.last, self.dry = store, state, store.spark, False, None, dry

    # tables
    def registry(self) -> Registry:
        r = Registry()
        r.types = dict(self.state.types)
        return r

    def table(self, name: str, place: N.Place = None) -> Table:
        if name not in self.state.tables:
            raise QueryError("E_TABLE", f"unknown table {name}", place)
        return self.state.tables[name]

    def row_type(self, t: Table) -> Record:
        out = self.registry().resolve(Named(t.row))
        assert isinstance(out, Record)
        return out

    def frame(self, name: str) -> DataFrame:
        """A table's rows with their hidden ids."""
        t, r = self.table(name), self.registry()
        schema = T.StructType([*r.spark(self.row_type(t)).fields, T.StructField(ROW_ID, T.LongType())])
        return self._segments(t.segments, schema)

    def _segments(self, names: list[str], schema: T.StructType) -> DataFrame:
        if not names or self.dry:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.store.root}/{s}" for s in names))

    def _replace(self, name: str, ids: DataFrame, new: DataFrame | None) -> None:
        """Writes the segments anew that hold rows with these ids (column __id), without them and with the new rows."""
        t, frame = self.table(name), self.frame(name)
        place = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[0-9a-f]{32})", 1)
        held = {r[0] for r in frame.select(ROW_ID, place.alias("__segment")).join(ids, F.col(ROW_ID) == F.col("__id"), "left_semi").select("__segment").distinct().collect()} if t.segments else set()
        rest = self._segments([s for s in t.segments if s in held], frame.schema).join(ids, F.col(ROW_ID) == F.col("__id"), "left_anti")
        out = rest if new is None else rest.unionByName(new)
        t.segments = [s for s in t.segments if s not in held]
        if new is not None or not rest.isEmpty():
            t.segments.append(self.write(out))
        self.dirty = True

    def source(self, name: str) -> Source:
        t = self.table(name)
        columns = {f.name: f.type for f in self.row_type(t).fields}
        return Source(name, columns, lambda: self.frame(name).select(*map(column, columns)), Named(t.row), t.key, t.indexes, checked=True)

    def engine(self) -> Engine:
        e = Engine(self.spark)
        e.registry = self.registry()
        for name in self.state.tables:
            e.add(self.source(name))
        return e

    def write(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        if self.dry:
            return name
        df.write.parquet(f"{self.store.root}/{name}")
        self.dirty = True
        return name

    def read_segment(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.root}/{name}")

    # statements
    def statement(self, n: N.Node, params: dict[str, Any]) -> Any:
        if isinstance(n, (N.Pipeline, N.Explain)):
            e = self.engine()
            return e.explain(n, **params) if isinstance(n, N.Explain) else e.query(n, **{k: v for k, v in params.items() if _mentions(n, k)})
        out = getattr(self, type(n).__name__.lower())(n, params)
        if isinstance(out, Changed):
            self.last = out
        return out

    def typedecl(self, n: N.TypeDecl, params: Any) -> None:
        r = self.registry()
        r.define(n.name, n.type)
        self.state.types = r.types
        self._known_types(n.type, n.place)
        if not has_finite_values(self.state.types, n.name):
            raise QueryError("E_SCHEMA", f"{n.name} has no finite value", n.place)
        self._defaults(n.type, r, n.place)
        self.dirty = True

    def _known_types(self, t: Type, place: N.Place) -> None:
        from adtflow.types import children

        if isinstance(t, Named) and t.name not in self.state.types:
            raise QueryError("E_TYPE", f"unknown type {t.name}", place)
        for x in children(t):
            self._known_types(x, place)

    def _defaults(self, t: Type, r: Registry, place: N.Place) -> None:
        for rec in [t] if isinstance(t, Record) else [v.payload for v in t.variants if isinstance(v.payload, Record)] if isinstance(t, Enum) else []:
            for f in rec.fields:
                if f.has_default:
                    r.encode(f.type, f.default)

    def tabledecl(self, n: N.TableDecl, params: Any) -> None:
        if n.name in self.state.tables:
            raise QueryError("E_TABLE", f"table {n.name} is already declared", n.place)
        row = self.registry().resolve(Named(n.row))
        if not isinstance(row, Record):
            raise QueryError("E_TYPE", f"{n.row} is no struct", n.place)
        for name in ([n.key] if n.key else []) + list(n.generated):
            if row.get(name) is None:
                raise QueryError("E_FIELD", f"{n.row} has no field {name}", n.place)
        for name, how in n.generated.items():
            self.generator(row, name, how, n.place)
        self.state.tables[n.name] = Table(n.row, n.key, dict(n.generated))
        self.dirty = True

    def generator(self, row: Record, name: str, how: str, place: N.Place) -> None:
        """Checks that a field can be generated so."""
        want = {"uuid_v7": UUID, "now": TIMESTAMP}.get(how, INT)
        if self.registry().resolve(row.get(name).type) != want:
            raise QueryError("E_TYPE", f"{name} can't be generated as {how}", place)
        if how.startswith("next ") and how[5:] not in self.state.sequences:
            raise QueryError("E_SEQUENCE", f"unknown sequence {how[5:]}", place)

    def sequencedecl(self, n: N.SequenceDecl, params: Any) -> None:
        if n.name in self.state.sequences:
            raise QueryError("E_SEQUENCE", f"sequence {n.name} is already declared", n.place)
        self.state.sequences[n.name] = n.start
        self.dirty = True

    def indexdecl(self, n: N.IndexDecl, params: Any) -> None:
        t = self.table(n.table, n.place)
        if not 1 <= len(n.components) <= 16:
            raise QueryError("E_INDEX", "an index has 1 to 16 components", n.place)
        b, s = Binder(self.registry()), Scope(self.source(n.table).columns)
        for p, _ in n.components:
            b.path(p, s)
        predicate = None
        if n.predicate is not None:
            if not n.unique:
                raise QueryError("E_INDEX_PREDICATE", "only unique indexes take a predicate", n.place)
            predicate = self.atoms(n.predicate)
            b.condition(n.predicate, s)
        index = Index(tuple((".".join(p.parts), d) for p, d in n.components), n.unique, predicate is not None, predicate)
        if any(i.components == index.components and i.predicate == index.predicate for i in t.indexes):
            raise QueryError("E_INDEX", "the index exists", n.place)
        t.indexes.append(index)
        if n.unique:
            keys = self._index_rows(n.table, index, self.frame(n.table))
            self._refuse(keys.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), f"{n.table} has duplicates for the unique index")
        self.dirty = True

    atoms = staticmethod(lambda predicate: _atoms(predicate))

    def referencedecl(self, n: N.ReferenceDecl, params: Any) -> None:
        fields = [tuple(".".join(p.parts) for p in ps) for ps in (n.source_fields, n.target_fields)]
        r = Reference(n.source, fields[0], n.target, fields[1])
        b = Binder(self.registry())
        for name, paths in ((n.source, n.source_fields), (n.target, n.target_fields)):
            self.table(name, n.place)
            for p in paths:
                b.path(p, Scope(self.source(name).columns))
        unique = [(self.table(n.target).key,), *(tuple(c for c, _ in i.components) for i in self.table(n.target).indexes if i.unique and not i.partial)]
        if len(fields[0]) != len(fields[1]) or fields[1] not in unique:
            raise QueryError("E_REFERENCE", "a reference targets a key or a unique index", n.place)
        if r in self.state.references:
            raise QueryError("E_REFERENCE", "the reference exists", n.place)
        self.state.references.append(r)
        self._missing(r, self.frame(n.source))
        self.dirty = True

    def dropreference(self, n: N.DropReference, params: Any) -> None:
        d = n.reference
        r = Reference(d.source, tuple(".".join(p.parts) for p in d.source_fields), d.target, tuple(".".join(p.parts) for p in d.target_fields))
        if r not in self.state.references:
            raise QueryError("E_REFERENCE", "there is no such reference", n.place)
        self.state.references.remove(r)
        self.dirty = True

    def expect(self, n: N.Expect, params: Any) -> None:
        have = self.last.affected if self.last is not None else 0
        if not {"==": have == n.count, "!=": have != n.count, ">": have > n.count, ">=": have >= n.count, "<": have < n.count, "<=": have <= n.count}[n.op]:
            raise QueryError("E_EXPECT", f"expected affected {n.op} {n.count}, found {have}", n.place)

    # constraints
    def _refuse(self, bad: DataFrame, message: str) -> None:
        if not self.dry and not bad.isEmpty():
            raise QueryError("E_CONSTRAINT", message)

    def _key(self, name: str, fields: tuple[str, ...]) -> Column:
        b, s = Binder(self.registry()), Scope(self.source(name).columns)
        return F.struct(*(b.path(N.Path(tuple(f.split("."))), s).col.alias(f"k{i}") for i, f in enumerate(fields)))

    def _index_rows(self, name: str, index: Index, rows: DataFrame) -> DataFrame:
        """The key of each row that the index covers."""
        if index.predicate is not None:
            b, s = Binder(self.registry()), Scope(self.source(name).columns)
            for atom in index.predicate:
                rows = rows.filter(b.condition(condition(atom), s))
        return rows.select(self._key(name, tuple(c for c, _ in index.components)).alias("k"))

    def _unique(self, name: str, new: DataFrame, rest: DataFrame) -> None:
        """No key among the new rows twice, and none that the other rows have; only the new rows' keys are shuffled to."""
        t = self.table(name)
        for index in [Index(((t.key, False),), True)] * bool(t.key) + [i for i in t.indexes if i.unique]:
            keys = self._index_rows(name, index, new)
            what = f"{name} has another row with the same {', '.join(c for c, _ in index.components)}"
            self._refuse(keys.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), what)
            self._refuse(self._index_rows(name, index, rest).join(keys.withColumnRenamed("k", "n"), F.col("k").eqNullSafe(F.col("n")), "left_semi"), what)

    def _missing(self, r: Reference, rows: DataFrame) -> None:
        """Each row's reference has a target; a None in it means that there is no reference."""
        keys = rows.select(self._key(r.source, r.source_fields).alias("k"))
        for i in range(len(r.source_fields)):
            keys = keys.filter(F.col("k")[f"k{i}"].isNotNull())
        target = self.frame(r.target).select(self._key(r.target, r.target_fields).alias("n"))
        self._refuse(keys.join(target, F.col("k").eqNullSafe(F.col("n")), "left_anti"), f"{r.source} refers to a row that {r.target} hasn't")

    def _references(self, name: str, new: DataFrame | None, gone: DataFrame | None) -> None:
        for r in self.state.references:
            if r.source == name and new is not None:
                self._missing(r, new)
            if r.target == name and gone is not None:
                lost = gone.select(self._key(name, r.target_fields).alias("n")).distinct()
                left = self.frame(name).select(self._key(name, r.target_fields).alias("m"))
                lost = lost.join(left, F.col("n").eqNullSafe(F.col("m")), "left_anti")
                held = self.frame(r.source).select(self._key(r.source, r.source_fields).alias("k"))
                self._refuse(held.join(lost, F.col("k").eqNullSafe(F.col("n")), "left_semi"), f"{r.source} still refers to the row of {name}")

    # changes
    def _rows(self, n: N.Insert, params: dict[str, Any]) -> list[Any]:
        t = self.table(n.table, n.place)
        if isinstance(n.rows, N.Param):
            if n.rows.name not in params:
                raise QueryError("E_PARAM", f"${n.rows.name} is missing", n.place)
            rows = params[n.rows.name] if n.many else [params[n.rows.name]]
        else:
            rows = [constant(x) for x in n.rows]
        if len(rows) > MAX_ROWS:
            raise QueryError("E_LIMIT", f"more than {MAX_ROWS} rows", n.place)
        r, now = self.registry(), dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        out = []
        for row in rows:
            if isinstance(row, tuple):
                row = row[1]
            row = dict(row)
            for name, how in t.generated.items():
                if name not in row:
                    if how.startswith("next "):
                        row[name] = self.state.sequences[how[5:]]
                        self.state.sequences[how[5:]] += 1
                    else:
                        row[name] = now if how == "now" else uuid_v7()
            try:
                out.append(r.encode(Named(t.row), row))
            except QueryError as e:
                raise QueryError(e.code, e.message, n.place) from e
        return out

    def insert(self, n: N.Insert, params: dict[str, Any]) -> Changed:
        t, rows = self.table(n.table, n.place), self._rows(n, params)
        source = self.source(n.table)
        schema = T.StructType([*self.registry().spark(self.row_type(t)).fields, T.StructField(ROW_ID, T.LongType())])
        if n.upsert and not t.key:
            raise QueryError("E_CONSTRAINT", f"{n.table} has no key", n.place)
        fresh = self.spark.createDataFrame([(*x, t.next_id + i) for i, x in enumerate(rows)], schema)
        t.next_id += len(rows)
        actions = None
        if not rows:
            return Changed(0, [] if n.returning is not None else None, [] if n.upsert else None)
        if n.upsert:
            key = column(t.key)
            self._refuse(fresh.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "a key occurs twice in the rows")
            old = self.frame(n.table).select(key.alias("__key"), F.col(ROW_ID).alias("__old"))
            met = fresh.join(old, key.eqNullSafe(F.col("__key")), "left")
            segment = self.write(met.withColumn("__order", F.col(ROW_ID)).withColumn(ROW_ID, F.coalesce("__old", ROW_ID)).drop("__key"))
            found = self.read_segment(segment)
            actions = ["updated" if x["__old"] is not None else "inserted" for x in found.orderBy("__order").select("__old").collect()]
            fresh = found.select(*map(column, schema.names), "__order")
            ids = found.select(F.col(ROW_ID).alias("__id"))
            kept = self.frame(n.table).join(ids, F.col(ROW_ID) == F.col("__id"), "left_anti")
            new = fresh.drop("__order")
            self._unique(n.table, new, kept)
            if "updated" not in actions:
                t.segments = [*t.segments, self.write(new)]
            else:
                gone = self.read_segment(self.write(self.frame(n.table).join(ids, F.col(ROW_ID) == F.col("__id"), "left_semi")))
                self._replace(n.table, ids, new)
                self._references(n.table, None, gone)
            self._references(n.table, new, None)
        else:
            self._unique(n.table, fresh, self.frame(n.table))
            t.segments = [*t.segments, self.write(fresh)]
            self._references(n.table, fresh, None)
            fresh = fresh.withColumn("__order", F.col(ROW_ID))
        return Changed(len(rows), *self._returned(n.returning, fresh, source, "__order", actions))

    def append(self, name: str, frame: DataFrame) -> int:
        t, r = self.table(name), self.registry()
        row = self.row_type(t)
        if set(frame.columns) != {f.name for f in row.fields}:
            raise QueryError("E_TYPE", f"the columns aren't the fields of {t.row}")
        required = [f.name for f in row.fields if not isinstance(r.resolve(f.type), Option)]
        typed = frame.select(*(column(f.name).cast(r.spark(f.type)).alias(f.name) for f in row.fields), (F.lit(t.next_id) + F.monotonically_increasing_id()).alias(ROW_ID))
        segment = self.write(typed)
        new = self._segments([segment], T.StructType([*r.spark(row).fields, T.StructField(ROW_ID, T.LongType())]))
        if required:
            missing = column(required[0]).isNull()
            for c in required[1:]:
                missing = missing | column(c).isNull()
            self._refuse(new.filter(missing), f"a row of {name} has no value for a required field")
        found = new.agg(F.count(F.lit(1)).alias("n"), F.max(ROW_ID).alias("last")).first()
        if found["n"]:
            self._unique(name, new, self.frame(name))
            t.segments, t.next_id = [*t.segments, segment], found["last"] + 1
            self._references(name, new, None)
        return found["n"]

    def _returned(self, fields: list[N.Path] | None, rows: DataFrame, source: Source, order: str, actions: list[str] | None = None) -> tuple[Any, Any, Any]:
        if fields is None:
            return None, actions, None
        b, r = Binder(self.registry()), self.registry()
        chosen = {".".join(p.parts): b.path(p, Scope(source.columns)) for p in (fields or [N.Path((c,)) for c in source.columns])}
        got = rows.orderBy(order).select(*(x.col.alias(k) for k, x in chosen.items())).collect()
        return [{k: r.decode(x.type, row[k]) for k, x in chosen.items()} for row in got], actions, {k: x.type for k, x in chosen.items()}

    def _target(self, table: str, stages: list[N.Node], params: dict[str, Any], returning: bool) -> DataFrame:
        source = self.source(table)
        low = Lowering(self.registry(), {table: replace(source, frame=lambda: self.frame(table).orderBy(ROW_ID) if any(isinstance(s, N.Take) for s in stages) and not any(isinstance(s, N.Sort) for s in stages) else self.frame(table))}, Binder(self.registry(), params))
        plan: Plan = low.pipeline(N.Pipeline(table, stages))
        sort = next((s for s in reversed(stages) if isinstance(s, N.Sort)), None)
        if not returning:
            return plan.frame.withColumn("__order", F.lit(0))
        order = low.order(sort.keys, plan, Scope(plan.columns)) if sort else [F.col(ROW_ID)]
        # the order in which rows were chosen; they are returned to the driver
        return plan.frame.withColumn("__order", F.row_number().over(Window.orderBy(*order, ROW_ID)))

    def images(self, n: N.Update, params: dict[str, Any], preparing: bool = False) -> list[tuple[str, list[str], Any]]:
        """Top-level column, path inside it and bound new value of each set; all read the old row."""
        source = self.source(n.table)
        b, s, out = Binder(self.registry(), params, preparing), Scope(source.columns), []
        seen: list[tuple[str, ...]] = []
        for p, value in n.sets:
            if any(p.parts[: len(q)] == q or q[: len(p.parts)] == p.parts for q in seen):
                raise QueryError("E_QUERY", f"{'.'.join(p.parts)} is set twice", p.place)
            seen.append(p.parts)
            out.append((p.parts[0], list(p.parts[1:]), b.bind(value, s, b.path(p, s).type)))
        return out

    def update(self, n: N.Update, params: dict[str, Any]) -> Changed:
        self.table(n.table, n.place)
        source, r = self.source(n.table), self.registry()
        sets = self.images(n, params)
        target = self._target(n.table, n.target, params, n.returning is not None)
        news: dict[str, Column] = {}
        for top, path, x in sets:
            value = x.col.cast(r.spark(x.type))
            news[top] = news.get(top, column(top)).withField(".".join(f"`{p}`" for p in path), value) if path else value
        images = target.select(*(news.get(c, column(c)).alias(c) for c in source.columns), ROW_ID, "__order", F.struct(*map(column, source.columns)).alias("__before"))
        changed = self.read_segment(self.write(images))
        affected = changed.count()
        if affected:
            new = changed.drop("__order", "__before")
            ids = changed.select(F.col(ROW_ID).alias("__id"))
            self._unique(n.table, new, self.frame(n.table).join(ids, F.col(ROW_ID) == F.col("__id"), "left_anti"))
            self._replace(n.table, ids, new)
            self._references(n.table, new, changed.select("__before.*"))
        return Changed(affected, *self._returned(n.returning, changed, source, "__order"))

    def delete(self, n: N.Delete, params: dict[str, Any]) -> Changed:
        self.table(n.table, n.place)
        source = self.source(n.table)
        gone = self.read_segment(self.write(self._target(n.table, n.target, params, n.returning is not None)))
        affected = gone.count()
        if affected:
            self._replace(n.table, gone.select(F.col(ROW_ID).alias("__id")), None)
            self._references(n.table, None, gone)
        return Changed(affected, *self._returned(n.returning, gone, source, "__order"))

    # migrations
    def migration(self, n: N.Migration, params: Any) -> None:
        last = self.state.migrations[-1]["name"] if self.state.migrations else None
        if n.parent != last:
            raise QueryError("E_MIGRATION", f"the parent must be {last or 'left out'}", n.place)
        if any(m["name"] == n.name for m in self.state.migrations):
            raise QueryError("E_MIGRATION", f"{n.name} was applied before", n.place)
        from adtflow.sources.migrate import apply

        apply(self, n)
        self.state.migrations.append({"name": n.name, "parent": n.parent, "checksum": hashlib.sha256(repr(n).encode()).hexdigest()})
        self.dirty = True


def _mentions(n: Any, name: str) -> bool:
    if isinstance(n, N.Param):
        return n.name == name
    if isinstance(n, N.Node):
        return any(_mentions(v, name) for v in vars(n).values())
    return isinstance(n, (list, tuple)) and any(_mentions(v, name) for v in n)


def _atoms(n: N.Node) -> list[list[Any]]:
    """A partial index's predicate as sorted [path, operator, value]: a conjunction of equalities, None and is_some."""
    if isinstance(n, N.Binary) and n.op == "&&":
        out = _atoms(n.left) + _atoms(n.right)
    elif isinstance(n, N.Call) and n.name == "is_some" and isinstance(n.args[0], N.Path):
        out = [[".".join(n.args[0].parts), "is_some", None]]
    elif isinstance(n, N.Binary) and n.op == "==" and isinstance(n.left, N.Path):
        none = isinstance(n.right, N.Constructor) and n.right.variant == "None"
        out = [[".".join(n.left.parts), "is_none" if none else "==", None if none else dump_value(constant(n.right))]]
    else:
        raise QueryError("E_INDEX_PREDICATE", "a predicate is made of ==, is_some and &&", n.place)
    if len(out) > 64:
        raise QueryError("E_INDEX_PREDICATE", "more than 64 conditions", n.place)
    by_path: dict[str, list] = {}
    for a in out:
        if by_path.setdefault(a[0], a) != a and {by_path[a[0]][1], a[1]} != {"is_some", "=="}:
            raise QueryError("E_INDEX_PREDICATE_CONTRADICTION", f"{a[0]} can't be both", n.place)
    return sorted(out, key=json.dumps)


def condition(atom: list[Any]) -> N.Node:
    path = N.Path(tuple(atom[0].split(".")))
    if atom[1] in ("is_some", "is_none"):
        return N.Call(atom[1], [path])
    return N.Binary("==", path, _stored(load_value(atom[2])))


def _stored(v: Any) -> N.Node:
    """A constant's value as syntax again."""
    if isinstance(v, bool):
        return N.Literal("bool", v)
    if isinstance(v, (int, float, str)):
        return N.Literal({int: "int", float: "float", str: "text"}[type(v)], v) if not (isinstance(v, str) and v[:1].isupper() and v.isidentifier()) else N.Constructor(None, v, None)
    if isinstance(v, tuple) and len(v) == 2 and isinstance(v[0], str):
        payload = N.RecordValue([(k, _stored(x)) for k, x in v[1].items()]) if isinstance(v[1], dict) else N.TupleValue([_stored(x) for x in (v[1] if isinstance(v[1], tuple) else (v[1],))])
        return N.Constructor(None, v[0], payload)
    raise QueryError("E_INDEX_PREDICATE", "the constant isn't supported")


def uuid_v7() -> str:
    """A UUID of version 7: milliseconds, then random bits."""
    ms = time.time_ns() // 1_000_000
    n = (ms << 80) | (0x7 << 76) | (secrets.randbits(12) << 64) | (0b10 << 62) | secrets.randbits(62)
    return str(uuid.UUID(int=n))


