"""Values of recursive types: bytes in the values' order, tables of trees, matches and constructors."""

from __future__ import annotations

import datetime as dt
import decimal
import random

import pytest

from adtflow.errors import QueryError
from adtflow.recursion import Packer
from adtflow.sources.store import Store
from adtflow.types import BOOL, BYTES, DATE, DURATION, FLOAT, INT, TEXT, TIMESTAMP, Decimal, Enum, Field, List, Map, Named, Option, Record, Registry, Tuple, Variant

FOLDERS = """
enum Entry {
  File {name: text, size: int}
  Folder {name: text, inside: List<Entry>, locked: Option<bool> = None}
  Gap
}
struct Chain { n: int
  next: Option<Chain> = None }
struct Disk { id: int
  root: Entry
  chain: Chain = {n: 0} }
table disks: Disk { key id }
insert many disks [
  {id: 1, root: Folder {name: "top", inside: [File {name: "a", size: 3}, Folder {name: "in", inside: [Gap]}]}, chain: {n: 1, next: Some({n: 2})}}
  {id: 2, root: File {name: "only", size: 9}}
  {id: 3, root: Folder {name: "top", inside: [], locked: Some(true)}}
  {id: 4, root: File {name: "only", size: 9}}
]
"""


def registry():
    r = Registry()
    r.define("T", Enum((Variant("A"), Variant("B", Record((Field("x", Option(Named("T"))), Field("ys", List(Named("T")))))), Variant("C", Tuple((TEXT, INT))), Variant("M", Record((Field("m", Map(Named("T"))),))))))
    return r


def tree(r, depth=4):
    kind = r.randrange(4 if depth else 2)
    if kind == 0:
        return "A"
    if kind == 1 and not depth or kind == 2:
        return ("C", (r.choice(("", "a", "a\0", "a\0b", "b", "é", "\U0001f980")), r.randrange(-2, 3)))
    if kind == 1:
        return ("B", {"x": None if r.random() < 0.4 else tree(r, depth - 1), "ys": [tree(r, depth - 1) for _ in range(r.randrange(3))]})
    return ("M", {"m": {r.choice("pqr"): tree(r, depth - 1) for _ in range(r.randrange(3))}})


def rank(t):
    """A key by which Python sorts as the algebra does."""
    if t is None:
        return (0,)
    name, p = t if isinstance(t, tuple) else (t, None)
    if name == "A":
        return (1, 0)
    if name == "B":
        return (1, 1, rank(p["x"]), [rank(y) for y in p["ys"]])
    if name == "C":
        return (1, 2, p[0].encode(), p[1])
    return (1, 3, [(k.encode(), rank(p["m"][k])) for k in sorted(p["m"])])


def test_bytes_are_ordered_as_values_and_come_back():
    r, reg = random.Random(1), registry()
    values = [tree(r) for _ in range(400)]
    packed = [bytes(reg.encode(Named("T"), v)) for v in values]
    assert [reg.decode(Named("T"), b) for b in packed] == values
    by_bytes = sorted(range(400), key=lambda i: packed[i])
    assert [rank(values[i]) for i in by_bytes] == sorted(rank(v) for v in values)
    assert all((packed[i] == packed[j]) == (values[i] == values[j]) for i in range(0, 400, 7) for j in range(400))


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        (INT, [-(2**63), -1, 0, 1, 2**63 - 1]),
        (FLOAT, [-1e300, -1.5, -5e-324, 0.0, 5e-324, 2.5, 1e300]),
        (BOOL, [False, True]),
        (TEXT, ["", "\0", "\0\0", "\0a", "a", "a\0", "ab", "é"]),
        (BYTES, [b"", b"\0", b"\0\xff", b"\xff"]),
        (DATE, [dt.date(1, 1, 1), dt.date(1970, 1, 1), dt.date(9999, 12, 31)]),
        (TIMESTAMP, [dt.datetime(1, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(9999, 12, 31)]),
        (DURATION, [dt.timedelta(-3), dt.timedelta(0), dt.timedelta(microseconds=1)]),
        (Decimal(38, 2), [decimal.Decimal("-9" * 1 + "9" * 35 + ".99"), decimal.Decimal("-0.01"), decimal.Decimal("0.00"), decimal.Decimal("9" * 36 + ".99")]),
        (Option(Option(INT)), [None, ("Some", None), ("Some", ("Some", 1))]),
    ],
)
def test_scalars_in_order(kind, values):
    reg = Registry()
    p = Packer(reg)
    packed = [p.pack(kind, reg.encode(kind, v)) for v in values]
    assert packed == sorted(packed) and len(set(packed)) == len(packed)
    assert [reg.decode(kind, p.unpack(kind, b)[0]) if not isinstance(kind, Option) else p.unpack(kind, b)[1] == len(b) for b in packed] == (values if not isinstance(kind, Option) else [True] * len(values))


@pytest.fixture(scope="module")
def store(spark):
    s = Store(spark)
    s.run(FOLDERS)
    return s


def got(s, q):
    return s.query(q).rows()


def test_trees_in_tables(store):
    rows = {r["id"]: r for r in got(store, "from disks")}
    assert rows[1]["root"] == ("Folder", {"name": "top", "inside": [("File", {"name": "a", "size": 3}), ("Folder", {"name": "in", "inside": ["Gap"], "locked": None})], "locked": None})
    assert rows[1]["chain"] == {"n": 1, "next": {"n": 2, "next": None}} and rows[2]["chain"] == {"n": 0, "next": None}
    assert [r["id"] for r in got(store, "from disks | sort {root, id} | select {id}")] == [2, 4, 3, 1]
    assert sorted(r["n"] for r in got(store, "from disks | group root { aggregate { n = count } } | select {n}")) == [1, 1, 2]
    assert [r["id"] for r in got(store, 'from disks | filter root == Entry::File {name: "only", size: 9} | sort id | select {id}')] == [2, 4]
    assert got(store, "from disks | aggregate { d = count_distinct root, low = min root }")[0]["d"] == 3


def test_matches_fields_and_constructors(store):
    q = """from disks
derive {
  label = match root {
    File {name, size} => concat name (to_text size)
    Folder {name, inside, ..} => concat name (to_text (length inside))
    Gap => "gap"
  }
  deep = match chain.next {
    Some(c) => c.n
    None => -1
  }
  wrapped = Entry::Folder {name: "w", inside: [root, Gap]}
}
sort id
select {id, label, deep, wrapped}"""
    rows = got(store, q)
    assert [(r["label"], r["deep"]) for r in rows] == [("top2", 2), ("only9", -1), ("top0", -1), ("only9", -1)]
    assert rows[1]["wrapped"] == ("Folder", {"name": "w", "inside": [("File", {"name": "only", "size": 9}), "Gap"], "locked": None})
    held = 'from disks | filter match root {\n  Folder {inside, ..} => contains inside (Entry::File {name: "a", size: 3})\n  _ => false\n} | select {id}'
    assert [r["id"] for r in got(store, held)] == [1]


def test_migration_rewrites_every_level(spark):
    s = Store(spark)
    s.run(FOLDERS)
    s.run(
        """migration deeper {
  rename variant Entry.Gap to Hole
  rename type Entry to Node
  rename field Chain.n to number
  add field Chain.note: text = "none"
  add variant Node.Link {to: Option<Node> = None}
}"""
    )
    rows = {r["id"]: r for r in got(s, "from disks")}
    assert rows[1]["root"] == ("Folder", {"name": "top", "inside": [("File", {"name": "a", "size": 3}), ("Folder", {"name": "in", "inside": ["Hole"], "locked": None})], "locked": None})
    assert rows[1]["chain"] == {"number": 1, "next": {"number": 2, "next": None, "note": "none"}, "note": "none"}
    s.run('insert disks {id: 9, root: Link {to: Some(Hole)}, chain: {number: 5, next: Some({number: 6, note: "x"})}}')
    assert {r["id"]: r["root"] for r in got(s, "from disks")}[9] == ("Link", {"to": "Hole"})
    for step in ("drop variant Node.Folder", "change field Chain.number to text using n -> to_text n"):
        with pytest.raises(Exception):
            s.run(f"migration last {{\n parent deeper\n {step}\n}}")
    assert len(got(s, "from disks")) == 5


def test_limits_and_declarations(spark):
    s = Store(spark)
    s.run("struct Chain { n: int\n  next: Option<Chain> = None }\nstruct Row { id: int\n  c: Chain }\ntable t: Row { key id }")
    deep = None
    for i in range(80):
        deep = {"n": i, "next": deep}
    with pytest.raises(QueryError) as e:
        s.run("insert t $r", r={"id": 1, "c": deep})
    assert e.value.code == "E_LIMIT"
    for text in ("struct Endless { n: int\n  next: Endless }", "enum E { One(E)\n Two {e: E} }"):
        with pytest.raises(QueryError) as e:
            s.run(text)
        assert e.value.code == "E_SCHEMA"
