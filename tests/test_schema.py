"""Portable schemas, differences as migrations, classes and backups."""

from __future__ import annotations

import dataclasses

import pytest

from adtflow.errors import QueryError
from adtflow.sources.schema import backup, difference, portable, python_classes, struct_of
from adtflow.sources.store import State, Store
from adtflow.types import INT, TEXT, List, Named, Option

OLD = """enum S {
  A
  B {n: int}
}
struct R { id: int
  s: S
  gone: int = 0 }
table r: R { key id }
insert many r [{id: 1, s: A}, {id: 2, s: B {n: 3}}]"""
NEW = """enum S {
  A
  B {n: int}
  C {t: text = "x"}
}
struct P { x: int = 1 }
struct R { id: int
  s: S
  tags: List<text> = ["a"]
  p: Option<P> = None }
table r: R { key id }"""


def test_difference_leads_from_one_schema_to_the_other(spark):
    a, b = Store(spark), Store(spark)
    a.run(OLD)
    b.run(NEW)
    text = difference(a.state, b.state)
    a.run(text)
    assert portable(a.state)["hash"] == portable(b.state)["hash"] and difference(a.state, b.state) is None
    assert sorted((r["id"], r["s"], r["tags"], r["p"]) for r in a.query("from r").rows()) == [(1, "A", ["a"], None), (2, ("B", {"n": 3}), ["a"], None)]
    with pytest.raises(QueryError):
        changed = State.load(a.state.dump())
        changed.types["R"] = dataclasses.replace(changed.types["R"], fields=(*changed.types["R"].fields[:1], dataclasses.replace(changed.types["R"].fields[2], name="new", has_default=False)))
        difference(a.state, changed)


def test_difference_of_indexes_references_sequences_and_defaults(spark):
    a, b = Store(spark), Store(spark)
    base = "enum Mood {{ Fine\n Odd }}\nstruct P {{ id: int\n name: text\n tag: Option<text> = None{0} }}\nstruct Q {{ id: int\n p: int }}\n{1}table ps: P {{ key id }}\ntable qs: Q {{ key id{2} }}\n{3}"
    a.run(base.format("", "create sequence old start 3\n", "", "create index ps (name)\ncreate reference qs (p) references ps (id)\n"))
    b.run(base.format('\n  note: text = "Fine"\n  mood: Mood = Odd', "create sequence fresh start 5\n", "\n default id = next(fresh)", 'create unique index ps (name, -id) if is_some tag && name == "x"\n'))
    text = difference(a.state, b.state)
    assert 'note: text = "Fine"' in text and "mood: Mood = Odd" in text and "drop reference" in text and "drop sequence old" in text
    a.run(text)
    assert portable(a.state)["hash"] == portable(b.state)["hash"] and difference(a.state, b.state) is None
    text = difference(b.state, State())
    assert "drop table ps" in text and "drop sequence fresh" in text


def test_backup_is_a_store(spark, tmp_path):
    a = Store(spark)
    a.run(OLD)
    out = backup(a, f"file://{tmp_path}/b")
    assert out["segments"] == 1 and Store(spark, f"file://{tmp_path}/b").query("from r | aggregate { n = count }").rows() == [{"n": 2}]
    assert backup(a, f"file://{tmp_path}/b")["segments"] == 0
    a.run("delete r | filter id == 1")
    assert backup(a, f"file://{tmp_path}/b")["segments"] == 1 and Store(spark, f"file://{tmp_path}/b").query("from r | aggregate { n = count }").rows() == [{"n": 1}]
    other = Store(spark)
    other.run(OLD)
    with pytest.raises(QueryError):
        backup(other, f"file://{tmp_path}/b")


def test_classes(spark):
    a = Store(spark)
    a.run(NEW)
    space: dict = {}
    exec(compile(python_classes(a.engine().registry), "classes", "exec"), space)
    assert space["R"](1, space["S_A"](), [], None).id == 1

    @dataclasses.dataclass
    class Row:
        id: int
        name: str = "x"
        tags: list[str] = dataclasses.field(default_factory=list)
        s: "int | None" = None

    r = struct_of(Row, a.engine().registry)
    assert [f.type for f in r.fields] == [INT, TEXT, List(TEXT), Option(INT)] and r.fields[1].default == "x" and Named("R") == Named("R")
