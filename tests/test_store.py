"""Managed tables: changes, constraints, atomic scripts, references, sequences and migrations."""

from __future__ import annotations

import datetime as dt
import decimal

import pytest

from adtflow.errors import QueryError
from adtflow.sources.store import Changed, State, Store

SCHEMA = """
enum Water {
  Rain
  Drip {litres: int, holes: List<int> = [2, 3]}
}
enum Care {
  Gone
  Sown {bed: int, water: Water, thinned: Option<bool> = None}
  Resting {until: date}
}
struct Label {
  latin: text
  common: Option<text> = None
}
struct Plant {
  code: text
  care: Care
  height: int = 7
  label: Label = {latin: "sp."}
  notes: List<text> = []
  cost: Decimal<8, 3> = decimal "0.25"
  giver: Option<text> = None
}
table plants: Plant { key code }
create index plants (height)
create unique index plants (giver) if is_some giver
insert plants {code: "fig", height: 31, care: Sown {bed: 4, water: Rain, thinned: Some(false)}, notes: ["pot", "sun"], giver: Some("Ute")}
insert many plants [
  {code: "hop", care: Resting {until: @2025-11-30}}
  {code: "ivy", height: 12, care: Care::Sown {bed: 9, water: Drip {litres: 2}}}
  {code: "yew", care: Gone}
]
"""


@pytest.fixture
def store(spark):
    s = Store(spark)
    s.run(SCHEMA)
    return s


def ids(store, q="from plants"):
    return [r["code"] for r in store.query(f"{q} | sort code | select {{code}}").rows()]


def fails(store, code, text, **params):
    before = (ids(store), store.state.revision)
    with pytest.raises(QueryError) as e:
        store.run(text, **params)
    assert e.value.code == code and (ids(store), store.state.revision) == before


def test_insert_defaults_and_nested_values(store):
    rows = {r["code"]: r for r in store.query("from plants").rows()}
    assert rows["fig"]["care"] == ("Sown", {"bed": 4, "water": "Rain", "thinned": False}) and rows["fig"]["cost"] == decimal.Decimal("0.250")
    assert rows["ivy"]["care"] == ("Sown", {"bed": 9, "water": ("Drip", {"litres": 2, "holes": [2, 3]}), "thinned": None})
    assert rows["hop"]["label"] == {"latin": "sp.", "common": None} and rows["hop"]["care"] == ("Resting", {"until": dt.date(2025, 11, 30)}) and rows["yew"]["height"] == 7


def test_update_reads_old_rows_and_returns_new_ones(store):
    (moved,) = store.run(
        """update plants
filter height > 7
sort height
take 1
set {
  label.common = Some(concat code "?")
  height = height * 2 - length code
  care = match care {
    Sown {bed, water, ..} => Sown {bed: bed * 2, water: water}
    Resting {..} => Gone
    Gone => Gone
  }
}
returning {code, height, label.common, care}"""
    )
    care = ("Sown", {"bed": 18, "water": ("Drip", {"litres": 2, "holes": [2, 3]}), "thinned": None})
    assert moved.affected == 1 and moved.rows == [{"code": "ivy", "height": 21, "label.common": "ivy?", "care": care}]
    (swap,) = store.run('update plants | filter code == "fig" | set {height = length notes, notes = [giver_of giver]} | returning {height}'.replace("giver_of giver", "code"))
    assert swap.rows == [{"height": 2}] and store.query('from plants | filter code == "fig"').rows()[0]["notes"] == ["fig"]
    assert store.run("update plants | filter height < 0 | set height = 1")[0].affected == 0


def test_update_leaves_other_segments_alone(store):
    """Only the segments that hold changed rows are written anew."""
    before = list(store.state.tables["plants"].segments)
    store.run('update plants | filter code == "fig" | set height = 1')
    after = store.state.tables["plants"].segments
    assert before[1] in after and before[0] not in after and ids(store) == ["fig", "hop", "ivy", "yew"]
    store.run('delete plants | filter code == "fig"')
    assert store.state.tables["plants"].segments == [before[1]]
    store.run('upsert plants {code: "hop", care: Gone}')
    assert before[1] not in store.state.tables["plants"].segments and ids(store) == ["hop", "ivy", "yew"]


def test_upsert_and_delete(store):
    up, gone = store.run('upsert many plants [{code: "elm", care: Gone}, {code: "yew", care: Gone, height: 55}]\nreturning {code}\ndelete plants | filter care == Gone && height < 50 | returning')
    assert up.actions == ["inserted", "updated"] and up.rows == [{"code": "elm"}, {"code": "yew"}]
    assert gone.affected == 1 and gone.rows[0]["code"] == "elm" and ids(store) == ["fig", "hop", "ivy", "yew"]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ('insert plants {code: "ivy", care: Gone}', "E_CONSTRAINT"),
        ('insert many plants [{code: "oak", care: Gone}, {code: "oak", care: Gone}]', "E_CONSTRAINT"),
        ('upsert many plants [{code: "oak", care: Gone}, {code: "oak", care: Gone}]', "E_CONSTRAINT"),
        ('insert plants {code: "oak", care: Gone, giver: Some("Ute")}', "E_CONSTRAINT"),
        ('update plants | set code = "one"', "E_CONSTRAINT"),
        ('insert plants {code: "oak"}', "E_TYPE"),
        ('insert plants {code: "oak", care: Lost}', "E_TYPE"),
        ("insert plants {code: 8, care: Gone}", "E_TYPE"),
        ('insert plants {code: "oak", care: Gone, cost: decimal "0.0625"}', "E_TYPE"),
        ('update plants | set {label = {latin: "x"}, label.common = None}', "E_QUERY"),
        ("update plants | set height = 60 / (height - 31)", "E_ARITH"),
        ('delete plants | filter code == "hop"\nexpect affected > 1', "E_EXPECT"),
        ('insert plants {code: "oak", care: Gone}\ninsert plants {code: "oak", care: Gone}', "E_CONSTRAINT"),
        ("create unique index plants (height)", "E_INDEX"),
        ("create unique index plants (label.latin)", "E_CONSTRAINT"),
        ("create unique index plants (height) if height > 3", "E_INDEX_PREDICATE"),
        ("insert weeds {code: 1}", "E_TABLE"),
        ("drop reference plants (giver) references plants (code)", "E_REFERENCE"),
    ],
)
def test_refused_changes_leave_all_as_it_was(store, text, code):
    fails(store, code, text) if code != "E_ARITH" else pytest.raises(Exception, store.run, text)
    assert ids(store) == ["fig", "hop", "ivy", "yew"]


def test_partial_unique_index_allows_many_nones(store):
    store.run('insert many plants [{code: "oak", care: Gone}, {code: "ash", care: Gone, giver: Some("Bo")}]')
    assert len(ids(store)) == 6


def test_parameters_and_receipts(store):
    rows = [{"code": "box", "care": "Gone"}, {"code": "rue", "care": ("Sown", {"bed": 1, "water": "Rain"})}]
    first = store.run("insert many plants $rows\nreturning {code}", idempotency="spring", rows=rows)
    again = store.run("insert many plants $rows\nreturning {code}", idempotency="spring", rows=rows)
    assert isinstance(again[0], Changed) and again[0].rows == first[0].rows == [{"code": "box"}, {"code": "rue"}] and len(ids(store)) == 6
    with pytest.raises(QueryError) as e:
        store.run("insert many plants $rows", idempotency="spring", rows=[])
    assert e.value.code == "E_IDEMPOTENCY"


def test_references(store):
    store.run(
        """struct Visit { n: int
  plant: Option<text> = None }
table visits: Visit { key n }
create reference visits (plant) references plants (code)
insert many visits [{n: 40, plant: Some("hop")}, {n: 41}]"""
    )
    fails(store, "E_CONSTRAINT", 'insert visits {n: 42, plant: Some("oak")}')
    fails(store, "E_CONSTRAINT", 'delete plants | filter code == "hop"')
    fails(store, "E_CONSTRAINT", 'update plants | filter code == "hop" | set code = "pop"')
    store.run('delete visits | filter n == 40\ndelete plants | filter code == "hop"')
    assert ids(store) == ["fig", "ivy", "yew"]
    store.run('drop reference visits (plant) references plants (code)\ninsert visits {n: 43, plant: Some("oak")}')
    fails(store, "E_CONSTRAINT", "create reference visits (plant) references plants (code)")


def test_generated_defaults(spark):
    s = Store(spark)
    s.run("create sequence ticket start 500\nstruct Entry { n: int\n  u: uuid\n  at: timestamp }\ntable gate: Entry {\n  key n\n  default n = next ticket\n  default u = uuid_v7\n  default at = now\n}")
    (done,) = s.run("insert many gate $rows\nreturning", rows=[{}, {"n": 3}, {}])
    assert [x["n"] for x in done.rows] == [500, 3, 501] and all(len(x["u"]) == 36 and x["u"][14] == "7" for x in done.rows) and len({x["at"] for x in done.rows}) == 1


def test_store_is_read_again_from_its_folder(store, spark):
    other = Store(spark, store.root)
    assert ids(other) == ids(store) and other.state.dump() == State.load(other.state.dump()).dump()
    other.run('insert plants {code: "oak", care: Gone}')
    with pytest.raises(QueryError) as e:
        store.run('insert plants {code: "ash", care: Gone}')
    assert e.value.code == "E_CONFLICT"


def test_of_writers_at_one_moment_a_single_one_wins(store, spark):
    """Both have read the same revision; the manifest of a revision can be made only once."""
    from concurrent.futures import ThreadPoolExecutor

    writers = [Store(spark, store.root) for _ in range(4)]

    def add(i):
        try:
            writers[i].run(f'insert plants {{code: "w{i}", care: Gone}}')
            return i
        except QueryError as e:
            assert e.code == "E_CONFLICT"

    with ThreadPoolExecutor(4) as pool:
        won = [i for i in pool.map(add, range(4)) if i is not None]
    assert len(won) == 1 and set(ids(Store(spark, store.root))) - {"fig", "hop", "ivy", "yew"} == {f"w{won[0]}"}


def test_migration_rebuilds_nested_values(store):
    store.run(
        """migration spring {
  add variant Care.Potted
  rename field Plant.height to cm
  rename field Label.latin to species
  add field Label.page: int = 77
  rename variant Care.Gone to Lost
  rename variant Water.Drip to Hose
  change field Plant.notes: int using t -> length t
  rename type Water to Supply
}"""
    )
    rows = {r["code"]: r for r in store.query("from plants").rows()}
    assert rows["fig"]["cm"] == 31 and rows["fig"]["notes"] == 2 and rows["fig"]["label"] == {"species": "sp.", "common": None, "page": 77}
    assert rows["ivy"]["care"] == ("Sown", {"bed": 9, "water": ("Hose", {"litres": 2, "holes": [2, 3]}), "thinned": None}) and rows["yew"]["care"] == "Lost"
    store.run('insert plants {code: "oak", care: Potted, notes: 3}\nmigration autumn {\n  parent spring\n  drop field Plant.cost\n  add field Plant.zone: Option<text> = None\n}')
    assert "cost" not in store.query("from plants").columns and len(ids(store)) == 5
    for bad in ("migration autumn { parent spring }", "migration winter { parent spring }", "migration winter {\n parent autumn\n drop field Plant.code\n}", "migration winter {\n parent autumn\n drop variant Care.Potted\n}"):
        with pytest.raises(Exception):
            store.run(bad)
    assert [m["name"] for m in store.state.migrations] == ["spring", "autumn"]


def test_migration_of_variants_with_expressions(store):
    store.run(
        """migration thaw {
  rename type Water to Supply
  change variant Care.Sown to {bed: text, wet: Supply, age: int} using old -> {bed: to_text old.bed, wet: old.water, age: 3}
  drop variant Care.Resting
    using old -> Care::Sown {bed: to_text old.until, wet: Rain, age: 0}
  change variant Supply.Drip to (int, int) using d -> (d.litres, length d.holes)
}"""
    )
    rows = {r["code"]: r["care"] for r in store.query("from plants").rows()}
    assert rows == {"fig": ("Sown", {"bed": "4", "wet": "Rain", "age": 3}), "hop": ("Sown", {"bed": "2025-11-30", "wet": "Rain", "age": 0}), "ivy": ("Sown", {"bed": "9", "wet": ("Drip", (2, 2)), "age": 3}), "yew": "Gone"}


def test_migration_of_indexes_references_sequences_and_generators(store):
    store.run(
        """create sequence seq start 3
struct Tag { n: int
  plant: text }
table tags: Tag { key n
  default n = next(seq) }
insert tags {plant: "fig"}
migration tidy {
  rename sequence seq to counter
  add sequence other start 90
  drop index plants (height)
  add unique index plants (label.latin, code)
  add index plants.height
  add reference tags (plant) references plants (code)
  change default tags.n to next(other)
}
insert tags {plant: "ivy"}"""
    )
    assert [r["n"] for r in store.query("from tags | sort n").rows()] == [3, 90] and store.state.sequences == {"counter": 4, "other": 91}
    fails(store, "E_CONSTRAINT", 'insert tags {plant: "oak"}')
    for step, code in (
        ("drop sequence other", "E_SEQUENCE"),
        ("drop sequence none", "E_SEQUENCE"),
        ("drop index plants (code)", "E_INDEX"),
        ("add unique index plants (label.latin)", "E_CONSTRAINT"),
        ("add reference tags (plant) references plants (code)", "E_REFERENCE"),
        ("drop reference tags (n) references plants (code)", "E_REFERENCE"),
        ("change default tags.plant to now()", "E_TYPE"),
    ):
        fails(store, code, f"migration more {{\n parent tidy\n {step}\n}}")
    store.run("migration more {\n parent tidy\n drop reference tags (plant) references plants (code)\n drop sequence counter\n drop index plants (label.latin, code)\n}")
    store.run('insert tags {plant: "oak"}')


def test_queries_are_tried_against_a_migration(store):
    """Nothing is written; each query shows how it binds before and after."""
    queries = {"tall": "from plants | filter height > $h | select {code, height}", "all": "from plants | select {code}", "broken": "from plants | filter nope == 1"}
    out = store.preflight('migration m {\n rename field Plant.height to cm\n}', queries)
    assert out["tall"]["now"] == {"columns": {"code": "text", "height": "int"}, "params": {"h": "int"}} and out["tall"]["after"]["error"] == "E_FIELD" and not out["tall"]["valid"]
    assert out["all"]["valid"] and not out["all"]["changed"] and out["broken"]["now"]["error"] == "E_FIELD"
    assert store.state.migrations == [] and "height" in store.query("from plants").columns


def test_queries_and_changes_are_explained(store):
    out = store.run('explain from plants | filter code == "fig"')[0]
    assert out["stages"][0] == {"stage": "from", "table": "plants"}
    assert "key code" in store.explain_change('delete plants | filter code == "fig"')["checks"]
    with pytest.raises(QueryError) as e:
        store.query("from plants | lookup x from plants on giver == giver take 2")
    assert e.value.code == "E_LOOKUP"
