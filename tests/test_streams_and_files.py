"""Parquet sources, streaming pipelines, JSON lines, the command line and the driver's entry points."""

from __future__ import annotations

import datetime as dt
import json
import subprocess
import sys
from pathlib import Path

import pytest

from adtflow import __main__ as cli
from adtflow.engine import Engine
from adtflow.errors import QueryError
from adtflow.sources.files import from_parquet, metadata, preview
from adtflow.streaming.pipelines import json_lines, over_stream


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("people") / "p.parquet")
    rows = [(1, "ada", True, (1, None), {"b": 2, "a": 1}, dt.datetime(2026, 1, 1)), (2, None, False, (2, 5), {}, dt.datetime(2026, 1, 2)), (3, "bo", True, (3, 1), {}, dt.datetime(2026, 1, 3))]
    spark.createDataFrame(rows, "id int, name string, active boolean, inner struct<a: short, b: int>, attrs map<string, int>, at timestamp").write.parquet(path)
    return path


def test_types_and_null_columns(spark, people):
    types = {m["name"]: m["type"] for m in metadata(spark, people)}
    assert types["id"] == "Option<int>" and types["attrs"] == "Option<Map<text, Option<int>>>" and types["at"] == "Option<timestamp>"
    e = Engine(spark).parquet(people, "data", ("id", "active", "inner", "attrs"))
    got = e.query("from data | filter inner.a >= Some(2) || get attrs \"a\" == Some(Some(1)) | sort id | select {id, name, inner.b}").rows()
    assert [r["id"] for r in got] == [1, 2, 3] and got[0]["inner.b"] is None
    with pytest.raises(QueryError) as x:
        from_parquet(spark, people, required="all", verify=True)
    assert x.value.code == "E_CONSTRAINT"


def test_pruning_reaches_the_scan(spark, people):
    plan = Engine(spark).parquet(people, "data", "all").explain("from data | filter id == 2 | select {id}")["plan"]
    assert "PushedFilters: [IsNotNull(id)" in plan and "ReadSchema: struct<id:int>" in plan


def test_preview(spark, people):
    assert [r["name"] for r in preview(spark, people, ["name"], limit=5).collect()].count(None) == 1
    for bad in ({"limit": 1001}, {"columns": ["nope"]}):
        with pytest.raises(QueryError):
            preview(spark, people, **bad)


def test_pipeline_over_a_stream(spark, people, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(people).schema).parquet(people)
    r = over_stream(Engine(spark), "s", stream, "from s | filter active | derive day = date_of at \"Z\" | group active { aggregate { n = count, m = max id } }", ("id", "active", "at"))
    q = r.frame.writeStream.format("memory").queryName("out_stream").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(x["n"], x["m"]) for x in spark.table("out_stream").collect()] == [(2, 3)]
    with pytest.raises(QueryError) as e:
        over_stream(Engine(spark), "s", stream, "from s | sort id")
    assert e.value.code == "E_STREAM"


def test_json_lines(spark, people):
    e = Engine(spark).parquet(people, "data", ("id", "at"))
    lines = [json.loads(x) for x in json_lines(e.query("from data | filter id < 3 | sort id | select {id, name, at}"))]
    assert lines[0]["columns"][0] == {"name": "id", "type": "int"} and lines[1]["row"] == {"id": 1, "name": "ada", "at": "2026-01-01T00:00:00Z"} and lines[-1] == {"rows": 2}


def test_command_line(spark, people, capsys):
    assert cli.main(["run", "from p | aggregate { n = count }", "--table", f"p={people}"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[1]) == {"row": {"n": 3}}
    assert cli.main(["fmt", "from p|filter a==1|take 2"]) == 0
    assert capsys.readouterr().out == "from p\nfilter a == 1\ntake 2\n"
    assert cli.main(["describe", "from p | filter id == $k", "--table", f"p={people}"]) == 0
    assert json.loads(capsys.readouterr().out)["params"] == {"k": "Option<int>"}
    assert cli.main(["run", "from nope"]) == 1 and "E_TABLE" in capsys.readouterr().err
    assert cli.main(["schema", people]) == 0 and cli.main(["preview", people, "--limit", "1"]) == 0


def test_entry_points():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"flagship", "exists_corr", "lookup_lines"} <= names and set(entry.oracle_sql()) <= names


def test_package_works_without_the_training_data_operators(tmp_path):
    """The entry module imports and offers the other queries when that subpackage and the pipeline are gone."""
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "adtflow", tmp_path / "adtflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not [n for n in q if n.startswith('op1')]; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).returncode == 0


def test_sample_queries_match_duckdb(spark):
    """A few of the sample queries against their SQL twins on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    d = Path("/root/testdata/sf0.001")
    if not d.is_dir():
        pytest.skip("no sample tables")
    from adtflow import queries

    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("flagship", "int_div_trunc", "decimal_mul_div_round", "timestamp_trunc_units", "lookup_lines", "exists_residual_outer", "match_enum_label", "window_rank_dense"):
        df = queries.FRAMES[name](spark, str(d))
        r = con.execute(queries.ORACLE_SQL[name])
        names = [x[0] for x in r.description]
        want = sorted(map(repr, (tuple(row[names.index(c)] for c in df.columns) for row in r.fetchall())))
        assert sorted(repr(tuple(x)) for x in df.collect()) == want, name


def test_contains_bytes_beyond_ten_digits(spark, tmp_path):
    """The bytes are the whole pairs of digits from the left, as the SQL takes them; a last digit without a partner belongs to none."""
    duckdb = pytest.importorskip("duckdb")
    from adtflow import queries

    keys = [k for first in (0, 1_136_000, 20_000_000, 200_000_000) for k in range(first, first + 1000)]  # of 10 to 13 digits
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["contains_bytes"]).fetchall())
    got = sorted(map(tuple, queries.FRAMES["contains_bytes"](spark, str(tmp_path)).collect()))
    assert got == want and {len(str(1_000_000_000 + k * 7919)) for k, _ in got} == {10, 11, 12, 13}
