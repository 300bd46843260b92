"""Sample queries over managed tables, scripts and migrations, with the same results in SQL.

Each query loads a whole table of the driver's into a store in the shared folder, runs a script and returns what the store then holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtflow.errors import QueryError
from adtflow.queries import engine
from adtflow.sources.store import Changed, Store

CUSTOMERS = """
enum Standing {
  Clear
  Owing {cents: int}
  Frozen {why: text, level: int}
}
struct Place {
  nation: int
  segment: Option<text> = None
}
struct Client {
  id: int
  name: text
  place: Place
  balance: float
  standing: Standing
  note: Option<text> = None
}
table clients: Client { key id }
create index clients (name)
"""


def variant(tag: int, owing: Column | None = None) -> Column:
    """Standing's encoding: its tag and a nullable struct for each variant with a payload."""
    return F.struct(
        F.lit(tag).alias("tag"),
        (F.struct(owing.alias("cents")) if owing is not None else F.lit(None).cast("struct<cents:bigint>")).alias("Owing"),
        F.lit(None).cast("struct<why:string,level:bigint>").alias("Frozen"),
    )


def clients(spark: SparkSession, sf_dir: str) -> Store:
    """A store with all customers; the ones with a negative balance owe it."""
    s = Store(spark)
    s.run(CUSTOMERS)
    cents = F.round(F.col("c_acctbal") * -100).cast("long")
    place = F.struct(F.col("c_nationkey").cast("long").alias("nation"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        place.alias("place"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_acctbal") < 0, variant(1, cents)).otherwise(variant(0)).alias("standing"),
        F.lit(None).cast("string").alias("note"),
    )
    s.load("clients", rows)
    return s


SHOWN = """from clients
derive state = match standing {
  Clear => "clear"
  Owing {cents} => concat "owing " (to_text cents)
  Frozen {why, level} => concat why (to_text level)
}
derive segment = place.segment
derive nation = place.nation
select {id, name, nation, segment, balance, state, note}"""

#: What SHOWN gives of the loaded rows.
BASE = """SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS nation, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment, c_acctbal AS balance,
  CASE WHEN c_acctbal < 0 THEN 'owing ' || round(-100 * c_acctbal)::BIGINT ELSE 'clear' END AS state, NULL::VARCHAR AS note FROM customer"""


def after(script: str, query: str = SHOWN) -> Callable[[SparkSession, str], DataFrame]:
    """The query's rows once a script has changed the clients."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = clients(spark, sf_dir)
        if script:
            s.run(script)
        result = s.query(query)
        return result.frame.select(*(F.col(f"`{c}`") for c in result.columns))

    return run


def returned(script: str) -> Callable[[SparkSession, str], DataFrame]:
    """What the last statement returned, with its number of affected rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = clients(spark, sf_dir)
        done = [x for x in s.run(script) if isinstance(x, Changed)][-1]
        rows = [(done.affected, i, *r.values()) for i, r in enumerate(done.rows)]
        return spark.createDataFrame(rows, "affected long, position long, id long, balance double, name string")

    return run


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of scripts that are refused, and the number of rows after each, which none may change."""
    s, out = clients(spark, sf_dir), []
    s.run("struct Visit { id: int\n  client: Option<int> = None }\ntable visits: Visit { key id }\ncreate reference visits (client) references clients (id)\ninsert many visits [{id: 1, client: Some(3)}, {id: 2}]")
    for text in REFUSED:
        try:
            s.run(text)
            code = "none"
        except QueryError as e:
            code = e.code
        out.append((text, code, s.query("from clients | aggregate { n = count }").rows()[0]["n"]))
    return spark.createDataFrame(out, "script string, code string, n long")


#: Scripts, and the codes with which they are refused.
REFUSED = {
    'insert clients {id: 3, name: "x", place: {nation: 1}, balance: 0.0, standing: Clear}': "E_CONSTRAINT",
    "insert visits {id: 3, client: Some(-5)}": "E_CONSTRAINT",
    "delete clients | filter id == 3": "E_CONSTRAINT",
    "update clients | filter id == 3 | set id = -3": "E_CONSTRAINT",
    "create unique index clients (place.nation)": "E_CONSTRAINT",
    "delete clients | filter id == 4\nexpect affected == 2": "E_EXPECT",
    'insert clients {id: -1, name: "x", place: {nation: 1}, balance: 0.0, standing: Lost}': "E_TYPE",
    "update clients | set {place = {nation: 1}, place.nation = 2}": "E_QUERY",
    "drop reference visits (id) references clients (id)": "E_REFERENCE",
    "migration m {\n drop field Client.id\n}": "E_MIGRATION",
    "insert nowhere {id: 1}": "E_TABLE",
}


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose key is generated from a sequence; given keys use no number of it."""
    s = Store(spark)
    s.run("create sequence ticket start 100\nstruct Nation { id: int\n  name: text\n  region: int\n  made: timestamp\n  tag: uuid }\ntable nations: Nation {\n  key id\n  default id = next(ticket)\n  default made = now()\n  default tag = uuid_v7()\n}")
    rows = [{"name": r["n_name"], "region": r["n_regionkey"]} | ({"id": r["n_nationkey"]} if r["n_nationkey"] % 5 == 0 else {}) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]
    s.run("insert many nations $rows", rows=rows)
    return s.query("from nations | derive same = to_text tag != name | filter same | select {id, name, region}").frame.select("id", "name", "region")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script run twice with one key changes the store once."""
    s = clients(spark, sf_dir)
    for _ in range(2):
        s.run("update clients | filter balance > 0.0 | set balance = balance * 2.0", idempotency="double")
    out = s.query("from clients | select {id, balance}").frame
    return out.select("id", "balance")


def backup_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full copy, a change, an incremental copy, and the copy opened as a store."""
    from adtflow.sources.schema import backup

    s = clients(spark, sf_dir)
    backup(s, f"{s.root}-copy")
    s.run('insert clients {id: -1, name: "new", place: {nation: 1}, balance: 1.5, standing: Frozen {why: "w", level: 2}}')
    backup(s, f"{s.root}-copy")
    result = Store(spark, f"{s.root}-copy").query(SHOWN)
    return result.frame.select(*(F.col(f"`{c}`") for c in result.columns))


def pages(order: str, size: int, n: int, back: bool) -> Callable[[SparkSession, str], DataFrame]:
    """The first n pages of orders, each from the cursor of the one before; with back the last of them comes from a cursor before."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, out, cursor, before = engine(spark, sf_dir, "from orders"), [], "", ""
        q = f"from orders | sort {order} | select {{o_orderkey, o_orderstatus, o_totalprice}} | page {size}"
        for i in range(n):
            step = f' before "{before}"' if back and i == n - 1 else f' after "{cursor}"' if cursor else ""
            rows, before, cursor = e.query(q + step).paged()
            out += [(i, j, *r.values()) for j, r in enumerate(rows)]
        return spark.createDataFrame(out, "page long, position long, o_orderkey long, o_orderstatus string, o_totalprice double")

    return run


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prepared query with several values of its parameters."""
    p = engine(spark, sf_dir, "from part").prepare("from part | filter p_size == $size && p_brand in [$a, $b] | select {p_partkey, p_size, p_brand}")
    out = None
    for size, a, b in ((3, "Brand#1", "Brand#2"), (7, "Brand#3", "Brand#3"), (9, "", "none")):
        got = p.run(size=size, a=a, b=b).frame
        out = got if out is None else out.unionByName(got)
    return out.select("p_partkey", "p_size", "p_brand")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, parameters and cardinality of queries, without running them."""
    e = engine(spark, sf_dir, "from orders")
    out = []
    for text in ("from orders | filter o_orderkey == $k", "from orders | aggregate { n = count, top = max o_totalprice }", "from orders | group o_custkey { aggregate { n = count } }"):
        c = e.describe(text)
        out.append((text, ", ".join(f"{k}: {t}" for k, t in c["params"].items()), ", ".join(f"{k}: {t}" for k, t in list(c["columns"].items())[:2]), c["cardinality"]))
    return spark.createDataFrame(out, "query string, params string, first_columns string, cardinality string")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result streamed as JSON lines and read back."""
    import json

    from adtflow.streaming.pipelines import json_lines as lines

    e = engine(spark, sf_dir, "from supplier")
    rows = [json.loads(x)["row"] for x in [*lines(e.query("from supplier | filter s_acctbal > 0.0 | select {s_suppkey, s_name}"))][1:-1]]
    return spark.createDataFrame([(r["s_suppkey"], r["s_name"]) for r in rows], "s_suppkey long, s_name string")


FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "store_load": after(""),
    "store_insert": after('insert many clients [{id: -1, name: "a", place: {nation: 7}, balance: 2.5, standing: Frozen {why: "why", level: 3}}, {id: -2, name: "b", place: {nation: 8, segment: Some("S")}, balance: -1.0, standing: Owing {cents: 100}, note: Some("n")}]'),
    "store_update_match": after(
        'update clients\nfilter balance < 1000.0\nset {\n  balance = balance + 1.0\n  place.segment = Some(name)\n  standing = match standing {\n    Owing {cents} => Frozen {why: "owes ", level: cents / 100}\n    s => s\n  }\n}'
    ),
    "store_update_sorted_take": after("update clients | sort {-balance, id} | take 5 | set note = Some(to_text id)"),
    "store_upsert": after('upsert many clients [{id: 5, name: "five", place: {nation: 0}, balance: 0.5, standing: Clear}, {id: -7, name: "minus", place: {nation: 1}, balance: 0.25, standing: Clear}]'),
    "store_delete": after("delete clients | filter balance > 5000.0 || place.nation in [1, 2]"),
    "store_returning": returned("update clients | filter balance < 0.0 | sort {balance, id} | take 9 | set balance = -balance | returning {id, balance, name}"),
    "store_refusals": refusals,
    "store_sequence_default": sequences,
    "store_receipt": receipts,
    "store_backup_incremental": backup_restored,
    "migration_fields": after(
        "migration a {\n  drop index clients (name)\n  rename field Client.balance to funds\n  add field Place.zone: int = 9\n  change field Client.name to int using n -> length n\n  drop field Client.note\n  rename table clients to people\n  rename type Client to Person\n}",
        "from people | derive zone = place.zone | filter funds > 0.0 | select {id, name, funds, zone}",
    ),
    "migration_variants": after(
        'migration a {\n  rename variant Standing.Clear to Fine\n  change variant Standing.Owing to {whole: int, rest: int} using o -> {whole: o.cents / 100, rest: o.cents - o.cents / 100 * 100}\n  add variant Standing.Unknown\n}\nmigration b {\n  parent a\n  drop variant Standing.Frozen using f -> Standing::Owing {whole: f.level, rest: 0}\n}',
        'from clients\nderive {\n  state = match standing {\n    Fine => "fine"\n    Owing {whole, rest} => concat (to_text whole) (concat "/" (to_text rest))\n    Unknown => "unknown"\n  }\n}\nselect {id, state}',
    ),
    "migration_index_page": after("migration a {\n  add unique index clients (name, id)\n  drop key clients\n}", "from clients | sort {name, id} | page 40 | select {id, name}"),
    "page_walk": pages("{o_orderstatus, -o_orderkey}", 50, 4, False),
    "page_before": pages("{-o_totalprice, o_orderkey}", 30, 3, True),
    "prepared_parameters": prepared,
    "query_contracts": contracts,
    "result_json_lines": json_lines,
}

_CHANGED = f"SELECT * REPLACE ({{}}) FROM ({BASE})"
ORACLE_SQL: dict[str, str] = {
    "store_load": BASE,
    "store_insert": f"{BASE} UNION ALL SELECT -1, 'a', 7, NULL, 2.5, 'why3', NULL UNION ALL SELECT -2, 'b', 8, 'S', -1, 'owing 100', 'n'",
    "store_update_match": f"""SELECT id, name, nation, CASE WHEN balance < 1000 THEN name ELSE segment END AS segment, CASE WHEN balance < 1000 THEN balance + 1 ELSE balance END AS balance,
  CASE WHEN balance < 0 THEN 'owes ' || (round(-100 * balance)::BIGINT // 100) ELSE state END AS state, note FROM ({BASE})""",
    "store_update_sorted_take": f"SELECT * REPLACE (CASE WHEN row_number() OVER (ORDER BY balance DESC, id) <= 5 THEN id::VARCHAR END AS note) FROM ({BASE})",
    "store_upsert": f"SELECT * FROM ({BASE}) WHERE id <> 5 UNION ALL SELECT 5, 'five', 0, NULL, 0.5, 'clear', NULL UNION ALL SELECT -7, 'minus', 1, NULL, 0.25, 'clear', NULL",
    "store_delete": f"SELECT * FROM ({BASE}) WHERE NOT (balance > 5000 OR nation IN (1, 2))",
    "store_returning": f"SELECT count(*) OVER () AS affected, row_number() OVER (ORDER BY balance, id) - 1 AS position, id, -balance AS balance, name FROM (SELECT * FROM ({BASE}) WHERE balance < 0 ORDER BY balance, id LIMIT 9)",
    "store_refusals": "SELECT script, code, (SELECT count(*) FROM customer) AS n FROM (VALUES " + ", ".join("('{}', '{}')".format(k.replace("'", "''"), v) for k, v in REFUSED.items()) + ") t(script, code)",
    "store_sequence_default": "SELECT CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey ELSE 99 + row_number() OVER (PARTITION BY n_nationkey % 5 = 0 ORDER BY n_nationkey) END::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation",
    "store_receipt": "SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_acctbal * 2 ELSE c_acctbal END AS balance FROM customer",
    "store_backup_incremental": f"{BASE} UNION ALL SELECT -1, 'new', 1, NULL, 1.5, 'w2', NULL",
    "migration_fields": "SELECT c_custkey AS id, length(c_name) AS name, c_acctbal AS funds, 9::BIGINT AS zone FROM customer WHERE c_acctbal > 0",
    "migration_variants": "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN (round(-100 * c_acctbal)::BIGINT // 100) || '/' || (round(-100 * c_acctbal)::BIGINT % 100) ELSE 'fine' END AS state FROM customer",
    "migration_index_page": "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_name, c_custkey LIMIT 41",
    "page_walk": "SELECT (r - 1) // 50 AS page, (r - 1) % 50 AS position, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderstatus, o_orderkey DESC) AS r FROM orders) WHERE r <= 200",
    "page_before": """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS r FROM orders)
SELECT p.page, r % 30 AS position, o_orderkey, o_orderstatus, o_totalprice FROM o JOIN (VALUES (0::BIGINT, 0), (1, 1), (2, 0)) p(page, part) ON r // 30 = p.part""",
    "prepared_parameters": "SELECT p_partkey, p_size::BIGINT AS p_size, p_brand FROM part WHERE p_size = 3 AND p_brand IN ('Brand#1', 'Brand#2') OR p_size = 7 AND p_brand = 'Brand#3'",
    "query_contracts": """SELECT * FROM (VALUES ('from orders | filter o_orderkey == $k', 'k: int', 'o_orderkey: int, o_custkey: int', 'at most one'),
  ('from orders | aggregate { n = count, top = max o_totalprice }', '', 'n: int, top: Option<float>', 'one'),
  ('from orders | group o_custkey { aggregate { n = count } }', '', 'o_custkey: int, n: int', 'many')) t(query, params, first_columns, cardinality)""",
    "result_json_lines": "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0",
}
