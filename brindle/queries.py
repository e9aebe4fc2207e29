"""The engine's operators as queries over a folder of tables, each with the SQL that says the same.

SELECTs go through the engine's own dialect over registered Parquet tables. Queries that change data do so in a
database of their own in the shared scratch folder and return the table afterwards.
"""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .errors import EngineError
from .functions import types as t
from .plans.parser import parse
from .repl import session
from .schema import ColumnDef, ForeignKey, TableSchema
from .sources.scratch import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return register


def _select(name: str, statement: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, scratch_dir(spark, name))
        parsed = parse(statement)
        for x in [parsed.table] + ([parsed.join.table] if parsed.join else []):
            engine.register_parquet(x, f"{sf_dir}/{x}.parquet")
        return engine.execute(parsed)

    _query(name, sql or statement.rstrip(";"))(run)


_select("scan_all", "SELECT * FROM nation;")
_select("scan_all_lineitem", "SELECT * FROM lineitem;")
_select("project", "SELECT c_custkey, c_mktsegment FROM customer;")
_select("project_qualified", "SELECT part.p_partkey, part.p_size FROM part;")
_select("filter_eq_num", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42;")
_select("filter_eq_str", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F';")
_select("filter_gt", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000;")
_select("filter_lt", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 5;")
_select("filter_str_gt", "SELECT p_partkey, p_brand FROM part WHERE p_brand > 'Brand#4';")
_select("filter_col_col", "SELECT p_partkey, p_size FROM part WHERE p_size > p_partkey;")
_select("filter_literal_first", "SELECT p_partkey, p_size FROM part WHERE 45 < p_size;")
_select(
    "filter_ts_lt", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < 19960101;",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'",
)
_select("filter_neg", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < -5.5;")
_select("pk_get", "SELECT * FROM customer WHERE c_custkey = 7;")
_select("join_inner", "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON orders.o_custkey = customer.c_custkey;")
_select("join_bare", "SELECT * FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey;")
_select("join_left", "SELECT documents.doc_id, lang, quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id;")
_select("join_left_outer", "SELECT documents.doc_id, toxic FROM documents LEFT OUTER JOIN labels ON labels.doc_id = documents.doc_id;")
_select("join_right", "SELECT doc_id, quality, item_id FROM labels RIGHT JOIN benchmark ON labels.doc_id = benchmark.item_id;")
_select("join_full", "SELECT doc_id, quality, item_id FROM labels FULL JOIN benchmark ON labels.doc_id = benchmark.item_id;")
_select("join_full_outer", "SELECT doc_id, item_id FROM labels FULL OUTER JOIN benchmark ON labels.doc_id = benchmark.item_id;")
_select(
    "join_clash", "SELECT * FROM documents INNER JOIN labels ON documents.doc_id = labels.doc_id;",
    "SELECT d.doc_id AS documents_doc_id, d.text, d.lang, d.source, d.n_chars, l.doc_id AS labels_doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
_select("join_where", "SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE c_mktsegment = 'BUILDING';")
_select("join_left_where", "SELECT documents.doc_id, quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id WHERE quality > 0;")


# Changes

REGION = "CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name VARCHAR(25) NOT NULL);"
CUSTOMER = "CREATE TABLE customer (c_custkey INT PRIMARY KEY, c_name VARCHAR(25) NOT NULL, c_mktsegment VARCHAR(10), c_acctbal DECIMAL(12,2));"
ORDERS = "CREATE TABLE orders (o_orderkey INT PRIMARY KEY, o_custkey INT NOT NULL, o_orderstatus ENUM('F','O','P'), o_totalprice DECIMAL(12,2), o_orderdate DATE);"
_CUSTOMER_SQL = "CAST(c_custkey AS INT) AS c_custkey, c_name, c_mktsegment, CAST({} AS DECIMAL(12,2)) AS c_acctbal FROM customer"
_ORDERS_SQL = """SELECT CAST(o_orderkey AS INT) AS o_orderkey, CAST(o_custkey AS INT) AS o_custkey,
  CAST(list_position(['F','O','P'], o_orderstatus) - 1 AS TINYINT) AS o_orderstatus,
  CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders"""


def _loaded(spark: SparkSession, sf_dir: str, *ddl: str) -> Engine:
    """An engine of its own with these tables, filled from the folder's tables of the same names."""
    engine = Engine(spark, scratch_dir(spark, "db"))
    for sql in ddl:
        engine.sql(sql)
        name = parse(sql).table
        engine.insert_df(name, _table(spark, sf_dir, name).select(*engine.schema(name).names))
    return engine


@_query("bulk_insert", _ORDERS_SQL)
def bulk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, ORDERS).table("orders")


@_query("insert_row", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(5 AS INT), 'ATLANTIS'")
def insert_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir, REGION)
    engine.sql("INSERT INTO region VALUES (5, 'ATLANTIS');")
    return engine.table("region")


@_query("update_where", "SELECT " + _CUSTOMER_SQL.format("CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END"))
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir, CUSTOMER)
    engine.sql("UPDATE customer SET c_acctbal = 0 WHERE c_mktsegment = 'BUILDING';")
    return engine.table("customer")


@_query("update_row", "SELECT " + _CUSTOMER_SQL.format("c_acctbal").replace("c_name,", "CASE WHEN c_custkey = 7 THEN 'Seven' ELSE c_name END AS c_name,"))
def update_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir, CUSTOMER)
    old = engine.get_by_pk("customer", 7)
    engine.update("customer", 7, old.c_custkey, "Seven", old.c_mktsegment, old.c_acctbal)
    return engine.table("customer")


@_query("update_key", "SELECT CASE WHEN r_regionkey = 2 THEN CAST(12 AS INT) ELSE r_regionkey END AS r_regionkey, r_name FROM region")
def update_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir, REGION)
    engine.sql("UPDATE region SET r_regionkey = 12 WHERE r_regionkey = 2;")
    return engine.table("region")


@_query("delete_where", _ORDERS_SQL + " WHERE NOT coalesce(o_orderstatus = 'F', false)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir, ORDERS)
    engine.sql("DELETE FROM orders WHERE o_orderstatus = 'F';")
    return engine.table("orders")


@_query("delete_row", "SELECT " + _CUSTOMER_SQL.format("c_acctbal") + " WHERE c_custkey <> 7")
def delete_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir, CUSTOMER)
    engine.delete("customer", 7)
    return engine.table("customer")


@_query("txn_commit", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(5 AS INT), 'ATLANTIS'")
def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen from a second opening of the database."""
    engine = _loaded(spark, sf_dir, REGION)
    engine.execute_script("BEGIN; INSERT INTO region VALUES (5, 'ATLANTIS'); COMMIT;")
    return Engine(spark, engine.catalog.files.root).table("region")


@_query("txn_rollback", "SELECT r_regionkey, r_name FROM region")
def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir, REGION)
    engine.execute_script("BEGIN; INSERT INTO region VALUES (5, 'ATLANTIS'); DELETE FROM region WHERE r_regionkey < 3; ROLLBACK;")
    return engine.table("region")


@_query("txn_own_changes", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 2 UNION ALL SELECT CAST(5 AS INT), 'ATLANTIS'")
def txn_own_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an open transaction reads."""
    engine = _loaded(spark, sf_dir, REGION)
    engine.execute_script("BEGIN; INSERT INTO region VALUES (5, 'ATLANTIS'); DELETE FROM region WHERE r_regionkey < 3;")
    return engine.table("region")


@_query("scan_ordered", "SELECT " + _CUSTOMER_SQL.format("c_acctbal"))
def scan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, CUSTOMER).scan("customer")


@_query("pk_get_own", "SELECT " + _CUSTOMER_SQL.format("c_acctbal") + " WHERE c_custkey = 7")
def pk_get_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, CUSTOMER).get("customer", 7)


@_query("autoinc", "SELECT CAST(row_number() OVER (ORDER BY n_name) AS INT) AS id, n_name AS name FROM nation")
def autoinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch_dir(spark, "db"))
    engine.create_table(TableSchema("n", (ColumnDef("id", t.INT, primary_key=True, auto_increment=True), ColumnDef("name", t.VARCHAR, 32))))
    engine.insert_df("n", _table(spark, sf_dir, "nation").orderBy("n_name").select(F.lit(None).cast("int").alias("id"), F.col("n_name").alias("name")))
    return engine.table("n")


# Constraints: each returns what the table holds after the refusals, and which they were


def _refusals(spark: SparkSession, engine: Engine, *attempts) -> DataFrame:
    """(attempt, code) for each statement or call; code 0 if it was done."""
    rows = []
    for k, attempt in enumerate(attempts):
        try:
            engine.sql(attempt) if isinstance(attempt, str) else attempt()
            rows.append((k, 0))
        except EngineError as e:
            rows.append((k, e.code))
    return spark.createDataFrame(rows, "attempt int, code int")


def _with(df: DataFrame, table: DataFrame, *cols: str) -> DataFrame:
    """Refusals and rows, one below the other."""
    text = [F.col(c).cast("string").alias(c) for c in cols]
    none = [F.lit(None).cast("string").alias(c) for c in cols]
    return df.select(F.col("attempt").cast("int"), F.col("code").cast("int"), *none).union(table.select(F.lit(None).cast("int"), F.lit(None).cast("int"), *text))


@_query(
    "pk_dup_check",
    """SELECT 'r_regionkey' AS "column", CAST(r_regionkey AS VARCHAR) AS value, 'a value that exists' AS why FROM region WHERE r_regionkey = 3
    UNION ALL SELECT 'r_regionkey', '9', 'a value twice' UNION ALL SELECT 'r_name', NULL, 'NULL' UNION ALL SELECT 'rows left', CAST(count(*) AS VARCHAR), 'refused' FROM region""",
)
def pk_dup_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that insert_df refuses, what of them it refuses, and that the table is as before."""
    engine = _loaded(spark, sf_dir, REGION)
    rows = spark.createDataFrame([(3, "again"), (8, "new"), (9, "one"), (9, "two"), (10, None)], "r_regionkey int, r_name string")
    refused = _refusals(spark, engine, lambda: engine.insert_df("region", rows))
    left = engine.table("region").agg(F.lit("rows left"), F.count("*").cast("string"))
    return engine.refused("region", rows).union(left.crossJoin(refused.select(F.when(F.col("code") < 0, "refused").otherwise("taken"))))


@_query(
    "unique_check",
    """SELECT * FROM (VALUES (0, -3), (1, 0), (2, 0), (3, -3), (4, 0)) AS x(attempt, code), (SELECT NULL::VARCHAR AS id, NULL::VARCHAR AS name)
    UNION ALL SELECT NULL, NULL, CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey = 3 THEN 'Renamed' ELSE n_name END FROM nation
    UNION ALL SELECT * FROM (VALUES (NULL, NULL, '100', NULL), (NULL, NULL, '101', NULL)) AS y""",
)
def unique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that exists is refused on insert and update; NULLs never clash."""
    engine = Engine(spark, scratch_dir(spark, "db"))
    engine.sql("CREATE TABLE n (id INT PRIMARY KEY, name VARCHAR(25) UNIQUE);")
    engine.insert_df("n", _table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    one, two = (engine.get_by_pk("n", k).name for k in (1, 2))
    found = _refusals(
        spark, engine, f"INSERT INTO n VALUES (99, '{one}');", "INSERT INTO n VALUES (100, NULL);", "INSERT INTO n VALUES (101, NULL);",
        f"UPDATE n SET name = '{two}' WHERE id = 3;", "UPDATE n SET name = 'Renamed' WHERE id = 3;",
    )
    return _with(found, engine.table("n"), "id", "name")


@_query(
    "not_null_check",
    """SELECT * FROM (VALUES (0, -6), (1, -6), (2, -6), (3, 0)) AS x(attempt, code), (SELECT NULL::VARCHAR AS r_regionkey, NULL::VARCHAR AS r_name)
    UNION ALL SELECT NULL, NULL, CAST(r_regionkey AS VARCHAR), r_name FROM region UNION ALL SELECT NULL, NULL, '7', 'seven'""",
)
def not_null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir, REGION)
    found = _refusals(
        spark, engine, "INSERT INTO region VALUES (7, NULL);", "UPDATE region SET r_name = NULL WHERE r_regionkey = 1;",
        lambda: engine.insert_df("region", spark.createDataFrame([(8, "x"), (9, None)], "r_regionkey int, r_name string")), "INSERT INTO region VALUES (7, 'seven');",
    )
    return _with(found, engine.table("region"), "r_regionkey", "r_name")


@_query("duplicate_key_keeps_the_first", "SELECT * FROM (VALUES (0, 0), (1, -3), (2, 0)) AS x(attempt, code), (SELECT NULL::VARCHAR AS id, NULL::VARCHAR AS name) UNION ALL VALUES (NULL, NULL, '5', 'Alice'), (NULL, NULL, '6', 'Bob')")
def duplicate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch_dir(spark, "db"))
    engine.sql("CREATE TABLE users (id INT PRIMARY KEY, name VARCHAR(32) NOT NULL);")
    found = _refusals(spark, engine, "INSERT INTO users VALUES (5, 'Alice');", "INSERT INTO users VALUES (5, 'Bob');", "INSERT INTO users VALUES (6, 'Bob');")
    return _with(found, engine.table("users"), "id", "name")


# Several tables in a transaction, its state, closing

NATION = "CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR(25), n_regionkey INT);"
_BOTH = "SELECT 'region' AS name, CAST(r_regionkey AS INT) AS id FROM region UNION ALL SELECT 'nation', CAST(n_nationkey AS INT) FROM nation"
_CHANGES = "BEGIN; INSERT INTO region VALUES (5, 'ATLANTIS'); DELETE FROM nation WHERE n_regionkey = 2; UPDATE nation SET n_nationkey = 50 WHERE n_nationkey = 0;"


def _both(engine: Engine) -> DataFrame:
    return engine.table("region").select(F.lit("region").alias("name"), F.col("r_regionkey").alias("id")).union(engine.table("nation").select(F.lit("nation"), "n_nationkey"))


@_query("txn_two_tables", "SELECT 'region' AS name, CAST(r_regionkey AS INT) AS id FROM region UNION ALL SELECT 'region', 5 UNION ALL SELECT 'nation', CAST(CASE WHEN n_nationkey = 0 THEN 50 ELSE n_nationkey END AS INT) FROM nation WHERE n_regionkey <> 2")
def txn_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed together, seen from a second opening."""
    engine = _loaded(spark, sf_dir, REGION, NATION)
    engine.execute_script(_CHANGES + " COMMIT;")
    return _both(Engine(spark, engine.catalog.files.root))


@_query("txn_two_tables_rollback", _BOTH)
def txn_two_tables_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir, REGION, NATION)
    engine.execute_script(_CHANGES + " ROLLBACK;")
    return _both(engine).intersectAll(_both(Engine(spark, engine.catalog.files.root)))


@_query("close_commits", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(5 AS INT), 'ATLANTIS'")
def close_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir, REGION)
    engine.execute_script("BEGIN; INSERT INTO region VALUES (5, 'ATLANTIS');")
    engine.close()
    engine.close()
    return Engine(spark, engine.catalog.files.root).table("region")


@_query("txn_state", "SELECT * FROM (VALUES (0, false, 0), (1, true, 1), (2, false, 0), (3, true, 2), (4, false, 0)) AS x(step, active, id)")
def txn_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a transaction is open, and its number; 0 is none."""
    engine = Engine(spark, scratch_dir(spark, "db"))
    steps = [lambda: None, engine.begin, engine.commit, engine.begin, engine.rollback]
    rows = [(k, engine.in_transaction, engine.txn_id) for k, step in enumerate(steps) if (step(), True)[1]]
    return spark.createDataFrame(rows, "step int, active boolean, id int")


# Scans row by row


@_query("scan_order", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS position, CAST(n_nationkey AS INT) AS n_nationkey FROM nation")
def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came in another order, by single inserts and in bulk, as a scan gives them."""
    engine = Engine(spark, scratch_dir(spark, "db"))
    engine.sql(NATION)
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    engine.insert_rows("nation", [tuple(r) for r in nation.where("n_nationkey % 3 = 0").orderBy(F.desc("n_nationkey")).collect()])
    engine.insert_df("nation", nation.where("n_nationkey % 3 > 0").orderBy(F.desc("n_nationkey")))
    return spark.createDataFrame([(k, r.n_nationkey) for k, r in enumerate(engine.rows("nation"), 1)], "position int, n_nationkey int")


@_query("scan_early_exit", "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INT) AS position, CAST(o_orderkey AS INT) AS o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
def scan_early_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that is left after seven rows, which is what this query is about."""
    found = []
    for r in _loaded(spark, sf_dir, ORDERS).rows("orders"):
        found.append((len(found) + 1, r.o_orderkey))
        if len(found) == 7:
            break
    return spark.createDataFrame(found, "position int, o_orderkey int")


@_query("scan_modify", "SELECT CASE WHEN r_regionkey % 2 = 0 THEN CAST(r_regionkey + 100 AS INT) ELSE r_regionkey END AS r_regionkey, r_name FROM region WHERE r_regionkey <> 3")
def scan_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row that a scan is at is changed or deleted; the scan goes on over what was there when it began."""
    engine = _loaded(spark, sf_dir, REGION)
    for r in engine.rows("region"):
        if r.r_regionkey % 2 == 0:
            engine.update("region", r.r_regionkey, r.r_regionkey + 100, r.r_name)
        elif r.r_regionkey == 3:
            engine.delete("region", 3)
    return engine.table("region")


# The catalog


@_query("drop_and_create", "SELECT CAST(n_nationkey AS INT) AS k, n_name AS v FROM nation WHERE n_nationkey < 5 UNION ALL SELECT -4, 'dropped twice' UNION ALL SELECT -2, 'not there'")
def drop_and_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the dropped one's name has other columns and none of its rows."""
    engine = _loaded(spark, sf_dir, REGION)
    engine.sql("DROP TABLE region;")
    seen = _refusals(spark, engine, "SELECT * FROM region;", "DROP TABLE region;")
    engine.sql("CREATE TABLE region (k INT PRIMARY KEY, v VARCHAR(25));")
    engine.insert_df("region", _table(spark, sf_dir, "nation").where("n_nationkey < 5").select("n_nationkey", "n_name"))
    told = seen.select((F.col("code") * (F.col("attempt") + 1)).alias("k"), F.when(F.col("attempt") == 0, "not there").otherwise("dropped twice").alias("v"))
    return Engine(spark, engine.catalog.files.root).table("region").union(told)


@_query("catalog_remove", "SELECT * FROM (VALUES ('a'), ('c'), ('d')) AS x(name)")
def catalog_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that a second opening finds."""
    engine = Engine(spark, scratch_dir(spark, "db"))
    for name in "abc":
        engine.sql(f"CREATE TABLE {name} (id INT PRIMARY KEY);")
    engine.catalog.remove("b")
    engine.sql("CREATE TABLE d (id INT PRIMARY KEY);")
    return spark.createDataFrame([(x,) for x in Engine(spark, engine.catalog.files.root).tables()], "name string")


_COLUMNS = "position int, name string, type string, max_len int, scale int, not_null boolean, primary_key boolean, is_unique boolean, auto_increment boolean, has_default boolean, default_value string, labels string, width int"


def _described(spark: SparkSession, schema: TableSchema) -> DataFrame:
    rows = []
    for k, c in enumerate(schema.columns):
        default = str(c.default) if c.has_default else None
        rows.append((k, c.name, c.type, c.max_len, c.scale, c.not_null, c.primary_key, c.unique, c.auto_increment, c.has_default, default, ",".join(c.labels), c.width))
    for k, f in enumerate(schema.foreign_keys):
        rows.append((100 + k, f.name, "FOREIGN KEY", 0, 0, False, False, False, False, False, None, f"{f.column} -> {f.ref_table}.{f.ref_column}", 0))
    rows.append((200, schema.name, "ROW", 0, 0, False, False, False, False, False, str(schema.next_id), "", schema.row_width))
    return spark.createDataFrame(rows, _COLUMNS)


@_query(
    "schema_round_trip",
    """SELECT * FROM (VALUES
    (0, 'id', 'INT', 0, 0, true, true, false, true, false, NULL, '', 4), (1, 'username', 'VARCHAR', 50, 0, true, false, true, false, false, NULL, '', 52),
    (2, 'score', 'DECIMAL', 10, 2, false, false, false, false, true, '0.00', '', 8), (3, 'active', 'BOOL', 0, 0, false, false, false, false, true, 'True', '', 1),
    (4, 'status', 'ENUM', 0, 0, false, false, false, false, true, '0', 'active,inactive,pending', 1), (5, 'since', 'DATE', 0, 0, false, false, false, false, false, NULL, '', 4),
    (6, 'at', 'DATETIME', 0, 0, false, false, false, false, false, NULL, '', 8), (7, 'region', 'INT', 0, 0, false, false, false, false, false, NULL, '', 4),
    (100, 'fk_region', 'FOREIGN KEY', 0, 0, false, false, false, false, false, NULL, 'region -> region.r_regionkey', 0), (200, 'products', 'ROW', 0, 0, false, false, false, false, false, '10', '', 82))
    AS x(position, name, type, max_len, scale, not_null, primary_key, is_unique, auto_increment, has_default, default_value, labels, width)""",
)
def schema_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, constraints, defaults, labels, foreign keys, counter and row width, as a second opening has them."""
    columns = (
        ColumnDef("id", t.INT, primary_key=True, auto_increment=True),
        ColumnDef("username", t.VARCHAR, 50, not_null=True, unique=True),
        ColumnDef("score", t.DECIMAL, 10, 2, has_default=True, default=0),
        ColumnDef("active", t.BOOL, has_default=True, default=True),
        ColumnDef("status", t.ENUM, labels=("active", "inactive", "pending"), has_default=True, default=0),
        ColumnDef("since", t.DATE),
        ColumnDef("at", t.DATETIME),
        ColumnDef("region", t.INT),
    )
    engine = Engine(spark, scratch_dir(spark, "db"))
    engine.create_table(TableSchema("products", columns, (ForeignKey("fk_region", "region", "region", "r_regionkey"),), next_id=10))
    return _described(spark, Engine(spark, engine.catalog.files.root).schema("products"))


@_query("foreign_key_audit", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation WHERE n_regionkey IN (1, 3)")
def foreign_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys are not enforced: rows whose counterpart has gone are found afterwards."""
    engine = _loaded(spark, sf_dir, REGION)
    engine.sql("CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR(25), n_regionkey INT REFERENCES region(r_regionkey));")
    engine.insert_df("nation", _table(spark, sf_dir, "nation").select(*engine.schema("nation").names))
    engine.sql("DELETE FROM region WHERE r_regionkey = 1;")
    engine.sql("DELETE FROM region WHERE r_regionkey = 3;")
    return engine.orphans("nation")


# Statements as text, the prompt


@_query(
    "statement_text",
    """SELECT * FROM (VALUES
    (0, 0, 'select from a'), (0, 1, '  columns: x, b.y'), (0, 2, '  left join b on a.id = b.id'), (0, 3, '  where x > 5'),
    (1, 0, 'create table t'), (1, 1, '  id: INT, primary key'), (1, 2, '  name: VARCHAR'), (2, 0, 'insert into t'), (2, 1, '  values: 1, two'),
    (3, 0, 'update t'), (3, 1, '  set name = x'), (3, 2, '  where id = 1'), (4, 0, 'delete from t'), (5, 0, 'drop table t'), (6, 0, 'transaction: begin'))
    AS x(statement, line, said)""",
)
def statement_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parser understood, line by line, through the facade."""
    engine = Engine(spark, scratch_dir(spark, "db"))
    statements = [
        "SELECT x, b.y FROM a LEFT JOIN b ON a.id = b.id WHERE x > 5;", "CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(9));", "INSERT INTO t VALUES (1, 'two');",
        "UPDATE t SET name = 'x' WHERE id = 1;", "DELETE FROM t;", "DROP TABLE t;", "BEGIN;",
    ]
    rows = [(n, k, line) for n, sql in enumerate(statements) for k, line in enumerate(engine.parse_query(sql).describe().split("\n"))]
    return spark.createDataFrame(rows, "statement int, line int, said string")


@_query("prompt_session", "SELECT * FROM (VALUES (0, 'created'), (1, 'inserted: 1'), (2, 'inserted: 1'), (3, 'id | name'), (4, '1 | Ada'), (5, '2 | NULL'), (6, 'rows: 2')) AS x(line, said)")
def prompt_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements over several lines, two on one line, an error that ends neither, and an exit in the middle of one."""
    engine, out, err = Engine(spark, scratch_dir(spark, "db")), io.StringIO(), io.StringIO()
    lines = ["CREATE TABLE u", "(id INT PRIMARY KEY, name VARCHAR(9));", "INSERT INTO u VALUES (2, NULL); INSERT INTO u VALUES (1, 'Ada');", "NONSENSE;", "SELECT *", "FROM u;", "DROP TABLE", "exit", "u;"]
    session(engine, lines, out, err)
    if "Syntax Error" not in err.getvalue():
        raise AssertionError("the error was not told")
    return spark.createDataFrame(list(enumerate(out.getvalue().strip().split("\n"))), "line int, said string")


# Integer forms

_query("enum_encode", "SELECT o_orderkey, CAST(list_position(['F','O','P'], o_orderstatus) - 1 AS INT) AS v FROM orders")(
    lambda spark, sf_dir: _table(spark, sf_dir, "orders").select("o_orderkey", t.enum_to_int(F.col("o_orderstatus"), ("F", "O", "P")).alias("v"))
)
_query("date_encode", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS v FROM orders")(
    lambda spark, sf_dir: _table(spark, sf_dir, "orders").select("o_orderkey", t.date_to_int(F.col("o_orderdate")).alias("v"))
)
_query("date_decode", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS v FROM orders")(
    lambda spark, sf_dir: _table(spark, sf_dir, "orders").select("o_orderkey", t.int_to_date(t.date_to_int(F.col("o_orderdate"))).alias("v"))
)
_query("datetime_encode", "SELECT event_id, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS v FROM events")(
    lambda spark, sf_dir: _table(spark, sf_dir, "events").select("event_id", t.datetime_to_int(F.col("ts")).alias("v"))
)
_query("datetime_decode", "SELECT event_id, date_trunc('second', ts) AS v FROM events")(
    lambda spark, sf_dir: _table(spark, sf_dir, "events").select("event_id", t.int_to_datetime(t.datetime_to_int(F.col("ts"))).alias("v"))
)
_query("decimal_encode", "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS v FROM part")(
    lambda spark, sf_dir: _table(spark, sf_dir, "part").select("p_partkey", t.decimal_to_int(F.col("p_retailprice")).alias("v"))
)
_query("decimal_decode", "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS v FROM part")(
    lambda spark, sf_dir: _table(spark, sf_dir, "part").select("p_partkey", t.int_to_decimal(t.decimal_to_int(F.col("p_retailprice"))).alias("v"))
)
_query("enum_decode", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F','O') THEN o_orderstatus END AS v FROM orders")(
    lambda spark, sf_dir: _table(spark, sf_dir, "orders").select("o_orderkey", t.int_to_enum(t.enum_to_int(F.col("o_orderstatus"), ("F", "O", "P")), ("F", "O")).alias("v"))
)
_query("varchar_trunc", "SELECT CAST(c_custkey AS INT) AS c_custkey, substring(c_name, 1, 10) AS c_name FROM customer")(
    lambda spark, sf_dir: _loaded(spark, sf_dir, "CREATE TABLE customer (c_custkey INT PRIMARY KEY, c_name VARCHAR(10));").table("customer")
)
