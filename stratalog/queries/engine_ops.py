"""Queries of the engine's remaining operators: statements that change tables, storage access by level, key and page, manifest and
maintenance, plans, logs, codecs and the outer interfaces. Each has SQL that says what must come out."""

from __future__ import annotations

import io
import json
import threading
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratalog import errors, shell
from stratalog.catalog import ColumnSpec, TableSchema, decode_key, encode_key
from stratalog.engine import Engine
from stratalog.formatting import envelope, text_table
from stratalog.functions import columnar, rows
from stratalog.operators import merge
from stratalog.plans import router
from stratalog.queries.loaded import KEY_SHIFT, engine_with, schema_of
from stratalog.server import serve
from stratalog.session import new_path, table
from stratalog.sources import columnar_file, generate, wal
from stratalog.types import parse_type

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _new(spark: SparkSession) -> Engine:
    return Engine(spark, new_path(spark, "engine"), auto_compact=False)


def _run(engine: Engine, *statements: str):
    result = None
    for text in statements:
        result = engine.execute(text)
        if result.error:
            raise result.error
    return result


def _values(rows_: str, names: str) -> str:
    return f"SELECT * FROM (VALUES {rows_}) AS t({names})"


# levels, keys, pages ------------------------------------------------------------------------------------------------


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS p_size FROM part UNION ALL SELECT p_partkey + {KEY_SHIFT}, p_size FROM part WHERE p_partkey % 11 = 0")
def level_scan(spark, d):
    """Level 1 alone: what was true before the updates and deletions that lie in level 0."""
    return engine_with(spark, d, ["part"]).store("part").read_levels([1]).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 = 0")
def newest_level_scan(spark, d):
    return engine_with(spark, d, ["part"]).store("part").read_levels([0]).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey BETWEEN 20 AND 60")
def plan_range(spark, d):
    engine = engine_with(spark, d, ["part"])
    return engine.run_request(router.QueryRequest(router.RANGE, "part", low=20, high=60, columns=["p_partkey", "p_size"]))


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey = 35")
def plan_point(spark, d):
    return engine_with(spark, d, ["part"]).run_request(router.QueryRequest(router.POINT, "part", key=35, columns=["p_partkey", "p_size"]))


@query("SELECT count(*) AS n, sum(p_size) AS total FROM part WHERE p_size > 10")
def aggregate_request(spark, d):
    store = engine_with(spark, d, ["part"])
    whole = store.run_request(router.QueryRequest(router.AGGREGATION, "part", aggregate="struct(count(*) AS n, sum(p_size) AS total) AS r", filter="p_size > 10"))
    return whole.select("r.*")


@query("SELECT c_name AS k, c_custkey AS v FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def store_prefix(spark, d):
    """A prefix of a textual key; files outside of it are not read."""
    engine = _new(spark)
    engine.create_table(TableSchema("names", [ColumnSpec("k", parse_type("STRING")), ColumnSpec("v", parse_type("BIGINT"))]))
    df = table(spark, d, "customer").select(F.col("c_name").alias("k"), F.col("c_custkey").cast("bigint").alias("v"))
    engine.store("names").put(df)
    return engine.store("names").prefix("Customer#00000001")


@query("SELECT c_name AS k, c_custkey AS v FROM customer WHERE c_name LIKE 'Customer#00000002%' AND c_custkey > 21")
def sql_prefix_pruned(spark, d):
    engine = _new(spark)
    engine.create_table(TableSchema("names", [ColumnSpec("k", parse_type("STRING")), ColumnSpec("v", parse_type("BIGINT"))]))
    df = table(spark, d, "customer").select(F.col("c_name").alias("k"), F.col("c_custkey").cast("bigint").alias("v"))
    for rest in range(3):
        engine.store("names").put(df.where(F.col("v") % 3 == rest))
    return _run(engine, "SELECT k, v FROM names WHERE k LIKE 'Customer#00000002%' AND v > 21").rows


@query("SELECT p_partkey FROM part WHERE p_partkey > 90 ORDER BY p_partkey LIMIT 15")
def ordered_after(spark, d):
    """Upper bound of a key: the next rows in order."""
    return engine_with(spark, d, ["part"]).store("part").after(90).select("p_partkey").limit(15)


@query("SELECT p_partkey FROM part WHERE p_partkey BETWEEN 10 AND 120")
def batch_iterator(spark, d):
    """Rows of a range by the iterator that fetches a partition at a time."""
    keys = [(r["p_partkey"],) for r in engine_with(spark, d, ["part"]).store("part").iterate(10, 120)]
    return spark.createDataFrame(keys, "p_partkey bigint")


@query(f"SELECT p_partkey, FALSE AS is_deleted FROM part UNION ALL SELECT p_partkey + {KEY_SHIFT}, TRUE FROM part WHERE p_partkey % 11 = 0")
def range_tombstones(spark, d):
    live, dead = engine_with(spark, d, ["part"]).store("part").range_with_tombstones()
    return live.select("p_partkey", F.lit(False).alias("is_deleted")).unionByName(dead.withColumn("is_deleted", F.lit(True)))


@query("SELECT c_custkey FROM customer WHERE c_custkey <= 60")
def store_pages(spark, d):
    """Pages of 25 keys, each from where the last one ended, until the key passes 60."""
    store, after, more, keys = engine_with(spark, d, ["customer"]).store("customer"), None, True, []
    while more and (after is None or after < 60):
        page, more, after = store.page(after, 25)
        keys += [r["c_custkey"] for r in page.collect()]
    return spark.createDataFrame([(k,) for k in keys if k <= 60], "c_custkey bigint")


# manifest and maintenance -------------------------------------------------------------------------------------------


@query("SELECT k, TRUE AS found, TRUE AS same FROM (VALUES (CAST(1 AS BIGINT)), (CAST(35 AS BIGINT)), (CAST(120 AS BIGINT))) AS t(k)")
def manifest_lookups(spark, d):
    """Files of a key by the manifest: they hold its row, and the index names the same ones as the scan."""
    store = engine_with(spark, d, ["part"]).store("part")
    index = store.index()
    out = []
    for k in (1, 35, 120):
        files = store.files_for_key(k)
        out.append((k, store.log(files).where(F.col("p_partkey") == k).count() > 0, {f.path for f in files} == {f.path for f in index.find(k)}))
    return spark.createDataFrame(out, "k bigint, found boolean, same boolean")


@query(f"SELECT count(*) AS n, TRUE AS enough, CAST(0 AS BIGINT) AS beyond FROM part WHERE p_partkey BETWEEN 20 AND 60 AND p_partkey < {KEY_SHIFT}")
def range_estimate(spark, d):
    """The rows of a range beside the estimate, which is an upper bound and 0 where no file reaches."""
    store = engine_with(spark, d, ["part"]).store("part")
    n = store.range(20, 60).count()
    return spark.createDataFrame([(n, store.estimate(20, 60) >= n, store.estimate(4 * KEY_SHIFT, None))], "n bigint, enough boolean, beyond bigint")


@query("SELECT CAST(count(*) AS BIGINT) AS entries, CAST(0 AS BIGINT) AS tombstones, CAST(min(o_orderkey) AS VARCHAR) AS low, CAST(max(o_orderkey) AS VARCHAR) AS high FROM orders")
def level_stats(spark, d):
    """The manifest after a compaction: entries, tombstones and key range over its files."""
    engine = _new(spark)
    df = table(spark, d, "orders")
    engine.create_table(schema_of(df, "orders", "o_orderkey"))
    engine.store("orders").put(df)
    engine.store("orders").compact(0)
    m = engine.store("orders").manifest_frame()
    return m.where("level = 1").agg(F.sum("entries").alias("entries"), F.sum("tombstones").alias("tombstones"), F.min(F.col("min_key").cast("bigint")).cast("string").alias("low"), F.max(F.col("max_key").cast("bigint")).cast("string").alias("high"))


@query(_values("(1, -1), (2, -1), (3, -1), (4, 0), (5, -1)", "step, due"))
def compaction_due(spark, d):
    """Which level is due after each of four commits and after the compaction (-1: none)."""
    engine = _new(spark)
    n = table(spark, d, "nation")
    engine.create_table(schema_of(n, "nation", "n_nationkey"))
    store, out = engine.store("nation"), []
    for step in range(1, 5):
        store.put(n.where(F.col("n_nationkey") % 4 == step - 1).coalesce(1))
        due = store.due()
        out.append((step, -1 if due is None else due))
    store.compact(0)
    due = store.due()
    return spark.createDataFrame([*out, (5, -1 if due is None else due)], "step int, due int")


@query("SELECT n + dead AS entries_in, n - dead AS entries_out, dead AS tombstones_removed FROM (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 5 = 0) AS dead FROM part)")
def compaction_tombstones(spark, d):
    """Entries read and kept by a compaction whose keys of every fifth row were deleted, and the tombstones that went."""
    engine = _new(spark)
    p = table(spark, d, "part").select("p_partkey", "p_size")
    engine.create_table(schema_of(p, "part", "p_partkey"))
    store = engine.store("part")
    store.put(p)
    store.delete(p.where("p_partkey % 5 = 0").select("p_partkey"))
    s = store.compact(0)
    return spark.createDataFrame([(s["entries_in"], s["entries_out"], s["tombstones_removed"])], "entries_in bigint, entries_out bigint, tombstones_removed bigint")


@query("SELECT CAST(1 AS BIGINT) AS tables, (SELECT count(*) FROM region) AS entries, TRUE AS has_bytes")
def engine_stats(spark, d):
    engine = _new(spark)
    r = table(spark, d, "region")
    engine.create_table(schema_of(r, "region", "r_regionkey"))
    engine.store("region").put(r)
    s = engine.stats()
    return spark.createDataFrame([(len(s["tables"]), s["entries"], s["bytes"] > 0)], "tables bigint, entries bigint, has_bytes boolean")


@query(_values("('pause', 'FAILED_PRECONDITION'), ('resume', 'OK')", "step, outcome"))
def admin_pause(spark, d):
    engine, out = _new(spark), []
    for step in ("pause", "resume"):
        getattr(engine, step)()
        try:
            engine.compact()
            out.append((step, "OK"))
        except errors.EngineError as e:
            out.append((step, e.code))
    return spark.createDataFrame(out, "step string, outcome string")


@query("SELECT 0 AS rows_read")
def bloom_prunes(spark, d):
    """Rows that a scan of a compacted file gives out for a key that lies in its range but is not in it: the bloom filter skips the row group."""
    engine = _new(spark)
    o = table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("k"), "o_custkey")
    engine.create_table(schema_of(o, "t", "k"))
    engine.store("t").put(o)
    engine.store("t").compact(0)
    found = engine.get("t", 1001)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    scans = [plan] if plan.children().size() == 0 else []
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            scans.append(p)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return spark.createDataFrame([(int(sum(p.metrics().apply("numOutputRows").value() for p in scans)),)], "rows_read int")


# statements ---------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 'third' ELSE n_name END AS name, CASE WHEN n_nationkey = 3 THEN NULL ELSE n_regionkey END AS region FROM nation UNION ALL SELECT 100, 'new', NULL UNION ALL SELECT 101, 'it''s', 2")
def sql_insert(spark, d):
    """INSERT of a query's rows, of values with and without column names, and of a key that is there already."""
    engine = _new(spark)
    n = table(spark, d, "nation")
    engine.create_table(schema_of(n, "nation", "n_nationkey"))
    engine.store("nation").put(n)
    _run(engine, "CREATE TABLE t (id BIGINT PRIMARY KEY, name VARCHAR(9), region BIGINT)", "INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation", "INSERT INTO t (name, id) VALUES ('new', 100)", "INSERT INTO t VALUES (101, 'it''s', 2), (3, 'third', NULL)")
    return _run(engine, "SELECT * FROM t").rows


@query(_values("('id', 'INT64', TRUE, 'before'), ('price', 'DOUBLE', FALSE, 'before'), ('ok', 'BOOL', FALSE, 'before')", "column_name, data_type, primary_key, state"))
def sql_create_drop(spark, d):
    """A table made, described, dropped and made again without its rows."""
    engine = _new(spark)
    made = _run(engine, "CREATE TABLE made (id BIGINT, price DECIMAL(10,2), ok BOOLEAN)", "INSERT INTO made VALUES (1, 2.5, TRUE)", "DESCRIBE made").rows
    before = [(r["column_name"], r["data_type"], r["primary_key"], "before") for r in made.collect()]
    left = _run(engine, "DROP TABLE made", "SHOW TABLES").rows.count()
    back = _run(engine, "CREATE TABLE made (id BIGINT)", "SELECT * FROM made").rows.count()
    return spark.createDataFrame(before + [("left", str(left + back), False, "after")] * (left + back), "column_name string, data_type string, primary_key boolean, state string")


@query(_values("('NOT_FOUND', 'SELECT * FROM missing'), ('INVALID_ARGUMENT', 'SELECT median_of(a) FROM t'), ('ALREADY_EXISTS', 'CREATE TABLE t (b INT)'), ('INVALID_ARGUMENT', 'INSERT INTO t VALUES (''x'')'), ('INVALID_ARGUMENT', 'DELETE FROM t'), ('UNIMPLEMENTED', 'TRUNCATE TABLE t'), ('INVALID_ARGUMENT', 'INSERT INTO t (a, b) VALUES (1, 2)')", "code, statement"))
def status_codes(spark, d):
    engine = _new(spark)
    _run(engine, "CREATE TABLE t (a INT)")
    statements = ["SELECT * FROM missing", "SELECT median_of(a) FROM t", "CREATE TABLE t (b INT)", "INSERT INTO t VALUES ('x')", "DELETE FROM t", "TRUNCATE TABLE t", "INSERT INTO t (a, b) VALUES (1, 2)"]
    return spark.createDataFrame([(getattr(engine.execute(s).error, "code", "OK"), s) for s in statements], "code string, statement string")


@query("SELECT k, max(v) AS v FROM (SELECT n_regionkey AS k, n_nationkey AS v FROM nation) GROUP BY k")
def guarded_put(spark, d):
    """A row comes in only over a lower order: the nations of each region in falling order of their keys."""
    engine = _new(spark)
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("k"), F.col("n_nationkey").cast("bigint").alias("v"))
    engine.create_table(TableSchema("t", [ColumnSpec("k", parse_type("BIGINT")), ColumnSpec("v", parse_type("BIGINT"))], ordered=True))
    for low, high in ((15, 99), (7, 14), (0, 6)):
        engine.store("t").put(n.where(F.col("v").between(low, high)), order=F.col("v"))
    return engine.table("t")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey <= 100")
def put_and_delete(spark, d):
    """Batches of rows put and of keys deleted, without SQL."""
    engine = _new(spark)
    p = table(spark, d, "part").select("p_partkey", "p_size")
    engine.create_table(schema_of(p, "part", "p_partkey"))
    engine.put("part", p)
    engine.delete_keys("part", p.where("p_partkey > 100").select("p_partkey"))
    return engine.table("part")


# plans --------------------------------------------------------------------------------------------------------------


@query(_values("('POINT_LOOKUP', 'ROW', TRUE), ('RANGE_SCAN', 'COLUMNAR', TRUE), ('FULL_SCAN', 'COLUMNAR', FALSE), ('PREFIX_SCAN', 'COLUMNAR', FALSE), ('AGGREGATION', 'COLUMNAR', FALSE)", "type, path, skips"))
def explain_plans(spark, d):
    """How each kind of request is run with a threshold of 50 rows, and whether files are skipped, over four commits of parts."""
    engine = _new(spark)
    p = table(spark, d, "part").select("p_partkey", "p_size").where("p_partkey <= 200")
    engine.create_table(schema_of(p, "part", "p_partkey"))
    store = engine.store("part")
    for low in range(0, 200, 50):
        store.put(p.where(F.col("p_partkey").between(low + 1, low + 50)).coalesce(1))
    plans = router.Router(threshold=50)
    requests = [router.QueryRequest.point("part", 1), router.QueryRequest.range("part", 1, 90), router.QueryRequest.full("part"), router.QueryRequest.starting("part", "1"), router.QueryRequest.aggregation("part", "count(*)")]
    return spark.createDataFrame([(p.request.kind, p.path, p.skipped > 0) for p in (plans.plan(r, store) for r in requests)], "type string, path string, skips boolean")


@query(_values("('SELECT * FROM part', 'FULL_SCAN'), ('SELECT p_size FROM part WHERE p_partkey = 5', 'POINT_LOOKUP'), ('SELECT p_size FROM part WHERE p_partkey > 5', 'RANGE_SCAN'), ('SELECT sum(p_size) FROM part WHERE p_partkey = 5', 'AGGREGATION'), ('SELECT p_name FROM part WHERE p_size = 5', 'RANGE_SCAN'), ('SELECT 1 FROM part a JOIN part b ON a.p_size = b.p_size', 'GENERAL'), ('SELECT '' where p_partkey = 5 '' FROM part', 'FULL_SCAN')", "statement, type"))
def explain_statements(spark, d):
    engine = engine_with(spark, d, ["part"])
    statements = ["SELECT * FROM part", "SELECT p_size FROM part WHERE p_partkey = 5", "SELECT p_size FROM part WHERE p_partkey > 5", "SELECT sum(p_size) FROM part WHERE p_partkey = 5", "SELECT p_name FROM part WHERE p_size = 5", "SELECT 1 FROM part a JOIN part b ON a.p_size = b.p_size", "SELECT ' where p_partkey = 5 ' FROM part"]
    return spark.createDataFrame([(s, _run(engine, f"EXPLAIN {s}").rows.collect()[1][0].split("Type: ")[1].split()[0]) for s in statements], "statement string, type string")


@query("SELECT '  Projection: p_name, p_size' AS line")
def explain_projection(spark, d):
    text = engine_with(spark, d, ["part"]).explain("SELECT p_name, p_size FROM part WHERE p_size > 3")
    return spark.createDataFrame([(x,) for x in text.splitlines() if "Projection" in x], "line string")


@query("SELECT count(*) AS n, TRUE AS enough FROM part WHERE p_partkey <= 77")
def plan_estimate(spark, d):
    engine = engine_with(spark, d, ["part"])
    n = engine.run_request(router.QueryRequest.range("part", None, 77)).count()
    return spark.createDataFrame([(n, engine.router.estimate(router.QueryRequest.range("part", None, 77), engine.store("part")) >= n)], "n bigint, enough boolean")


# logs ---------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey <> 4")
def buffered_flush(spark, d):
    """Small writes and a deletion through the log, flushed by the engine; half of them by one that opens the table after a crash."""
    engine = _new(spark)
    _run(engine, "CREATE TABLE t (id BIGINT PRIMARY KEY, name STRING)")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    log = engine.buffered("t")
    for r in nations[:12]:
        log.put(id=r["n_nationkey"], name="old" if r["n_nationkey"] == 3 else r["n_name"])
    engine.flush()
    for r in [nations[3], *nations[12:]]:
        log.put(id=r["n_nationkey"], name=r["n_name"])
    log.delete(4)
    log.group.flush()  # logged, not yet in the table
    again = Engine(spark, engine.path, auto_compact=False)
    again.flush()
    return again.table("t")


@query(_values("('IMMEDIATE', 5, 5), ('BATCHED', 2, 5), ('TIMED', 1, 5)", "mode, commits, entries"))
def group_commit(spark, d):
    out = []
    for mode in wal.GroupCommit.MODES:
        group = wal.GroupCommit(wal.Log(spark, new_path(spark, "wal")), mode, entries=3, millis=600_000)
        for i in range(5):
            group.add(i, wal.INSERT, f"k{i}", "v")
        group.flush()
        out.append((mode, group.stats["commits"], group.log.recover().count()))
    return spark.createDataFrame(out, "mode string, commits int, entries int")


@query("SELECT event_id AS sequence FROM events WHERE event_id > 300 AND event_id % 10 <> 0")
def wal_damaged(spark, d):
    """Recovery after truncation skips entries whose checksum does not fit: here every tenth."""
    log = wal.Log(spark, new_path(spark, "wal"))
    e = table(spark, d, "events").select(F.col("event_id").alias("sequence"), F.lit(0).cast("bigint").alias("ts"), F.lit(wal.INSERT).alias("operation"), F.col("event_type").alias("key"), F.lit("v").alias("value"))
    log.append(e.where("sequence % 10 <> 0"))
    damaged = e.where("sequence % 10 = 0").withColumn("crc", F.lit(1).cast("bigint"))
    damaged.write.mode("append").parquet(f"{log.path}/entries/{log._appends()[0][1]}")
    log.truncate(300)
    return log.recover().select("sequence")


# codecs and checks --------------------------------------------------------------------------------------------------


@query(_values("('123456789', CAST(3421780262 AS BIGINT)), ('', CAST(0 AS BIGINT)), ('a', CAST(3904355907 AS BIGINT))", "text, crc"))
def crc32_known(spark, d):
    """Checksums of which the values are public."""
    return spark.createDataFrame([("123456789",), ("",), ("a",)], "text string").select("text", columnar.crc32(F.col("text")).alias("crc"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS type, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS user_id FROM events")
def null_defaults(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("nullif(event_type, 'error')").alias("t"), F.expr("CASE WHEN user_id % 3 <> 0 THEN user_id END").alias("u"))
    return e.select("event_id", rows.with_default(F.col("t"), parse_type("STRING")).alias("type"), rows.with_default(F.col("u"), e.schema["u"].dataType).alias("user_id"))


@query("SELECT n_nationkey, n_name FROM nation")
def row_column_values(spark, d):
    """Single columns of row blobs."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    blob = n.select(rows.encode_row(n.columns).alias("b"))
    return blob.select(rows.column_value(F.col("b"), "n_nationkey").cast(n.schema["n_nationkey"].dataType).alias("n_nationkey"), rows.column_value(F.col("b"), "n_name").alias("n_name"))


@query(_values("('12', TRUE, TRUE, FALSE), ('1.5', FALSE, TRUE, FALSE), ('abc', FALSE, FALSE, FALSE), ('TRUE', FALSE, FALSE, TRUE)", "x, is_int, is_number, is_bool"))
def type_checks(spark, d):
    t = spark.createDataFrame([("12",), ("1.5",), ("abc",), ("TRUE",)], "x string")
    return t.select("x", rows.is_valid(F.col("x"), parse_type("INT")).alias("is_int"), rows.is_numeric(F.col("x")).alias("is_number"), rows.is_valid(F.col("x"), parse_type("BOOL")).alias("is_bool"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS pk, 'orders:' || CAST(o_orderkey AS VARCHAR) AS row_key, NULL::VARCHAR AS other FROM orders")
def key_decode(spark, d):
    o = table(spark, d, "orders").select(encode_key("Orders", F.col("o_orderkey")).alias("row_key"))
    return o.select(decode_key("orders", F.col("row_key")).alias("pk"), "row_key", decode_key("order", F.col("row_key")).alias("other"))


@query(_values("('id', 'INT64', FALSE), ('name', 'STRING', TRUE), ('at', 'TIMESTAMP', TRUE)", "name, type, nullable"))
def schema_roundtrip(spark, d):
    """A schema through its JSON, as the catalog keeps it."""
    made = TableSchema("t", [ColumnSpec("id", parse_type("BIGINT"), False), ColumnSpec("name", parse_type("VARCHAR(3)")), ColumnSpec("at", parse_type("timestamp"))])
    back = TableSchema.from_json(json.loads(json.dumps(made.to_json())))
    return spark.createDataFrame([(c["name"], c["type"], c["nullable"]) for c in back.to_json()["columns"]], "name string, type string, nullable boolean")


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_orderkey BETWEEN 100 AND 300")
def columnar_group_read(spark, d):
    """Only the row groups whose range meets the wanted one are read, a column of one group at a time."""
    path = new_path(spark, "columns")
    columnar_file.write(table(spark, d, "lineitem").select("l_orderkey", "l_quantity").coalesce(1).sortWithinPartitions("l_orderkey"), path, rows_per_group=500)
    groups = sorted({r["row_group"] for r in columnar_file.groups_that_may_contain(spark, path, "l_orderkey", 100, 300).collect()})
    parts = [columnar_file.read_column(spark, path, "l_orderkey", g) for g in groups]
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df.where(F.col("l_orderkey").between(100, 300)).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query("SELECT 10000 AS n, TRUE AS in_range, TRUE AS same_again")
def generate_transactions(spark, d):
    a, b = generate.transactions(spark, 10_000), generate.transactions(spark, 10_000)
    bad = a.where("region IS NULL OR category IS NULL OR status IS NULL OR amount < 10 OR amount > 5000 OR units < 1 OR units > 100").count()
    return a.agg(F.count("*").cast("int").alias("n")).select("n", F.lit(bad == 0).alias("in_range"), F.lit(a.exceptAll(b).isEmpty()).alias("same_again"))


# outer interfaces ---------------------------------------------------------------------------------------------------


def _call(base: str, path: str, body: dict | None = None) -> dict:
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(base + path, data=data)) as r:
        return json.loads(r.read())


def _served(engine: Engine, work):
    server = serve(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        return work(f"http://127.0.0.1:{server.server_address[1]}")
    finally:
        server.shutdown()
        server.server_close()


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def rest_query(spark, d):
    """A statement posted over HTTP."""
    engine = engine_with(spark, d, ["nation"])
    got = _served(engine, lambda base: _call(base, "/api/query", {"sql": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2"}))
    return spark.createDataFrame([tuple(r) for r in got["data"]["rows"]], "n_nationkey bigint, n_name string")


@query(_values("('health', 'ok', TRUE), ('info', 'stratalog', TRUE), ('tables', 'nation', TRUE)", "route, answer, complete"))
def rest_contract(spark, d):
    engine = _new(spark)
    _run(engine, "CREATE TABLE nation (a INT)")

    def work(base):
        health, info, tables = (_call(base, f"/api/{x}")["data"] for x in ("health", "info", "tables"))
        return [
            ("health", health["status"], {"status", "uptime_seconds", "version", "engine"} <= set(health)),
            ("info", info["engine"], {"version", "supportedStatements", "supportedTypes", "supportedAggregations", "supportedWhereOps", "features"} <= set(info)),
            ("tables", tables[0], True),
        ]

    return spark.createDataFrame(_served(engine, work), "route string, answer string, complete boolean")


@query(_values("('true', 'null'), ('false', 'NOT_FOUND')", "success, type"))
def envelopes(spark, d):
    made = [json.loads(envelope({"a": 1})), json.loads(envelope(error=errors.NotFound("x")))]
    return spark.createDataFrame([(json.dumps(m["success"]), m["error"]["type"] if m["error"] else "null") for m in made], "success string, type string")


@query("SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def text_tables(spark, d):
    """The rows of a printed table, without their padding."""
    engine = engine_with(spark, d, ["region"])
    lines = text_table(_run(engine, "SELECT r_regionkey, r_name FROM region")).splitlines()
    return spark.createDataFrame([("| " + " | ".join(x.strip() for x in line.strip("|").split("|")) + " |",) for line in lines[3:-2]], "line string")


@query(_values("('| 1 | x |'), ('t')", "line"))
def shell_session(spark, d):
    out = io.StringIO()
    shell.run(_new(spark), io.StringIO("CREATE TABLE t (a INT,\n b VARCHAR(9));\nINSERT INTO t VALUES (1, 'x');\nSELECT *\nFROM t;\n\\d\n\\q\n"), out)
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines() if x in ("| 1 | x |", "t")], "line string")


@query("SELECT user_id, event_id AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stored_latest(spark, d):
    """The last event of each user by the store's own merge of two commits."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("value"))
    engine = _new(spark)
    engine.create_table(TableSchema("t", [ColumnSpec(f.name, f.dataType) for f in e.schema], "user_id"))
    store = engine.store("t")
    half = e.agg(F.expr("percentile_approx(value, 0.5)")).first()[0]
    for part in (F.col("value") <= half, F.col("value") > half):
        store.put(merge.latest(e.where(part), "user_id", [F.col("value")], ["user_id", "value"]))
    return store.read()

