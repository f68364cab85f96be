"""Queries of the engine's own operators over the test tables, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.catalog import ColumnSpec, TableSchema, encode_key
from stratalog.engine import Engine
from stratalog.functions import columnar, rows
from stratalog.operators import merge
from stratalog.plans import router
from stratalog.queries.loaded import ask, engine_with
from stratalog.session import new_path, table
from stratalog.sources import generate, wal
from stratalog.sources.store import TableStore
from stratalog.streaming import ingest
from stratalog.types import stored_type

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, new_path(spark, "engine"), auto_compact=False)


def _schema(df: DataFrame, name: str, key: str) -> TableSchema:
    return TableSchema(name, [ColumnSpec(f.name, stored_type(f.dataType)) for f in df.schema], key)


def _loaded(spark: SparkSession, d: str, name: str, key: str) -> tuple[Engine, TableStore]:
    """An engine with one test table in it, written as a single commit."""
    df = table(spark, d, name)
    engine = _engine(spark)
    engine.create_table(_schema(df, name, key))
    store = engine.store(name)
    store.put(df)
    return engine, store


# scans and lookups: through the engine, over tables with a history to merge ----------------------------------------


def statement(name: str, text: str, other: str | None = None):
    """Register a statement that the engine answers; ``other`` is its form for the comparison where that differs."""
    QUERIES[name] = lambda spark, d: ask(spark, d, text)
    SQL[name] = other or text


statement("full_scan", "SELECT * FROM orders")
statement("project", "SELECT p_name, p_size FROM part")
statement("project_expressions", "SELECT p_partkey, p_size * 2 + 1 AS twice, upper(p_brand) AS brand FROM part")
statement("project_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
statement("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 42")
statement("prefix_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE startswith(CAST(o_orderkey AS STRING), '12')", "SELECT o_orderkey, o_totalprice FROM orders WHERE starts_with(CAST(o_orderkey AS VARCHAR), '12')")
statement("page_after_key", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 25")
statement("sql_range_pruned", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_orderstatus = 'F'")
statement("sql_key_list", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 7, 14, 77, -3)")
statement("sql_star_beside_columns", "SELECT *, r_regionkey + 1 AS next_key FROM region")


@query("SELECT * FROM orders WHERE o_orderkey = 42")
def store_point_lookup(spark, d):
    """The same by the store: only files whose key range holds 42 are read."""
    return engine_with(spark, d, ["orders"]).get("orders", 42)


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def store_range_scan(spark, d):
    return engine_with(spark, d, ["orders"]).store("orders").range(100, 900)


@query("SELECT 'orders:' || CAST(o_orderkey AS VARCHAR) AS k, o_custkey FROM orders WHERE 'orders:' || CAST(o_orderkey AS VARCHAR) BETWEEN 'orders:10' AND 'orders:5'")
def key_range(spark, d):
    """Byte order of textual keys."""
    return engine_with(spark, d, ["orders"]).table("orders").select(encode_key("orders", F.col("o_orderkey")).alias("k"), "o_custkey").where(F.col("k").between("orders:10", "orders:5"))


_KEYS = "(VALUES (CAST(1 AS BIGINT)), (CAST(7 AS BIGINT)), (CAST(-5 AS BIGINT))) AS w(k)"


def _keys(spark) -> DataFrame:
    return spark.sql(f"SELECT k FROM {_KEYS}")


@query(f"SELECT w.k AS o_orderkey, o_custkey, o_totalprice FROM {_KEYS} LEFT JOIN orders ON w.k = o_orderkey")
def batch_get(spark, d):
    return engine_with(spark, d, ["orders"]).store("orders").batch_get(_keys(spark), "k").select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"SELECT w.k AS o_orderkey FROM {_KEYS} WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = w.k)")
def batch_get_missing(spark, d):
    return engine_with(spark, d, ["orders"]).store("orders").missing(_keys(spark), "k")


# predicates ---------------------------------------------------------------------------------------------------------

for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    statement(f"filter_{_name}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 7")

statement("filter_and_or", "SELECT * FROM part WHERE (p_size < 10 AND p_brand = 'Brand#1') OR (p_size > 45 AND (p_retailprice > 1500 OR p_brand <> 'Brand#2'))")
statement("filter_extended", "SELECT p_partkey FROM part WHERE NOT (p_size = 3) AND p_brand LIKE 'Brand%' AND p_size IN (1, 2, 3, 4, 5) AND p_retailprice BETWEEN 900 AND 1500 AND p_name IS NOT NULL")
statement("filter_literal_left", "SELECT p_partkey FROM part WHERE 5 < p_size")
statement("filter_column_column", "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount > l_tax")


_NULLS = [("differs", "t <> 'view'"), ("equals_null", "t = NULL"), ("null_or_not", "t IS NULL OR NOT (t < 'm')")]


@query("WITH e AS (SELECT event_id, nullif(event_type, 'error') AS t FROM events) " + " UNION ALL ".join(f"SELECT '{n}' AS test, event_id FROM e WHERE {c}" for n, c in _NULLS))
def null_predicates(spark, d):
    """Three-valued logic on a column with nulls."""
    e = engine_with(spark, d, ["events"]).table("events").select("event_id", F.expr("nullif(event_type, 'error')").alias("t"))
    # one scan: each row is tested against all three
    tests = F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in _NULLS))
    return e.select(F.explode(F.array_compact(tests)).alias("test"), "event_id")


# aggregates ---------------------------------------------------------------------------------------------------------

_SUM = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
_AGGS = f"SELECT COUNT(*) AS n, {_SUM.format('l_quantity')} AS total, MIN(l_extendedprice) AS lowest, MAX(l_extendedprice) AS highest, ROUND(AVG(l_quantity), 9) AS mean FROM lineitem WHERE l_shipdate >= TIMESTAMP{{}} '1995-01-01' AND l_discount < 0.08"
statement("agg_filtered", _AGGS.format("_NTZ"), _AGGS.format(""))
statement("agg_count_variants", "SELECT count(*) AS n, count(nullif(event_type, 'error')) AS known, count(DISTINCT event_type) AS types, count(DISTINCT user_id) AS users FROM events")
statement("agg_empty_input", "SELECT count(*) AS n, sum(l_quantity) AS total, min(l_quantity) AS lowest, max(l_quantity) AS highest, avg(l_quantity) AS mean FROM lineitem WHERE l_quantity < -1")
statement("agg_grouped", f"SELECT l_returnflag, l_linestatus, {_SUM.format('l_extendedprice')} AS total, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
statement("agg_rollup", f"SELECT l_returnflag, l_linestatus, {_SUM.format('l_quantity')} AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")


@query("SELECT count(*) AS n, min(o_orderkey) AS lowest, max(o_orderkey) AS highest FROM orders")
def agg_compacted(spark, d):
    """An aggregate over a compacted table, which is read without a merge."""
    engine, store = _loaded(spark, d, "orders", "o_orderkey")
    store.compact_all()
    return engine.execute("SELECT count(*) AS n, min(o_orderkey) AS lowest, max(o_orderkey) AS highest FROM orders").rows


statement("engine_sql", f"SELECT o_orderpriority, count(*) AS n, {_SUM.format('o_totalprice')} AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY o_orderpriority")
statement("engine_sql_join", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
statement("sql_point_subquery", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS n, (SELECT max(o_totalprice) FROM orders) AS top FROM orders WHERE o_orderkey = 42")
statement("sql_point_self_join", "SELECT a.o_orderkey, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey = 42")
statement("sql_point_union", "SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey = 42")


# versions -----------------------------------------------------------------------------------------------------------


def _event_log(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", "value", F.col("event_id").alias(merge.SEQ), F.lit(0).alias(merge.ORD), (F.col("event_type") == "error").alias(merge.DELETED))


_LAST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events"


@query(f"SELECT user_id, value FROM ({_LAST}) WHERE r = 1 AND event_type <> 'error'")
def latest_wins_merge(spark, d):
    return merge.live(_event_log(spark, d), "user_id", ["user_id", "value"])


@query(f"SELECT user_id, event_type = 'error' AS is_deleted FROM ({_LAST}) WHERE r = 1")
def tombstone_report(spark, d):
    return merge.with_tombstones(_event_log(spark, d), "user_id", ["user_id"]).select("user_id", F.col(merge.DELETED).alias("is_deleted"))


@query("SELECT p_partkey, CASE WHEN p_partkey < 100 THEN p_size + 100 ELSE p_size END AS p_size FROM part UNION ALL SELECT p_partkey + 1000000000, p_size FROM part WHERE p_partkey < 38")
def upsert_merge(spark, d):
    """Base, updates and inserts as three commits of a table, merged on read."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    engine = _engine(spark)
    engine.create_table(_schema(p, "part", "p_partkey"))
    store = engine.store("part")
    store.put(p)
    store.put(p.where("p_partkey < 100").withColumn("p_size", F.col("p_size") + 100))
    store.put(p.where("p_partkey < 38").withColumn("p_partkey", F.col("p_partkey") + 1_000_000_000))
    return store.read()


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 0 ELSE p_size END AS p_size FROM part")
def update_rows(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    engine = _engine(spark)
    engine.create_table(_schema(p, "part", "p_partkey"))
    engine.store("part").put(p)
    result = engine.execute("UPDATE part SET p_size = 0 WHERE p_brand = 'Brand#1'")
    if result.error:
        raise result.error
    return engine.table("part").select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE NOT coalesce(p_size > 45, FALSE)")
def delete_rows(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    engine = _engine(spark)
    engine.create_table(_schema(p, "part", "p_partkey"))
    engine.store("part").put(p)
    result = engine.execute("DELETE FROM part WHERE p_size > 45")
    if result.error:
        raise result.error
    return engine.table("part")


@query("SELECT count(*) AS entries_in, count(*) FILTER (WHERE r = 1) AS entries_out, count(*) FILTER (WHERE r > 1) AS duplicates_removed FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)")
def compaction_stats(spark, d):
    """What a compaction of the events by user reads, keeps and drops."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    engine = _engine(spark)
    engine.create_table(_schema(e, "events", "user_id"))
    engine.store("events").put(e)
    s = engine.store("events").compact(0)
    return spark.createDataFrame([(s["entries_in"], s["entries_out"], s["duplicates_removed"])], "entries_in bigint, entries_out bigint, duplicates_removed bigint")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def compacted_read(spark, d):
    """All events of all users as versions of the users' rows, the younger half committed first; the compaction keeps the last of each."""
    e = table(spark, d, "events").select("user_id", "event_id")
    engine = _engine(spark)
    engine.create_table(TableSchema("events", [ColumnSpec("user_id", e.schema["user_id"].dataType), ColumnSpec("event_id", e.schema["event_id"].dataType)], "user_id", ordered=True))
    store = engine.store("events")
    half = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    store.put(e.where(F.col("event_id") > half), order=F.col("event_id"))
    store.put(e.where(F.col("event_id") <= half), order=F.col("event_id"))
    store.compact_all()
    return store.read()


# log ----------------------------------------------------------------------------------------------------------------


def _log_of_events(spark, d) -> wal.Log:
    log = wal.Log(spark, new_path(spark, "wal"))
    e = table(spark, d, "events")
    log.append(e.select(F.col("event_id").alias("sequence"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.when(F.col("event_type") == "error", wal.DELETE).otherwise(wal.INSERT).alias("operation"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("value")))
    return log


_LOG = "SELECT event_id AS sequence, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS operation, 'user:' || CAST(user_id AS VARCHAR) AS key, event_type AS value FROM events"


@query(_LOG)
def wal_recover(spark, d):
    return _log_of_events(spark, d).recover().select("sequence", "operation", "key", "value")


@query(f"{_LOG} WHERE event_id > 500")
def wal_truncate(spark, d):
    log = _log_of_events(spark, d)
    log.truncate(500)
    return log.recover().select("sequence", "operation", "key", "value")


# columns ------------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_values, min(v) AS min_value, max(v) AS max_value FROM (SELECT nullif(event_type, 'error') AS v FROM events)")
def column_stats(spark, d):
    return columnar.column_stats(table(spark, d, "events").select(F.expr("nullif(event_type, 'error')").alias("v")), "v")


@query("SELECT event_id // 1000 AS row_group, count(*) AS total, count(*) - count(user_id) AS nulls, min(user_id) AS min_value, max(user_id) AS max_value FROM events GROUP BY 1")
def zone_map(spark, d):
    return columnar.zone_map(table(spark, d, "events"), F.floor(F.col("event_id") / 1000), "user_id")


@query("SELECT event_id // 1000 AS row_group, min(event_id) AS min_value, max(event_id) AS max_value FROM events GROUP BY 1 HAVING min(event_id) <= 4200 AND max(event_id) >= 2500")
def zone_map_prune(spark, d):
    zones = columnar.zone_map(table(spark, d, "events"), F.floor(F.col("event_id") / 1000), "event_id")
    return zones.where(columnar.may_contain(2500, 4200)).select("row_group", "min_value", "max_value")


_RUNS = """WITH a AS (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS p FROM events),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS g FROM a)
SELECT CAST(g AS BIGINT) AS run_id, min(event_type) AS val, count(*) AS run_len FROM b GROUP BY g"""


@query(_RUNS)
def rle_encode(spark, d):
    return columnar.rle_encode(table(spark, d, "events"), "event_id", "event_type")


@query("SELECT event_type AS val, count(*) AS n FROM events GROUP BY event_type")
def rle_roundtrip(spark, d):
    return columnar.rle_decode(columnar.rle_encode(table(spark, d, "events"), "event_id", "event_type")).groupBy("val").agg(F.count("*").alias("n"))


@query("SELECT event_type AS val, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS BIGINT) AS code FROM events GROUP BY event_type")
def dict_encode(spark, d):
    return columnar.dictionary(table(spark, d, "events"), "event_id", "event_type")


@query("SELECT event_id, event_type AS val FROM events")
def dict_roundtrip(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    codes = columnar.dictionary(e, "event_id", "event_type")
    return columnar.dictionary_decode(columnar.dictionary_encode(e, codes, "event_type"), codes).select("event_id", "val")


@query("SELECT event_id, CASE WHEN lag(user_id) OVER (ORDER BY event_id) IS NULL THEN user_id END AS base, user_id - lag(user_id) OVER (ORDER BY event_id) AS delta FROM events")
def delta_encode(spark, d):
    return columnar.delta_encode(table(spark, d, "events"), "event_id", "user_id")


@query("SELECT event_id, user_id AS val FROM events")
def delta_roundtrip(spark, d):
    return columnar.delta_decode(columnar.delta_encode(table(spark, d, "events"), "event_id", "user_id"), "event_id")


@query("SELECT user_id AS val, count(*) AS n FROM events GROUP BY user_id")
def bitpack_roundtrip(spark, d):
    return columnar.bit_unpack(columnar.bit_pack(table(spark, d, "events"), "event_id", "user_id")).groupBy("val").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT event_type) AS entries FROM events")
def dict_size(spark, d):
    return columnar.dictionary_size(columnar.dictionary(table(spark, d, "events"), "event_id", "event_type"))


@query("SELECT count(l_quantity) AS count_value, sum(l_quantity) AS sum_value, avg(l_quantity) AS avg_value, min(l_quantity) AS min_value, max(l_quantity) AS max_value FROM lineitem")
def block_aggregate(spark, d):
    return columnar.from_blocks(columnar.block_stats(table(spark, d, "lineitem"), F.floor(F.col("l_orderkey") / 1000), "l_quantity"))


@query("SELECT length(bin(max(user_id))) AS bits FROM events")
def bit_width(spark, d):
    return table(spark, d, "events").agg(columnar.bit_width(F.col("user_id")).cast("bigint").alias("bits"))


@query("SELECT event_id, user_id, event_type FROM events")
def row_codec_roundtrip(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    blob = e.select(rows.encode_row(e.columns).alias("blob"))
    return blob.select(rows.decode_row(F.col("blob"), e.schema).alias("r")).select("r.*")


# catalog, plans, streams --------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('customer'), ('orders')) AS t(\"Tables\")")
def show_tables(spark, d):
    engine = _engine(spark)
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey")):
        engine.create_table(_schema(table(spark, d, name), name, key))
    return engine.execute("SHOW TABLES").rows


_COLUMNS = "('o_orderkey', 'INT64', TRUE), ('o_custkey', 'INT64', FALSE), ('o_orderstatus', 'STRING', FALSE), ('o_totalprice', 'DOUBLE', FALSE), ('o_orderdate', 'TIMESTAMP', FALSE), ('o_orderpriority', 'STRING', FALSE)"


@query(f"SELECT column_name, data_type, TRUE AS nullable, 'NONE' AS compression, primary_key FROM (VALUES {_COLUMNS}) AS t(column_name, data_type, primary_key)")
def describe_table(spark, d):
    engine = _engine(spark)
    engine.create_table(_schema(table(spark, d, "orders"), "orders", "o_orderkey"))
    return engine.execute("DESCRIBE orders").rows


@query("SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def stream_upsert(spark, d):
    """The raw events, shuffled by a hash over four files, as one stream of changes into an ordered table; each batch is one commit."""
    source = new_path(spark, "stream")
    e = table(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("gone"))
    e.repartition(4, F.xxhash64("event_id")).write.parquet(source)
    engine = _engine(spark)
    engine.create_table(TableSchema("users", [ColumnSpec("user_id", e.schema["user_id"].dataType), ColumnSpec("value", e.schema["value"].dataType)], "user_id", ordered=True))
    ingest.upsert_stream(engine, "users", ingest.file_stream(spark, source, e.schema, 2), "events", new_path(spark, "checkpoint"), deleted="gone", order="event_id").awaitTermination()
    return engine.table("users")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Daily windows by event time of a file stream in order of time; a last marker far ahead lets the watermark close all windows."""
    source, out = new_path(spark, "stream"), new_path(spark, "windows")
    e = table(spark, d, "events").select("ts", "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
    e.coalesce(1).sortWithinPartitions("ts").write.parquet(source)
    stream = ingest.file_stream(spark, source, e.schema, 1)
    run = lambda: ingest.windowed_totals(stream, "ts", "1 day", "1 hour", ["event_type"], "value").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-mark").trigger(availableNow=True).start().awaitTermination()
    run()
    e.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("decimal(18,2)").alias("value")).coalesce(1).write.mode("append").parquet(source)
    run()
    found = spark.read.parquet(out)
    return found.withColumns({"total": F.col("total").cast("double"), "window_start": F.col("window_start").cast("timestamp_ntz")})
