import io
import json
import random
import threading
import urllib.error
import urllib.request

import pytest

from stratalog import errors, types
from stratalog.catalog import ColumnSpec, TableSchema
from stratalog.engine import Engine
from stratalog.formatting import text_table
from stratalog.plans import router
from stratalog.server import serve
from stratalog.session import new_path
from stratalog.shell import run

from .conftest import rows


@pytest.fixture
def engine(spark):
    return Engine(spark, new_path(spark, "engine"))


def ok(engine, text):
    r = engine.execute(text)
    assert r.error is None, r.error
    return r


def got(engine, text):
    return rows(ok(engine, text).rows)


ORDERS = "INSERT INTO orders VALUES (1,'a',99.99,'APAC','completed'),(2,'b',250,'EMEA','pending'),(3,'c',75.5,'APAC','completed'),(4,'d',500,'NA','completed'),(5,'e',125,'EMEA','cancelled')"


@pytest.fixture
def orders(engine):
    ok(engine, "CREATE TABLE Orders (id BIGINT PRIMARY KEY, customer VARCHAR(5), amount DOUBLE, region VARCHAR(5), status VARCHAR(9))")
    assert ok(engine, ORDERS).affected == 5
    return engine


def test_predicates(orders):
    for cond, n in (("region = 'APAC'", 2), ("amount > 100", 3), ("amount < 100", 2), ("amount >= 250", 2), ("region='APAC' AND amount > 80", 1), ("region='APAC' OR region='EMEA'", 4), ("status != 'pending'", 4), ("NOT (id IN (1,2))", 3), ("region LIKE 'E%'", 2), ("200 < amount", 2), ("amount BETWEEN 99 AND 126", 2), ("region = NULL", 0)):
        assert len(got(orders, f"SELECT id FROM orders WHERE {cond}")) == n, cond


def test_aggregates(engine):
    ok(engine, "CREATE TABLE t (id BIGINT, amount DOUBLE, qty INT)")
    ok(engine, "INSERT INTO t VALUES (1,100.5,3),(2,200.5,1),(3,300.25,6),(4,NULL,NULL)")
    assert got(engine, "SELECT sum(amount), min(amount), max(amount), sum(qty), min(qty), max(qty), count(*), count(qty) FROM t") == [(601.25, 100.5, 300.25, 10, 1, 6, 4, 3)]
    assert got(engine, "SELECT sum(amount), count(*) FROM t WHERE id > 99") == [(None, 0)]


def test_update_and_delete(orders):
    assert ok(orders, "UPDATE orders SET amount = 1 WHERE id = 2").affected == 1
    assert ok(orders, "UPDATE orders SET status = 'x', amount = amount + 1 WHERE region = 'APAC'").affected == 2
    assert ok(orders, "UPDATE orders SET amount = 1 WHERE id = 99").affected == 0
    assert got(orders, "SELECT id, amount FROM orders WHERE status = 'x'") == [(1, 100.99), (3, 76.5)]
    assert ok(orders, "DELETE FROM orders WHERE id = 1 OR id = 3").affected == 2
    assert ok(orders, "DELETE FROM orders WHERE id = 1").affected == 0
    assert [r[0] for r in got(orders, "SELECT id FROM orders")] == [2, 4, 5]
    ok(orders, "INSERT INTO orders (id, customer) VALUES (1, 'again')")
    assert got(orders, "SELECT customer, amount FROM orders WHERE id = 1") == [("again", None)]


def test_update_of_the_key_moves_the_row(orders):
    assert ok(orders, "UPDATE orders SET id = 50 WHERE id = 1").affected == 1
    assert [r[0] for r in got(orders, "SELECT id FROM orders")] == [2, 3, 4, 5, 50]
    assert isinstance(orders.execute("UPDATE orders SET id = 2 WHERE id = 3").error, errors.FailedPrecondition)
    assert isinstance(orders.execute("UPDATE orders SET id = 7 WHERE id > 3").error, errors.FailedPrecondition)
    assert len(got(orders, "SELECT id FROM orders")) == 5


def test_errors(orders):
    for text, kind in (
        ("CREATE TABLE orders (id INT)", errors.AlreadyExists), ("SELECT * FROM missing", errors.NotFound), ("DROP TABLE missing", errors.NotFound), ("INSERT INTO orders VALUES (1)", errors.InvalidArgument), ("INSERT INTO orders (id, nope) VALUES (1, 2)", errors.InvalidArgument),
        ("INSERT INTO orders (customer) VALUES ('x')", errors.InvalidArgument), ("INSERT INTO orders VALUES ('x','a',1,'r','s')", errors.InvalidArgument), ("UPDATE orders SET amount = 1", errors.InvalidArgument), ("DELETE FROM orders", errors.InvalidArgument), ("UPDATE orders SET nope = 1 WHERE id = 1", errors.InvalidArgument),
        ("UPDATE orders SET amount = 'abc' WHERE id = 1", errors.InvalidArgument), ("SELECT nope FROM orders", errors.InvalidArgument), ("SELEC", errors.InvalidArgument), ("", errors.InvalidArgument), ("CREATE TABLE z (a INT, PRIMARY KEY (b))", errors.InvalidArgument), ("CREATE TABLE z (a ARRAY<INT>)", errors.InvalidArgument),
    ):
        assert isinstance(orders.execute(text).error, kind), (text, orders.execute(text).error)
    with pytest.raises(errors.Unimplemented):
        orders.explain("DELETE FROM orders WHERE id = 1")
    assert len(got(orders, "SELECT * FROM orders")) == 5  # failed changes leave nothing behind


def test_types_and_catalog(engine, spark):
    ok(engine, "CREATE TABLE types_test (a BIGINT, b INT, c DECIMAL(10,2), d FLOAT, e VARCHAR(2), f BOOLEAN NOT NULL, g TIMESTAMP, h BINARY)")
    ok(engine, "INSERT INTO types_test VALUES (1, 2, 3.25, 1.5, 'longer than two', TRUE, TIMESTAMP_NTZ '2024-01-01 00:00:00', X'00FF')")
    assert got(engine, "SELECT a, b, c, d, e, f FROM types_test") == [(1, 2, 3.25, 1.5, "longer than two", True)]
    assert engine.execute("INSERT INTO types_test (a) VALUES (2)").error
    assert engine.catalog.get("TYPES_TEST").primary_key == "a"
    again = Engine(spark, engine.path)
    assert got(again, "SHOW TABLES") == [("types_test",)]
    assert again.catalog.get("types_test").to_json() == engine.catalog.get("types_test").to_json()
    assert len(got(again, "SELECT * FROM types_test")) == 1  # rows outlive the engine
    ok(again, "DROP TABLE types_test")
    ok(again, "CREATE TABLE types_test (a INT)")
    assert got(again, "SELECT * FROM types_test") == []  # no row comes back
    assert types.value_size(types.parse_type("int")) == 4 and not types.is_fixed_size(types.parse_type("text"))
    with pytest.raises(errors.InvalidArgument):
        types.parse_type("geometry")


def test_random_operations_equal_a_dict(engine, spark):
    rng, model = random.Random(11), {}
    engine.create_table(TableSchema("kv", [ColumnSpec("k", types.parse_type("BIGINT")), ColumnSpec("v", types.parse_type("STRING"))]))
    for step in range(14):
        keys = [rng.randrange(30) for _ in range(8)]
        if rng.random() < 0.6:
            values = dict.fromkeys(keys, f"v{step}")
            engine.put("kv", spark.createDataFrame(list(values.items()), "k bigint, v string"))
            model |= values
        else:
            engine.delete_keys("kv", spark.createDataFrame([(k,) for k in keys], "k bigint"))
            for k in keys:
                model.pop(k, None)
        if step in (6, 11):
            engine.compact("kv")
        if step % 4 == 3:
            assert dict(rows(engine.table("kv"))) == model
    store = engine.store("kv")
    assert dict(rows(store.range(5, 20))) == {k: v for k, v in model.items() if 5 <= k <= 20}
    for k in range(0, 30, 5):
        assert rows(store.get(k)) == ([(k, model[k])] if k in model else [])
    live, dead = store.range_with_tombstones()
    assert dict(rows(live)) == model and not {r[0] for r in rows(dead)} & set(model)
    page, more, last = store.page(after=4, limit=3)
    assert [r[0] for r in page.collect()] == sorted(k for k in model if k > 4)[:3] and more == (len([k for k in model if k > 4]) > 3)
    assert [r[0] for r in store.iterate(0, 9)] == sorted(k for k in model if k <= 9)


def test_levels_and_plans(engine, spark):
    engine.auto_compact = False
    engine.create_table(TableSchema("lv", [ColumnSpec("k", types.parse_type("STRING")), ColumnSpec("v", types.parse_type("INT"))]))
    store = engine.store("lv")
    for low, high in (("aaa", "mmm"), ("nnn", "zzz"), ("a", "b"), ("c", "d")):
        store.put(spark.createDataFrame([(low, 1), (high, 2)], "k string, v int").coalesce(1))
    assert len(store.files_for_key("bbb")) == 1 and len(store.files_for_range("aaa", "ooo")) == 4
    assert store.due() == 0
    request = router.QueryRequest
    plans = {r.kind: engine.router.plan(r, store) for r in (request.point("lv", "a"), request.range("lv", "a", "b"), request.full("lv"), request.aggregation("lv", "count(*)"))}
    assert [(len(plans[k].files), plans[k].rows, plans[k].skipped) for k in (router.POINT, router.RANGE, router.FULL, router.AGGREGATION)] == [(1, 1, 3), (2, 4, 2), (4, 8, 0), (4, 8, 0)]
    assert plans[router.POINT].merge and "Merge: in one task" in plans[router.FULL].explain()
    assert "Exchange" not in plans[router.FULL].frame()._jdf.queryExecution().executedPlan().toString()
    few = router.Router(threshold=3)
    assert "4 newer files in parallel over 0 base files" in few.plan(request.full("lv"), store).explain() and few.plan(request.point("lv", "a"), store).path == router.ROW
    stats = store.compact(0)
    assert (stats["entries_in"], stats["entries_out"]) == (8, 8) and store.files_at(0) == []
    assert not engine.router.plan(request.full("lv"), store).merge
    assert engine.run_request(request.aggregation("lv", "count(*) AS n")).first()[0] == 8
    assert rows(engine.run_request(request.starting("lv", "a"))) == [("a", 1), ("aaa", 1)]
    assert "HashAggregate" not in store.read()._jdf.queryExecution().executedPlan().toString()
    assert store.estimate("a", "b") == 8 and store.estimate("zzzz", None) == 0
    store.delete(spark.createDataFrame([("a",)], "k string"))
    assert store.compact_all()[-1]["tombstones_removed"] == 1 and store.read().count() == 7
    assert store.vacuum() > 0 and store.read().count() == 7
    engine.pause()
    with pytest.raises(errors.FailedPrecondition):
        engine.compact()
    engine.resume()


def test_scan_prunes_columns_and_pushes_filters(orders):
    plan = orders.execute("SELECT customer FROM orders WHERE id > 3").rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan and "region" not in plan.split("ReadSchema")[1]


def test_explain(orders):
    assert "Type: POINT_LOOKUP" in orders.explain("SELECT * FROM orders WHERE id = 3")
    assert "Type: AGGREGATION" in orders.explain("SELECT count(*) FROM orders")
    assert "Type: RANGE_SCAN" in orders.explain("SELECT id FROM orders WHERE amount > 3")
    assert "Type: FULL_SCAN" in orders.explain("SELECT * FROM orders;")
    assert "Physical Plan" in orders.explain("SELECT * FROM orders", physical=True)
    assert got(orders, "EXPLAIN SELECT * FROM orders")


def test_shell(engine):
    out = io.StringIO()
    run(engine, io.StringIO("CREATE TABLE t (a INT,\n b VARCHAR(9));\nINSERT INTO t VALUES (1, 'x');\nSELECT *\nFROM t;\n\\d\n\\d t\n\\s\n\\h\n\\x\n\\d none\nSELECT * FROM nope;\n\\q\nSELECT 1;\n"), out)
    text = out.getvalue()
    assert "| 1 | x |" in text and "unknown command" in text and text.count("Error:") == 2 and "bytes" in text
    assert text_table(engine.execute("SELECT NULL AS n FROM t")).count("NULL") == 1


def test_server(engine):
    server = serve(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode() if not isinstance(body, bytes) else body
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data=data)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/api/query", {"sql": "CREATE TABLE t (a INT, b DOUBLE)"})[0] == 200
        assert call("/api/query", {"sql": "INSERT INTO t VALUES (1, 2.5)"})[1]["data"]["rowsAffected"] == 1
        status, body = call("/api/query", {"sql": "SELECT * FROM t"})
        assert (status, body["success"], body["data"]["columns"], body["data"]["rows"]) == (200, True, ["a", "b"], [[1, 2.5]])
        assert call("/api/query", {"sql": "SELEC"})[1]["error"]["type"] == "INVALID_ARGUMENT"
        assert call("/api/query", b"{")[0] == 400 and call("/api/query", {})[0] == 400
        assert "FULL_SCAN" in call("/api/explain", {"sql": "SELECT * FROM t"})[1]["data"]["plan"]
        assert call("/api/tables")[1]["data"] == ["t"]
        assert call("/api/tables/t")[1]["data"]["primary_key"] == "a"
        assert len(call("/api/tables/t/describe")[1]["data"]) == 2
        assert call("/api/tables/none")[0] == 404 and call("/nowhere")[0] == 404
        assert call("/api/status")[1]["data"]["entries"] == 1
        for path in ("/api/admin/flush", "/api/admin/compact", "/api/admin/compact/pause", "/api/admin/compact/resume"):
            assert call(path, {})[0] == 200
        assert call("/api/health")[1]["data"]["status"] == "ok" and "BIGINT" in call("/api/info")[1]["data"]["supportedTypes"]
    finally:
        server.shutdown()
