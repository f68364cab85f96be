import pytest

from stratalog.engine import Engine
from stratalog.session import new_path

from .conftest import rows


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, new_path(spark, "engine"), auto_compact=False)
    assert e.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, x BIGINT, z BIGINT)").ok
    for values in ("(1, 10, 30)", "(5, 20, 10)", "(9, 30, 20)"):
        assert e.execute(f"INSERT INTO t VALUES {values}").ok
    return e


def got(engine, text):
    r = engine.execute(text)
    assert r.error is None, r.error
    return rows(r.rows)


def files(engine, text):
    return len(engine.execute(text).rows.inputFiles())


def test_a_table_read_twice_is_read_whole(engine):
    assert [r[0] for r in got(engine, "SELECT * FROM t UNION ALL SELECT * FROM t WHERE id = 5")] == [1, 5, 5, 9]
    assert got(engine, "SELECT t.id FROM t JOIN (SELECT x AS y FROM t) s ON t.z = s.y WHERE id = 5") == [(5,)]
    assert got(engine, "SELECT id, (SELECT count(*) FROM t) AS n FROM t WHERE id = 5") == [(5, 3)]
    assert got(engine, "WITH s AS (SELECT x AS y FROM t) SELECT (SELECT max(y) FROM s) AS m FROM t WHERE id = 5") == [(30,)]
    assert "GENERAL" in engine.explain("SELECT * FROM t UNION ALL SELECT * FROM t WHERE id = 5")


def test_a_condition_that_is_not_of_the_scan_prunes_nothing(engine):
    assert got(engine, "SELECT * FROM (SELECT x / 2 AS id FROM t) WHERE id = 5") == [(5.0,)]
    assert got(engine, "SELECT id FROM t AS s(z, x, id) WHERE id = 10") == [(10,)]
    assert got(engine, "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM t) WHERE r = 2") == [(5,)]
    assert got(engine, "SELECT r FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM t) WHERE id = 9") == [(3,)]
    assert len(got(engine, "SELECT 'where id = 5' AS w FROM t")) == 3


def test_a_point_lookup_reads_only_its_files(engine):
    for text in ("SELECT x FROM t WHERE id = 5", "SELECT x FROM t s WHERE 5 = id ORDER BY x LIMIT 3"):
        assert got(engine, text) == [(20,)] and files(engine, text) == 1 and "POINT_LOOKUP" in engine.explain(text)


BIG = 9007199254740993  # 2^53 + 1, no float


def test_a_large_key_is_found_changed_and_removed(engine):
    assert engine.execute("CREATE TABLE big (id BIGINT PRIMARY KEY, v STRING)").ok
    assert engine.execute(f"INSERT INTO big VALUES ({BIG}, 'old')").ok and engine.execute("INSERT INTO big VALUES (1, 'x')").ok
    for literal in (BIG, f"{BIG}.0", f"'{BIG}'"):
        assert got(engine, f"SELECT v FROM big WHERE id = {literal}") == [("old",)]
    assert files(engine, f"SELECT v FROM big WHERE id = {BIG}") == 1
    assert len(got(engine, f"SELECT v FROM big WHERE id = {BIG - 1}D")) == 1  # a double stands for several keys
    assert engine.execute(f"UPDATE big SET v = 'new' WHERE id = {BIG}").affected == 1
    assert got(engine, f"SELECT v FROM big WHERE id = {BIG}") == [("new",)]
    assert engine.execute(f"DELETE FROM big WHERE {BIG} = id").affected == 1
    assert got(engine, "SELECT id FROM big") == [(1,)]


def test_what_is_no_literal_of_the_key_reads_all_files(engine):
    assert engine.execute("CREATE TABLE s (k STRING PRIMARY KEY, v STRING)").ok
    for values in (r"('a', 'a')", r"('b\\c', 'x')", "('07', 'y')"):
        assert engine.execute(f"INSERT INTO s VALUES {values}").ok
    assert got(engine, "SELECT k FROM s WHERE k = v") == [("a",)]
    assert got(engine, "SELECT k FROM s WHERE k = 'a'") == [("a",)] and files(engine, "SELECT k FROM s WHERE k = 'a'") == 1
    assert engine.execute(r"UPDATE s SET v = 'z' WHERE k = 'b\\c'").affected == 1
    assert got(engine, r"SELECT v FROM s WHERE k = 'b\\c'") == [("z",)]
    assert engine.execute("DELETE FROM s WHERE k = v").affected == 1


def test_ranges_prefixes_and_lists_read_only_their_files(engine):
    for text, ids, n in (
        ("SELECT id FROM t WHERE id BETWEEN 4 AND 6", [5], 1), ("SELECT id FROM t WHERE id > 4.5 AND x > 0", [5, 9], 2), ("SELECT id FROM t WHERE 2 > id", [1], 1), ("SELECT id FROM t WHERE id IN (1, 9)", [1, 9], 2), ("SELECT id FROM t WHERE id >= 2 AND id < 9 AND id <> 3", [5], 2),
        ("SELECT id FROM t WHERE id < 2 OR x = 30", [1, 9], 3), ("SELECT id FROM t WHERE NOT id < 2", [5, 9], 3), ("SELECT id FROM t WHERE id IN (1, NULL)", [1], 3),
    ):
        assert [r[0] for r in got(engine, text)] == ids and files(engine, text) == n, text
    assert engine.execute("CREATE TABLE p (k STRING PRIMARY KEY, v INT)").ok
    for values in ("('aa', 1), ('ac', 2)", "('b', 3), ('bz', 4)", "('c%', 5), ('d', 6)"):
        assert engine.execute(f"INSERT INTO p VALUES {values}").ok
    for cond, v, n in (("k LIKE 'a%'", [1, 2], 1), ("k LIKE 'b_'", [4], 1), ("startswith(k, 'c')", [5], 1), ("k LIKE 'c\\\\%'", [5], 3), ("k LIKE '%a'", [1], 3), ("k LIKE 'ab%'", [], 1), ("k LIKE 'x%'", [], 0)):
        text = f"SELECT v FROM p WHERE {cond}"
        assert [r[0] for r in got(engine, text)] == v and files(engine, text) == n, text
    assert "PREFIX_SCAN" in engine.explain("SELECT v FROM p WHERE k LIKE 'a%'") and "2 skipped" in engine.explain("SELECT v FROM p WHERE k LIKE 'a%'")
    assert engine.execute("UPDATE p SET v = 0 WHERE k LIKE 'a%'").affected == 2
    assert engine.execute("DELETE FROM p WHERE k >= 'b' AND k < 'c'").affected == 2
    assert [r[0] for r in got(engine, "SELECT v FROM p")] == [0, 0, 5, 6]
