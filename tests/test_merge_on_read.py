import random

import pytest
from pyspark.sql import functions as F

from stratalog.catalog import ColumnSpec, TableSchema
from stratalog.engine import Engine
from stratalog.errors import Aborted
from stratalog.session import new_path
from stratalog.sources import store as S
from stratalog.types import parse_type

from .conftest import rows


def make(spark, name="t", key="BIGINT", ordered=False):
    engine = Engine(spark, new_path(spark, "engine"), auto_compact=False)
    engine.create_table(TableSchema(name, [ColumnSpec("k", parse_type(key)), ColumnSpec("v", parse_type("BIGINT"))], ordered=ordered))
    return engine, engine.store(name)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_the_base_is_not_shuffled_or_aggregated(spark, monkeypatch):
    monkeypatch.setattr(S, "FILE_BYTES", 20_000)
    engine, store = make(spark)
    store.put(spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    store.compact(0)
    base = store.files()
    assert len(base) > 2 and sum(f.entries for f in base) == 20_000
    store.put(spark.createDataFrame([(5, -5), (30_000, 1)], "k bigint, v bigint"))
    store.delete(spark.createDataFrame([(7,)], "k bigint"))
    df = store.read()
    assert df.count() == 20_000 and df.where("v = -5").first()[0] == 5 and df.where("k = 7").count() == 0
    _, text = plan(df)
    # three scans: the base behind a broadcast anti join, the newer keys, the newer rows; only the newer ones are shuffled
    assert "BroadcastHashJoin" in text and "LeftAnti" in text and "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning") == 2
    # only the columns that are asked for are read, by the base and by what is merged
    keys_only = plan(df.select("k"))[1]
    assert "ReadSchema" in keys_only and all("v:bigint" not in part.split("\n")[0] for part in keys_only.split("ReadSchema")[1:])
    # a filter on a column goes down to the base's scan
    assert "GreaterThan(v,39990)" in plan(df.where("v > 39990"))[1]
    store.compact(0)
    assert rows(store.read().where("k < 10")) == [(k, -5 if k == 5 else 2 * k) for k in range(10) if k != 7]


@pytest.mark.parametrize("few", [0, 1 << 40])
def test_random_histories_equal_a_dict(spark, monkeypatch, few):
    monkeypatch.setattr(S, "BROADCAST_BYTES", few)
    monkeypatch.setattr(S, "FILE_BYTES", 2_000)
    monkeypatch.setattr(S, "SNAPSHOT_EVERY", 3)
    rng, model = random.Random(few % 97), {}
    engine, store = make(spark, key="STRING")
    for step in range(12):
        keys = {f"k{rng.randrange(300)}" for _ in range(40)}
        if step % 3 == 2:
            store.delete(spark.createDataFrame([(k,) for k in keys], "k string"))
            model = {k: v for k, v in model.items() if k not in keys}
        else:
            store.put(spark.createDataFrame([(k, step) for k in keys], "k string, v bigint"))
            model |= dict.fromkeys(keys, step)
        if step in (3, 7):
            store.compact(0)
        if step == 8:
            store.compact(1)
    assert dict(rows(store.read())) == model
    assert rows(store.prefix("k12")) == sorted((k, v) for k, v in model.items() if k.startswith("k12"))
    S._MANIFESTS.clear()  # another process reads the snapshots
    assert dict(rows(engine.store("t").read())) == model


def test_an_ordered_table_keeps_the_highest_order(spark):
    engine, store = make(spark, ordered=True)
    frame = lambda *xs: spark.createDataFrame(list(xs), "k bigint, v bigint, n bigint")
    put = lambda *xs: store.put(frame(*xs), order=F.col("n"))
    put((1, 10, 5), (2, 20, 5))
    put((1, 11, 4), (2, 21, 6), (3, 30, 1))
    put((1, 12, 5))  # an equal order does not replace
    assert rows(store.read()) == [(1, 10), (2, 21), (3, 30)]
    store.commit(frame((2, 0, 9)), deleted=True, order=F.col("n"))
    store.compact(0)
    put((2, 22, 8), (3, 31, 2))  # late: the deletion still counts after the compaction
    assert rows(store.read()) == [(1, 10), (3, 31)]
    assert engine.execute("INSERT INTO t VALUES (2, 99)").ok  # a plain write is newer than all
    assert rows(store.read()) == [(1, 10), (2, 99), (3, 31)]


def test_a_change_of_an_older_version_is_refused_and_retried(spark, monkeypatch):
    engine, store = make(spark)
    store.put(spark.createDataFrame([(1, 1), (2, 2)], "k bigint, v bigint"))
    old = store.version()
    store.put(spark.createDataFrame([(1, 100)], "k bigint, v bigint"))
    with pytest.raises(Aborted):
        store.commit(spark.createDataFrame([(1, 2)], "k bigint, v bigint"), since=old)
    real, raced = S.TableStore.commit, []

    def overtaken(self, rows, **kw):
        if kw.get("since") is not None and not raced:
            raced.append(1)
            real(self, spark.createDataFrame([(2, 50)], "k bigint, v bigint"))
        return real(self, rows, **kw)

    monkeypatch.setattr(S.TableStore, "commit", overtaken)
    assert engine.execute("UPDATE t SET v = v + 1 WHERE v >= 50").affected == 2  # sees the row that came in between
    assert rows(store.read()) == [(1, 101), (2, 51)]


def test_a_commit_during_a_compaction_stays(spark, monkeypatch):
    engine, store = make(spark)
    for i in range(3):
        store.put(spark.createDataFrame([(1, i), (i + 2, i)], "k bigint, v bigint"))
    real = S.TableStore._measure

    def measured(self, folder, level):
        if level:
            monkeypatch.setattr(S.TableStore, "_measure", real)
            self.put(spark.createDataFrame([(1, 77)], "k bigint, v bigint"))
        return real(self, folder, level)

    monkeypatch.setattr(S.TableStore, "_measure", measured)
    store.compact(0)
    assert rows(store.read()) == [(1, 77), (2, 0), (3, 1), (4, 2)] and len(store.files_at(0)) == 1


def test_pages_follow_each_other(spark):
    _, store = make(spark)
    store.put(spark.range(25).select(F.col("id").alias("k"), F.col("id").alias("v")))
    seen, after, more = [], None, True
    while more:
        page, more, after = store.page(after, 10)
        seen += [r[0] for r in page.collect()]
    assert seen == list(range(25)) and after is None


def test_file_index_equals_a_scan():
    rng = random.Random(1)
    files = []
    for i in range(400):
        low = rng.randrange(10_000)
        files.append(S.FileMeta(f"f{i}", rng.randrange(4), low, low + rng.randrange(300), 0, 0, 1, 0, 1, 0.0))
    files.append(S.FileMeta("open", 0, None, None, 0, 0, 1, 0, 1, 0.0))
    index = S.FileIndex(files)
    for key in range(0, 10_300, 37):
        assert {f.path for f in index.find(key)} == {f.path for f in files if f.may_contain(key)}
    keys = [rng.randrange(-50, 10_400) for _ in range(500)]
    many = {f.path: sorted(keys[i] for i in at) for f, at in index.find_many(keys)}
    assert many == {f.path: hits for f in files if (hits := sorted(k for k in keys if f.may_contain(k)))}
    assert S.FileIndex([]).find_many([1]) == []


def test_footers_read_by_tasks_equal_those_of_the_driver(spark, monkeypatch):
    _, store = make(spark)
    store.put(spark.range(0, 1000, 1, 9).select(F.col("id").alias("k"), F.col("id").alias("v")))
    store.delete(spark.createDataFrame([(3,)], "k bigint"))
    facts = lambda fs: sorted((f.path, f.min_key, f.max_key, f.entries, f.tombstones, f.min_sequence, f.bytes) for f in fs)
    before = facts(store.files())
    monkeypatch.setattr(S, "DRIVER_FOOTERS", 0)
    again = [f for d in {x.path.rsplit("/", 1)[0] for x in store.files()} for f in store._measure(d, 0)]
    assert facts(again) == before and sum(f.tombstones for f in again) == 1
