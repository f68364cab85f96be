import datetime as dt
import random

from stratalog.operators.incremental import FlushLog, next_flush
from stratalog.session import new_path
from stratalog.sources.versioned import Consumer, VersionedTable

from .conftest import rows

T0 = dt.datetime(2024, 1, 1)
LOG = "sequence_number bigint, arrived_at timestamp_ntz, operation int, entry_key string, block int, _file string"
META = "file_path string, min_sequence bigint, max_sequence bigint, sst_level int, creation_time timestamp_ntz, state string, registered_at timestamp_ntz, until string"


def at(n):
    return T0 + dt.timedelta(seconds=n)


def model(log, meta):
    first = {}
    for s, a, op, k, *_ in log:
        if s is not None and k is not None and op in (1, 2):
            first[s] = min(a, first.get(s, a))
    last = {}
    for m in meta:
        if m[0] is not None and (m[0] not in last or m[6] > last[m[0]][6]):
            last[m[0]] = m
    flushes = [(m[1], m[2], m[4]) for m in last.values() if m[3] == 0 and m[5] != "aborted" and None not in (m[1], m[2], m[4])]
    return sorted((s,) for s, a in first.items() if not any(lo <= s <= hi and c >= a for lo, hi, c in flushes))


def test_random_logs_equal_brute_force(spark):
    rng = random.Random(3)
    for spread in (300, 100_000):
        log = [(rng.choice([None, *[rng.randrange(spread) for _ in range(30)]]), at(rng.randrange(500)), rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None]), 1, "x") for _ in range(800)]
        meta = []
        for i in range(60):
            lo = rng.randrange(spread)
            width = rng.choice([0, 3, 50, spread // 2, spread])
            meta.append((f"f{i % 50}", lo, lo + width - rng.choice([0, 0, 5]), rng.choice([0, 0, 0, 1]), at(rng.randrange(300)), rng.choice(["live", "obsolete", "aborted"]), at(i), "u"))
        meta.append((None, 0, spread, 0, at(999), "live", at(1), "u"))
        assert rows(next_flush(spark.createDataFrame(log, LOG), spark.createDataFrame(meta, META))) == sorted(model(log, meta), key=repr)


def test_empty_tables(spark):
    log = spark.createDataFrame([(1, at(0), 1, "a", 1, "x")], LOG)
    meta = spark.createDataFrame([], META)
    assert rows(next_flush(log, meta)) == [(1,)]
    assert rows(next_flush(log.limit(0), meta)) == []


def test_consumer_takes_each_change_once(spark):
    table = VersionedTable(spark, new_path(spark, "vt"))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "x bigint").coalesce(1)
    table.append(frame([1, 2, 3]))
    c = Consumer(table, new_path(spark, "out"))
    assert c.run() == 1
    assert c.run() is None
    first = table.state().files
    where = table.rows(first).where("x = 2").select("_file", "_row")
    table.delete_positions(where)
    table.append(frame([4]))

    def fails(delta):
        raise OSError("lost")

    try:
        c.run(fails)
    except OSError:
        pass
    assert c.processed() == 1  # the failed run left no trace
    assert c.run() == 2
    table.append(frame([9]), remove=list(first))
    assert c.run() == 3
    assert rows(c.output("x bigint, _change int")) == sorted([(1, 1), (2, 1), (3, 1), (2, -1), (4, 1), (1, -1), (3, -1), (9, 1)], key=repr)
    assert rows(table.read()) == [(4,), (9,)]
    assert rows(table.read(1)) == [(1,), (2,), (3,)]


def test_deletion_vectors_add_up_and_large_positions(spark):
    table = VersionedTable(spark, new_path(spark, "vt"))
    table.append(spark.range(100_000).coalesce(1))
    for low in (0, 40_000):
        rows_at = table.rows(table.state().files).where(f"id >= {low} AND id < {low + 33_000}").select("_file", "_row")
        table.delete_positions(rows_at)
    left = table.read()
    assert left.count() == 100_000 - 66_000
    assert left.where("id < 33000 OR (id >= 40000 AND id < 73000)").count() == 0


def test_snapshots_shorten_the_replay(spark, monkeypatch):
    from stratalog.sources import versioned

    monkeypatch.setattr(versioned, "SNAPSHOT_EVERY", 2)
    table = VersionedTable(spark, new_path(spark, "vt"))
    for i in range(5):
        table.append(spark.createDataFrame([(i,)], "x bigint").coalesce(1))
    assert [len(table.state(v).files) for v in range(6)] == [0, 1, 2, 3, 4, 5]
    assert rows(table.changes(1, 4).select("x")) == [(1,), (2,), (3,)]


def test_a_version_touches_only_its_files(spark):
    table = VersionedTable(spark, new_path(spark, "vt"))
    for i in range(5):
        table.append(spark.range(i * 100, i * 100 + 100).coalesce(1))
    one = lambda n: table.delete_positions(table.rows(table.state().files).where(f"id = {n}").select("_file", "_row"))
    one(7)
    one(8)
    one(107)
    a, b = table.state(6), table.state(7)
    added, gone, cut = table.difference(a, b)
    assert (len(added), len(gone), len(cut)) == (0, 0, 1)
    assert rows(table.changes(6, 7)) == [(8, -1)] and rows(table.changes(5)) == [(107, -1), (7, -1), (8, -1)]
    assert len(table.changes(7).inputFiles()) <= 1 + len(table._vectors(table.state().vectors).inputFiles()) * 2
    assert table.read().count() == 497 and table.read(6).count() == 499


def test_runs_that_follow_each_other_equal_one_run(spark):
    rng = random.Random(5)
    for trial in range(2):
        log = [(rng.randrange(200), at(i // 3), rng.choice([1, 2, 3]), "a", 1, "x") for i in range(500)]
        meta = []
        for i in range(30):
            lo = rng.randrange(200)
            meta.append((f"f{i % 20}", lo, lo + rng.randrange(40), 0, at(rng.randrange(150)), rng.choice(["live", "obsolete", "aborted"]), at(i * 5), "u"))
        flush = FlushLog(spark, new_path(spark, "flush"))
        frame = lambda xs: spark.createDataFrame([(i, *x) for i, x in enumerate(xs)], "arrival_no bigint, " + LOG)
        for n, m in ((170, 8), (330, 22), (500, 30)):
            flush.advance(frame(log[:n]), spark.createDataFrame(meta[:m], META), "arrival_no" if trial else None)
            flush.consumer.run(lambda d: d.select("sequence_number", "_change"))
            net = {}
            for s, c in rows(flush.consumer.output("sequence_number bigint, _change int")):
                net[s] = net.get(s, 0) + c
            assert sorted((s,) for s, c in net.items() if c) == model(log[:n], meta[:m]) and set(net.values()) <= {0, 1}
        again = flush.advance(frame(log), spark.createDataFrame(meta, META), "arrival_no" if trial else None)
        assert again == 4 and flush.table.difference(flush.table.state(3), flush.table.state(4))[2] == {}
