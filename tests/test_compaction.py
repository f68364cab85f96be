import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratalog.operators import compaction as C
from stratalog.session import new_path

from .conftest import rows

META = "file_path string, file_size bigint, sst_level int, state string, registered_at timestamp_ntz, _end int, size string"
INDEX = "index_id bigint, file_path string, block_offset bigint, block_size bigint"
ENTRY = "entry_id bigint, file_path string, entry_key string, sequence_number bigint, is_deleted boolean, entry_value string, output string"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    meta = [(f"f{i}", 1000 + i * 300, 0, "live", T0, 1, "x") for i in range(200)]
    meta += [("f0", 9_000_000, 0, "live", T0 - dt.timedelta(1), 1, "x"), ("f1", 5, 0, "obsolete", T0 + dt.timedelta(1), 1, "x")]
    meta += [("unsized", None, 0, "live", T0, 1, "x"), ("negative", -1, 0, "live", T0, 1, "x"), ("large", 65536, 0, "live", T0, 1, "x"), ("dead", 10, 0, "aborted", T0, 1, "x"), (None, 10, 0, "live", T0, 1, "x")]
    meta += meta[:50]
    index = [(1, "unsized", 60_000, 10_000), (1, "unsized", 60_000, 10_000), (2, "negative", 5, 10), (3, None, 1, 1)]
    entries = [(n, f"f{n % 200}", None if n % 50 == 0 else f"k{n % 90}", n // 2, n % 7 == 0, "v" * (n % 5), "x") for n in range(2000)] + [(9000, "large", "z", 1, False, "", "x")]
    entries += entries[:300]
    return spark.createDataFrame(meta, META), spark.createDataFrame(index, INDEX), spark.createDataFrame(entries, ENTRY)


def test_small_files(tables):
    meta, index, _ = tables
    small = {r[0] for r in C.small_files(C.sized_files(meta, index)).select("file_path").collect()}
    assert small == {f"f{i}" for i in range(200) if i != 1} | {"negative"}


def test_every_small_file_gets_one_output_of_good_size(tables):
    meta, index, _ = tables
    small = C.small_files(C.sized_files(meta, index))
    assignment, journal = C.plan_merges(small, target=1 << 20)
    got = assignment.collect()
    assert len(got) == 200 and len({r["file_path"] for r in got}) == 200
    sizes = assignment.join(small.select("file_path", "size"), "file_path").groupBy("output").agg(F.sum("size").alias("b")).collect()
    total = sum(r["b"] for r in sizes)
    assert len(sizes) <= -(-total // (1 << 20)) + 1
    merges = journal.collect()
    assert {m["tier"] for m in merges} <= set(range(len(C.tiers(C.SMALL_BYTES, 1 << 20))))
    assert all(len(m["inputs"]) >= 1 for m in merges)
    again, _ = C.plan_merges(small, target=1 << 20)
    assert rows(again) == rows(assignment)


def test_records_once_and_runs_are_idempotent(spark, tables):
    meta, index, entries = tables
    path = new_path(spark, "compaction")
    done = C.compact(meta, index, entries, path)
    want = {(e["entry_key"], e["sequence_number"]) for e in entries.where("file_path <> 'f1' AND file_path <> 'large'").collect()}
    records = lambda c: [(r["entry_key"], r["sequence_number"]) for r in c.records().collect()]
    assert len(records(done)) == len(want) and set(records(done)) == want
    before = done.commits()
    again = C.compact(meta, index, entries, path)
    assert again.commits() == before and len(before) == 1 and len(records(again)) == len(want)
    assert {r[0] for r in done.retired().collect()} == {f"f{i}" for i in range(200) if i != 1} | {"negative"}
    # one file per output, as large as the registry says
    outputs = done.outputs().collect()
    assert before[0]["files"] == len([o for o in outputs if o["entry_count"]]) and sum(o["entry_count"] for o in outputs) == len(want)


def test_a_second_run_moves_only_what_is_new(spark, tables):
    meta, index, entries = tables
    path = new_path(spark, "compaction")
    frame = lambda ids, base: spark.createDataFrame([(base + n, f"n{n}", f"k{n}", n if n != 1 else 0, False, "v", "x") for n in ids] + [(base + 90, "n2", "k5", 5 // 2, False, "other", "x")], ENTRY)
    done = C.Compactor(spark, path)
    monkey = C.SMALL_BYTES
    assert done.run(meta, index, entries, below=monkey)["inputs"] == 200
    first = {r["file_path"] for r in done.outputs().where("size >= 65536").collect()}
    more = meta.unionByName(spark.createDataFrame([(f"n{i}", 500, 0, "live", T0, 1, "x") for i in range(3)], META))
    held = entries.unionByName(frame(range(3), 50_000))
    small = done.outputs().where("size < 65536").count()
    commit = done.run(more, index, held)
    assert commit["inputs"] == 3 + small
    want = {(e["entry_key"], e["sequence_number"]) for e in held.where("file_path <> 'f1' AND file_path <> 'large'").collect()}
    got = [(r["entry_key"], r["sequence_number"]) for r in done.records().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert first <= {r["file_path"] for r in done.outputs().collect()}
    assert done.run(more, index, held) is None and len(done.commits()) == 2
    txns = [r["txn"] for r in done.journal().collect()]
    assert len(txns) == len(set(txns))


def test_a_run_that_fails_leaves_no_trace(spark, tables, monkeypatch):
    meta, index, entries = tables
    done = C.Compactor(spark, new_path(spark, "compaction"))
    real = C.durable.put_if_absent
    monkeypatch.setattr(C.durable, "put_if_absent", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        done.run(meta, index, entries)
    assert done.commits() == [] and done.records().count() == 0
    monkeypatch.setattr(C.durable, "put_if_absent", real)
    assert done.run(meta, index, entries)["inputs"] == 200


def test_empty_tables(spark, tables):
    meta, index, entries = tables
    done = C.compact(meta.limit(0), index.limit(0), entries.limit(0))
    assert done.records().count() == 0 and done.journal().count() == 0 and done.retired().count() == 0
    held = C.compact(meta, index, entries.limit(0))
    assert held.records().count() == 0 and held.retired().count() == 200


def test_many_shards(tables):
    meta, index, _ = tables
    small = C.small_files(C.sized_files(meta, index))
    assignment, _ = C.plan_merges(small, shards=7)
    assert assignment.select("file_path").distinct().count() == 200
    assert assignment.select("output").distinct().count() <= 8
