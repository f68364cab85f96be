import random
import time

import pytest
from pyspark.sql import functions as F

from stratalog.catalog import ColumnSpec, TableSchema, decode_key, encode_key, table_prefix
from stratalog.engine import Engine
from stratalog.errors import InvalidArgument
from stratalog.functions import columnar, rows as R
from stratalog.session import new_path
from stratalog.sources import generate
from stratalog.sources.wal import DELETE, INSERT, GroupCommit, Log
from stratalog.streaming import ingest
from stratalog.types import parse_type

from .conftest import rows


def numbered(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"pos bigint, v {kind}").repartition(3)


def test_statistics(spark):
    df = numbered(spark, [*range(0, 1000, 10), None], "bigint")
    assert rows(columnar.column_stats(df, "v")) == [(101, 1, 100, 0, 990)]
    zones = columnar.zone_map(df, F.floor(F.col("pos") / 10), "v")
    assert {r["row_group"] for r in zones.where(columnar.may_contain(250, 300)).collect()} == {2, 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_run_lengths_round_trip(spark, seed):
    rng = random.Random(seed)
    values = [v for _ in range(60) for v in [rng.choice(["a", "b", None])] * rng.randrange(1, 20)]
    runs = columnar.rle_encode(numbered(spark, values), "pos", "v")
    got = sorted(tuple(r) for r in runs.collect())
    assert [v for _, v, n in got for _ in range(n)] == values
    assert [g[0] for g in got] == list(range(1, len(got) + 1))
    assert all(a[1] != b[1] for a, b in zip(got, got[1:], strict=False))
    assert columnar.rle_decode(runs).count() == len(values)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_runs_across_borders(spark, parts):
    nan = float("nan")
    values = [nan, nan, None, None] + [1.0] * 50 + [nan] * 30 + [2.0, 1.0]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        runs = columnar.rle_encode(numbered(spark, values, "double"), "pos", "v").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = [(r["run_id"], str(r["val"]), r["run_len"]) for r in sorted(runs, key=lambda r: r["run_id"])]
    assert got == [(1, "nan", 2), (2, "None", 2), (3, "1.0", 50), (4, "nan", 30), (5, "2.0", 1), (6, "1.0", 1)]


def test_a_long_run_is_given_out_in_chunks(spark):
    runs = spark.createDataFrame([(1, "a", 10_000), (2, None, 3), (3, "z", 0)], "run_id bigint, val string, run_len bigint")
    got = columnar.rle_decode(runs)
    assert got.groupBy("run_id").agg(F.count("*"), F.min("offset"), F.max("offset"), F.count_distinct("offset")).orderBy("run_id").collect() == [(1, 10_000, 0, 9_999, 10_000), (2, 3, 0, 2, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_and_packed_bits_come_back(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([None, rng.randrange(-50, 50), rng.randrange(1 << 40)]) if n % 7 else rng.randrange(10) for n in range(300)]
    values += [5] * 20 + [None] * 20 + [-(1 << 63), (1 << 63) - 1]
    df = numbered(spark, values, "bigint")
    small = [v if v is None or abs(v) < 1 << 45 else 0 for v in values]
    back = columnar.delta_decode(columnar.delta_encode(numbered(spark, small, "bigint"), "pos", "v"), "pos")
    assert [r["val"] for r in back.orderBy("pos").collect()] == small
    back = columnar.bit_unpack(columnar.bit_pack(df, "pos", "v")).orderBy("part", "block", "pos").collect()
    assert [r["val"] for r in back] == values
    blocks = columnar.bit_pack(spark.range(20_000).withColumn("v", F.col("id") % 16), "id", "v")
    assert blocks.where("n = 4096").select("width", F.length("packed")).distinct().collect() == [(4, 2048)]
    assert columnar.bit_unpack(blocks).count() == 20_000


def test_aggregates_from_block_statistics(spark):
    df = numbered(spark, [*range(0, 1000, 10), None], "bigint")
    blocks = columnar.block_stats(df, F.floor(F.col("pos") / 7), "v")
    assert rows(columnar.from_blocks(blocks)) == [(100, 49_500, 495.0, 0, 990)]


def test_dictionary_and_delta(spark):
    df = numbered(spark, ["red", "blue", "red", None, "green", "blue", "red"])
    codes = columnar.dictionary(df, "pos", "v")
    assert rows(codes) == [("blue", 1), ("green", 2), ("red", 0)]
    back = columnar.dictionary_decode(columnar.dictionary_encode(df, codes, "v"), codes)
    assert [r["val"] for r in back.orderBy("pos").collect()] == ["red", "blue", "red", "", "green", "blue", "red"]
    numbers = [5, 9, 9, 2]
    delta = columnar.delta_encode(numbered(spark, numbers, "bigint"), "pos", "v").orderBy("pos").collect()
    assert [r["base"] for r in delta] == [5, None, None, None] and [r["delta"] for r in delta] == [None, 4, 0, -7]
    for values, bits in (([0], 1), ([1], 1), ([7, 8], 4), ([1 << 40], 41)):
        assert numbered(spark, values, "bigint").agg(columnar.bit_width(F.col("v")).alias("b")).first()[0] == bits


def test_empty_columns(spark):
    df = numbered(spark, ["x"]).limit(0)
    assert columnar.rle_encode(df, "pos", "v").count() == 0
    assert columnar.dictionary(df, "pos", "v").count() == 0
    assert rows(columnar.column_stats(df, "v")) == [(0, 0, 0, None, None)]


def test_row_codec_and_checks(spark):
    schema = TableSchema("t", [ColumnSpec("id", parse_type("BIGINT"), False), ColumnSpec("name", parse_type("STRING")), ColumnSpec("ok", parse_type("BOOL"))])
    df = spark.createDataFrame([(1, "a", None), (2, None, True), (3, "", False)], schema.struct())
    blobs = df.select(R.encode_row(df.columns).alias("b"))
    assert rows(blobs.select(R.decode_row(F.col("b"), schema.struct()).alias("r")).select("r.*")) == rows(df)
    assert blobs.select(R.column_value(F.col("b"), "name")).first()[0] == "a"
    assert spark.range(1).select(R.decode_row(F.lit('{"id":1}'), schema.struct()).alias("r")).first()[0] == (1, None, None)
    t = spark.createDataFrame([("12",), ("1.5",), ("abc",), (None,), ("TRUE",)], "x string")
    check = lambda k: [r[0] for r in t.select(R.is_valid(F.col("x"), parse_type(k))).collect()]
    assert check("INT") == [True, False, False, True, False]
    assert check("BOOL") == [False, False, False, True, True] and all(check("TEXT"))
    assert [r[0] for r in t.select(R.is_numeric(F.col("x"))).collect()] == [True, True, False, False, False]
    assert t.select(R.with_default(F.col("x"), parse_type("TEXT"))).collect()[3][0] == ""
    with pytest.raises(InvalidArgument):
        R.conform(df.withColumnRenamed("ok", "what"), schema)
    key = encode_key("T", F.lit(5))
    assert spark.range(1).select(key, decode_key("t", key), decode_key("u", key)).first() == ("t:5", "5", None)
    assert table_prefix("T") == "t:"


def test_log(spark):
    log = Log(spark, new_path(spark, "wal"))
    assert log.max_sequence() == -1
    kind = "sequence bigint, ts bigint, operation int, key string, value string"
    log.append(spark.createDataFrame([(i, 0, INSERT if i % 2 else DELETE, f"key_{i}", None if i == 4 else f"v{i}") for i in range(10)], kind).repartition(3))
    assert [r["sequence"] for r in log.recover().collect()] == list(range(10)) and log.max_sequence() == 9
    damaged = spark.createDataFrame([(50, 0, 1, "k", "v", 123)], kind + ", crc bigint")
    damaged.write.mode("append").parquet(f"{log.path}/entries/{log._appends()[0][1]}")
    assert log.max_sequence() == 9
    assert log.truncate(5) == 0
    assert [r["sequence"] for r in log.recover().collect()] == [6, 7, 8, 9]
    log.append(spark.createDataFrame([(20, 0, INSERT, "k", "v")], kind))
    assert log.truncate(9) == 1 and [r["sequence"] for r in log.recover().collect()] == [20] and len(log._appends()) == 1
    assert log.checkpoint() == 20 and log.recover().count() == 0 and log._appends() == []
    log.append(spark.createDataFrame([], kind))
    assert log._appends() == []


def test_group_commit(spark):
    for mode, commits in (("IMMEDIATE", 5), ("BATCHED", 2), ("TIMED", None)):
        log = Log(spark, new_path(spark, "wal"))
        group = GroupCommit(log, mode, entries=3, millis=10_000)
        for i in range(5):
            group.add(i, INSERT, f"k{i}", "v")
        if mode == "TIMED":
            group.add(5, INSERT, "k5", "v")
            group.millis = 50
            group.flush()
            group.add(6, INSERT, "k6", "v")  # appended by the timer
            for _ in range(100):
                if group.stats["commits"] == 2:
                    break
                time.sleep(0.1)
            assert group.stats == {"commits": 2, "entries": 7, "bytes": 21, "largest": 6} and log.recover().count() == 7
            continue
        group.flush()
        assert group.stats["entries"] == 5 and log.recover().count() == 5
        assert group.stats["commits"] == (commits or 1)
    with pytest.raises(InvalidArgument):
        GroupCommit(log, "NEVER")


def test_stream_batches_are_taken_once(spark):
    engine = Engine(spark, new_path(spark, "engine"), auto_compact=False)
    engine.create_table(TableSchema("s", [ColumnSpec("k", parse_type("BIGINT")), ColumnSpec("v", parse_type("STRING"), False)]))
    source, mark = new_path(spark, "in"), new_path(spark, "mark")
    kind = "k bigint, v string, gone boolean"
    spark.createDataFrame([(1, "a", False), (2, "b", None), (None, "x", False)], kind).write.parquet(source)
    start = lambda m: ingest.upsert_stream(engine, "s", ingest.file_stream(spark, source, kind), "in", m, deleted="gone").awaitTermination()
    start(mark)
    assert rows(engine.table("s")) == [(1, "a"), (2, "b")]
    spark.createDataFrame([(1, None, True), (3, "c", False)], kind).write.mode("append").parquet(source)
    start(mark)
    assert rows(engine.table("s")) == [(2, "b"), (3, "c")]
    version = engine.store("s").version()
    start(new_path(spark, "mark"))  # a lost checkpoint runs batch 0 again: the manifest has it already
    assert engine.store("s").version() == version


def test_generator_repeats(spark):
    a, b = generate.transactions(spark, 500), generate.transactions(spark, 500)
    assert rows(a) == rows(b) and a.count() == 500 and a.where("region IS NULL OR amount < 10 OR amount > 5000 OR units < 1 OR units > 100").count() == 0


def test_windows_of_a_stream_drop_what_is_too_late(spark):
    source, mark = new_path(spark, "events"), new_path(spark, "mark")
    kind = "ts timestamp_ntz, k string, v bigint"
    for batch in ([("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:50:00", "a", 2)], [("2024-01-01 05:00:00", "a", 4)], [("2024-01-01 00:20:00", "a", 8), ("2024-01-01 05:30:00", "b", 16)], [("2024-01-01 09:00:00", "a", 32)]):
        spark.createDataFrame(batch, "t string, k string, v bigint").selectExpr("CAST(t AS TIMESTAMP_NTZ) AS ts", "k", "v").coalesce(1).write.mode("append").parquet(source)
        stream = ingest.file_stream(spark, source, kind, 1)
        query = ingest.windowed_totals(stream, "ts", "1 hour", "1 hour", ["k"], "v").writeStream.outputMode("append").format("parquet").option("path", f"{source}-out").option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r["window_start"].hour, r["k"], r["n"], r["total"]) for r in spark.read.parquet(f"{source}-out").collect())
    assert got == [(0, "a", 2, 3), (5, "a", 1, 4), (5, "b", 1, 16)]


def test_small_writes_through_the_log(spark):
    path = new_path(spark, "engine")
    engine = Engine(spark, path)
    engine.create_table(TableSchema("w", [ColumnSpec("k", parse_type("BIGINT")), ColumnSpec("v", parse_type("STRING")), ColumnSpec("x", parse_type("DOUBLE"))]))
    t = engine.buffered("w", entries=2)
    for k in (1, 2, 3):
        t.put(k=k, v=f"v{k}", x=k / 2)
    t.delete(2)
    assert rows(engine.table("w")) == []  # logged, not yet in the table
    assert engine.flush() == {"w": 3} and rows(engine.table("w")) == [(1, "v1", 0.5), (3, "v3", 1.5)]
    t.put(k=1, v="late", x=None)
    t.put(k=4, v=None, x=2.0)
    again = Engine(spark, path)  # the process died before its flush
    assert again.buffered("w").recovered == 2 and rows(again.table("w")) == [(1, "late", None), (3, "v3", 1.5), (4, None, 2.0)]
    assert again.buffered("w").put(k=9, v="n", x=1.0) == 6


def test_a_flush_that_failed_before_its_truncation_takes_nothing_twice(spark, monkeypatch):
    engine = Engine(spark, new_path(spark, "engine"), auto_compact=False)
    engine.create_table(TableSchema("w", [ColumnSpec("k", parse_type("BIGINT")), ColumnSpec("v", parse_type("STRING"))]))
    t = engine.buffered("w")
    t.put(k=1, v="a")
    with monkeypatch.context() as m:
        m.setattr(Log, "truncate", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.flush()
    version = engine.store("w").version()
    assert t.flush() == 0 and engine.store("w").version() == version and rows(engine.table("w")) == [(1, "a")]


def test_a_stream_in_any_order_keeps_the_highest(spark):
    engine = Engine(spark, new_path(spark, "engine"), auto_compact=False)
    engine.create_table(TableSchema("s", [ColumnSpec("k", parse_type("BIGINT")), ColumnSpec("v", parse_type("STRING"))], ordered=True))
    rng, events = random.Random(4), [(n, n % 7, f"v{n}", n % 11 == 0) for n in range(60)]
    want = {}
    for n, k, v, gone in events:
        want[k] = None if gone else v
    rng.shuffle(events)
    source, kind = new_path(spark, "in"), "n bigint, k bigint, v string, gone boolean"
    for i in range(0, 60, 20):
        spark.createDataFrame([*events[i : i + 20], (None, 1, "x", False)], kind).write.mode("append").parquet(source)
    stream = ingest.file_stream(spark, source, kind, 1)
    ingest.upsert_stream(engine, "s", stream, "in", new_path(spark, "mark"), deleted="gone", order="n").awaitTermination()
    assert rows(engine.table("s")) == sorted((k, v) for k, v in want.items() if v is not None)
    older = new_path(spark, "older")
    spark.createDataFrame([(-1, 1, "old", False)], kind).write.parquet(older)
    ingest.upsert_stream(engine, "s", ingest.file_stream(spark, older, kind), "other", new_path(spark, "mark"), deleted="gone", order="n").awaitTermination()
    assert rows(engine.table("s")) == sorted((k, v) for k, v in want.items() if v is not None)
