import random

import pytest

from stratalog.errors import InvalidArgument
from stratalog.operators import changefeed
from stratalog.operators.changefeed import BucketedTable, Feed, replay
from stratalog.session import new_path, ship

from .conftest import rows

FEED = Feed("k", "s", "op", "n", ["v"])
KIND = "n bigint, s bigint, op int, k string, v string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def model(changes):
    """Plain Python: first arrival of a sequence counts, then the highest sequence of a key."""
    first = {}
    for n, s, op, k, v in sorted(changes, key=lambda c: c[0]):
        if s is not None and k is not None and op in (1, 2):
            first.setdefault(s, (s, op, k, v))
    top = {}
    for s, op, k, v in first.values():
        if k not in top or s > top[k][0]:
            top[k] = (s, op, v)
    return sorted(((k, s, v) for k, (s, op, v) in top.items() if op == 1), key=repr)


def test_random_feeds_equal_a_dict(spark):
    rng = random.Random(7)
    changes = []
    for n in range(1500):
        s = rng.choice([None, *range(1, 900)])
        k = None if s is None or rng.random() < 0.02 else ("hot" if s % 3 == 0 else f"k{s % 41}")
        changes.append((n, s, rng.choice([1, 1, 1, 2, 3, None]), k, rng.choice([None, "", "x" * 5000, f"v{n}"])))
    got = replay(spark.createDataFrame(changes, KIND).repartition(5), FEED).live()
    assert rows(got.select("key", "sequence", "v")) == model(changes)


def test_batches_in_any_order_give_the_same_table(spark):
    changes = [(i, (i * 37) % 200, 1 if i % 5 else 2, f"k{(i * 37) % 200 % 20}", f"v{i}") for i in range(200)]
    whole = rows(replay(spark.createDataFrame(changes, KIND), FEED).live())
    t = BucketedTable(spark, new_path(spark, "cf"))
    for part in (changes[120:], changes[:60], changes[60:120], changes[:60]):
        t.apply(spark.createDataFrame(part, KIND), FEED, 3)
    assert rows(t.live()) == whole
    assert len(t.versions()) == 4
    assert t.vacuum() == 0


def test_tombstone_stops_a_late_older_insert(spark):
    t = BucketedTable(spark, new_path(spark, "cf"))
    t.apply(spark.createDataFrame([(1, 10, 2, "a", None)], KIND), FEED, 2)
    t.apply(spark.createDataFrame([(2, 5, 1, "a", "late")], KIND), FEED)
    assert rows(t.live()) == []
    t.apply(spark.createDataFrame([(3, 11, 1, "a", "new")], KIND), FEED)
    assert rows(t.live()) == [("a", 11, "new")]


def test_empty_feed_and_extra_columns(spark):
    assert rows(replay(spark.createDataFrame([], KIND), FEED).live()) == []
    df = spark.createDataFrame([(1, 1, 1, "", "e", "x", True, 3)], "n bigint, s bigint, op int, k string, v string, b string, d boolean, bucket int")
    assert rows(replay(df, FEED).live()) == [("", 1, "e")]


def test_unreferenced_files_are_removed(spark):
    t = BucketedTable(spark, new_path(spark, "cf"))
    t.apply(spark.createDataFrame([(1, 1, 1, "a", "x")], KIND), FEED, 1)
    spark.createDataFrame([(1,)], "x int").coalesce(1).write.parquet(f"{t.path}/data/tmp")
    name = next(f for f in t.manifest()["files"].values())[0]["file"]
    import shutil

    plain = name.removeprefix("file://")
    shutil.copy(plain, plain.replace("bucket-00000", "bucket-99999"))
    assert t.vacuum() == 1
    assert rows(t.live()) == [("a", 1, "x")]


def test_small_runs_add_deltas_and_buckets_grow(spark, monkeypatch):
    rng = random.Random(9)
    # sequences belong to one key each; arrival is the order of the runs
    changes = [(n, s, rng.choice([1, 1, 2]), f"k{s % 450}", f"v{n}") for n, s in enumerate(rng.sample(range(3_000), 3_000))]
    t = BucketedTable(spark, new_path(spark, "cf"))
    t.apply(spark.createDataFrame(changes[:2_000], KIND), FEED, 2)
    first = t.manifest()
    assert all(len(f) == 1 for f in first["files"].values()) and len(first["files"]) == 2
    t.apply(spark.createDataFrame(changes[2_000:2_010], KIND), FEED)
    t.apply(spark.createDataFrame(changes[2_010:2_015], KIND), FEED)
    second = t.manifest()
    assert {f[0]["file"] for f in second["files"].values()} == {f[0]["file"] for f in first["files"].values()}  # the old files stay
    assert max(len(f) for f in second["files"].values()) == 3
    assert rows(t.live()) == model(changes[:2_015])
    monkeypatch.setattr(changefeed, "ROWS_PER_BUCKET", 60)
    t.apply(spark.createDataFrame(changes[2_015:2_020], KIND), FEED)
    third = t.manifest()
    assert third["buckets"] == 8 and len(third["files"]) == 8 and all(len(f) == 1 for f in third["files"].values())
    assert sum(f[0]["keys"] for f in third["files"].values()) == len({c[3] for c in changes[:2_020]})
    assert rows(t.live()) == model(changes[:2_020])
    t.apply(spark.createDataFrame(changes[2_020:], KIND), FEED)
    assert rows(t.live()) == model(changes)


def test_values_keep_their_types(spark):
    import datetime as dt
    from decimal import Decimal

    kind = "n bigint, s bigint, op int, k binary, a binary, b double, c boolean, d timestamp_ntz, e date, f decimal(12,3), g int, h timestamp"
    feed = Feed("k", "s", "op", "n", ["a", "b", "c", "d", "e", "f", "g", "h"])
    row = (bytearray(b"\x00\xff"), 1.5, True, dt.datetime(2024, 1, 2, 3, 4, 5, 6), dt.date(2024, 1, 2), Decimal("1.250"), 7, dt.datetime(2024, 5, 6, 7, 8, 9))
    t = BucketedTable(spark, new_path(spark, "cf"))
    t.apply(spark.createDataFrame([(1, 1, 1, bytearray(b"k\xff"), *row), (2, 1, 1, bytearray(b"k"), *[None] * 8)], kind), feed, 1)
    t.apply(spark.createDataFrame([(3, 2, 1, bytearray(b"z"), *row)], kind), feed)
    got = {bytes(r["key"]): tuple(r)[2:] for r in t.live().collect()}
    assert got == {b"k\xff": row, b"k": (None,) * 8, b"z": row}
    assert [f.dataType.simpleString() for f in t.live().schema][2:] == ["binary", "double", "boolean", "timestamp_ntz", "date", "decimal(12,3)", "int", "timestamp"]
    with pytest.raises(InvalidArgument):
        t.apply(spark.createDataFrame([(1, 1, 1, "a", "x")], KIND), FEED)


def test_a_split_passes_on_what_it_reduced_when_it_is_full(spark, monkeypatch):
    monkeypatch.setattr(changefeed, "SPLIT_BYTES", 2_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        changes = [(n, n, 1, f"k{n % 30}", f"v{n}") for n in range(1_000)]
        assert rows(replay(spark.createDataFrame(changes, KIND).coalesce(1), FEED).live()) == model(changes)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
