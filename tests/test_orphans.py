import datetime as dt
import random

import pytest

from stratalog.functions import bitmaps
from stratalog.operators import orphans
from stratalog.operators.orphans import Lives, References, orphan_references
from stratalog.session import ship

from .conftest import rows

REF, LIFE = References("id", "user_id", "ordered_at"), Lives("id", "created_at", "deleted_at", "loaded_at")
ORDERS = "id bigint, user_id bigint, ordered_at timestamp_ntz, key string, period int, code int"
USERS = "id bigint, created_at timestamp_ntz, deleted_at timestamp_ntz, loaded_at timestamp_ntz, shard int"


def day(n):
    return dt.datetime(2023, 11, 1) + dt.timedelta(hours=n)


def model(orders, users):
    last = {}
    for i, c, d, loaded, _ in users:
        if i is not None and c is not None and ((i, c) not in last or loaded > last[i, c][0]):
            last[i, c] = (loaded, d)
    out = set()
    for i, u, t, *_ in orders:
        if u is not None and t is not None and not any(k == u and c <= t and (d is None or d > t) for (k, c), (_, d) in last.items()):
            out.add((i, t.strftime("%Y-%m")))
    return sorted(out, key=repr)


def test_random_tables_equal_brute_force(spark):
    ship(spark)
    rng = random.Random(5)
    users = []
    for n in range(250):
        c = rng.randrange(6000)
        users.append((rng.choice([None, *range(40)]), rng.choice([day(c), day(1460)]), rng.choice([None, day(c + rng.randrange(-50, 3000))]), day(n), 1))
    orders = [(n % 700, rng.choice([None, -1, 2147483647, 7, 7, 7, *range(45)]), rng.choice([day(rng.randrange(9000)), day(1464)]), "k", 1, 2) for n in range(700)]
    orders += orders[:100]
    got = orphan_references(spark.createDataFrame(orders, ORDERS), spark.createDataFrame(users, USERS), REF, LIFE, shards=3)
    assert rows(got) == model(orders, users)


def test_empty_tables(spark):
    ship(spark)
    orders = [(1, 5, day(0), "k", 1, 2), (2, None, day(0), "k", 1, 2)]
    o, u = spark.createDataFrame(orders, ORDERS), spark.createDataFrame([], USERS)
    assert rows(orphan_references(o, u, REF, LIFE)) == [(1, "2023-11")]
    assert rows(orphan_references(o.limit(0), u, REF, LIFE)) == []


def test_bitmaps_round_trip_and_compress():
    rng = random.Random(1)
    sets = [[], [0], [65535, 65536], range(100_000), [x * 3 for x in range(30_000)], [rng.randrange(1 << 32) for _ in range(3000)], [*range(10), 4_000_000_000]]
    for s in sets:
        data = bitmaps.encode(list(s))
        assert bitmaps.decode(data).tolist() == sorted(set(s))
    assert len(bitmaps.encode(range(100_000))) < 40
    minus = lambda a, b: bitmaps.decode(bitmaps.and_not(a and bitmaps.encode(list(a)), b and bitmaps.encode(list(b)))).tolist()
    for a in sets:
        for b in [*sets, [x * 3 + 1 for x in range(30_000)], range(5_000, 80_000)]:
            assert minus(a, b) == sorted(set(a) - set(b))
    assert bitmaps.and_not(None, bitmaps.encode([1])) == b"" and bitmaps.and_not(bitmaps.encode([1]), bitmaps.encode([1])) == b""


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_half_of_all_references_on_one_key_and_long_lives(spark, monkeypatch, few):
    ship(spark)
    monkeypatch.setattr(orphans, "BROADCAST_ROWS", few)
    rng = random.Random(few % 7)
    when = lambda: dt.datetime(2010, 1, 1) + dt.timedelta(days=rng.randrange(6500), hours=rng.randrange(24))
    users = []
    for n in range(120):
        c = when()
        # the hot key 3 has many lives that begin and end inside months
        users.append((rng.choice([3, *range(30)]), c, rng.choice([None, c + dt.timedelta(days=rng.choice([1, 40, 3000]))]) if n % 2 else c + dt.timedelta(days=3), c, 1))
    users += [(0, dt.datetime(2000, 1, 1), None, dt.datetime(2000, 1, 1), 1), (1, dt.datetime(2010, 3, 1), dt.datetime(2024, 7, 1), dt.datetime(2000, 1, 1), 1)]
    orders = [(n, -1 if n % 4 == 0 else 3 if n % 4 == 1 else rng.randrange(40), when(), "k", 1, 2) for n in range(600)]
    got = orphan_references(spark.createDataFrame(orders, ORDERS), spark.createDataFrame(users, USERS), REF, LIFE)
    assert rows(got) == model(orders, users)


def test_marks_are_one_row_a_key_and_window(spark):
    refs = spark.createDataFrame([(5, orphans_month(2024, m)) for m in (1, 1, 2)] + [(6, orphans_month(2024, 3))], "key bigint, period int")
    lives = spark.createDataFrame([(5, dt.datetime(1990, 1, 2), None), (5, dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 9))], "key bigint, start timestamp_ntz, end timestamp_ntz")
    marks = orphans.month_masks(refs, lives, orphans_month(2020, 1), orphans_month(2024, 3))
    assert marks.where("key = 5").count() == len({orphans_month(y, m) // 64 for y in range(2020, 2025) for m in range(1, 13) if (y, m) <= (2024, 3)}) and marks.where("key = 6").count() == 1


def orphans_month(year, month):
    return year * 12 + month - 1
