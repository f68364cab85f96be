import random

import numpy as np

from stratalog.llm.bloom import BloomChain, seen_before
from stratalog.session import ship

from ..conftest import rows

OLD = "entry_key string, h bigint, kind int"
NEW = "entry_id bigint, entry_key string, n bigint, seen boolean"


def model(old, new):
    known = {k for k, *_ in old if k is not None}
    out, first = set(), {}
    for i, k, *_ in new:
        if k is not None and i is not None:
            first[k] = min(i, first.get(k, i))
    for i, k, *_ in new:
        if k is not None and i is not None and (k in known or i > first[k]):
            out.add((i,))
    return sorted(out, key=repr)


def test_chain_never_misses_and_keeps_its_bound():
    rng = np.random.default_rng(1)
    chain = BloomChain(0.01, first=64)
    keys = rng.integers(-(1 << 62), 1 << 62, 60_000)
    for part in np.split(keys, 20):
        chain.seen_then_add(part)
    assert chain.seen_then_add(keys).all()
    assert len(chain.layers) > 5 and chain.layers[-1].capacity == 64 * 2 ** (len(chain.layers) - 1)
    fresh = rng.integers(-(1 << 62), 1 << 62, 20_000)
    assert chain.bound() <= 0.01 and _asks(chain, fresh).mean() <= 0.015


def _asks(chain, hashes):
    from stratalog.llm.bloom import _mix

    a = _mix(hashes.astype(np.int64).view(np.uint64))
    b = _mix(a ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.zeros(hashes.size, bool)
    for layer in chain.layers:
        out |= layer.has(a, b)
    return out


def test_repeats_inside_one_call():
    chain = BloomChain()
    assert chain.seen_then_add(np.array([5, 5, 7, 5])).tolist() == [False, True, False, True]
    assert chain.seen_then_add(np.array([7, 8])).tolist() == [True, False]


def test_random_records_equal_brute_force(spark):
    ship(spark)
    rng = random.Random(2)
    keys = [None, "", "hot", *[f"k{i}" for i in range(300)], "K1", "k1 ", "é", "é"]
    old = [(rng.choice(keys[3:]), 1, 1) for _ in range(150)] + [(None, 1, 1)]
    new = [(i, "hot" if i % 3 == 0 else rng.choice(keys), 9, True) for i in range(900)] + [(None, "k1", 1, True)]
    new += new[:200]
    rng.shuffle(new)
    # a poor error rate: what is wrong must be found by the exact check
    for error in (0.01, 0.9):
        found, report = seen_before(spark.createDataFrame(old, OLD).repartition(3), spark.createDataFrame(new, NEW).repartition(4), "entry_key", "entry_key", "entry_id", error)
        assert rows(found) == model(old, new)
        r = report.first()
        assert r["answered_seen"] - r["wrong"] == len(model(old, new))


def test_empty_tables(spark):
    ship(spark)
    old, new = spark.createDataFrame([("a", 1, 1)], OLD), spark.createDataFrame([(1, "a", 1, True), (2, "b", 1, True)], NEW)
    run = lambda a, b: rows(seen_before(a, b, "entry_key", "entry_key", "entry_id")[0])
    assert run(old, new) == [(1,)] and run(old.limit(0), new) == [] and run(old, new.limit(0)) == []
