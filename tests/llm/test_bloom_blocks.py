import numpy as np

from stratalog.llm.bloom import BloomChain, seen_before
from stratalog.session import ship

from ..conftest import rows


def test_keys_of_one_call_are_asked_of_the_chain():
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 62), 1 << 62, 50_000)
    whole, single = BloomChain(0.1, first=64), BloomChain(0.1, first=64)
    rate = whole.seen_then_add(keys).mean()
    alone = np.concatenate([single.seen_then_add(keys[i : i + 1]) for i in range(5_000)])
    assert 0.03 < rate <= 0.11
    assert abs(BloomChain(0.1, first=64).seen_then_add(keys[:5_000]).mean() - alone.mean()) < 0.01


def test_report_of_a_small_input_measures_the_chains(spark):
    ship(spark)
    old = spark.createDataFrame([(f"old{i}",) for i in range(500)], "entry_key string")
    new = spark.createDataFrame([(i, f"old{i}" if i < 100 else f"k{i}") for i in range(4_000)] + [(9_000, "k3999")], "entry_id bigint, entry_key string")
    found, report = seen_before(old, new, "entry_key", "entry_key", "entry_id", error=0.3)
    assert rows(found) == sorted([*((i,) for i in range(100)), (9_000,)], key=repr)
    r = report.first()
    assert r["wrong"] + r["unseen"] == 3_900 and 0.02 < r["measured_error"] <= r["error_bound"]
