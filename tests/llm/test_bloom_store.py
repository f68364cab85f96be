from pyspark.sql import functions as F

from stratalog.llm import bloom
from stratalog.session import new_path, ship

from ..conftest import rows


def test_chain_comes_back_from_its_bytes():
    import numpy as np

    keys = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 9_000)
    chain = bloom.BloomChain(0.02, first=64)
    chain.seen_then_add(keys[:5_000])
    again = bloom.BloomChain.from_bytes(chain.to_bytes())
    assert again.bound() == chain.bound() and again.expected() == chain.expected()
    assert (again.seen_then_add(keys) == chain.seen_then_add(keys)).all() and len(again.layers) == len(chain.layers)


def test_the_next_run_goes_on_from_the_kept_chains(spark):
    ship(spark)
    frame = lambda a, b: spark.range(a, b).select((F.col("id") * 10).alias("entry_id"), F.concat(F.lit("k"), F.col("id") % 700).alias("entry_key"))
    store = bloom.ChainStore(spark, new_path(spark, "chains"))
    old = spark.createDataFrame([("k5",), ("x",)], "entry_key string")
    run = lambda h, r, e=None: rows(bloom.seen_before(h, r, "entry_key", "entry_key", "entry_id", error=0.3, store=store, earlier=e)[0])
    assert run(old, frame(0, 500)) == [(50,)]
    earlier = old.select(F.col("entry_key").alias("k")).unionByName(frame(0, 500).select(F.col("entry_key").alias("k")))
    assert [r[0] for r in run(None, frame(500, 1_500), earlier)] == sorted((10 * i for i in range(700, 1_500)), key=lambda x: repr((x,)))
    m = store.manifest()
    assert m["version"] == 2 and len(m["files"]) == m["shards"]


def test_what_a_collision_called_seen_is_taken_back(spark):
    keys = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("c", 4), ("c", -(1 << 63))], "k string, n bigint")
    # as if the hash of b were that of a: its first record was called certainly seen
    answers = keys.where("n > 0 AND k <> 'a' OR n = 3").select("n", F.xxhash64("k").alias("h"), F.lit(True).alias("seen"), F.lit(True).alias("certain"))
    assert rows(bloom.wrongly_seen(answers, keys)) == [(2,)]


def test_only_keys_that_were_called_seen_are_compared(spark, monkeypatch):
    keys = spark.range(1000).select(F.col("id").cast("string").alias("k"), "id").withColumnRenamed("id", "n")
    answers = keys.where("n = 7").select("n", F.xxhash64("k").alias("h"), F.lit(True).alias("seen"))
    for few in (0, 10):
        monkeypatch.setattr(bloom, "CHECK_BROADCAST", few)
        assert rows(bloom.wrongly_seen(answers, keys)) == [(7,)]
