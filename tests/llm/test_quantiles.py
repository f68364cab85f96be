import datetime as dt

import numpy as np
import pytest

from stratalog.llm import quantiles as Q
from stratalog.session import ship

POINTS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def error(values, q, found):
    values = np.sort(values)
    return max(0.0, np.searchsorted(values, found, "left") / values.size - q, q - np.searchsorted(values, found, "right") / values.size)


@pytest.mark.parametrize("kind", ["sorted", "reversed", "random", "ties", "heavy"])
def test_rank_error_of_merged_sketches(kind):
    rng = np.random.default_rng(4)
    x = {"sorted": np.arange(200_000.0), "reversed": np.arange(200_000.0)[::-1], "random": rng.normal(size=200_000), "ties": rng.integers(0, 5, 200_000).astype(float), "heavy": rng.pareto(0.3, 200_000)}[kind]
    parts = []
    for i, piece in enumerate(np.array_split(x, 17)):
        s = Q.Sketch(seed=i)
        s.update(piece)
        parts.append(s.to_bytes())
    s = Q.Sketch.from_bytes(Q.merge_sketches(parts))
    assert s.n == x.size == sum(level.size << i for i, level in enumerate(s.levels))
    assert (s.low, s.high) == (x.min(), x.max()) and sum(level.size for level in s.levels) < 4 * Q.K
    assert max(error(x, q, v) for q, v in zip(POINTS.values(), s.quantiles(list(POINTS.values())), strict=True)) <= Q.rank_error()
    assert s.quantiles([0, 1]) == [x.min(), x.max()]


def test_small_groups_are_exact():
    s = Q.Sketch()
    s.update(np.array([3.0, 1.0, 2.0]))
    assert s.quantiles([0.01, 0.5, 0.99]) == [1.0, 2.0, 3.0]
    assert Q.Sketch.from_bytes(s.to_bytes()).quantiles([0.5]) == [2.0]


def test_days_combine_and_dirt_is_left_out(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    data, want = [], {}
    for i in range(6000):
        g = (None, "c") if i % 3 == 0 else ("r", None) if i % 50 == 1 else ("r", "c")
        v = float(rng.normal())
        data.append((i, *g, v, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i % 200), 1.0, "x"))
        want.setdefault(g, []).append(v)
    data += [(10_000 + i, "r", "c", v, dt.datetime(2024, 1, 1), 1.0, "x") for i, v in enumerate([None, float("nan"), float("inf"), float("-inf")])]
    data += [(20_000, "only", "dirt", None, dt.datetime(2024, 1, 1), 1.0, "x")]
    data += data[:500]
    df = spark.createDataFrame(data, "id bigint, region string, category string, amount double, at timestamp_ntz, value double, day string").repartition(6)
    days = Q.daily_sketches(df, "amount", ["region", "category"], "at", "id")
    assert days.select("day").distinct().count() == 9
    got = {(r["region"], r["category"]): r for r in Q.read_quantiles(Q.combine(days, ["region", "category"]), ["region", "category"], POINTS).collect()}
    assert set(got) == set(want)
    for g, values in want.items():
        assert got[g]["n"] == len(values) and got[g]["lowest"] == min(values) and got[g]["highest"] == max(values)
        assert max(error(values, q, got[g][n]) for n, q in POINTS.items()) <= Q.rank_error()


def test_empty_table(spark):
    ship(spark)
    df = spark.createDataFrame([], "id bigint, region string, amount double, at timestamp_ntz")
    assert Q.read_quantiles(Q.combine(Q.daily_sketches(df, "amount", ["region"], "at", "id"), ["region"]), ["region"], POINTS).count() == 0


def test_groups_beyond_the_budget_go_on_in_parts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from stratalog.llm import quantiles as Q
    from stratalog.session import ship

    ship(spark)
    rows_in = spark.range(0, 4000, 1, 2).select((F.col("id") % 50).alias("g"), F.col("id").cast("double").alias("v"))
    whole = {r["g"]: (r["n"], r["lowest"], r["highest"]) for r in Q.read_quantiles(Q.sketch_groups(rows_in, "v", {"g": F.col("g")}), ["g"], {"m": 0.5}).collect()}
    monkeypatch.setattr(Q, "MOST_GROUPS", 3)
    monkeypatch.setattr(Q, "TAKE_ROWS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    try:
        run = Q._sketch_split(["g"], 400)
        parts = rows_in.select("v", "g").withColumnRenamed("v", "value").mapInArrow(run, "g bigint, n bigint, sketch binary").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(parts) > 100 and sum(r["n"] for r in parts) == 4000
    assert whole == {g: (80, float(g), float(3950 + g)) for g in range(50)}
