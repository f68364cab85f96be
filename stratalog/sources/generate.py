"""Synthetic sales rows for demonstrations and load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGIONS = ["coast", "delta", "forest", "highland", "island", "plain", "valley"]
CATEGORIES = ["bikes", "boats", "books", "garden", "kitchen", "lamps", "music", "paper", "tools", "toys"]
STATUSES = ["new", "paid", "packed", "sent", "arrived", "sent back"]


def transactions(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """(id, region, category, amount, units, status), made in parallel; the same seed and partitions give the same rows."""

    def pick(values: list[str], n: int):
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.rand(seed + n) * len(values)) + 1).cast("int"))

    return spark.range(rows).select(
        (F.col("id") + 1).alias("id"), pick(REGIONS, 1).alias("region"), pick(CATEGORIES, 2).alias("category"), F.round(F.rand(seed + 3) * 4990 + 10, 2).alias("amount"), (F.floor(F.rand(seed + 4) * 100) + 1).cast("int").alias("units"), pick(STATUSES, 5).alias("status")
    )
