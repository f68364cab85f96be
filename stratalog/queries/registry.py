"""All core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalog.queries import core, engine_ops, extended, pipeline

QUERIES = {**core.QUERIES, **engine_ops.QUERIES, **extended.QUERIES, **pipeline.QUERIES}
SQL = {**core.SQL, **engine_ops.SQL, **extended.SQL, **pipeline.SQL}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.p2_found(spark, d)
