"""Test tables in an engine, loaded once per session and folder, with a history that a read has to merge.

Every keyed table is written with wrong values for each seventh key and with keys of its own beyond KEY_SHIFT, compacted into a
base, and then put right by a commit of updates and one of deletions. What the engine reads must equal the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.catalog import ColumnSpec, TableSchema
from stratalog.engine import Engine
from stratalog.session import new_path, table
from stratalog.sources import durable
from stratalog.types import stored_type

KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "lineitem": "l_id"}
KEY_SHIFT = 1_000_000_000_000

_ENGINES: dict[tuple[str, str], Engine] = {}


def source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A test table; lineitem, which has no key, with the number of the row in its file."""
    df = table(spark, d, name)
    return df.withColumn("l_id", F.col("_metadata.row_index")) if name == "lineitem" else df


def schema_of(df: DataFrame, name: str, key: str) -> TableSchema:
    return TableSchema(name, [ColumnSpec(f.name, stored_type(f.dataType)) for f in df.schema], key)


def load(engine: Engine, spark: SparkSession, d: str, name: str) -> None:
    df, key = source(spark, d, name), KEYS[name]
    engine.create_table(schema_of(df, name, key))
    store = engine.store(name)
    k = F.col(key)
    rest = [c for c in df.columns if c != key]
    first = df.select(key, *(F.when(k % 7 != 0, F.col(c)).alias(c) for c in rest))
    extra = df.where(k % 11 == 0).withColumn(key, k + F.lit(KEY_SHIFT).cast(df.schema[key].dataType)) if df.schema[key].dataType.simpleString() == "bigint" else df.limit(0)
    store.put(first.unionByName(extra))
    store.compact(0)
    store.put(df.where(k % 7 == 0))
    store.delete(extra.select(key))


def engine_with(spark: SparkSession, d: str, names: list[str]) -> Engine:
    """The session's engine over a test folder, with at least the named tables in it. For reading only."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _ENGINES or not durable.exists(spark, _ENGINES[at].path):
        _ENGINES[at] = Engine(spark, new_path(spark, "engine"), auto_compact=False)
    engine = _ENGINES[at]
    for name in names:
        if not engine.catalog.exists(name):
            load(engine, spark, d, name)
    return engine


def ask(spark: SparkSession, d: str, text: str) -> DataFrame:
    """Rows of a statement through the engine."""
    words = set(text.lower().replace("(", " ").replace(")", " ").replace(",", " ").split())
    result = engine_with(spark, d, [n for n in KEYS if n in words]).execute(text)
    if result.error:
        raise result.error
    return result.rows
