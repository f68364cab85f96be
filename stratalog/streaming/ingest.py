"""Streaming writes into a table: each micro-batch is one commit, taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.engine import Engine
from stratalog.functions.rows import conform
from stratalog.operators import merge

#: Group commit of the log as triggers: at once, by size of a batch, or by time.
TRIGGERS = {"IMMEDIATE": {"processingTime": "0 seconds"}, "BATCHED": {"availableNow": True}, "TIMED": {"processingTime": "10 seconds"}}


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, kind: str = "parquet") -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def upsert_stream(engine: Engine, table: str, stream: DataFrame, name: str, checkpoint: str, deleted: str | None = None, mode: str = "BATCHED", order: str | None = None) -> StreamingQuery:
    """Start writing a stream into a table. ``deleted`` names a boolean column whose true rows are tombstones.

    ``order`` names the column by which changes of a key follow each other, in an ordered table: whatever order they arrive in, inside a
    batch, across batches or across streams, the highest stays. Without it the last batch wins, and of a batch any row of a key.

    The batch number is saved in the table's manifest with the rows, so a batch that runs again after a failure changes nothing.
    """
    schema = engine.catalog.get(table)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(schema.primary_key).isNotNull())
        flag = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        keep, skip = [merge.DELETED], [deleted] if deleted else []
        rows = rows.withColumn(merge.DELETED, flag)
        if order:
            rows = rows.where(F.col(order).isNotNull()).withColumn("_order", F.col(order).cast("bigint"))
            keep.append("_order")
            skip += [order] if order.lower() not in {c.name.lower() for c in schema.columns} else []
        typed = conform(rows, schema, skip=skip, keep=keep, unchecked=merge.DELETED)
        engine.store(table).commit(typed, stream=(name, number), order=F.col("_order") if order else None)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**TRIGGERS[mode]).start()


def windowed_totals(events: DataFrame, time: str, width: str, lateness: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of event-time windows; rows later than ``lateness`` behind the newest are left out."""
    at = F.col(time).cast("timestamp")
    marked = events.withColumn("_at", at).withWatermark("_at", lateness)
    return marked.groupBy(F.window("_at", width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")
