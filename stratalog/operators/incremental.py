"""Take from a log exactly the changes that no completed flush has taken.

The log becomes an immutable versioned table (one row per sequence number with its first arrival). What completed flushes
took is published as deletion vectors on its files. The consumer then diffs the manifest of the version it has processed
against the latest one - added files, removed files, deletion vectors - and commits its output together with the
processed version, so a failed run skips nothing and a repeated one takes nothing twice.

Log and consumer live in a folder and are opened again by the next run, which appends only numbers it does not hold, applies to old
rows only the flushes that are new, and brings back the numbers of a flush that turned out to have failed. All of it is one version.

A flush is a range of sequence numbers and a moment: it took a number of its range if that had arrived by then. Ranges are
cut into pieces of BLOCK numbers (the inside of a wide range into dyadic nodes, so a range of any width gives few rows) and
joined on the block; the pieces of a block are reduced to distinct ranges, so a block never holds more than BLOCK * (BLOCK + 1) / 2.

Defined results: rows without sequence or key or with an unknown operation are void. A sequence delivered more than once
counts from its first arrival. A file registered more than once counts by its latest registration (of equal times the
greatest row); a range with a null end takes nothing. Empty log or no flushes: nothing or everything is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.session import new_path, settle
from stratalog.sources.versioned import Consumer, VersionedTable

BLOCK_BITS = 8
BLOCK = 1 << BLOCK_BITS
#: Levels of dyadic nodes above the blocks; sequence numbers are below 2^(BLOCK_BITS + LEVELS).
LEVELS = 54


#: What is read of a registration; other columns play no part.
REGISTRATION = ["min_key", "max_key", "min_sequence", "max_sequence", "file_size", "entry_count", "sst_level", "creation_time", "state"]


def counting_registrations(meta: DataFrame) -> DataFrame:
    """One row per file: its latest registration. Registrations without a path are void."""
    rest = [c for c in REGISTRATION if c in meta.columns]
    best = meta.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.max(F.struct("registered_at", *rest)).alias("_r"))
    return best.select("file_path", "_r.*")


def valid_changes(log: DataFrame) -> DataFrame:
    return log.where(F.col("sequence_number").isNotNull() & F.col("entry_key").isNotNull() & F.col("operation").isin(1, 2))


def _dyadic(flushes: DataFrame) -> DataFrame:
    """(level, node, until): the blocks lying wholly inside each range, as the nodes of a binary tree over the blocks."""
    a, b = F.col("lo_block") + 1, F.col("hi_block") - 1
    wide = flushes.where(F.col("hi_block") - F.col("lo_block") >= 2).select(a.alias("a"), b.alias("b"), "until")
    depth = F.least(F.lit(LEVELS), F.ceil(F.log2(F.col("b") - F.col("a") + 2)).cast("int"))
    at = wide.withColumn("level", F.explode(F.sequence(F.lit(0), depth)))
    left = F.expr("shiftright(a + shiftleft(1L, level) - 1, level)")
    right = F.expr("shiftright(b + 1, level) - 1")
    node: Column = F.when(left % 2 != 0, F.array(left)).otherwise(F.array().cast("array<bigint>"))
    other: Column = F.when(right % 2 == 0, F.array(right)).otherwise(F.array().cast("array<bigint>"))
    nodes = at.where(left <= right).select("level", F.explode(F.concat(node, other)).alias("node"), "until")
    return nodes.groupBy("level", "node").agg(F.max("until").alias("until"))


def flushed_pieces(flushes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, lo, hi, until): for each block what ranges took of it and until which arrival."""
    cut = flushes.where("min_sequence <= max_sequence").withColumns({"lo_block": F.expr(f"shiftright(min_sequence, {BLOCK_BITS})"), "hi_block": F.expr(f"shiftright(max_sequence, {BLOCK_BITS})")})
    ends = cut.select(F.explode(F.array_distinct(F.array("lo_block", "hi_block"))).alias("block"), "min_sequence", "max_sequence", "until").select(
        "block",
        F.greatest("min_sequence", F.expr(f"shiftleft(block, {BLOCK_BITS})")).alias("lo"),
        F.least("max_sequence", F.expr(f"shiftleft(block + 1, {BLOCK_BITS}) - 1")).alias("hi"),
        "until",
    )
    inside = (
        blocks.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
        .withColumn("node", F.expr("shiftright(block, level)"))
        .join(_dyadic(cut), ["level", "node"])
        .select("block", F.expr(f"shiftleft(block, {BLOCK_BITS})").alias("lo"), F.expr(f"shiftleft(block + 1, {BLOCK_BITS}) - 1").alias("hi"), "until")
    )
    return ends.unionByName(inside).groupBy("block", "lo", "hi").agg(F.max("until").alias("until"))


def completed_flushes(meta: DataFrame) -> DataFrame:
    """(min_sequence, max_sequence, until) of the level-0 files whose counting registration is not aborted."""
    counting = counting_registrations(meta).where("sst_level = 0 AND coalesce(state, '') <> 'aborted'")
    return counting.select("min_sequence", "max_sequence", F.col("creation_time").alias("until")).where("min_sequence <= max_sequence AND until IS NOT NULL").distinct()


def covered(rows: DataFrame, flushes: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows that a flush took (or, by ``how``, those that none took)."""
    pieces = flushed_pieces(flushes, rows.select("block").distinct()).withColumnRenamed("block", "_b")
    return rows.join(pieces, (F.col("block") == F.col("_b")) & F.col("sequence_number").between(F.col("lo"), F.col("hi")) & (F.col("until") >= F.col("first_arrival")), how)


class FlushLog:
    """The log as a versioned table in a folder, and the consumer of the next flush."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = VersionedTable(spark, f"{self.path}/log")
        self.consumer = Consumer(self.table, f"{self.path}/flush")

    def advance(self, log: DataFrame, meta: DataFrame, arrival: str | None = None) -> int | None:
        """Publish what is new in log and registry as one version; None if nothing is.

        ``arrival`` names a column that grows with the log: rows up to the highest value of an earlier run are not read again.
        """
        state, flushes = self.table.state(), completed_flushes(meta)
        notes = {}
        if arrival:
            high = state.notes.get("arrival")
            log = log if high is None else log.where(F.col(arrival) > high)
            top = log.agg(F.max(arrival)).first()[0]
            notes["arrival"] = high if top is None else top
        new = valid_changes(log).groupBy("sequence_number").agg(F.min("arrived_at").alias("first_arrival")).withColumn("block", F.expr(f"shiftright(sequence_number, {BLOCK_BITS})"))
        applied = f"{self.path}/flushes/{uuid.uuid4().hex}"
        flushes.write.parquet(applied)
        flushes = self.spark.read.schema(flushes.schema).parquet(applied)
        notes["flushes"] = applied
        columns = ["sequence_number", "first_arrival", "block"]
        taken = None
        if state.files:
            rows = self.table.marked(state)
            new = new.join(rows.select("sequence_number"), "sequence_number", "left_anti")
            before = self.spark.read.schema(flushes.schema).parquet(state.notes["flushes"])
            on = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in flushes.columns]
            added = settle(flushes.alias("n").join(before.alias("o"), on, "left_anti"), "flushes-added")
            withdrawn = settle(before.alias("n").join(flushes.alias("o"), on, "left_anti"), "flushes-withdrawn")
            if not withdrawn.isEmpty():
                # numbers that only a withdrawn flush had taken come back as new rows
                dead = rows.groupBy(*columns).agg(F.min("_deleted").alias("_deleted")).where("_deleted").drop("_deleted")
                new = new.select(*columns).unionByName(covered(covered(dead, withdrawn), flushes, "left_anti").select(*columns))
            if not added.isEmpty():
                taken = covered(rows.where("NOT _deleted"), added).select("_file", "_row")
        files = self.table.write(new.select(*columns))
        if files:
            fresh = covered(self.table.rows(files), flushes).select("_file", "_row")
            taken = fresh if taken is None else taken.unionByName(fresh)
        vectors = self.table.write_vectors(taken, state) if taken is not None else {}
        return self.table.publish({"add": files, "vectors": vectors, "notes": notes}, since=state.version)


def next_flush(log: DataFrame, meta: DataFrame, path: str | None = None, arrival: str | None = None) -> DataFrame:
    """Sequence numbers the next flush must take, read from its commit."""
    flush = FlushLog(log.sparkSession, path or new_path(log.sparkSession, "flush-log"))
    flush.advance(log, meta, arrival)
    flush.consumer.run(lambda delta: delta.where("_change = 1").select("sequence_number"))
    return flush.consumer.output("sequence_number bigint")
