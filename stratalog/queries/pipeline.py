"""Queries of the general data-pipeline operators, each over its whole tables, with SQL to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import changefeed, compaction, incremental, orphans
from stratalog.session import new_path, table

WAL_FEED = changefeed.Feed(key="entry_key", sequence="sequence_number", operation="operation", arrival="arrival_no", values=["entry_value"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Live keys after the whole change log, with the sequence that set each."""
    state = changefeed.replay(table(spark, d, "wal_entry"), WAL_FEED)
    return state.live().select(F.col("key").alias("entry_key"), F.col("sequence").alias("sequence_number"))


def p2_current_values(spark: SparkSession, d: str) -> DataFrame:
    state = changefeed.replay(table(spark, d, "wal_entry"), WAL_FEED)
    return state.live().select(F.col("key").alias("entry_key"), "entry_value")


def p2_in_parts(spark: SparkSession, d: str) -> DataFrame:
    """The log applied in three parts, the last part of the time first: the state must not depend on it."""
    log = table(spark, d, "wal_entry")
    third, two = log.agg(F.expr("percentile_approx(arrival_no, array(0.33, 0.97), 1000)").alias("n")).first()["n"]
    out = changefeed.BucketedTable(spark, new_path(spark, "changefeed"))
    at = F.col("arrival_no")
    for part in (at > two, at <= third, (at > third) & (at <= two)):
        out.apply(log.where(part), WAL_FEED)
    return out.live().select(F.col("key").alias("entry_key"), F.col("sequence").alias("sequence_number"), "entry_value")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(
        table(spark, d, "user_orders"), table(spark, d, "users"), orphans.References("id", "user_id", "ordered_at"), orphans.Lives("id", "created_at", "deleted_at", "loaded_at")
    ).withColumnRenamed("period", "order_month")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p4_per_month(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("order_month").agg(F.count("*").alias("orphans"))


def _compacted(spark: SparkSession, d: str) -> compaction.Compactor:
    return compaction.compact(table(spark, d, "sstable_meta"), table(spark, d, "index_entry"), table(spark, d, "sstable_entry"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that the committed merges took."""
    return _compacted(spark, d).retired()


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return _compacted(spark, d).records().select("entry_key", "sequence_number")


def p5_journal(spark: SparkSession, d: str) -> DataFrame:
    """What the merges took and made, in sums that SQL can check: files taken, their bytes where known, and transactions that occur twice."""
    done = _compacted(spark, d)
    sizes = compaction.sized_files(table(spark, d, "sstable_meta"), table(spark, d, "index_entry")).select("file_path", "size")
    taken = done.retired().join(sizes, "file_path").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    log = done.journal().agg((F.count("*") - F.count_distinct("txn")).alias("repeated_merges"))
    return taken.crossJoin(log)  # one row each


def p5_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Two runs: one over the registrations of the first half of the time, one over all; every record of the files taken lies in one output once."""
    meta, index, entries = (table(spark, d, n) for n in ("sstable_meta", "index_entry", "sstable_entry"))
    half = meta.agg(F.expr("percentile_approx(registered_at, 0.5, 1000)").alias("t")).first()["t"]
    done = compaction.Compactor(spark, new_path(spark, "compaction"))
    # only what was registered last counts, so a file that changes later takes no part in the first run
    late = meta.where(F.col("registered_at") > F.lit(half)).select("file_path").distinct()
    done.run(meta.join(late, "file_path", "left_anti"), index, entries)
    done.run(meta, index, entries)
    again = done.run(meta, index, entries)  # a third run finds nothing left to do
    return done.records().select("entry_key", "sequence_number", F.lit(again is None).alias("settled"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.next_flush(table(spark, d, "wal_entry"), table(spark, d, "sstable_meta"))


def p6_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs with a failed one between: the first over the older half of the log and of the registrations, the second over all. What was taken and not since flushed by others is what one run over all takes."""
    log, meta = table(spark, d, "wal_entry"), table(spark, d, "sstable_meta")
    half = log.agg(F.expr("percentile_approx(arrival_no, 0.5, 1000)").alias("n")).first()["n"]
    then = log.where(F.col("arrival_no") <= half).agg(F.max("arrived_at").alias("t")).first()["t"]
    flush = incremental.FlushLog(spark, new_path(spark, "flush-log"))
    keep = lambda delta: delta.select("sequence_number", "_change")

    def fails(delta: DataFrame) -> DataFrame:
        raise OSError("the flush was lost")

    flush.advance(log.where(F.col("arrival_no") <= half), meta.where(F.col("registered_at") <= F.lit(then)), "arrival_no")
    try:
        flush.consumer.run(fails)
    except OSError:
        pass
    flush.consumer.run(keep)
    flush.advance(log, meta, "arrival_no")
    flush.consumer.run(keep)
    net = flush.consumer.output("sequence_number bigint, _change int").groupBy("sequence_number").agg(F.sum("_change").alias("n"))
    return net.where("n = 1").select("sequence_number")


QUERIES = {f.__name__: f for f in (p2_found, p2_current_values, p2_in_parts, p4_found, p4_per_month, p5_found, p5_records, p5_journal, p5_incremental, p6_found, p6_two_runs)}

_WAL = """
valid AS (SELECT * FROM wal_entry WHERE sequence_number IS NOT NULL AND entry_key IS NOT NULL AND operation IN (1, 2)),
first_of AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sequence_number ORDER BY arrival_no) AS r FROM valid) WHERE r = 1),
top_of AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_key ORDER BY sequence_number DESC) AS q FROM first_of) WHERE q = 1)"""
_ORPHANS = """
life AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, created_at ORDER BY loaded_at DESC) AS r FROM users) WHERE r = 1),
found AS (SELECT DISTINCT o.id, strftime(o.ordered_at, '%Y-%m') AS order_month FROM user_orders o WHERE o.user_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM life l WHERE l.id = o.user_id AND l.created_at <= o.ordered_at AND (l.deleted_at IS NULL OR l.deleted_at > o.ordered_at)))"""
_META = """counted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY registered_at DESC) AS r FROM sstable_meta) WHERE r = 1)"""
_SMALL = f"""{_META},
ends AS (SELECT file_path, max(block_offset + block_size) AS e FROM index_entry GROUP BY file_path),
small AS (SELECT c.file_path FROM counted c LEFT JOIN ends USING (file_path) WHERE state = 'live' AND CASE WHEN file_size > 0 THEN file_size ELSE coalesce(e, 0) END < 65536)"""

_UNFLUSHED = f"""WITH {_WAL}, {_META},
arrived AS (SELECT sequence_number, min(arrived_at) AS first_arrival FROM valid GROUP BY sequence_number)
SELECT sequence_number FROM arrived a WHERE NOT EXISTS (SELECT 1 FROM counted c WHERE c.sst_level = 0 AND c.state <> 'aborted'
  AND c.min_sequence <= a.sequence_number AND a.sequence_number <= c.max_sequence AND c.creation_time >= a.first_arrival)"""

SQL = {
    "p2_found": f"WITH {_WAL} SELECT entry_key, sequence_number FROM top_of WHERE operation = 1",
    "p2_current_values": f"WITH {_WAL} SELECT entry_key, entry_value FROM top_of WHERE operation = 1",
    "p2_in_parts": f"WITH {_WAL} SELECT entry_key, sequence_number, entry_value FROM top_of WHERE operation = 1",
    "p4_found": f"WITH {_ORPHANS} SELECT id, order_month FROM found",
    "p4_per_month": f"WITH {_ORPHANS} SELECT order_month, count(*) AS orphans FROM found GROUP BY order_month",
    "p5_found": f"WITH {_SMALL} SELECT file_path FROM small",
    "p5_records": f"WITH {_SMALL} SELECT DISTINCT entry_key, sequence_number FROM sstable_entry WHERE file_path IN (SELECT file_path FROM small)",
    "p5_journal": f"""WITH {_SMALL}, all_sizes AS (SELECT c.file_path, CASE WHEN file_size > 0 THEN file_size ELSE coalesce(e, 0) END AS size FROM counted c LEFT JOIN ends USING (file_path))
SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS repeated_merges FROM small JOIN all_sizes USING (file_path)""",
    "p5_incremental": f"WITH {_SMALL} SELECT DISTINCT entry_key, sequence_number, TRUE AS settled FROM sstable_entry WHERE file_path IN (SELECT file_path FROM small)",
    "p6_found": _UNFLUSHED,
    "p6_two_runs": _UNFLUSHED,
}
