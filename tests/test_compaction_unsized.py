import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratalog.operators import compaction as C

T0 = dt.datetime(2024, 1, 1)
FILES = 120


@pytest.mark.parametrize("counted", [True, False])
def test_files_of_unknown_size_are_spread_by_their_entries(spark, counted):
    # 100 bytes an entry; files of unknown size hold 50 entries each, which the registry may not know
    meta = [(f"s{i}", 2_000, 20, 0, "live", T0) for i in range(20)] + [(f"u{i}", (None, 0, -1)[i % 3], 50 if counted else (None, 0, -1)[i % 3], 0, "live", T0) for i in range(FILES)]
    meta = spark.createDataFrame(meta, "file_path string, file_size bigint, entry_count bigint, sst_level int, state string, registered_at timestamp_ntz")
    index = spark.createDataFrame([], "file_path string, block_offset bigint, block_size bigint")
    entries = spark.range(FILES * 50).select(F.col("id").alias("entry_id"), F.format_string("u%d", F.col("id") % FILES).alias("file_path"))
    small = C.small_files(C.sized_files(meta, index))
    assert small.where("size = 0").count() == FILES  # the defined size stays
    assignment, journal = C.plan_merges(small, target=64_000, below=16_000, entries=None if counted else entries)
    held = {r["output"]: r["count"] * 50 * 100 for r in assignment.where("file_path LIKE 'u%'").groupBy("output").count().collect()}
    assert sum(held.values()) == FILES * 5_000 and max(held.values()) <= 2 * 64_000
    assert journal.agg(F.max("bytes")).first()[0] <= 2 * 64_000
