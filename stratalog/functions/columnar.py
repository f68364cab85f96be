"""Column statistics, zone maps and encodings as DataFrame expressions.

Encodings keep an order column. Those that need the order of all rows run it by key (``by``) or, without a key, in two levels:
the rows are range-partitioned by the order (which costs nothing where they are already), every partition works on its own part, and only the totals of the partitions
(one row each) meet in one task, so no task sees the whole input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_stats(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """total, nulls, distinct and the extremes of a column in one pass (distinct approximate if asked: one fewer shuffle)."""
    c = F.col(column)
    distinct = F.approx_count_distinct(c) if approximate else F.count_distinct(c)
    return df.agg(F.count("*").alias("total"), (F.count("*") - F.count(c)).alias("nulls"), distinct.alias("distinct_values"), F.min(c).alias("min_value"), F.max(c).alias("max_value"))


def zone_map(df: DataFrame, group: Column, column: str) -> DataFrame:
    """Extremes and nulls of a column per row group."""
    c = F.col(column)
    return df.groupBy(group.alias("row_group")).agg(F.count("*").alias("total"), (F.count("*") - F.count(c)).alias("nulls"), F.min(c).alias("min_value"), F.max(c).alias("max_value"))


def block_stats(df: DataFrame, group: Column, column: str) -> DataFrame:
    """The statistics of each block of a numeric column, from which aggregates come without its values."""
    c = F.col(column)
    exact = F.sum(c) if dict(df.dtypes)[column] not in ("double", "float") else F.sum(c.cast("double"))
    return df.groupBy(group.alias("block")).agg(F.count("*").alias("total"), (F.count("*") - F.count(c)).alias("nulls"), F.min(c).alias("min_value"), F.max(c).alias("max_value"), exact.alias("sum_value"))


def from_blocks(blocks: DataFrame) -> DataFrame:
    """count, sum, avg, min and max of a column from its blocks' statistics alone; nulls don't count."""
    known = F.sum(F.col("total") - F.col("nulls"))
    return blocks.agg(known.alias("count_value"), F.sum("sum_value").alias("sum_value"), (F.sum("sum_value") / known).alias("avg_value"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def may_contain(low, high) -> Column:
    """Does a zone [min_value, max_value] overlap [low, high]?"""
    return (F.col("min_value") <= F.lit(high)) & (F.col("max_value") >= F.lit(low))


def _parts(df: DataFrame, order: str) -> DataFrame:
    """Rows with the number of their range partition, which follows the order; fixed by a write so that it can't change."""
    from stratalog.session import settle

    return settle(df.orderBy(order).withColumn("_part", F.spark_partition_id()), "ordered")


def _before(df: DataFrame, order: str, value: Column) -> DataFrame:
    """Adds _prev (the value of the row before) and _first (is there none?), across partition borders."""
    own = Window.partitionBy("_part").orderBy(order)
    rows = df.withColumns({"_prev": F.lag(F.struct(value.alias("v"))).over(own)})
    tails = df.groupBy("_part").agg(F.max_by(F.struct(value.alias("v")), F.col(order)).alias("_tail"))
    tails = tails.select("_part", F.lag("_tail").over(Window.orderBy("_part")).alias("_tail"))  # one row per partition
    return rows.join(F.broadcast(tails), "_part").withColumn("_prev", F.coalesce("_prev", "_tail")).drop("_tail")


def _local_runs(column: str):
    """Runs of one sorted partition, found by Arrow's run-end encoding a batch at a time."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, None  # held: the last run, which the next batch may continue
        for b in batches:
            if not b.num_rows:
                continue
            encoded = pc.run_end_encode(b.column(column))
            values, ends = encoded.values, np.asarray(encoded.run_ends).astype(np.int64)
            if pa.types.is_floating(values.type):  # NaN equals NaN here as it does in Spark
                nan = np.asarray(pc.fill_null(pc.is_nan(values), False))
                last_of = np.append(~(nan[:-1] & nan[1:]), True)
                values, ends = values.filter(pa.array(last_of)), ends[last_of]
            lengths = np.diff(ends, prepend=0)
            if held is not None:
                if _same(values[0].as_py(), held[0].as_py()):
                    lengths[0] += held[1]
                else:
                    yield _run_batch(part, number, held[0], held[1], column, b)
                    number += 1
            held = (values[-1], int(lengths[-1]))
            n = len(values) - 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(number, number + n)), values.slice(0, n), pa.array(lengths[:n])], ["_part", "_n", "val", "run_len"])
                number += n
            last = b
        if held is not None:
            yield _run_batch(part, number, held[0], held[1], column, last)

    return run


def _run_batch(part: int, number: int, value, length: int, column: str, like):
    import pyarrow as pa

    kind = like.schema.field(column).type
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([value.as_py()], kind), pa.array([length], pa.int64())], ["_part", "_n", "val", "run_len"])


def _same(a, b) -> bool:
    """Equal, or both null, or both NaN."""
    return a == b if a == a and b == b else a != a and b != b


#: Rows that one generated row of a run expands to at most.
RUN_CHUNK = 4096


def rle_encode(df: DataFrame, order: str, column: str) -> DataFrame:
    """Runs of equal values in order: run_id from 1, val, run_len. Nulls make runs too.

    Each range partition finds its own runs in one pass. Runs that cross a border are joined by the first and last runs of the
    partitions (one row each, on the driver); the runs themselves are numbered where they lie.
    """
    from stratalog.session import settle, ship

    spark = df.sparkSession
    ship(spark)
    rows = df.select(order, F.col(column)).orderBy(order).select(column)
    kind = df.schema[column].dataType.simpleString()
    runs = settle(rows.mapInArrow(_local_runs(column), f"_part int, _n bigint, val {kind}, run_len bigint"), "runs")
    ends = runs.groupBy("_part").agg(F.count("*").alias("k"), F.min_by(F.struct("val", "run_len"), "_n").alias("head"), F.max_by(F.struct("val"), "_n").alias("tail")).orderBy("_part").collect()
    places, at, tail, owner = [], 0, None, None
    for e in ends:
        joins = tail is not None and _same(e["head"]["val"], tail["val"])
        # the run numbered k - 1 of the owner goes on in this partition
        if joins:
            places[owner]["extra"] += e["head"]["run_len"]
        places.append({"_part": e["_part"], "off": at - int(joins), "from": int(joins), "last": e["k"] - 1, "extra": 0})
        if not joins or e["k"] > 1:
            owner = len(places) - 1
        at, tail = at + e["k"] - int(joins), e["tail"]
    borders = spark.createDataFrame([(p["_part"], p["off"], p["from"], p["last"], p["extra"]) for p in places], "_part int, _off bigint, _from bigint, _last bigint, _extra bigint")
    placed = runs.join(F.broadcast(borders), "_part").where("_n >= _from")
    length = F.col("run_len") + F.when(F.col("_n") == F.col("_last"), F.col("_extra")).otherwise(0)
    return placed.select((F.col("_off") + F.col("_n") + 1).alias("run_id"), "val", length.alias("run_len"))


def rle_decode(runs: DataFrame) -> DataFrame:
    """(run_id, offset, val): the rows of the runs. A run of any length is given out in chunks."""
    chunks = runs.where("run_len > 0").select("run_id", "val", "run_len", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("run_len") - 1, F.lit(RUN_CHUNK).cast("bigint"))).alias("_at"))
    return chunks.select("run_id", F.explode(F.sequence("_at", F.least(F.col("_at") + RUN_CHUNK, F.col("run_len")) - 1)).alias("offset"), "val")


def dictionary(df: DataFrame, order: str, column: str) -> DataFrame:
    """Code of each distinct value by first appearance. Values are reduced first; the numbering is over distinct values only."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("val")).agg(F.min(order).alias("_at"))
    rows = _parts(firsts, "_at").withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_at", "val")))
    totals = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))
    return rows.join(F.broadcast(offsets), "_part").select("val", (F.col("_rank") + F.col("_off") - 1).cast("bigint").alias("code"))


def dictionary_size(codes: DataFrame) -> DataFrame:
    """entries: how many values a dictionary holds."""
    return codes.agg(F.count("*").alias("entries"))


def dictionary_encode(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    return df.join(codes.withColumnRenamed("val", column), column, "left").drop(column)


def dictionary_decode(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Values of codes; an unknown code gives the empty string."""
    return df.join(codes, "code", "left").withColumn("val", F.coalesce("val", F.lit("")))


def delta_encode(df: DataFrame, order: str, column: str) -> DataFrame:
    """Difference to the row before; a row without a value before it (the first, or one after a null) keeps its value as ``base``."""
    rows = _before(_parts(df.select(order, column), order), order, F.col(column))
    return rows.select(order, F.when(F.col("_prev.v").isNull(), F.col(column)).alias("base"), (F.col(column) - F.col("_prev.v")).alias("delta"))


def delta_decode(encoded: DataFrame, order: str) -> DataFrame:
    """(order, val): running sums of the deltas from each base on, nulls where both are null.

    Sums are made inside range partitions; what a partition hands to the next is one number a partition.
    """
    rows = _parts(encoded.select(order, "base", "delta"), order)
    own = Window.partitionBy("_part").orderBy(order)
    rows = rows.withColumn("_seg", F.sum(F.col("base").isNotNull().cast("bigint")).over(own))
    step = F.coalesce("base", "delta")
    rows = rows.withColumn("_sum", F.sum(step).over(Window.partitionBy("_part", "_seg").orderBy(order)))
    last = rows.groupBy("_part").agg(F.max_by(F.struct("_seg", "_sum"), F.col(order)).alias("e")).orderBy("_part").collect()  # one row per partition
    carried, carry = [], 0
    for r in last:
        carried.append((r["_part"], carry))
        carry = (r["e"]["_sum"] or 0) + (carry if r["e"]["_seg"] == 0 else 0)
    kind = rows.schema["delta"].dataType.simpleString()
    carries = encoded.sparkSession.createDataFrame(carried, f"_part int, _carry {kind}")
    value = F.when(step.isNotNull(), F.col("_sum") + F.when(F.col("_seg") == 0, F.col("_carry")).otherwise(F.lit(0)))
    return rows.join(F.broadcast(carries), "_part").select(order, value.alias("val"))


#: Values of a packed block.
PACK_BLOCK = 4096
_PACKED = "part int, block bigint, n int, base bigint, width int, present binary, packed binary"


def bit_pack(df: DataFrame, order: str, column: str) -> DataFrame:
    """Blocks of PACK_BLOCK integers in order: each value less the block's lowest, in as many bits as the largest needs, and a bit per row for nulls."""
    from stratalog.session import ship

    ship(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, block, kept, size = TaskContext.get().partitionId(), 0, [], 0

        def packed(column):
            nonlocal block
            for at in range(0, len(column), PACK_BLOCK):
                piece = column.slice(at, PACK_BLOCK).combine_chunks()
                there = ~np.asarray(piece.is_null())
                values = piece.drop_null().to_numpy().astype(np.int64)
                base = int(values.min()) if values.size else 0
                left = values.view(np.uint64) - np.int64(base).view(np.uint64)
                width = int(left.max()).bit_length() if values.size else 0
                bits = ((left[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
                rows = (part, block, len(piece), base, width, np.packbits(there, bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes())
                block += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(rows, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], [f.split()[0] for f in _PACKED.split(", ")])

        for b in batches:
            kept.append(b.column(0))
            size += b.num_rows
            if size >= PACK_BLOCK:
                whole = pa.chunked_array(kept)
                full = size - size % PACK_BLOCK
                yield from packed(whole.slice(0, full))
                kept, size = ([whole.slice(full).combine_chunks()], size - full) if size > full else ([], 0)
        if size:
            yield from packed(pa.chunked_array(kept))

    return df.select(order, F.col(column).cast("bigint").alias("v")).orderBy(order).select("v").mapInArrow(run, _PACKED)


def bit_unpack(blocks: DataFrame) -> DataFrame:
    """(part, block, pos, val): the values of packed blocks in their order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                there = np.unpackbits(np.frombuffer(r["present"], np.uint8), bitorder="little")[: r["n"]].astype(bool)
                k, width = int(there.sum()), r["width"]
                bits = np.unpackbits(np.frombuffer(r["packed"], np.uint8), bitorder="little")[: k * width].reshape(k, width).astype(np.uint64)
                values = np.zeros(r["n"], np.int64)
                values[there] = ((bits << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) + np.int64(r["base"]).view(np.uint64)).view(np.int64)
                n = r["n"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["block"], np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(values, mask=~there)], ["part", "block", "pos", "val"])

    return blocks.mapInArrow(run, "part int, block bigint, pos int, val bigint")


def bit_width(column: Column) -> Column:
    """Bits that the values of a non-negative integer column need, as an aggregate."""
    top = F.max(column)
    return F.when(top > 0, F.length(F.regexp_replace(F.bin(top), "^0+", ""))).otherwise(F.when(top.isNotNull(), 1))


def crc32(value: Column) -> Column:
    return F.crc32(value.cast("binary"))
