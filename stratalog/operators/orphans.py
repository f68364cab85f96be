"""References to records that do not exist at the time of the reference.

References and lives are reduced per key and window of 64 months to three masks of months: referred to, with a life in the month,
alive through all of it. A life sets its range of bits at once, and the reduction is a map-side aggregate, so neither a long life nor
a key with any share of all rows costs more than a row per window and split. Keys are then dictionary-encoded: a shard by hash and a
dense code inside it. Each shard and month has three compressed bitmaps over the codes; ``referred AND NOT any life`` are orphans,
``referred AND NOT alive throughout`` leaves those whose life begins or ends within the month, and only their references are checked
exactly against the lives. The AND-NOT works on the compressed containers; only what survives is decoded to keys.

What survives meets the references by a broadcast of checked size, else by a join in which each surviving key is spread over SALTS parts,
so the references of a placeholder key never meet in one task. Certain orphans are done with that.

Defined results: a null key or time refers to nothing and is never an orphan. Repeated references count once. Of several
versions of a life (key, start) the one loaded last counts; its end may be null. A life that ends at or before its start is
empty. Without parents every reference is an orphan. Null start times are no life.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import bitmaps
from stratalog.session import settle, ship

#: Rows of keys per shard of the dictionary; a shard is coded in one task and its bitmaps are built in one.
KEYS_PER_SHARD = 20_000
#: Surviving keys up to this many (some 32 bytes each) are sent to the references; more are joined in SALTS parts a key.
BROADCAST_ROWS, SALTS = 1_000_000, 16


@dataclass(frozen=True)
class References:
    id: str
    key: str
    time: str


@dataclass(frozen=True)
class Lives:
    key: str
    start: str
    end: str
    loaded: str


def month_number(time: Column) -> Column:
    return (F.year(time) * 12 + F.month(time) - 1).cast("int")


def month_name(number: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(number / 12), number % 12 + 1)


def counting_lives(parents: DataFrame, cols: Lives) -> DataFrame:
    """(key, start, end) of each non-empty life by its latest version."""
    rows = parents.select(F.col(f"`{cols.key}`").alias("key"), F.col(f"`{cols.start}`").alias("start"), F.struct(F.col(f"`{cols.loaded}`").alias("at"), F.col(f"`{cols.end}`").alias("end")).alias("v"))
    last = rows.where("key IS NOT NULL AND start IS NOT NULL").groupBy("key", "start").agg(F.max("v").alias("v"))
    return last.select("key", "start", F.col("v.end").alias("end")).where("end IS NULL OR end > start")


def _mask(low: Column, high: Column) -> Column:
    """Bits low to high of 64, none if low > high."""
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (F.lit(63) - (high - low)).cast("int"))
    return F.when(low <= high, F.call_function("shiftleft", ones, low.cast("int"))).otherwise(F.lit(0).cast("bigint"))


def month_masks(refs: DataFrame, lives: DataFrame, first: int, last: int) -> DataFrame:
    """(key, window, referred, any_life, throughout): masks over the 64 months of a window, from (key, period) and (key, start, end)."""
    begins, ends = month_number(F.col("start")), F.coalesce(month_number(F.col("end")), F.lit(last))
    span = lives.withColumns({"from": F.greatest(begins, F.lit(first)), "to": F.least(ends, F.lit(last))}).where("`from` <= `to`")
    at = lambda month: F.make_timestamp_ntz(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    # the months that are covered from their first to their last moment
    whole_from = F.when(F.col("start").cast("timestamp_ntz") <= at(F.col("from")), F.col("from")).otherwise(F.col("from") + 1)
    whole_to = F.when(F.col("end").isNull() | (F.col("end").cast("timestamp_ntz") >= at(F.col("to") + 1)), F.col("to")).otherwise(F.col("to") - 1)
    cut = span.withColumns({"_a": whole_from, "_b": whole_to}).withColumn("window", F.explode(F.sequence(F.floor(F.col("from") / 64).cast("int"), F.floor(F.col("to") / 64).cast("int"))))
    low, high = (lambda c: F.greatest(F.col(c) - F.col("window") * 64, F.lit(0))), (lambda c: F.least(F.col(c) - F.col("window") * 64, F.lit(63)))
    zero = F.lit(0).cast("bigint")
    alive = cut.select("key", "window", zero.alias("r"), _mask(low("from"), high("to")).alias("a"), _mask(low("_a"), high("_b")).alias("t"))
    window = F.floor(F.col("period") / 64).cast("int")
    asked = refs.select("key", window.alias("window"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("period") - window * 64).cast("int")).alias("r"), zero.alias("a"), zero.alias("t"))
    return asked.unionByName(alive).groupBy("key", "window").agg(F.bit_or("r").alias("referred"), F.bit_or("a").alias("any_life"), F.bit_or("t").alias("throughout"))


def dictionary(marks: DataFrame, shards: int) -> DataFrame:
    """``marks`` with shard and code: codes of a shard's keys are dense from 0."""
    spread = marks.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return spread.withColumn("code", F.dense_rank().over(Window.partitionBy("shard").orderBy("key")) - 1)


def surviving(coded: DataFrame) -> DataFrame:
    """(key, period, certain): bits of AND NOT per shard and month, decoded; certain where the key has no life in the month.

    A group holds one window of one shard's keys.
    """

    def run(group):
        import numpy as np
        import pandas as pd

        group = group.sort_values("code")
        code, window = group["code"].to_numpy(), int(group["window"].iloc[0])
        masks = {c: group[c].to_numpy(np.int64).view(np.uint64) for c in ("referred", "any_life", "throughout")}
        place = np.zeros(int(code[-1]) + 1, np.int64)  # row of a code
        place[code] = np.arange(code.size)
        out = []
        for month in range(64):
            bit = np.uint64(1) << np.uint64(month)
            maps = {c: bitmaps.encode(code[(m & bit) != 0]) for c, m in masks.items()}
            if not maps["referred"]:
                continue
            left = bitmaps.decode(bitmaps.and_not(maps["referred"], maps["throughout"]))
            sure = bitmaps.decode(bitmaps.and_not(maps["referred"], maps["any_life"]))
            out.append(pd.DataFrame({"key": group["key"].to_numpy()[place[left]], "period": np.int32(window * 64 + month), "certain": np.isin(left, sure, assume_unique=True)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"key": group["key"].iloc[:0], "period": np.zeros(0, np.int32), "certain": np.zeros(0, bool)})

    kind = coded.schema["key"].dataType.simpleString()
    return coded.select("shard", "window", "code", "key", "referred", "any_life", "throughout").groupBy("shard", "window").applyInPandas(run, f"key {kind}, period int, certain boolean")


def _meet(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """Join many ``rows`` to ``small`` (columns o_...) on keys of which one may be in any share of the rows."""
    few = small.count() <= BROADCAST_ROWS
    if not few:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
        small = small.withColumn("o__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        on = [*on, "_salt"]
    condition = F.lit(True) if also is None else also
    for c in on:
        condition = condition & (F.col(c) == F.col(f"o_{c}"))
    return rows.join(F.broadcast(small) if few else small, condition, how).drop("_salt", *(f"o_{c}" for c in on))


def orphan_references(references: DataFrame, parents: DataFrame, ref: References, life: Lives, shards: int | None = None) -> DataFrame:
    """(id, period as YYYY-MM) of every distinct reference whose key has no life at its time."""
    ship(references.sparkSession)
    refs = references.select(F.col(f"`{ref.id}`").alias("id"), F.col(f"`{ref.key}`").alias("key"), F.col(f"`{ref.time}`").alias("time")).where("key IS NOT NULL AND time IS NOT NULL").withColumn("period", month_number(F.col("time")))
    lives = settle(counting_lives(parents, life), "lives")
    facts = refs.agg(F.count("*").alias("n"), F.min("period").alias("first"), F.max("period").alias("last")).first()
    first, last = (0, -1) if facts["first"] is None else (facts["first"], facts["last"])
    if shards is None:
        shards = max(1, -(-(facts["n"] + lives.count()) // KEYS_PER_SHARD))
    left = settle(surviving(dictionary(month_masks(refs, lives, first, last), shards)), "orphan-bits").select(F.col("key").alias("o_key"), F.col("period").alias("o_period"), "certain")
    certain = _meet(refs, left.where("certain"), ["key", "period"], "left_semi")
    # a life begins or ends in the month: its references are compared with the lives of their key that touch the month
    edge = left.where("NOT certain")
    doubtful = _meet(refs, edge, ["key", "period"], "left_semi")
    begins, ends = month_number(F.col("start")), F.coalesce(month_number(F.col("end")), F.lit(last))
    near = _meet(lives, edge, ["key"]).where(F.col("o_period").between(begins, ends)).select(F.col("key").alias("o_key"), "o_period", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    alive_then = (F.col("o_start") <= F.col("time")) & (F.col("o_end").isNull() | (F.col("o_end") > F.col("time")))
    gone = _meet(doubtful, near, ["key", "period"], "left_anti", alive_then)
    return certain.select("id", "period").unionByName(gone.select("id", "period")).select("id", month_name(F.col("period")).alias("period")).distinct()
