"""Fill containers of fixed capacity with documents by best-two-fit.

Sizes are tokens of the public vocabulary. Documents are spread by hash over shards of SHARD_ITEMS and each shard is packed
for itself: a container is filled greedily with the largest document that still fits; if space is left, its smallest
document is exchanged for the two unpacked documents that together fill the enlarged gap best. A shard's work is on a count
per size (no size exceeds the capacity), so a container costs time in proportion to the capacity, not to the documents. Only the last containers of a
shard can be badly filled, a fixed number whatever the corpus.

A document larger than the capacity is cut: each full part has a container of its own and the rest is packed like a document.

Defined results: every document appears, for every capacity; one without tokens (null or empty text) takes no space and is put
in the first container of its shard. Repeated ids are separate items. Capacities that are null or below 1 are left out.
An empty corpus gives no containers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import settle

SHARD_ITEMS = 40_000
#: The capacity table is read to the driver; it is a list of settings and may not be larger.
MOST_CAPACITIES = 1000


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (sizes from 1 to ``capacity``) by best-two-fit."""
    order = np.argsort(sizes, kind="stable")
    begins = np.searchsorted(sizes[order], np.arange(capacity + 2))
    taken = begins[:-1].copy()  # next unused item of each size
    count = np.diff(begins)
    out = np.full(sizes.size, -1, np.int64)
    # largest size with items left that is at most i
    at_most = np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), 0))
    left, number = sizes.size, 0

    def used(size: int) -> None:
        """A size ran out: entries that pointed at it now point below."""
        below = at_most[size - 1]
        end = size + int(np.argmax(at_most[size:] != size)) if at_most[-1] != size else capacity + 1
        at_most[size:end] = below

    def give(size: int) -> None:
        """A size is there again."""
        part = at_most[size:]
        end = size + int(np.searchsorted(part, size))
        at_most[size:end] = size

    while left:
        gap, mine = capacity, []
        while (size := int(at_most[gap])) > 0:
            k = min(int(count[size]), gap // size)
            count[size] -= k
            mine += [size] * k
            gap -= size * k
            if count[size] == 0:
                used(size)
        if gap and left > len(mine):
            smallest = mine[-1]
            room = gap + smallest
            # two unpacked documents a <= b with smallest < a + b <= room, as large as possible
            a = np.flatnonzero(count[1 : room // 2 + 1]) + 1
            if a.size:
                b = at_most[room - a]
                fits = (b > a) | ((b == a) & (count[a] > 1))
                total = np.where(fits, a + b, 0)
                best = int(np.argmax(total))
                if total[best] > smallest:
                    one, two = int(a[best]), int(b[best])
                    mine[-1:] = [one, two]
                    for size in (one, two):
                        count[size] -= 1
                        if count[size] == 0:
                            used(size)
                    count[smallest] += 1
                    if count[smallest] == 1:
                        give(smallest)
        for size in mine:
            out[order[taken[size]]] = number
            taken[size] += 1
        left -= len(mine)
        number += 1
    return out


def _pack_shard(group):
    """One shard of one capacity: cut what is too large, pack the rest, number the containers."""
    import pandas as pd

    capacity, shard = int(group["capacity_tokens"].iloc[0]), int(group["shard"].iloc[0])
    group = group.sort_values(["doc_id", "tokens"], kind="stable")
    ids, tokens = group["doc_id"], group["tokens"].to_numpy(np.int64)
    full, rest = tokens // capacity, tokens % capacity
    exact = (rest == 0) & (full > 0)
    full = full - exact
    rest = np.where(exact, capacity, rest)  # the last part is packed, be it whole or not
    numbers = np.zeros(tokens.size, np.int64)
    some = rest > 0
    if some.any():
        numbers[some] = pack_sizes(rest[some], capacity)
    packed = int(numbers.max()) + 1 if numbers.size else 0
    rows = np.arange(tokens.size)
    cut = np.repeat(rows, full)
    part = np.arange(cut.size) - np.repeat(np.cumsum(full) - full, full)
    row, part_no = np.concatenate([rows, cut]), np.concatenate([full, part])
    start = part_no * capacity
    end = np.concatenate([full * capacity + rest, (part + 1) * capacity])
    number = np.concatenate([numbers, packed + np.arange(cut.size)])
    return pd.DataFrame(
        {"capacity_id": int(group["capacity_id"].iloc[0]), "capacity_tokens": capacity, "container": f"{shard}-" + pd.Series(number).astype(str), "doc_id": ids.to_numpy()[row], "part": part_no, "token_start": start, "token_end": end}
    ).astype({"doc_id": "Int64"})


PACKED = "capacity_id bigint, capacity_tokens bigint, container string, doc_id bigint, part bigint, token_start bigint, token_end bigint"


def pack(sizes: DataFrame, capacities: DataFrame, shards: int) -> DataFrame:
    """Assign (doc_id, tokens) to containers of every capacity: one row per document or part of one."""
    wanted = capacities.where("capacity_tokens >= 1").select("capacity_id", "capacity_tokens").distinct().limit(MOST_CAPACITIES + 1).collect()
    if len(wanted) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    if not wanted:
        return sizes.sparkSession.createDataFrame([], PACKED)
    each = F.explode(F.array(*(F.struct(F.lit(int(r["capacity_id"])).cast("bigint").alias("capacity_id"), F.lit(int(r["capacity_tokens"])).cast("bigint").alias("capacity_tokens")) for r in wanted)))
    # copies of a document go to different shards by their number, which is written with them: a repeated task must not give new ones
    numbered = settle(sizes.select("doc_id", "tokens", (F.monotonically_increasing_id() % 64).alias("copy")), "pack-sizes")
    items = numbered.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id", "tokens", "copy"), F.lit(shards)).cast("int").alias("shard"), each.alias("c"))
    return items.select("doc_id", "tokens", "shard", "c.*").groupBy("capacity_id", "shard").applyInPandas(_pack_shard, PACKED)


def shard_count(documents: DataFrame) -> int:
    return max(1, -(-documents.count() // SHARD_ITEMS))


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, how full they are, and the documents that were cut."""
    boxes = packed.groupBy("capacity_id", "capacity_tokens", "container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"), F.count("*").alias("items"), F.sum((F.col("part") > 0).cast("bigint")).alias("later_parts"))
    return boxes.groupBy("capacity_id", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * F.col("capacity_tokens"))).alias("fill"), F.max("used").alias("fullest"), F.sum("later_parts").alias("later_parts")
    )
