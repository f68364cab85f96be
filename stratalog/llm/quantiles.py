"""Percentiles of very large numeric columns by KLL sketches.

A sketch is a hierarchy of compactors: values enter level 0; a full level is sorted and every other value, from a random
start, moves one level up with twice the weight. Capacities shrink geometrically from the top (k, 2k/3, 4k/9, ...), so a
sketch of any number of values holds about 3k of them. Sketches merge level by level, so sketches of splits, days or sites
combine; the rank error is at most ``rank_error(k)`` of n with 99 % probability for each quantile asked.

Every input split makes one sketch per group before the shuffle (a hot group costs one row per split) and the sketches of a
group meet in a tree of merges over bounded fans. Randomness is seeded by the group and split, so results repeat.

Defined results: null, NaN and infinite values don't count; repeated rows (by id) count once; groups are taken as stored,
nulls being a group; a group without a finite value gives no row. Ties keep their ranks. Minimum and maximum are exact.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import settle

K = 400
SHRINK = 2 / 3
SMALLEST = 8
#: Rows that a split groups at once.
TAKE_ROWS = 200_000
#: Groups whose sketches a split holds at once; beyond it they go on to the merge, which joins a group's sketches anyway.
MOST_GROUPS = 20_000
#: Parts over which a group's sketches are spread for the first merge.
FAN_OUT = 64


def rank_error(k: int = K) -> float:
    """Rank error that a quantile stays within with 99 % probability (published fit for the hierarchy's shrinkage)."""
    return 2.296 / k**0.9021


class Sketch:
    def __init__(self, k: int = K, seed: int = 0):
        self.k, self.n, self.low, self.high = k, 0, np.inf, -np.inf
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.seed, self._rng = seed, None

    @property
    def rng(self) -> np.random.Generator:
        """Made at the first compaction; most sketches of small groups never need one."""
        if self._rng is None:
            self._rng = np.random.default_rng(self.seed)
        return self._rng

    def capacity(self, level: int) -> int:
        return max(SMALLEST, int(np.ceil(self.k * SHRINK ** (len(self.levels) - 1 - level))))

    def update(self, values: np.ndarray) -> None:
        """Add finite values."""
        if not values.size:
            return
        self.n += values.size
        self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        for i in range(0, values.size, 65536):
            self.levels[0] = np.concatenate([self.levels[0], values[i : i + 65536]])
            self._compact()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        while len(self.levels) < len(other.levels):
            self.levels.append(np.zeros(0))
        for i, level in enumerate(other.levels):
            self.levels[i] = np.concatenate([self.levels[i], level])
        self._compact()

    def _compact(self) -> None:
        """While the sketch is over its size, compact the lowest full level."""
        if len(self.levels) == 1 and self.levels[0].size <= self.k:
            return
        while sum(x.size for x in self.levels) > sum(self.capacity(i) for i in range(len(self.levels))):
            i = next(i for i, x in enumerate(self.levels) if x.size > self.capacity(i))
            if i + 1 == len(self.levels):
                self.levels.append(np.zeros(0))
            level = np.sort(self.levels[i])
            odd = level.size % 2  # an odd value stays, the rest compacts in pairs
            stay, rest = (level[:1], level[1:]) if odd and self.rng.integers(2) else (level[level.size - odd :], level[: level.size - odd])
            self.levels[i] = stay
            self.levels[i + 1] = np.concatenate([self.levels[i + 1], rest[self.rng.integers(2) :: 2]])

    def quantiles(self, at: list[float]) -> list[float]:
        """Values whose rank is nearest above q * n; 0 and 1 are exact."""
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(x.size, 1 << i, np.int64) for i, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, total = values[order], np.cumsum(weights[order])
        out = []
        for q in at:
            i = min(np.searchsorted(total, np.ceil(q * total[-1])), values.size - 1)
            out.append(self.low if q <= 0 else self.high if q >= 1 else float(values[i]))
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<IqddI", self.k, self.n, self.low, self.high, len(self.levels)) + struct.pack(f"<{len(self.levels)}I", *(x.size for x in self.levels))
        return head + np.concatenate(self.levels).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, seed: int | None = None) -> Sketch:
        k, n, low, high, levels = struct.unpack_from("<IqddI", data)
        at = struct.calcsize("<IqddI")
        sizes = struct.unpack_from(f"<{levels}I", data, at)
        out = cls(k, zlib.crc32(data) if seed is None else seed)
        out.n, out.low, out.high = n, low, high
        out.levels = list(np.split(np.frombuffer(data, "<f8", sum(sizes), at + 4 * levels), np.cumsum(sizes)[:-1])) if levels else [np.zeros(0)]
        return out


def _sketch_split(groups: list[str], k: int):
    """One sketch per group of an input split; memory is that of the sketches."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow as pa

        from pyspark import TaskContext

        found: dict[tuple, Sketch] = {}
        task, rounds = TaskContext.get(), 0
        split = task.partitionId() if task else 0

        def take(kept):
            x = pa.Table.from_batches(kept).to_pandas()
            number = x.groupby(groups, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(number, kind="stable")
            values = x["value"].to_numpy(np.float64)[order]
            cuts = np.flatnonzero(np.diff(number[order])) + 1
            firsts = x[groups].iloc[order[np.concatenate(([0], cuts))]]
            for key, part in zip(firsts.itertuples(index=False, name=None), np.split(values, cuts), strict=True):
                key = tuple(None if pd.isna(v) else v for v in key)
                if key not in found:
                    # splits must not toss the same coins, or their errors would add up
                    found[key] = Sketch(k, zlib.crc32(repr((split, rounds, key)).encode()))
                found[key].update(part)

        def out():
            items = list(found.items())
            for i in range(0, len(items), 2000):
                part = items[i : i + 2000]
                columns = [pa.array([key[c] for key, _ in part], kinds[name]) for c, name in enumerate(groups)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s.n for _, s in part], pa.int64()), pa.array([s.to_bytes() for _, s in part], pa.binary())], [*groups, "n", "sketch"])
            found.clear()

        kept, size, kinds = [], 0, {}
        for b in batches:
            kinds = kinds or {g: b.schema.field(g).type for g in groups}
            if b.num_rows:
                kept.append(b)
                size += b.num_rows
            if size >= TAKE_ROWS:
                take(kept)
                kept, size = [], 0
                if len(found) > MOST_GROUPS:
                    yield from out()
                    rounds += 1
        if kept:
            take(kept)
        yield from out()

    return run


def merge_sketches(data: list[bytes]) -> bytes:
    out = Sketch.from_bytes(data[0])
    for x in data[1:]:
        out.merge(Sketch.from_bytes(x))
    return out.to_bytes()


def _fold(groups: list[str]):
    """Merge the sketches of a sorted partition, group after group; memory is that of one sketch."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, sketch, done = None, None, []

        def out(schema):
            columns = [pa.array([k[c] for k, _ in done], schema.field(name).type) for c, name in enumerate(groups)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([s.n for _, s in done], pa.int64()), pa.array([s.to_bytes() for _, s in done], pa.binary())], [*groups, "n", "sketch"])

        schema = None
        for b in batches:
            schema = b.schema
            for *own, data in zip(*(b.column(g).to_pylist() for g in groups), b.column("sketch").to_pylist(), strict=True):
                if sketch is not None and own == key:
                    sketch.merge(Sketch.from_bytes(data))
                    continue
                if sketch is not None:
                    done.append((key, sketch))
                    if len(done) == 500:
                        yield out(schema)
                        done.clear()
                key, sketch = own, Sketch.from_bytes(data)
        if sketch is not None:
            done.append((key, sketch))
            yield out(schema)

    return run


def combine(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Merge the sketches of each group (columns: groups, n, sketch): first in FAN_OUT salted parts, then the parts."""
    rows = sketches.select(*groups, "n", "sketch")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    salt = F.pmod(F.xxhash64("sketch"), F.lit(FAN_OUT))
    parts = rows.repartition(*groups, salt).sortWithinPartitions(*groups, F.xxhash64("sketch")).mapInArrow(_fold(groups), kind)
    return parts.repartition(*groups).sortWithinPartitions(*groups, F.xxhash64("sketch")).mapInArrow(_fold(groups), kind)


def sketch_groups(rows: DataFrame, value: str, groups: dict[str, F.Column], distinct: str | None = None, k: int = K) -> DataFrame:
    """(groups, n, sketch) of the finite values; ``distinct`` names the id by which repeated rows count once."""
    x = F.col(f"`{value}`").cast("double")
    own = [c.alias(name) for name, c in groups.items()]
    finite = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    if distinct:
        picked = finite.select(F.col(f"`{distinct}`").alias("_id"), x.alias("value"), *own).distinct()
    else:
        picked = finite.select(x.alias("value"), *own)
    types = {f.name: f.dataType.simpleString() for f in picked.schema}
    schema = ", ".join(f"`{g}` {types[g]}" for g in groups) + ", n bigint, sketch binary"
    return combine(picked.select("value", *groups).mapInArrow(_sketch_split(list(groups), k), schema), list(groups))


def read_quantiles(sketches: DataFrame, groups: list[str], at: dict[str, float]) -> DataFrame:
    """One column per quantile, with n, the exact extremes and the rank-error bound."""
    names, points = [*at, "lowest", "highest", "rank_error"], list(at.values())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [Sketch.from_bytes(x) for x in b.column("sketch").to_pylist()]
            rows = [[*s.quantiles(points), s.low, s.high, 0.0 if len(s.levels) == 1 else rank_error(s.k)] for s in found]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(b.column(g) for g in groups), b.column("n"), *columns], [*groups, "n", *names])

    rows = sketches.select(*groups, "n", "sketch")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "sketch")
    return rows.mapInArrow(run, kind + "".join(f", {n} double" for n in names))


def daily_sketches(rows: DataFrame, value: str, groups: list[str], time: str, distinct: str | None = None, k: int = K) -> DataFrame:
    """Sketches per day and group, written once so that any span of days can be combined from them."""
    return settle(sketch_groups(rows, value, {"day": F.to_date(F.col(f"`{time}`"))} | {g: F.col(f"`{g}`") for g in groups}, distinct, k), "daily-sketches")
