"""A keyed table as immutable Parquet files in levels, under one atomic manifest.

Every write is one commit: files of rows with their sequence and a tombstone mark enter level 0. Reads merge all levels by
key, the latest version winning. The deepest level is the base: it holds each key once, so a read merges only the files above it
and takes the base's rows whose keys are not among theirs; base files that overlap no newer file are read as they are. The base is
neither shuffled nor aggregated while the newer keys fit a broadcast of known size. Compaction merges a level into the next.

Files carry their key and sequence ranges, by which lookups skip them; these come from the Parquet footers, not from a second
read. Compacted files are range-partitioned and sorted by key with a Parquet bloom filter on it.

An ordered table keeps for each key the row with the highest order value that a write has brought with it, whatever the order of the
writes; of equal values the first write stays. Other tables keep the last write.

A manifest version names what it adds and removes; every SNAPSHOT_EVERY versions the whole list is written, so a commit costs what
it changes. A commit that another writer overtook is tried again; a change that was computed from a version is refused instead.
"""

from __future__ import annotations

import bisect
import time
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.catalog import TableSchema
from stratalog.errors import Aborted, FailedPrecondition
from stratalog.operators import merge
from stratalog.session import qualified, ship
from stratalog.sources import durable

# The level count, the trigger, the sizes and the first columnar level are settings of the storage contract.
MAX_LEVELS = 7
#: Files of level 0 that call for a compaction; deeper levels are bounded by size.
L0_TRIGGER = 4
BASE_BYTES = 64 << 20
#: Levels from here on count as columnar in the statistics.
COLUMNAR_LEVEL = 4
#: Bytes of a compacted file.
FILE_BYTES = 128 << 20
#: Newer keys up to this many bytes are sent to the base; more of them meet the base files they overlap by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Keys of a batch up to this many are sent to the table.
BATCH_KEYS = 500_000
#: Versions after which the manifest is written whole.
SNAPSHOT_EVERY = 20
#: How often a commit that was overtaken is tried again.
ATTEMPTS = 8
#: Footers read by the driver itself; more files are read by tasks.
DRIVER_FOOTERS = 64

_MANIFESTS: OrderedDict[tuple[str, int], dict] = OrderedDict()


@dataclass
class FileMeta:
    path: str
    level: int
    min_key: object
    max_key: object
    min_sequence: int
    max_sequence: int
    entries: int
    tombstones: int
    bytes: int
    created: float
    key_bytes: int = 0

    def may_contain(self, key) -> bool:
        return self.min_key is None or self.min_key <= key <= self.max_key

    def overlaps(self, low, high) -> bool:
        return self.min_key is None or ((low is None or low <= self.max_key) and (high is None or self.min_key <= high))


class FileIndex:
    """Finds the files of a key: a sorted list per level with the greatest end so far, so a lookup costs a search and its hits."""

    def __init__(self, files: list[FileMeta]):
        self.levels: dict[int, tuple[list, list, list[FileMeta]]] = {}
        self.open = [f for f in files if f.min_key is None]
        for level in sorted({f.level for f in files}):
            own = sorted((f for f in files if f.level == level and f.min_key is not None), key=lambda f: f.min_key)
            ends: list = []
            for f in own:
                ends.append(f.max_key if not ends or f.max_key > ends[-1] else ends[-1])
            self.levels[level] = ([f.min_key for f in own], ends, own)

    def find(self, key) -> list[FileMeta]:
        out = list(self.open)
        for starts, ends, own in self.levels.values():
            i = bisect.bisect_right(starts, key) - 1
            while i >= 0 and ends[i] >= key:
                if own[i].max_key >= key:
                    out.append(own[i])
                i -= 1
        return out

    def find_many(self, keys) -> list[tuple[FileMeta, object]]:
        """For many keys at once: each file that can hold some of them, with their positions."""
        import numpy as np

        keys = np.asarray(keys)
        found: dict[str, tuple[FileMeta, list]] = {f.path: (f, [np.arange(keys.size)]) for f in self.open}
        for starts, ends, own in self.levels.values():
            if not own:
                continue
            starts, ends, last = np.asarray(starts), np.asarray(ends), np.asarray([f.max_key for f in own])
            who = np.arange(keys.size)
            at = np.searchsorted(starts, keys, side="right") - 1
            while who.size:
                live = at >= 0
                live[live] = ends[at[live]] >= keys[who[live]]
                who, at = who[live], at[live]
                hit = last[at] >= keys[who]
                if hit.any():
                    order = np.argsort(at[hit], kind="stable")
                    files, mine = at[hit][order], who[hit][order]
                    cuts = np.flatnonzero(np.diff(files)) + 1
                    for part, f in zip(np.split(mine, cuts), files[np.r_[0, cuts]], strict=True):
                        found.setdefault(own[f].path, (own[f], []))[1].append(part)
                at = at - 1
        return [(f, np.concatenate(parts)) for f, parts in found.values()]


def level_limit(level: int) -> int:
    """Bytes a level may hold; level 0 counts files."""
    return BASE_BYTES * 10**level


def footer(uri: str, key: str) -> tuple:
    """(uri, min and max key, min and max sequence, rows, tombstones, bytes of keys) of a file, from its footer alone."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        meta = pq.ParquetFile(f).metadata
    low = high = first = last = None
    known, rows, dead, size = True, 0, 0, 0
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        rows += group.num_rows
        for c in range(group.num_columns):
            column = group.column(c)
            s = column.statistics
            if column.path_in_schema == key:
                size += column.total_uncompressed_size
                if s is None or not s.has_min_max:
                    known = False
                else:
                    low, high = s.min if low is None else min(low, s.min), s.max if high is None else max(high, s.max)
            elif column.path_in_schema == merge.SEQ:
                first, last = s.min if first is None else min(first, s.min), s.max if last is None else max(last, s.max)
            elif column.path_in_schema == merge.DELETED:
                dead += group.num_rows - s.null_count  # a tombstone is true, all else is null
    known = known and low == low and high == high  # NaN has no place in a range
    return uri, low if known else None, high if known else None, first, last, rows, dead, size


class TableStore:
    def __init__(self, spark: SparkSession, path: str, schema: TableSchema):
        self.spark, self.path, self.schema = spark, qualified(spark, path.rstrip("/")), schema
        self.key = schema.primary_key
        self.columns = [c.name for c in schema.columns]
        self._unique = not schema.ordered  # rows of one write may share an order value
        self.stored = T.StructType([*(T.StructField(c.name, c.type) for c in schema.columns), T.StructField(merge.SEQ, T.LongType()), T.StructField(merge.ORD, T.LongType()), T.StructField(merge.DELETED, T.BooleanType())])

    # manifest -----------------------------------------------------------------------------------------------------

    def version(self) -> int:
        found = durable.listing(self.spark, f"{self.path}/_manifest", ".json")
        return int(found[-1][0].rsplit("/", 1)[1][:20]) if found else 0

    def manifest(self, version: int | None = None) -> dict:
        """version, sequence, streams and files (by path) of a version, the latest if none is named."""
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "sequence": 0, "files": {}, "streams": {}}
        known = (self.path, v)
        if known not in _MANIFESTS:
            _MANIFESTS[known] = self._replay(v)
            while len(_MANIFESTS) > 64:
                _MANIFESTS.popitem(last=False)
        m = _MANIFESTS[known]
        return m | {"files": dict(m["files"]), "streams": dict(m["streams"])}

    def _replay(self, v: int) -> dict:
        if (self.path, v - 1) in _MANIFESTS:
            m, start = self.manifest(v - 1), v - 1
        else:
            snaps = [int(p.rsplit("/", 1)[1][:20]) for p, _ in durable.listing(self.spark, f"{self.path}/_snapshot", ".json")]
            start = max((x for x in snaps if x <= v), default=0)
            m = durable.read_json(self.spark, f"{self.path}/_snapshot/{start:020d}.json") if start else {"sequence": 0, "files": {}, "streams": {}}
        for n in range(start + 1, v + 1):
            d = durable.read_json(self.spark, f"{self.path}/_manifest/{n:020d}.json")
            for path in d["remove"]:
                m["files"].pop(path, None)
            m["files"] |= {f["path"]: f for f in d["add"]}
            m["sequence"], m["streams"] = d["sequence"], m["streams"] | d["streams"]
        return m | {"version": v}

    def files(self, manifest: dict | None = None) -> list[FileMeta]:
        return [FileMeta(**f) for f in (manifest or self.manifest())["files"].values()]

    def _publish(self, old: dict, add: list[FileMeta], remove: list[str], sequence: int, streams: dict | None = None) -> None:
        """Publish the version after ``old``; Aborted if another writer did so first."""
        v = old["version"] + 1
        if not durable.put_if_absent(self.spark, f"{self.path}/_manifest/{v:020d}.json", {"sequence": sequence, "add": [asdict(f) for f in add], "remove": remove, "streams": streams or {}}):
            raise Aborted(f"table {self.schema.name} was changed by another writer")
        if v % SNAPSHOT_EVERY == 0:
            m = self.manifest(v)
            durable.put_if_absent(self.spark, f"{self.path}/_snapshot/{v:020d}.json", {k: m[k] for k in ("sequence", "files", "streams")})

    def _measure(self, folder: str, level: int) -> list[FileMeta]:
        """Metadata of a folder's files from their footers."""
        kind = self.schema.column(self.key).type
        keyed = not isinstance(kind, (T.BinaryType, T.TimestampNTZType))
        sizes = {qualified(self.spark, p): n for p, n in durable.listing(self.spark, folder, ".parquet")}
        key = self.key
        if len(sizes) <= DRIVER_FOOTERS:
            with ThreadPoolExecutor(8) as pool:
                found = list(pool.map(lambda uri: footer(uri, key), sizes))
        else:
            ship(self.spark)
            k = kind.simpleString() if keyed else "string"

            def read(batches: Iterator) -> Iterator:
                import pandas as pd

                for b in batches:
                    rows = [footer(uri, key) for uri in b["uri"]]
                    yield pd.DataFrame([r if keyed else (r[0], None, None, *r[3:]) for r in rows], columns=["uri", "a", "b", "s", "t", "n", "d", "size"])

            names = self.spark.createDataFrame([(u,) for u in sizes], "uri string").repartition(min(-(-len(sizes) // 8), self.spark.sparkContext.defaultParallelism * 4))
            found = [tuple(r) for r in names.mapInPandas(read, f"uri string, a {k}, b {k}, s bigint, t bigint, n bigint, d bigint, size bigint").collect()]
        now = time.time()
        return [FileMeta(uri, level, a if keyed else None, b if keyed else None, s, t, n, d, sizes[uri], now, size) for uri, a, b, s, t, n, d, size in found if n]

    # writes -------------------------------------------------------------------------------------------------------

    def commit(self, rows: DataFrame, deleted: bool = False, stream: tuple[str, int] | None = None, since: int | None = None, order: Column | None = None) -> int:
        """Append rows (or tombstones of their keys) as one commit; the number of rows. A stream's batch is taken once.

        ``since`` is the version that the rows were computed from: the commit is refused if there is a newer one. ``order`` is the
        rows' order value in an ordered table; without it they are newer than all there is.
        """
        if order is not None and not self.schema.ordered:
            raise FailedPrecondition(f"table {self.schema.name} keeps no order of its rows")
        for attempt in range(ATTEMPTS):
            m = self.manifest()
            if since is not None and m["version"] != since:
                raise Aborted(f"table {self.schema.name} was changed after version {since} was read")
            if stream and m["streams"].get(stream[0], -1) >= stream[1]:
                return 0
            number = m["sequence"] + 1
            if self.schema.ordered:
                value = order if order is not None else F.lit(max((f.max_sequence for f in self.files(m)), default=0) + 1)
                marks = {merge.SEQ: value.cast("bigint"), merge.ORD: F.lit(-number).cast("bigint")}  # of equal orders the earlier commit stays
            else:
                marks = {merge.SEQ: F.lit(number).cast("bigint"), merge.ORD: F.monotonically_increasing_id()}
            marked = rows.withColumns(marks)
            gone = F.lit(True) if deleted else F.when(F.col(merge.DELETED), True) if merge.DELETED in rows.columns else F.lit(None).cast("boolean")
            if deleted:
                marked = marked.select(*(F.col(c) if c == self.key else F.lit(None).cast(self.schema.column(c).type).alias(c) for c in self.columns), merge.SEQ, merge.ORD)
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            marked.withColumn(merge.DELETED, gone).select(*[f.name for f in self.stored]).sortWithinPartitions(self.key).write.parquet(folder)
            new = self._measure(folder, 0)
            try:
                self._publish(m, new, [], number, {stream[0]: stream[1]} if stream else None)
                return sum(f.entries for f in new)
            except Aborted:
                durable.remove(self.spark, folder)
                if since is not None or attempt == ATTEMPTS - 1:
                    raise
        return 0

    def put(self, rows: DataFrame, order: Column | None = None) -> int:
        return self.commit(rows, order=order)

    def delete(self, keys: DataFrame, since: int | None = None) -> int:
        return self.commit(keys, deleted=True, since=since)

    def truncate(self) -> None:
        m = self.manifest()
        self._publish(m, [], list(m["files"]), m["sequence"])

    # reads --------------------------------------------------------------------------------------------------------

    def log(self, files: list[FileMeta] | None = None) -> DataFrame:
        """All versions in the files, tombstones marked true and all else false."""
        files = self.files() if files is None else files
        reader = self.spark.read.schema(self.stored)
        df = reader.parquet(*[f.path for f in files]) if files else self.spark.createDataFrame([], self.stored)
        return df.withColumn(merge.DELETED, F.coalesce(merge.DELETED, F.lit(False)))

    @staticmethod
    def base(files: list[FileMeta]) -> list[FileMeta]:
        """The files of the deepest level, which hold each key once; none if all are in level 0."""
        deepest = max((f.level for f in files), default=0)
        return [f for f in files if f.level == deepest] if deepest else []

    def _plain(self, files: list[FileMeta]) -> bool:
        """Can the files be read without a merge?"""
        return len(self.base(files)) == len(files) and not any(f.tombstones for f in files)

    def _merged(self, files: list[FileMeta], columns: list[str]) -> DataFrame:
        """The latest version of each key, tombstones too, with the columns named (DELETED among them)."""
        below = self.base(files)
        own = {f.path for f in below}
        newer = [f for f in files if f.path not in own]
        order = [F.col(merge.SEQ), F.col(merge.ORD)]
        if not newer:
            return self.log(below).select(*columns)
        if not below:
            return merge.latest(self.log(newer), self.key, order, columns, self._unique)
        over = [f for f in below if any(f.min_key is None or d.min_key is None or f.overlaps(d.min_key, d.max_key) for d in newer)]
        apart = [f for f in below if f not in over]
        log = self.log(newer)
        parts = []
        if over:
            keys = log.select(self.key).distinct()
            if sum(f.key_bytes + 24 * f.entries for f in newer) <= BROADCAST_BYTES:
                keys = F.broadcast(keys)
            old = self.log(over)
            parts.append(old.join(keys, self.key, "left_anti").select(*columns))
            if self.schema.ordered:  # a newer write may carry an older order
                log = log.unionByName(old.join(keys, self.key, "left_semi").select(*log.columns))
        parts.append(merge.latest(log, self.key, order, columns, self._unique))
        if apart:
            parts.append(self.log(apart).select(*columns))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def read(self, files: list[FileMeta] | None = None, few: bool = False) -> DataFrame:
        """The current rows. ``few`` says that a filter on the key leaves few of them: they are merged in one task without a shuffle."""
        files = self.files() if files is None else files
        if self._plain(files):
            return self.log(files).select(*self.columns)
        if few:
            return merge.live(self.log(files).coalesce(1), self.key, self.columns, self._unique)
        return self._merged(files, [*self.columns, merge.DELETED]).where(~F.col(merge.DELETED)).drop(merge.DELETED)

    def get(self, key) -> DataFrame:
        """The row of a key, from the files whose range holds it."""
        return self.read(self.files_for_key(key), few=True).where(F.col(self.key) == F.lit(key))

    def range(self, low=None, high=None, few: bool = False) -> DataFrame:
        """Rows with low <= key <= high; an open end is None."""
        return self._between(self.read(self.files_for_range(low, high), few), low, high)

    def _between(self, df: DataFrame, low, high) -> DataFrame:
        if low is not None:
            df = df.where(F.col(self.key) >= F.lit(low))
        return df if high is None else df.where(F.col(self.key) <= F.lit(high))

    def prefix(self, start: str) -> DataFrame:
        """Rows whose key as text begins with ``start``; of textual keys only the files that can hold such are read."""
        if not isinstance(self.schema.column(self.key).type, T.StringType):
            return self.read().where(F.col(self.key).cast("string").startswith(start))
        return self.read(self.files_for_prefix(start)).where(F.col(self.key).startswith(start))

    def after(self, key) -> DataFrame:
        """Rows behind a key (upper bound), in key order."""
        return self.range(key, None).where(F.col(self.key) > F.lit(key)).orderBy(self.key)

    def page(self, after=None, limit: int = 100) -> tuple[DataFrame, bool, object]:
        """Up to ``limit`` rows in key order after a key, whether there are more, and the key to go on from. A page is as large as was asked."""
        df = self.read().orderBy(self.key) if after is None else self.after(after)
        rows = df.limit(limit + 1).collect()
        page = rows[:limit]
        return self.spark.createDataFrame(page, df.schema), len(rows) > limit, page[-1][self.key] if len(rows) > limit else None

    def _hits(self, wanted: DataFrame) -> DataFrame:
        """The rows of wanted keys. Few keys are sent to the table, so it is neither shuffled nor sorted; many meet it by a shuffle."""
        few = wanted.count() <= BATCH_KEYS
        return self.read().join(F.broadcast(wanted) if few else wanted, self.key, "left_semi")

    def batch_get(self, keys: DataFrame, key: str) -> DataFrame:
        """Each wanted key with its row; nulls where there is none."""
        wanted = keys.select(F.col(key).cast(self.schema.column(self.key).type).alias(self.key))
        return wanted.join(self._hits(wanted), self.key, "left")

    def missing(self, keys: DataFrame, key: str) -> DataFrame:
        wanted = keys.select(F.col(key).cast(self.schema.column(self.key).type).alias(self.key))
        return wanted.join(self._hits(wanted).select(self.key), self.key, "left_anti")

    def range_with_tombstones(self, low=None, high=None) -> tuple[DataFrame, DataFrame]:
        """(live rows, deleted keys) of a range."""
        all_rows = self._between(self._merged(self.files_for_range(low, high), [*self.columns, merge.DELETED]), low, high)
        return all_rows.where(~F.col(merge.DELETED)).drop(merge.DELETED), all_rows.where(F.col(merge.DELETED)).select(self.key)

    def estimate(self, low=None, high=None) -> int:
        """Upper bound of the rows of a range from the manifest alone."""
        return sum(f.entries for f in self.files_for_range(low, high))

    def iterate(self, low=None, high=None):
        """Rows of a range in key order, a partition at a time."""
        return self.range(low, high).orderBy(self.key).toLocalIterator(prefetchPartitions=True)

    # file selection -----------------------------------------------------------------------------------------------

    def index(self) -> FileIndex:
        return FileIndex(self.files())

    def files_for_key(self, key) -> list[FileMeta]:
        return [f for f in self.files() if f.may_contain(key)]

    def files_for_range(self, low, high) -> list[FileMeta]:
        return [f for f in self.files() if f.overlaps(low, high)]

    def files_for_prefix(self, start: str) -> list[FileMeta]:
        """Files whose range of keys meets those that begin with ``start``."""
        return [f for f in self.files() if f.min_key is None or not start or (f.max_key >= start and f.min_key[: len(start)] <= start)]

    def files_at(self, level: int) -> list[FileMeta]:
        return [f for f in self.files() if f.level == level]

    def read_levels(self, levels: list[int]) -> DataFrame:
        return merge.live(self.log([f for f in self.files() if f.level in levels]), self.key, self.columns, self._unique)

    # compaction ---------------------------------------------------------------------------------------------------

    def due(self) -> int | None:
        """The first level that is over its bound."""
        for level in range(MAX_LEVELS - 1):
            files = self.files_at(level)
            if (level == 0 and len(files) >= L0_TRIGGER) or (level and sum(f.bytes for f in files) > level_limit(level)):
                return level
        return None

    def compact(self, level: int = 0) -> dict:
        """Merge a level with the overlapping files of the next and replace both; tombstones go when nothing lies deeper.

        Commits that came in between stay: they lie above what was merged. Only another compaction of the same files makes this one void.
        """
        m = self.manifest()
        files = self.files(m)
        upper = [f for f in files if f.level == level]
        if not upper:
            return {"entries_in": 0, "entries_out": 0, "tombstones_removed": 0, "duplicates_removed": 0, "bytes_in": 0, "bytes_out": 0, "space_ratio": 1.0}
        keyed = all(f.min_key is not None for f in upper)
        low, high = (min(f.min_key for f in upper), max(f.max_key for f in upper)) if keyed else (None, None)
        inputs = upper + [f for f in files if f.level == level + 1 and f.overlaps(low, high)]
        merged = self._merged(inputs, [f.name for f in self.stored])
        if not self.schema.ordered and not any(f.level > level + 1 for f in files):  # in an ordered table a late write must still meet its tombstone
            merged = merged.where(~F.col(merge.DELETED))
        size = sum(f.bytes for f in inputs)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        parts = max(1, -(-size // FILE_BYTES))
        spread = merged.repartitionByRange(parts, self.key) if parts > 1 else merged.coalesce(1)
        spread = spread.withColumn(merge.DELETED, F.when(F.col(merge.DELETED), True))
        spread.sortWithinPartitions(self.key).select(*[f.name for f in self.stored]).write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(folder)
        new = self._measure(folder, level + 1)
        taken = [f.path for f in inputs]
        for attempt in range(ATTEMPTS):
            try:
                self._publish(m, new, taken, m["sequence"])
                break
            except Aborted:
                m = self.manifest()
                if attempt == ATTEMPTS - 1 or not all(p in m["files"] for p in taken):
                    durable.remove(self.spark, folder)
                    raise
        entries, out = sum(f.entries for f in inputs), sum(f.entries for f in new)
        dead = sum(f.tombstones for f in inputs) - sum(f.tombstones for f in new)
        written = sum(f.bytes for f in new)
        return {"entries_in": entries, "entries_out": out, "tombstones_removed": dead, "duplicates_removed": entries - out - dead, "bytes_in": size, "bytes_out": written, "space_ratio": written / size if size else 1.0}

    def compact_all(self) -> list[dict]:
        """Push everything into one level."""
        out = []
        while len({f.level for f in self.files()}) > 1 or self.files_at(0):
            level = min(f.level for f in self.files())
            out.append(self.compact(level))
        return out

    def vacuum(self) -> int:
        """Remove data folders that no file of the current version lies in; old versions can't be read afterwards."""
        used = {f.path.rsplit("/", 2)[1] for f in self.files()}
        jvm_fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = jvm_fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = 0
        if fs.exists(jvm_fs):
            for s in fs.listStatus(jvm_fs):
                if s.getPath().getName() not in used:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone

    def stats(self) -> dict:
        files = self.files()
        levels = [{"level": n, "files": len(own), "entries": sum(f.entries for f in own), "bytes": sum(f.bytes for f in own), "columnar": n >= COLUMNAR_LEVEL} for n in range(MAX_LEVELS) if (own := [f for f in files if f.level == n]) or n == 0]
        return {"table": self.schema.name, "version": self.version(), "files": len(files), "entries": sum(f.entries for f in files), "bytes": sum(f.bytes for f in files), "levels": levels}

    def manifest_frame(self) -> DataFrame:
        kind = "path string, level int, min_key string, max_key string, min_sequence bigint, max_sequence bigint, entries bigint, tombstones bigint, bytes bigint"
        rows = [(f.path, f.level, None if f.min_key is None else str(f.min_key), None if f.max_key is None else str(f.max_key), f.min_sequence, f.max_sequence, f.entries, f.tombstones, f.bytes) for f in self.files()]
        return self.spark.createDataFrame(rows, kind)
