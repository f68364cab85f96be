"""Apply a feed of inserts, updates and deletes to a keyed table.

Keys are split over buckets by hash. In each bucket an embedded DuckDB database takes the changes by a conditional upsert: a
change replaces the stored row only if its sequence is higher (of equal sequences, the one that arrived first stays). Deletes are
stored as tombstones, so a late older insert can't revive a key. Each touched bucket is exported as one file; one atomic manifest
publishes the new files of all buckets together.

A run with few changes for a bucket adds a delta file to it; a bucket is written whole when its deltas are MOST_DELTAS or the
changes are a good part of it, so small runs cost what they change. The rule of the upsert does not depend on the order, so
a read merges a bucket's files by the same rule. When buckets hold more than ROWS_PER_BUCKET keys or BYTES_PER_BUCKET on average their number is
doubled, each old bucket giving two; a worker never holds more than a bucket.

The same upsert runs on each input split before the shuffle, flushed when it has taken SPLIT_BYTES, and leaves at most one row per key
and flush, so a key with any share of all rows reaches its bucket as a handful of rows.

Defined results: a change without key or sequence, or with an unknown operation, is void and skipped. Null, empty and very
long values are kept as they are, in their own types (text, numbers, booleans, bytes, dates, times). Repeated and out-of-order changes
don't alter the result, within a run or across runs. An empty feed publishes nothing new; a table without a version reads as empty.
Only the named columns are read, so extra columns and clashing names do no harm.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.errors import Aborted, InvalidArgument
from stratalog.session import new_path, parallelism, qualified
from stratalog.sources import durable

INSERT, DELETE = 1, 2
#: Keys that a bucket should hold at most on average; fewer than SMALL_BUCKET changes are not split further.
ROWS_PER_BUCKET, SMALL_BUCKET = 500_000, 20_000
#: Compressed bytes that a bucket should hold at most on average.
BYTES_PER_BUCKET = 64 << 20
#: Rows handed to DuckDB in one statement.
UPSERT_ROWS = 120_000
#: Bytes of changes that a split reduces before it passes them on.
SPLIT_BYTES = 128 << 20
#: Delta files after which a bucket is written whole, and how many times the changes a bucket must hold to get a delta at all.
MOST_DELTAS, DELTA_SHARE = 8, 4
DUCKDB_MEMORY = "400MB"

_COMMIT = "bucket int, file string, keys bigint, bytes bigint, max_sequence bigint, whole boolean"
#: DuckDB's names of the types that a column may have.
_TYPES = {"string": "VARCHAR", "binary": "BLOB", "boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMPTZ"}


@dataclass(frozen=True)
class Feed:
    """Names of the feed's columns. ``arrival`` breaks ties of equal sequence: the smallest stays."""

    key: str
    sequence: str
    operation: str
    arrival: str
    values: list[str] = field(default_factory=list)


def _duckdb_type(kind: str) -> str:
    if kind in _TYPES or kind.startswith("decimal"):
        return _TYPES.get(kind, kind.upper())
    raise InvalidArgument(f"a changed table can't hold a column of type {kind}")


class _Bucket:
    """The embedded database of one bucket or split. ``kinds``: DuckDB types of the key and the values."""

    def __init__(self, kinds: list[str]):
        import duckdb

        key, *values = kinds
        self.names = ["k", "h", "s", "a", "d", *(f"v{i}" for i in range(len(values)))]
        columns = ", ".join(self.names)
        self.con = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        self.con.execute(f"CREATE TABLE state (k {key} PRIMARY KEY, h BIGINT, s BIGINT, a BIGINT, d BOOLEAN" + "".join(f", v{i} {kind}" for i, kind in enumerate(values)) + ")")
        sets = ", ".join(f"{c} = excluded.{c}" for c in self.names[2:])
        # one statement may touch a key once, so each block is reduced by the same rule first
        self.upsert = (
            f"INSERT INTO state SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, a) AS r FROM block) WHERE r = 1 "
            f"ON CONFLICT (k) DO UPDATE SET {sets} WHERE excluded.s > state.s OR (excluded.s = state.s AND excluded.a < state.a)"
        )

    def take(self, tables) -> None:
        import pyarrow as pa

        block = pa.concat_tables(tables)
        self.con.register("block", block)
        self.con.execute(self.upsert)
        self.con.unregister("block")

    def take_all(self, tables) -> None:
        kept, rows = [], 0
        for t in tables:
            kept.append(t)
            rows += t.num_rows
            if rows >= UPSERT_ROWS:
                self.take(kept)
                kept, rows = [], 0
        if rows:
            self.take(kept)

    def count(self) -> int:
        return self.con.execute("SELECT count(*) FROM state").fetchall()[0][0]

    def batches(self, size: int = 20_000):
        return self.con.sql(f"SELECT {', '.join(self.names)} FROM state").to_arrow_reader(size)

    def close(self) -> None:
        self.con.close()


def _reduce_split(kinds: list[str]):
    """Upsert of one input split; the surviving row of each key goes on."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = None

        def part(first):
            nonlocal schema
            size = 0
            for b in itertools.chain([first], batches):
                schema = schema or b.schema
                yield pa.Table.from_batches([b])
                size += b.nbytes
                if size >= SPLIT_BYTES:
                    return

        while (first := next(batches, None)) is not None:
            bucket = _Bucket(kinds)
            try:
                bucket.take_all(part(first))
                for b in bucket.batches():
                    yield from pa.Table.from_batches([b]).select(schema.names).cast(schema).to_batches()
            finally:
                bucket.close()

    return run


def _apply_bucket(kinds: list[str], folder: str, previous: dict[int, list[dict]], buckets: int, old_buckets: int):
    """Upsert one bucket's changes and export what changed, or the whole bucket, under a name of its own."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        first = next((b for b in batches if b.num_rows), None)  # a task holds one bucket
        if first is None:
            return
        n = first.column("b")[0].as_py()

        def changes():
            for b in itertools.chain([first], batches):
                t = pa.Table.from_batches([b]).drop_columns(["b"])
                yield t.filter(t.column("k").is_valid())  # a row without key only asks for the bucket to be written

        def stored(uri: str):
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as f:
                for b in pq.ParquetFile(f).iter_batches(UPSERT_ROWS):
                    t = pa.Table.from_batches([b])
                    # an old bucket gives two: each takes its own keys
                    yield t if buckets == old_buckets else t.filter(pa.array(np.mod(t.column("h").to_numpy(), buckets) == n))

        old = previous.get(n % old_buckets, []) if old_buckets else []
        bucket = _Bucket(kinds)
        try:
            bucket.take_all(changes())
            whole = not old or buckets != old_buckets or len(old) > MOST_DELTAS or sum(f["keys"] for f in old) <= DELTA_SHARE * bucket.count()
            if whole:
                for f in old:
                    bucket.take_all(stored(f["file"]))
            uri = f"{folder}/bucket-{n:05d}-{uuid.uuid4().hex}.parquet"
            system, path = fs.FileSystem.from_uri(uri)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            keys, top = bucket.con.execute("SELECT count(*), max(s) FROM state").fetchall()[0]
            reader = bucket.batches(UPSERT_ROWS)
            with system.open_output_stream(path) as f, pq.ParquetWriter(f, reader.schema, compression="zstd", compression_level=1) as out:
                for b in reader:
                    out.write_batch(b)
                out.close()
                size = f.tell()
        finally:
            bucket.close()
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([n], pa.int32()), "file": [uri], "keys": pa.array([keys], pa.int64()), "bytes": pa.array([size], pa.int64()), "max_sequence": pa.array([top], pa.int64()), "whole": [whole]})

    return run


class BucketedTable:
    """A keyed table kept as files per bucket; each version is a manifest naming the files of every bucket."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, qualified(spark, path.rstrip("/"))

    def versions(self) -> list[str]:
        return [p for p, _ in durable.listing(self.spark, f"{self.path}/_versions", ".json")]

    def manifest(self) -> dict | None:
        found = self.versions()
        return durable.read_json(self.spark, found[-1]) if found else None

    def apply(self, changes: DataFrame, feed: Feed, buckets: int | None = None) -> dict:
        """Apply ``changes`` and publish the next version; returns its manifest."""
        old = self.manifest()
        picked = [F.col(f"`{feed.key}`").alias("k"), *(F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(feed.values))]
        rows = changes.select(
            *picked[:1],
            F.xxhash64(F.col(f"`{feed.key}`")).alias("h"),
            F.col(f"`{feed.sequence}`").cast("bigint").alias("s"),
            F.col(f"`{feed.arrival}`").cast("bigint").alias("a"),
            (F.col(f"`{feed.operation}`") == DELETE).alias("d"),
            *picked[1:],
        ).where(F.col(f"`{feed.operation}`").isin(INSERT, DELETE) & F.col("k").isNotNull() & F.col("s").isNotNull())
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        kinds = [schema["k"].dataType.simpleString(), *(schema[f"v{i}"].dataType.simpleString() for i in range(len(feed.values)))]
        if old and (old["values"] != feed.values or old["types"] != kinds):
            raise InvalidArgument(f"the table has {list(zip(old['values'], old['types'][1:], strict=True))}, not the columns of this feed")
        old_buckets = old["buckets"] if old else 0
        if old:
            held, size = (sum(f[x] for files in old["files"].values() for f in files) for x in ("keys", "bytes"))
            buckets = old_buckets
            while held > ROWS_PER_BUCKET * buckets or size > BYTES_PER_BUCKET * buckets:
                buckets *= 2
        elif buckets is None:
            n = changes.count()
            buckets = max(1, min(parallelism(self.spark), -(-n // SMALL_BUCKET)), -(-n // ROWS_PER_BUCKET))
        types = [_duckdb_type(k) for k in kinds]
        reduced = rows.mapInArrow(_reduce_split(types), schema)
        if old and buckets != old_buckets:
            every = self.spark.range(buckets).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema), F.col("id").cast("int").alias("b"))
            reduced = reduced.withColumn("b", F.pmod("h", F.lit(buckets)).cast("int")).unionByName(every)
        else:
            reduced = reduced.withColumn("b", F.pmod("h", F.lit(buckets)).cast("int"))
        previous = {int(k): v for k, v in old["files"].items()} if old else {}
        done = reduced.repartitionById(buckets, F.col("b")).mapInArrow(_apply_bucket(types, f"{self.path}/data", previous, buckets, old_buckets), _COMMIT)
        # one row per bucket; a file of a failed or repeated attempt is named by no row and so by no manifest
        commits = done.collect()
        if old and not commits:
            return old
        files = {} if buckets != old_buckets else dict(old["files"])
        for r in commits:
            one = {"file": r["file"], "keys": r["keys"], "bytes": r["bytes"], "max_sequence": r["max_sequence"]}
            files[str(r["bucket"])] = [one] if r["whole"] else [*files[str(r["bucket"])], one]
        new = {"version": len(self.versions()) + 1, "buckets": buckets, "values": feed.values, "types": kinds, "files": files}
        if not durable.put_if_absent(self.spark, f"{self.path}/_versions/{new['version']:020d}.json", new):
            raise Aborted("another writer published this version first; apply the changes again")
        return new

    def rows(self) -> DataFrame:
        """All stored rows with tombstones: key, sequence, arrival, deleted and the values. Only buckets with deltas are merged."""
        m = self.manifest() or {"values": [], "types": ["string"], "files": {}}
        names, types = m["values"], m["types"]
        schema = f"k {types[0]}, s bigint, a bigint, d boolean" + "".join(f", v{i} {kind}" for i, kind in enumerate(types[1:]))
        read = lambda groups: self.spark.read.schema(schema).parquet(*[f["file"] for g in groups for f in g])
        single, several = [g for g in m["files"].values() if len(g) == 1], [g for g in m["files"].values() if len(g) > 1]
        df = read(single) if single else self.spark.createDataFrame([], schema)
        if several:
            rest = [c for c in df.columns if c != "k"]
            best = read(several).groupBy("k").agg(F.max_by(F.struct(*rest), F.struct("s", -F.col("a"))).alias("r")).select("k", "r.*")
            df = df.unionByName(best) if single else best
        return df.select(F.col("k").alias("key"), F.col("s").alias("sequence"), F.col("a").alias("arrival"), F.col("d").alias("deleted"), *(F.col(f"v{i}").alias(n) for i, n in enumerate(names)))

    def live(self) -> DataFrame:
        return self.rows().where(~F.col("deleted")).drop("deleted", "arrival")

    def vacuum(self) -> int:
        """Remove files that no version names; the number removed."""
        named = {f["file"].rsplit("/", 1)[1] for v in self.versions() for files in durable.read_json(self.spark, v)["files"].values() for f in files}
        gone = [p for p, _ in durable.listing(self.spark, f"{self.path}/data") if p.rsplit("/", 1)[1] not in named]
        for p in gone:
            durable.remove(self.spark, p)
        return len(gone)


def replay(changes: DataFrame, feed: Feed) -> BucketedTable:
    """Rebuild a table from its whole change log in a new place of the shared folder."""
    spark = changes.sparkSession
    out = BucketedTable(spark, new_path(spark, "changefeed"))
    out.apply(changes, feed)
    return out
