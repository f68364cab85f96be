"""Immutable table versions: a log of manifests that add files, remove files and set deletion vectors.

A version never changes once published. Data files hold the rows; a deletion vector is a set of 4 KB bitmaps over
the row positions of a file. A version writes vectors for the files it touches and for no others, so the difference of two versions
is found from the manifests alone: a reader that knows the version it has processed reads only the files and bitmaps that differ.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.sources import durable

#: A deletion vector up to this many bytes is broadcast; a larger one is joined by shuffle. The number of its bitmaps is in the manifest.
DV_BROADCAST_BYTES = 8 << 20
BITMAP_BYTES = 4096
#: Versions after which the state is written whole, so that replay stays short.
SNAPSHOT_EVERY = 20


@dataclass
class State:
    """Files live at a version, the deletion vector of each file that has one, and what writers noted."""

    version: int
    files: dict[str, str] = field(default_factory=dict)  # file name -> full path
    vectors: dict[str, list] = field(default_factory=dict)  # file name -> folder and number of its bitmaps
    notes: dict = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self, version: int) -> str:
        return f"{self.path}/_log/{version:020d}.json"

    def latest(self) -> int:
        found = durable.listing(self.spark, f"{self.path}/_log", ".json")
        return int(found[-1][0].rsplit("/", 1)[1][:20]) if found else 0

    def state(self, version: int | None = None) -> State:
        """Replay of the manifests up to ``version``; version 0 is the empty table."""
        version = self.latest() if version is None else version
        out, start = State(version), 0
        snaps = [p for p, _ in durable.listing(self.spark, f"{self.path}/_snapshots", ".json") if int(p.rsplit("/", 1)[1][:20]) <= version]
        if snaps:
            d = durable.read_json(self.spark, snaps[-1])
            out.files, out.vectors, out.notes, start = d["files"], d["vectors"], d["notes"], int(snaps[-1].rsplit("/", 1)[1][:20])
        for v in range(start + 1, version + 1):
            log = durable.read_json(self.spark, self._log(v))
            for name, path in log.get("add", {}).items():
                out.files[name] = path
            for name in log.get("remove", []):
                out.files.pop(name, None)
                out.vectors.pop(name, None)
            out.vectors |= {name: v for name, v in log.get("vectors", {}).items() if name in out.files}
            out.notes |= log.get("notes", {})
        return out

    def publish(self, actions: dict, since: int | None = None) -> int:
        """Publish a version; ``since`` is the one the actions were computed from."""
        version = (self.latest() if since is None else since) + 1
        if not durable.put_if_absent(self.spark, self._log(version), actions):
            raise RuntimeError(f"version {version} was published by another writer; retry on the new state")
        if version % SNAPSHOT_EVERY == 0:
            state = self.state(version)
            durable.put_if_absent(self.spark, f"{self.path}/_snapshots/{version:020d}.json", {"files": state.files, "vectors": state.vectors, "notes": state.notes})
        return version

    def write(self, df: DataFrame) -> dict[str, str]:
        """Write the rows as files that no version names yet: file name -> full path."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return {p.rsplit("/", 1)[1]: p for p, _ in durable.listing(self.spark, folder, ".parquet")}

    def append(self, df: DataFrame, remove: list[str] | None = None) -> int:
        """Publish a version with the rows of ``df`` added (and the named files removed)."""
        return self.publish({"add": self.write(df), "remove": remove or []})

    def rows(self, files: dict[str, str], schema=None) -> DataFrame:
        """Rows of the given files with their position: columns _file and _row are added."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        df = reader.parquet(*files.values())
        return df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def write_vectors(self, positions: DataFrame, state: State) -> dict[str, list]:
        """Write the vectors of the files that ``positions`` (_file, _row) touches, together with what was deleted in them before: file name -> folder and number of bitmaps."""
        folder = f"{self.path}/vectors/{uuid.uuid4().hex}"
        bits = positions.groupBy("_file", F.bitmap_bucket_number(F.col("_row") + 1).alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_row") + 1)).alias("_bits"))
        old = self._vectors(state.vectors)
        if old is not None:
            bits.write.parquet(f"{folder}/new")
            bits = self.spark.read.schema("_file string, _block bigint, _bits binary").parquet(f"{folder}/new")
            old = old.join(bits.select("_file").distinct(), "_file", "left_semi")
            bits = bits.unionByName(old).groupBy("_file", "_block").agg(F.bitmap_or_agg("_bits").alias("_bits"))
        bits.write.parquet(f"{folder}/all")
        counts = self.spark.read.schema("_file string, _block bigint").parquet(f"{folder}/all").groupBy("_file").count().collect()  # one row per touched file
        return {r["_file"]: [f"{folder}/all", r["count"]] for r in counts}

    def delete_positions(self, positions: DataFrame, version: int | None = None) -> int:
        """Publish a version in which the rows at (_file, _row) are deleted, beside those deleted before."""
        return self.publish({"vectors": self.write_vectors(positions, self.state(version))})

    def _vectors(self, vectors: dict[str, list]) -> DataFrame | None:
        if not vectors:
            return None
        folders = sorted({v[0] for v in vectors.values()})
        df = self.spark.read.schema("_file string, _block bigint, _bits binary").parquet(*folders)
        # a folder also holds what a later one replaced: each file's bitmaps count from its own folder only
        named = self.spark.createDataFrame([(name, v[0].rsplit("/", 2)[1]) for name, v in vectors.items()], "_file string, _folder string")
        return df.withColumn("_folder", F.element_at(F.split("_metadata.file_path", "/"), -3)).join(named, ["_file", "_folder"], "left_semi").drop("_folder")

    def _marked(self, rows: DataFrame, vectors: dict[str, list]) -> DataFrame:
        """``rows`` with _deleted: is the row's bit set in the vectors?"""
        bits = self._vectors(vectors)
        if bits is None:
            return rows.withColumn("_deleted", F.lit(False))
        if sum(v[1] for v in vectors.values()) * BITMAP_BYTES <= DV_BROADCAST_BYTES:
            bits = F.broadcast(bits)
        at = F.bitmap_bit_position(F.col("_row") + 1)
        byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1, F.lit(False))
        joined = rows.withColumn("_block", F.bitmap_bucket_number(F.col("_row") + 1)).join(bits, ["_file", "_block"], "left")
        return joined.withColumns({"_at": at, "_byte": byte}).withColumn("_deleted", hit).drop("_block", "_bits", "_at", "_byte")

    def marked(self, state: State) -> DataFrame:
        """All rows of a version with _file, _row and _deleted."""
        return self._marked(self.rows(state.files), {k: v for k, v in state.vectors.items() if k in state.files})

    def read(self, version: int | None = None) -> DataFrame | None:
        state = self.state(version)
        return self._live(state.files, state.vectors) if state.files else None

    def _live(self, files: dict[str, str], vectors: dict[str, list]) -> DataFrame:
        own = {k: v for k, v in vectors.items() if k in files}
        return self._marked(self.rows(files), own).where(~F.col("_deleted")).drop("_file", "_row", "_deleted")

    @staticmethod
    def difference(a: State, b: State) -> tuple[dict, dict, dict]:
        """Files added, files removed and files whose vectors differ: all that a reader of the changes opens."""
        added = {k: v for k, v in b.files.items() if k not in a.files}
        gone = {k: v for k, v in a.files.items() if k not in b.files}
        cut = {k: v for k, v in b.files.items() if k in a.files and a.vectors.get(k) != b.vectors.get(k)}
        return added, gone, cut

    def changes(self, old: int, new: int | None = None) -> DataFrame | None:
        """Rows that differ between two versions, with _change 1 (added) or -1 (gone); None if no manifest differs."""
        a, b = self.state(old), self.state(new)
        added, gone, cut = self.difference(a, b)
        parts = []
        if added:
            parts.append(self._live(added, b.vectors).withColumn("_change", F.lit(1)))
        if gone:
            parts.append(self._live(gone, a.vectors).withColumn("_change", F.lit(-1)))
        if cut:
            before = self._marked(self.rows(cut), {k: v for k, v in a.vectors.items() if k in cut}).withColumnRenamed("_deleted", "_before")
            after = self._marked(before, {k: v for k, v in b.vectors.items() if k in cut})
            parts.append(after.where(F.col("_deleted") & ~F.col("_before")).drop("_file", "_row", "_deleted", "_before").withColumn("_change", F.lit(-1)))
        if not parts:
            return None
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


class Consumer:
    """Takes each change of a source table exactly once: the processed version is saved in the output's own commit.

    A run that fails before its commit leaves no trace but unreferenced files, and the next run takes the same changes
    again; a run that committed is never repeated, as its version is the starting point of the next.
    """

    def __init__(self, source: VersionedTable, out: str):
        self.source, self.out, self.spark = source, out.rstrip("/"), source.spark

    def _named(self) -> list[str]:
        return [p for p, _ in durable.listing(self.spark, f"{self.out}/_commits", ".json")]

    def processed(self) -> int:
        named = self._named()
        return durable.read_json(self.spark, named[-1])["processed"] if named else 0

    def run(self, transform=None) -> int | None:
        """Process what is new; the number of the commit, or None if there was nothing."""
        n, start, end = len(self._named()) + 1, self.processed(), self.source.latest()
        delta = self.source.changes(start, end) if end > start else None
        if delta is None:
            return None
        folder = f"{self.out}/data/{uuid.uuid4().hex}"
        (transform(delta) if transform else delta).write.parquet(folder)
        if not durable.put_if_absent(self.spark, f"{self.out}/_commits/{n:020d}.json", {"from": start, "processed": end, "data": folder}):
            raise RuntimeError("another run of this consumer committed first")
        return n

    def output(self, schema: str) -> DataFrame:
        """All rows committed so far."""
        folders = [durable.read_json(self.spark, p)["data"] for p in self._named()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
