"""Size-tiered incremental compaction with a journal of merges.

Planning works on the file registry alone. Files too small are grouped with files of similar size: the files of a tier are
merged until a merge reaches the next tier, its output joins that tier's files, and so on level by level up to the
target size. What is left below the target at the end is merged once more. Planning is split into shards of SHARD_FILES files by a hash
of their paths; a shard's tiers are planned in one task, on paths and sizes only.

The records are moved once, straight from the original files to the last output, which is one file sorted by key; a record
(key, sequence) held by several inputs is kept once, from the smallest record id.

Each merge is a transaction named by a hash of its sorted inputs. A run commits its merges in one atomic step of the journal, which
retires their inputs and registers their outputs; the next plan starts from the registry so changed, so what was merged is not
merged again, a repeated run changes nothing, and new small files (and outputs that are still too small) are all that later runs
move. A run that fails before its commit leaves no trace but unnamed files. Records that an earlier run moved from another
file are not moved a second time.

Defined results: a file's counting registration is its latest (of equal times the greatest row). Size is file_size if
positive, else the end of its last index block, else 0; a file of size 0 is planned, not chosen, by its entries times the
mean bytes of an entry in the other small files. Files without records still take part, with the records they
have (none). Null keys are a key of their own. Registered files that are not live are left alone. An empty registry plans nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.errors import Aborted, Internal
from stratalog.operators.incremental import counting_registrations
from stratalog.session import new_path, parallelism, settle, ship
from stratalog.sources import durable

SMALL_BYTES = 65_536
TARGET_BYTES = 4 << 20
#: Each tier holds files up to this many times the size of the one below.
FAN_OUT = 4
SHARD_FILES = 50_000
#: Planned bytes that one task writes; an output is always written by one task.
TASK_BYTES = 64 << 20
RECORD = ["entry_id", "entry_key", "sequence_number", "is_deleted", "entry_value"]
#: Bytes of an entry where no small file has both a size and a count of entries.
ENTRY_BYTES = 1024


def sized_files(meta: DataFrame, index: DataFrame) -> DataFrame:
    """Counting registrations with ``size``, the bytes a file really takes."""
    ends = index.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.max(F.col("block_offset") + F.col("block_size")).alias("_end"))
    known = F.when(F.col("file_size") > 0, F.col("file_size"))
    return counting_registrations(meta).join(ends, "file_path", "left").withColumn("size", F.coalesce(known, F.col("_end"), F.lit(0)).cast("bigint")).drop("_end")


def small_files(files: DataFrame, below: int = SMALL_BYTES) -> DataFrame:
    return files.where((F.col("state") == "live") & (F.col("size") < below))


def tiers(below: int = SMALL_BYTES, target: int = TARGET_BYTES) -> list[int]:
    """Upper bounds of the tiers, ending with the target."""
    out = [target]
    while out[0] > below // (FAN_OUT**3):
        out.insert(0, out[0] // FAN_OUT)
    return out


def with_entries(small: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Small files with ``n``, the entries by the registry; of a file of size 0 also those it holds, if that is more."""
    files = small.select("file_path", "size", (F.greatest("entry_count", F.lit(0)) if "entry_count" in small.columns else F.lit(0)).cast("bigint").alias("n"))
    if entries is None:
        return files
    unsized = files.where("size = 0").select("file_path")
    held = entries.join(unsized, "file_path", "left_semi").groupBy("file_path").agg(F.count("*").alias("held"))
    return files.join(held, "file_path", "left").select("file_path", "size", F.greatest("n", "held").alias("n"))


def _plan_shard(bounds: list[int]):
    """All tiers of one shard: rows of kind merge (inputs and output) and file (the output in which a file's records end)."""

    def plan(shard):
        import hashlib

        import numpy as np
        import pandas as pd

        names, sizes = shard["file_path"].tolist(), shard["bytes"].to_numpy(np.int64)
        number = int(shard["shard"].iloc[0])
        leaves = set(names)
        units, parent, merges = dict(zip(names, sizes.tolist(), strict=True)), {}, []
        for tier, bound in enumerate(bounds):
            last = tier == len(bounds) - 1
            here = sorted((size, name) for name, size in units.items() if last or size < bound)
            groups: dict[int, list[tuple[int, str]]] = {}
            total = 0
            for size, name in here:
                groups.setdefault(total // bound, []).append((size, name))
                total += size
            for group in groups.values():
                if len(group) == 1 and not last:
                    continue  # a lone file moves up unmerged, except at the end where it gets its own output
                inputs = sorted(name for _, name in group)
                txn = hashlib.sha256("|".join(inputs).encode()).hexdigest()[:24]
                output = f"./data/compacted_{txn}.sst"
                size = sum(x for x, _ in group)
                merges.append((txn, output, tier, inputs, [x for x in inputs if x in leaves], size))
                for name in inputs:
                    parent[name] = output
                    del units[name]
                units[output] = size
        final = {output: i for i, output in enumerate(sorted(units))}
        ends = []
        for name in names:
            end = name
            while end in parent:
                end = parent[end]
            ends.append(end)
        files = pd.DataFrame({"kind": "file", "shard": number, "file_path": names, "output": ends, "number": [final[x] for x in ends], "bytes": sizes})
        log = pd.DataFrame(merges, columns=["txn", "output", "tier", "inputs", "files", "bytes"]).assign(kind="merge", shard=number)
        columns = ["kind", "shard", "number", "file_path", "txn", "output", "tier", "inputs", "files", "bytes"]
        out = pd.concat([files.reindex(columns=columns), log.reindex(columns=columns)], ignore_index=True)
        lists = out["kind"] == "merge"
        for c in ("inputs", "files"):
            out[c] = out[c].where(lists, None)
        return out.astype({"number": "Int32", "tier": "Int32", "shard": "int32", "bytes": "int64"})

    return plan


_PLAN = "kind string, shard int, number int, file_path string, txn string, output string, tier int, inputs array<string>, files array<string>, bytes bigint"


def plan_merges(small: DataFrame, target: int = TARGET_BYTES, below: int = SMALL_BYTES, shards: int | None = None, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(assignment, journal): file_path -> output with its shard, number and planned bytes, and one row per merge with its transaction, tier, inputs, those of them that are files, and planned bytes."""
    ship(small.sparkSession)
    files = settle(with_entries(small, entries), "compaction-files")
    known = F.when((F.col("size") > 0) & (F.col("n") > 0), True)
    facts = files.agg(F.count("*").alias("files"), (F.sum(F.when(known, F.col("size"))) / F.sum(F.when(known, F.col("n")))).alias("mean")).first()
    if shards is None:
        shards = max(1, -(-facts["files"] // SHARD_FILES))
    weight = F.when(F.col("size") > 0, F.col("size")).otherwise(F.ceil(F.col("n") * F.lit(float(facts["mean"] or ENTRY_BYTES))))
    units = files.select("file_path", F.pmod(F.xxhash64("file_path"), F.lit(shards)).cast("int").alias("shard"), F.greatest(weight, F.lit(1)).cast("bigint").alias("bytes"))
    plan = settle(units.groupBy("shard").applyInPandas(_plan_shard(tiers(below, target)), _PLAN), "compaction-plan")
    return plan.where("kind = 'file'").select("file_path", "output", "shard", "number", "bytes"), plan.where("kind = 'merge'").select("txn", "output", "tier", "inputs", "files", "bytes")


def merged_records(entries: DataFrame, assignment: DataFrame) -> DataFrame:
    """The records of the planned inputs with their output, each (entry_key, sequence_number) once.

    Reduced by a map-side aggregate on the record, so a key with any share of all rows is no hot spot (its records differ by sequence).
    """
    rest = ["entry_id", "is_deleted", "entry_value"]
    place = ["shard", "number", "output"]
    rows = entries.select("file_path", "entry_key", "sequence_number", *rest).join(assignment.select("file_path", *place), "file_path")
    kept = rows.groupBy("entry_key", "sequence_number").agg(F.min_by(F.struct(*place, *rest), F.struct("entry_id", "output")).alias("r"))
    return kept.select("entry_key", "sequence_number", "r.*")


class Compactor:
    """Plans and runs merges against a journal: plan, data, commit. Each step may be repeated after a failure."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> list[dict]:
        return [durable.read_json(self.spark, p) for p, _ in durable.listing(self.spark, f"{self.path}/_journal", ".json")]

    def journal(self) -> DataFrame:
        """Every committed merge."""
        folders = [c["merges"] for c in self.commits()]
        schema = "txn string, output string, tier int, inputs array<string>, files array<string>, bytes bigint"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def retired(self) -> DataFrame:
        """Files whose records have moved."""
        return self.journal().select(F.explode("files").alias("file_path"))

    def outputs(self) -> DataFrame:
        """Registered outputs that are not retired: file_path, size and entries as written, and where they are."""
        folders = [c["outputs"] for c in self.commits()]
        schema = "file_path string, size bigint, entry_count bigint, commit int, shard int, number int"
        made = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return made.join(self.retired(), "file_path", "left_anti")

    def records(self, outputs: DataFrame | None = None) -> DataFrame:
        """The records of all outputs that are not retired (or of the ones given), with file_path, the output they are in."""
        wanted = self.outputs() if outputs is None else outputs
        commits = self.commits()
        schema = "entry_id bigint, entry_key string, sequence_number bigint, is_deleted boolean, entry_value string, shard int, number int"
        parts = [self.spark.read.schema(schema).parquet(c["records"]).withColumn("commit", F.lit(i)) for i, c in enumerate(commits) if c["rows"]]
        if not parts:
            return self.spark.createDataFrame([], "file_path string, entry_id bigint, entry_key string, sequence_number bigint, is_deleted boolean, entry_value string")
        held = parts[0]
        for part in parts[1:]:
            held = held.unionByName(part)
        return held.join(wanted.select("file_path", "commit", "shard", "number"), ["commit", "shard", "number"]).select("file_path", *RECORD)

    def run(self, meta: DataFrame, index: DataFrame, entries: DataFrame, target: int = TARGET_BYTES, below: int = SMALL_BYTES) -> dict | None:
        """Merge what the registry and the journal leave too small; the commit, or None if there was nothing to do."""
        commits = self.commits()
        small = small_files(sized_files(meta, index), below)
        small = small.select("file_path", "size", (F.col("entry_count") if "entry_count" in small.columns else F.lit(0)).cast("bigint").alias("entry_count"))
        again = None
        if commits:
            small = small.join(self.retired(), "file_path", "left_anti")
            again = self.outputs().where(F.col("size") < below)
            if small.isEmpty():
                return None  # outputs that are still small wait for new files to join them
            small = small.unionByName(again.select("file_path", "size", "entry_count"))
        assignment, journal = plan_merges(small, target, below, entries=entries)
        facts = assignment.agg(F.count("*").alias("inputs"), F.count_distinct("output").alias("outputs"), F.sum("bytes").alias("bytes")).first()
        if not facts["inputs"]:
            return None
        held = entries.select("file_path", *RECORD)
        if commits:
            held = held.unionByName(self.records(again)) if again is not None else held
        records = merged_records(held, assignment)
        if commits:
            # what an earlier run moved into an output that stays is not moved again: the new records, not the old ones, are sent around
            staying = self.records(self.outputs().where(F.col("size") >= below)).select("entry_key", "sequence_number")
            records = settle(records, "compaction-records")
            same = F.col("entry_key").eqNullSafe(F.col("_k")) & F.col("sequence_number").eqNullSafe(F.col("_s"))
            twice = staying.join(records.select(F.col("entry_key").alias("_k"), F.col("sequence_number").alias("_s")), same, "left_semi").distinct()
            records = records.join(twice.select(F.col("entry_key").alias("_k"), F.col("sequence_number").alias("_s")), same, "left_anti")
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        # one sorted file per output: its records meet in one task, which writes output after output
        tasks = max(1, min(facts["outputs"], max(parallelism(self.spark), -(-facts["bytes"] // TASK_BYTES))))
        sorted_rows = records.select("shard", "number", *RECORD).repartition(tasks, "shard", "number").sortWithinPartitions("shard", "number", "entry_key", "sequence_number")
        sorted_rows.write.partitionBy("shard", "number").parquet(f"{folder}/records")
        sizes = _written(self.spark, f"{folder}/records")
        made = self.spark.createDataFrame(sizes, "shard int, number int, size bigint, rows bigint")
        named = assignment.select("shard", "number", F.col("output").alias("file_path")).distinct()
        registered = named.join(made, ["shard", "number"], "left").select("file_path", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("rows", F.lit(0)).alias("entry_count"), F.lit(len(commits)).alias("commit"), "shard", "number")
        registered.write.parquet(f"{folder}/outputs")
        journal.write.parquet(f"{folder}/merges")
        commit = {"inputs": facts["inputs"], "outputs": f"{folder}/outputs", "records": f"{folder}/records", "merges": f"{folder}/merges", "files": len(sizes), "rows": sum(x[3] for x in sizes)}
        if not durable.put_if_absent(self.spark, f"{self.path}/_journal/{len(commits) + 1:020d}.json", commit):
            raise Aborted("another run committed its merges first; run again on what it left")
        return commit


def _written(spark: SparkSession, folder: str) -> list[tuple[int, int, int, int]]:
    """(shard, number, bytes, rows) of each output from its one file's name and footer; one row per output of a commit."""
    import re
    from concurrent.futures import ThreadPoolExecutor

    import pyarrow.parquet as pq
    from pyarrow import fs

    from stratalog.session import qualified

    found = [(qualified(spark, p), n, re.search(r"shard=(\d+)/number=(\d+)/", p)) for p, n in durable.listing_below(spark, folder, ".parquet")]

    def rows(uri: str) -> int:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            return pq.ParquetFile(f).metadata.num_rows

    found = [x for x in found if x[2]]  # a write without rows leaves a file outside of any output
    if len({(m[1], m[2]) for _, _, m in found}) != len(found):
        raise Internal("an output was written as several files")
    with ThreadPoolExecutor(16) as pool:
        return [(int(m[1]), int(m[2]), n, k) for (_, n, m), k in zip(found, pool.map(rows, [x[0] for x in found]), strict=True)]


def compact(meta: DataFrame, index: DataFrame, entries: DataFrame, path: str | None = None) -> Compactor:
    """Merge all files that are too small through a committed transaction; the compactor holds records, outputs and journal."""
    out = Compactor(meta.sparkSession, path or new_path(meta.sparkSession, "compaction"))
    out.run(meta, index, entries)
    return out
