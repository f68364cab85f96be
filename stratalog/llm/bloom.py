"""Has this key been seen before? Scalable Bloom chains over a stream of keys in order of writing.

Keys are split by hash over shards. Each shard keeps a chain of Bloom filters: when a layer has taken the keys it was
made for, a layer of twice the size and half the error rate is added, so the chance of a wrong "seen" stays below
``error * (1/2 + 1/4 + ...) = error`` however long the history grows, in about 1.44 * log2(1/rate) bits a key. No key is kept.

Rows travel as a 64-bit hash and a record number. Before the shuffle each input split reduces its records to the first one
of each key; the others are certainly seen, so a key with any share of all rows reaches its shard once per split. Shards are
read as sorted streams, a batch at a time: memory is the chain's, not the shard's. The chain takes a batch in blocks of at
most a sixteenth of the keys it holds. Repeats inside a block are found exactly, the chain answers for everything before it; so
each key is asked of nearly the chain that a key at a time would meet, on small inputs too.

The chains can be kept in a folder (ChainStore): each shard's chain is a file, a version of all shards is one manifest, and the next
run goes on from there without reading old keys again.

The chain never misses a seen key. What was called seen is checked exactly afterwards, by bytes, over the keys whose hash is among
those: of all other keys neither history nor records are looked at. The check also measures the rate of wrong answers, and takes
back answers that a collision of the 64-bit hash has caused.

Defined results: records with a null key or number are left out; a record delivered twice counts once; keys are compared by
bytes; the empty string is a key. Without history every first record is unseen.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.session import parallelism, qualified, settle
from stratalog.sources import durable

ERROR_RATE = 0.01
FIRST_LAYER = 1024
GROWTH, TIGHTENING = 2, 0.5
#: Keys are asked of the chain and added to it in blocks of this share of the keys it holds, and of so many at least.
BLOCK_SHARE, LEAST_BLOCK = 1 / 16, 16
HISTORY, RECORD = 0, 1
#: Keys that a shard should take about; its chain is then about 8 MB. Fewer keys than SMALL_SHARD are not split further.
KEYS_PER_SHARD, SMALL_SHARD = 4_000_000, 10_000
#: Hashes to be checked up to this many are sent to the keys; of more, the keys are reduced first.
CHECK_BROADCAST = 2_000_000
#: Rows that are reduced together before the shuffle.
REDUCE_ROWS = 400_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A second hash from the first (finalizer of a public 64-bit generator)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Layer:
    def __init__(self, capacity: int, error: float):
        self.capacity, self.error, self.count = capacity, error, 0
        self.hashes = max(1, int(np.ceil(-np.log2(error))))
        self.size = np.uint64(max(64, int(np.ceil(capacity * -np.log(error) / np.log(2) ** 2))))
        self.bits = np.zeros((int(self.size) + 7) // 8, np.uint8)

    def _places(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(self.hashes):
            at = (a + np.uint64(i) * b + np.uint64(i * i)) % self.size
            yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(a.size, bool)
        for byte, bit in self._places(a, b):
            out &= (self.bits[byte] & bit) != 0
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for byte, bit in self._places(a, b):
            np.bitwise_or.at(self.bits, byte, bit)
        self.count += a.size

    def to_bytes(self) -> bytes:
        return struct.pack("<qdq", self.capacity, self.error, self.count) + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Layer:
        capacity, error, count = struct.unpack_from("<qdq", data)
        out = cls(capacity, error)
        out.count, out.bits = count, np.frombuffer(data, np.uint8, offset=24).copy()
        return out

    def fill(self) -> float:
        return float(np.unpackbits(self.bits).sum()) / float(self.size)


class BloomChain:
    """Layers of growing size and falling error; the compounded error stays below ``error``."""

    def __init__(self, error: float = ERROR_RATE, first: int = FIRST_LAYER):
        self.error, self.layers = error, [Layer(first, error * TIGHTENING)]

    def seen_then_add(self, hashes: np.ndarray) -> np.ndarray:
        """For each 64-bit hash in order: seen before (in earlier calls, or earlier in this one)?"""
        h, out, at = hashes.astype(np.int64).view(np.uint64), [], 0
        while at < h.size:
            block = max(LEAST_BLOCK, int(sum(x.count for x in self.layers) * BLOCK_SHARE))
            out.append(self._block(h[at : at + block]))
            at += block
        return np.concatenate(out) if out else np.zeros(0, bool)

    def _block(self, h: np.ndarray) -> np.ndarray:
        """The same for a block, in which repeats are found exactly."""
        _, first = np.unique(h, return_index=True)
        seen = np.ones(h.size, bool)
        first.sort()
        a = _mix(h[first])
        b = _mix(a ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        known = np.zeros(first.size, bool)
        for layer in self.layers:
            known |= layer.has(a, b)
        seen[first] = known
        a, b = a[~known], b[~known]
        while a.size:
            top = self.layers[-1]
            room = top.capacity - top.count
            if room <= 0:
                self.layers.append(Layer(top.capacity * GROWTH, top.error * TIGHTENING))
                continue
            top.add(a[:room], b[:room])
            a, b = a[room:], b[room:]
        return seen

    def to_bytes(self) -> bytes:
        parts = [x.to_bytes() for x in self.layers]
        return struct.pack(f"<dI{len(parts)}q", self.error, len(parts), *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomChain:
        error, n = struct.unpack_from("<dI", data)
        sizes = struct.unpack_from(f"<{n}q", data, 12)
        out, at = cls(error), 12 + 8 * n
        out.layers = []
        for size in sizes:
            out.layers.append(Layer.from_bytes(data[at : at + size]))
            at += size
        return out

    def bound(self) -> float:
        """Bound of the compounded false-positive rate of the layers there are."""
        return 1 - float(np.prod([1 - x.error for x in self.layers]))

    def expected(self) -> float:
        """The rate that the present fill of the layers gives."""
        return 1 - float(np.prod([1 - x.fill() ** x.hashes for x in self.layers]))


def _first_of_split(batches: Iterator) -> Iterator:
    """Keep the first record of each key for the shards; the others are certainly seen. Works on runs of REDUCE_ROWS, so memory is bounded."""
    import pyarrow as pa

    kept, size = [], 0
    for b in batches:
        if b.num_rows:
            kept.append(b)
            size += b.num_rows
        if size >= REDUCE_ROWS:
            yield from _reduced(pa.Table.from_batches(kept))
            kept, size = [], 0
    if kept:
        yield from _reduced(pa.Table.from_batches(kept))


def _reduced(table) -> Iterator:
    """A run's rows with ``certain``; a history key and a copy of a record are kept once."""
    import pyarrow as pa

    x = table.to_pandas().drop_duplicates(["kind", "h", "n"])
    x["certain"] = (x["kind"] == RECORD) & (x["n"] > x.groupby(["kind", "h"])["n"].transform("min"))
    yield from pa.Table.from_pandas(x, preserve_index=False).to_batches(max_chunksize=50_000)


class ChainStore:
    """Chains in a folder: a file per shard and version, and a manifest per version that names each shard's latest file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, qualified(spark, path.rstrip("/"))

    def manifest(self) -> dict | None:
        found = durable.listing(self.spark, f"{self.path}/_versions", ".json")
        return durable.read_json(self.spark, found[-1][0]) | {"version": len(found)} if found else None

    def publish(self, old: dict | None, shards: int, files: dict[str, str]) -> None:
        new = {"shards": shards, "files": (old["files"] if old else {}) | files}
        if not durable.put_if_absent(self.spark, f"{self.path}/_versions/{(old['version'] if old else 0) + 1:020d}.json", new):
            raise RuntimeError("another run published these chains first; ask again")


def _walk_shards(error: float, saved: dict[str, str], folder: str | None):
    """Stream a sorted partition through its shards' chains: the history first, then the records by number.

    A shard goes on from its saved chain. With a folder, its chain is written there under a name of its own when the shard ends.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        shard, chain, last = None, None, None

        def opened(n: int) -> BloomChain:
            if str(n) not in saved:
                return BloomChain(error)
            system, path = fs.FileSystem.from_uri(saved[str(n)])
            with system.open_input_file(path) as f:
                return BloomChain.from_bytes(f.read())

        def closing():
            layers, uri = chain.layers, None
            if folder:
                uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
                system, path = fs.FileSystem.from_uri(uri)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as f:
                    f.write(chain.to_bytes())
            return pa.RecordBatch.from_pydict(
                {"n": pa.array([None], pa.int64()), "h": pa.array([None], pa.int64()), "seen": pa.array([None], pa.bool_()), "shard": pa.array([shard], pa.int32()), "layers": pa.array([len(layers)], pa.int32()), "keys": pa.array([sum(x.count for x in layers)], pa.int64()),
                 "bits": pa.array([sum(int(x.size) for x in layers)], pa.int64()), "bound": pa.array([chain.bound()], pa.float64()), "expected": pa.array([chain.expected()], pa.float64()), "file": pa.array([uri], pa.string())}
            )

        for batch in batches:
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            hashes, numbers = batch.column("h").to_numpy(), batch.column("n").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), shards.size]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if shards[i] != shard:
                    if chain is not None:
                        yield closing()
                    shard, last = int(shards[i]), None
                    chain = opened(shard)
                # copies of a record from several splits follow each other
                record, n = kinds[i:j] == RECORD, numbers[i:j].astype(np.int64)
                again = record & np.concatenate(([last is not None and bool(record[0]) and n[0] == last], record[:-1] & (n[1:] == n[:-1])))
                last = int(n[-1]) if record[-1] else None
                keep = ~again
                h = hashes[i:j][keep]
                seen = chain.seen_then_add(h)
                out = record[keep]
                m = int(out.sum())
                if m:
                    none = lambda kind: pa.nulls(m, kind)  # noqa: B023, E731
                    yield pa.RecordBatch.from_pydict(
                        {"n": pa.array(n[keep][out], pa.int64()), "h": pa.array(h[out], pa.int64()), "seen": pa.array(seen[out]), "shard": none(pa.int32()), "layers": none(pa.int32()), "keys": none(pa.int64()), "bits": none(pa.int64()), "bound": none(pa.float64()), "expected": none(pa.float64()), "file": none(pa.string())}
                    )
        if chain is not None:
            yield closing()

    return run


def _key(name: str):
    return F.col(f"`{name}`").cast("string")


def shard_count(spark: SparkSession, rows: int) -> int:
    """Shards for that many rows: one a task, unless they are few or a chain would grow too large."""
    return max(1, min(parallelism(spark), -(-rows // SMALL_SHARD)), -(-rows // KEYS_PER_SHARD))


def bloom_pass(history: DataFrame | None, records: DataFrame, history_key: str, record_key: str, record_id: str, error: float = ERROR_RATE, shards: int | None = None, store: ChainStore | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, chains). answers: n, h, seen, certain for each distinct record; chains: one row per shard's chain.

    With a store the chains go on from its last version and the next one is published. Its first version fixes the number of shards;
    a chain has no end, so it may be given for the keys that are expected.
    """
    spark = records.sparkSession
    rows = records.where(F.col(f"`{record_key}`").isNotNull() & F.col(f"`{record_id}`").isNotNull()).select(F.lit(RECORD).alias("kind"), F.xxhash64(_key(record_key)).alias("h"), F.col(f"`{record_id}`").cast("bigint").alias("n"))
    if history is not None:
        old = history.where(F.col(f"`{history_key}`").isNotNull()).select(F.lit(HISTORY).alias("kind"), F.xxhash64(_key(history_key)).alias("h"), F.lit(-(1 << 63)).cast("bigint").alias("n"))
        rows = old.unionByName(rows)
    manifest = store.manifest() if store else None
    reduced = settle(rows.mapInArrow(_first_of_split, "kind int, h bigint, n bigint, certain boolean"), "bloom-firsts")
    if manifest:
        shards = manifest["shards"]
    elif shards is None:
        shards = shard_count(spark, reduced.count())
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")
    stream = reduced.where(~F.col("certain")).select("kind", "h", "n", shard.alias("shard")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "n", "h")
    schema = "n bigint, h bigint, seen boolean, shard int, layers int, keys bigint, bits bigint, bound double, expected double, file string"
    walked = settle(stream.mapInArrow(_walk_shards(error, manifest["files"] if manifest else {}, f"{store.path}/chains" if store else None), schema), "bloom-answers")
    if store:
        # one row per shard; a file of a failed or repeated attempt is named by no row
        store.publish(manifest, shards, {str(r["shard"]): r["file"] for r in walked.where("n IS NULL").select("shard", "file").collect()})
    certain = reduced.where("certain").select("n", "h", F.lit(True).alias("seen"), F.lit(True).alias("certain"))
    answers = walked.where("n IS NOT NULL").select("n", "h", "seen", F.lit(False).alias("certain")).unionByName(certain)
    return answers, walked.where("n IS NULL").drop("n", "h", "seen", "file")


def wrongly_seen(answers: DataFrame, keys: DataFrame) -> DataFrame:
    """(n): records called seen that are the first of their key by bytes. ``keys`` (k, n): all keys, those of the history with the lowest n.

    Only keys whose hash was called seen are compared. A key's rows are reduced where they lie, so a hot key costs a row per split.
    """
    asked = settle(answers.where("seen").select("h").distinct(), "bloom-asked")
    hashed = keys.where("k IS NOT NULL AND n IS NOT NULL").withColumn("h", F.xxhash64("k"))
    firsts = lambda rows: rows.groupBy("h", "k").agg(F.min("n").alias("n"))
    few = asked.count() <= CHECK_BROADCAST  # 8 bytes each
    first = firsts(hashed.join(F.broadcast(asked), "h", "left_semi")) if few else firsts(hashed).join(asked, "h", "left_semi")
    return settle(first.where(F.col("n") > -(1 << 63)).select("n").join(answers.where("seen").select("n"), "n", "left_semi"), "bloom-wrong")


def seen_before(history: DataFrame | None, records: DataFrame, history_key: str, record_key: str, record_id: str, error: float = ERROR_RATE, store: ChainStore | None = None, earlier: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(found, report). found: ids of records whose key occurred before, exactly; report: what the chains answered and how often it was wrong.

    ``earlier`` (k): keys that the store's chains took in earlier runs; they are read for the check alone.
    """
    answers, chains = bloom_pass(history, records, history_key, record_key, record_id, error, store=store)
    lowest = F.lit(-(1 << 63)).cast("bigint")
    keys = records.select(_key(record_key).alias("k"), F.col(f"`{record_id}`").cast("bigint").alias("n"))
    if history is not None:
        keys = keys.unionByName(history.select(_key(history_key).alias("k"), lowest.alias("n")))
    if earlier is not None:
        keys = keys.unionByName(earlier.select(F.col("k").cast("string").alias("k"), lowest.alias("n")))
    wrong = wrongly_seen(answers, keys)
    # copies of a record in several splits have one answer
    spoken = answers.groupBy("n").agg(F.bool_or("seen").alias("seen"), F.bool_or("certain").alias("certain"))
    found = spoken.where("seen").join(wrong, "n", "left_anti").select(F.col("n").alias(record_id))
    unseen = spoken.where("NOT seen").agg(F.count("*").alias("unseen"))
    total = chains.agg(F.count("*").alias("chains"), F.max("layers").alias("most_layers"), F.sum("keys").alias("keys"), F.sum("bits").alias("bits"), F.max("bound").alias("error_bound"), F.avg("expected").alias("expected_error"))
    report = (
        wrong.agg(F.count("*").alias("wrong"))
        .join(unseen)
        .join(total)
        .join(spoken.where("seen").agg(F.count("*").alias("answered_seen")))
        .select("answered_seen", "wrong", "unseen", (F.col("wrong") / F.greatest(F.col("wrong") + F.col("unseen"), F.lit(1))).alias("measured_error"), "error_bound", "expected_error", "chains", "most_layers", "keys", "bits")
    )
    return found, report
