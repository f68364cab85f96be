"""A write-ahead log as append-only Parquet, with checksums, group commit, real truncation and recovery."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.errors import InvalidArgument
from stratalog.session import qualified
from stratalog.sources import durable

INSERT, DELETE = 1, 2
SCHEMA = "sequence bigint, ts bigint, operation int, key string, value string"
_FIELDS = ["sequence", "ts", "operation", "key", "value"]


def checksum() -> F.Column:
    """Of all fields, told apart by their names, so no two entries look alike."""
    return F.crc32(F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "false"}).cast("binary"))


class Log:
    """Entries in folders, one per append. An append counts once its name, which holds its highest sequence, is in the index.

    Truncation sets a mark and removes the folders that lie wholly below it; the entries of the others are filtered by the mark.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, qualified(spark, path.rstrip("/"))

    def append(self, entries: DataFrame) -> None:
        from stratalog.sources.columnar_file import numeric_extremes

        folder = uuid.uuid4().hex
        entries.select(*_FIELDS).withColumn("crc", checksum()).write.parquet(f"{self.path}/entries/{folder}")
        top = numeric_extremes(self.spark, f"{self.path}/entries/{folder}", "sequence")[1]  # from the footers
        if top is None:
            durable.remove(self.spark, f"{self.path}/entries/{folder}")
        else:
            durable.put_if_absent(self.spark, f"{self.path}/_index/{top + (1 << 63):020d}-{folder}.json", {"at": time.time()})

    def _appends(self) -> list[tuple[int, str]]:
        """(highest sequence, folder) of each append."""
        names = [p.rsplit("/", 1)[1][:-5] for p, _ in durable.listing(self.spark, f"{self.path}/_index", ".json")]
        return [(int(n[:20]) - (1 << 63), n[21:]) for n in names]

    def _low(self) -> int:
        marks = durable.listing(self.spark, f"{self.path}/_truncated", ".json")
        return int(marks[-1][0].rsplit("/", 1)[1][:20]) if marks else -1

    def recover(self) -> DataFrame:
        """Intact entries above the last truncation in order of sequence; damaged ones are skipped. Appends wholly below are not read."""
        low = self._low()
        folders = [f"{self.path}/entries/{folder}" for top, folder in self._appends() if top > low]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA + ", crc bigint").parquet(*folders)
        return rows.where((F.col("crc") == checksum()) & (F.col("sequence") > low)).drop("crc").orderBy("sequence")

    def truncate(self, sequence: int) -> int:
        """Forget entries up to ``sequence``, in one atomic step, and remove the appends that hold no others; the number removed."""
        if sequence > self._low():
            durable.put_if_absent(self.spark, f"{self.path}/_truncated/{sequence:020d}.json", {"at": time.time()})
        gone = [(top, folder) for top, folder in self._appends() if top <= self._low()]
        for top, folder in gone:
            durable.remove(self.spark, f"{self.path}/_index/{top + (1 << 63):020d}-{folder}.json")
            durable.remove(self.spark, f"{self.path}/entries/{folder}")
        return len(gone)

    def max_sequence(self) -> int:
        found = self.recover().agg(F.max("sequence")).first()[0]
        return -1 if found is None else found

    def checkpoint(self) -> int:
        """Truncate at the highest sequence there is."""
        top = self.max_sequence()
        if top >= 0:
            self.truncate(top)
        return top


class GroupCommit:
    """Collects small writes of the driver and appends them together: at once, by count or bytes, or by time.

    In TIMED mode a timer appends what waits, also if no further entry comes.
    """

    MODES = ("IMMEDIATE", "BATCHED", "TIMED")

    def __init__(self, log: Log, mode: str = "BATCHED", entries: int = 100, size: int = 64 << 10, millis: int = 10):
        if mode not in self.MODES:
            raise InvalidArgument(f"mode must be one of {self.MODES}")
        self.log, self.mode, self.entries, self.size, self.millis = log, mode, entries, size, millis
        self.buffer: list[tuple] = []
        self.bytes = 0
        self.stats = {"commits": 0, "entries": 0, "bytes": 0, "largest": 0}
        self._lock, self._timer = threading.RLock(), None

    def add(self, sequence: int, operation: int, key: str, value: str | None = None) -> None:
        with self._lock:
            self.buffer.append((sequence, int(time.time() * 1000), operation, key, value))
            self.bytes += len(key) + len(value or "")
            full = len(self.buffer) >= self.entries or self.bytes >= self.size
            if self.mode == "IMMEDIATE" or (self.mode == "BATCHED" and full):
                self.flush()
            elif self.mode == "TIMED" and self._timer is None:
                self._timer = threading.Timer(self.millis / 1000, self.flush)
                self._timer.daemon = True
                self._timer.start()

    def flush(self) -> None:
        with self._lock:
            if self._timer is not None:
                self._timer.cancel()
                self._timer = None
            if self.buffer:
                self.log.append(self.log.spark.createDataFrame(self.buffer, SCHEMA).coalesce(1))
                n = len(self.buffer)
                self.stats = {"commits": self.stats["commits"] + 1, "entries": self.stats["entries"] + n, "bytes": self.stats["bytes"] + self.bytes, "largest": max(self.stats["largest"], n)}
            self.buffer, self.bytes = [], 0
