"""Small writes to a table through its log: durable when logged, in the table when flushed, taken once.

The log's entries name the row by its textual key and hold it as a JSON blob. A flush takes what the log holds, keeps the last entry
of each key, commits it as one version of the table and truncates the log. The commit carries the highest sequence it took, so a
flush that is repeated after a failure between commit and truncation takes nothing twice. Opening the table again flushes what
an earlier process left in the log.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.catalog import decode_key, table_prefix
from stratalog.functions.rows import conform, decode_row
from stratalog.operators import merge
from stratalog.sources.store import TableStore
from stratalog.sources.wal import DELETE, INSERT, GroupCommit, Log


class BufferedTable:
    def __init__(self, store: TableStore, mode: str = "BATCHED", **group):
        self.store, self.schema = store, store.schema
        self.log = Log(store.spark, f"{store.path}/_wal")
        self.group = GroupCommit(self.log, mode, **group)
        self.recovered = self.flush()
        self.sequence = self._taken()

    def _taken(self) -> int:
        return self.store.manifest()["streams"].get("_wal", -1)

    def put(self, **values) -> int:
        """Log a row; its sequence number."""
        self.sequence += 1
        self.group.add(self.sequence, INSERT, f"{table_prefix(self.schema.name)}{values[self.schema.primary_key]}", json.dumps(values, default=str))
        return self.sequence

    def delete(self, key) -> int:
        self.sequence += 1
        self.group.add(self.sequence, DELETE, f"{table_prefix(self.schema.name)}{key}")
        return self.sequence

    def append(self, entries: DataFrame) -> None:
        """Log many entries (sequence, ts, operation, key, value) at once."""
        self.group.flush()
        self.log.append(entries)

    def flush(self) -> int:
        """Move the log's entries into the table; the number of rows committed."""
        self.group.flush()
        taken = self._taken()
        entries = self.log.recover().where(F.col("sequence") > taken)
        top = entries.agg(F.max("sequence")).first()[0]
        n = 0
        if top is not None:
            last = entries.groupBy("key").agg(F.max_by(F.struct("operation", "value"), "sequence").alias("e"))
            gone = F.col("e.operation") == DELETE
            row = decode_row(F.col("e.value"), self.schema.struct())
            key = decode_key(self.schema.name, F.col("key")).cast(self.schema.column(self.schema.primary_key).type)
            fields = [key.alias(c.name) if c.name == self.schema.primary_key else F.when(~gone, row[c.name]).alias(c.name) for c in self.schema.columns]
            rows = conform(last.where(key.isNotNull()).select(*fields, gone.alias(merge.DELETED)), self.schema, keep=[merge.DELETED], unchecked=merge.DELETED)
            n = self.store.commit(rows, stream=("_wal", top))
        self.log.truncate(max(taken, -1 if top is None else top))
        return n
