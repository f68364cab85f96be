"""The engine: tables, SQL, lookups, maintenance."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.catalog import Catalog, TableSchema
from stratalog.errors import Aborted, EngineError, FailedPrecondition, Internal, InvalidArgument, Unimplemented
from stratalog.functions.rows import conform
from stratalog.operators import merge
from stratalog.plans import router, sql
from stratalog.session import ship
from stratalog.sources import durable
from stratalog.sources.buffered import BufferedTable
from stratalog.sources.store import ATTEMPTS, TableStore


@dataclass
class Result:
    """Rows of a query or the outcome of a change."""

    rows: DataFrame | None = None
    affected: int = 0
    message: str = ""
    error: EngineError | None = None
    millis: float = 0.0

    @property
    def ok(self) -> bool:
        return self.error is None


class Engine:
    def __init__(self, spark: SparkSession, path: str, columnar_threshold: int = router.COLUMNAR_THRESHOLD, auto_compact: bool = True):
        ship(spark)
        self.spark, self.path, self.auto_compact = spark, path.rstrip("/"), auto_compact
        self.catalog = Catalog(spark, self.path)
        self.router = router.Router(columnar_threshold)
        self.paused = False
        self._views = threading.RLock()
        self._buffers: dict[str, BufferedTable] = {}
        self.started = time.time()

    # tables -------------------------------------------------------------------------------------------------------

    def create_table(self, schema: TableSchema) -> None:
        schema.incarnation = uuid.uuid4().hex  # a table created again never sees an older one's rows
        self.catalog.create(schema)

    def drop_table(self, name: str) -> None:
        schema = self.catalog.drop(name)
        self._buffers.pop(schema.name, None)
        durable.remove(self.spark, f"{self.path}/tables/{schema.name}-{schema.incarnation}")

    def store(self, name: str) -> TableStore:
        schema = self.catalog.get(name)
        return TableStore(self.spark, f"{self.path}/tables/{schema.name}-{schema.incarnation}", schema)

    def table(self, name: str) -> DataFrame:
        return self.store(name).read()

    # SQL ----------------------------------------------------------------------------------------------------------

    def execute(self, text: str) -> Result:
        """Run one statement. Errors come back in the result; a change is applied entirely or not at all."""
        began = time.perf_counter()
        try:
            out = self._run(sql.parse(self.spark, text))
        except EngineError as e:
            out = Result(error=e)
        except Exception as e:
            lines = [x for x in str(e).splitlines() if x.strip()]
            known = next((x for x in lines if "type mismatch" in x or "may not be null" in x), None)
            out = Result(error=InvalidArgument(known.strip()) if known else type(e).__name__.endswith("AnalysisException") and InvalidArgument(lines[0]) or Internal(lines[0] if lines else repr(e)))
        out.millis = (time.perf_counter() - began) * 1000
        return out

    def _run(self, s: sql.Statement) -> Result:
        return getattr(self, f"_{s.kind.lower()}")(s)

    def _create(self, s: sql.Statement) -> Result:
        self.create_table(sql.table_schema(s))
        return Result(message=f"Table {s.table} created")

    def _drop(self, s: sql.Statement) -> Result:
        if s.plan.ifExists() and not self.catalog.exists(s.table):
            return Result(message=f"Table {s.table} does not exist")
        self.drop_table(s.table)
        return Result(message=f"Table {s.table} dropped")

    def _show(self, s: sql.Statement) -> Result:
        return Result(rows=self.catalog.show())

    def _describe(self, s: sql.Statement) -> Result:
        return Result(rows=self.catalog.describe(s.table))

    def _register(self, names: list[str]) -> None:
        for name in names:
            if self.catalog.exists(name):
                self.router.plan(router.QueryRequest.full(name), self.store(name)).frame().createOrReplaceTempView(name)

    def _select(self, s: sql.Statement) -> Result:
        for name in s.tables:
            if not self.catalog.exists(name) and name not in _ctes(s.text):
                self.catalog.get(name)
        request = self._request(s)
        with self._views:  # names of views are the session's: the statement is analysed before another one gives them new meaning
            if request:
                # the files that can hold wanted keys are known before planning
                self.router.plan(request, self.store(request.table)).frame().createOrReplaceTempView(request.table)
                self._register([n for n in s.tables if n != request.table])
            else:
                self._register(s.tables)
            return Result(rows=self.spark.sql(s.text))

    def _request(self, s: sql.Statement) -> router.QueryRequest | None:
        own = [n for n in s.tables if self.catalog.exists(n)]
        return sql.request_of(s, self.catalog.get(own[0])) if len(own) == 1 and sql.reads(s.plan) == 1 else None

    def _insert(self, s: sql.Statement) -> Result:
        schema = self.catalog.get(s.table)
        with self._views:
            self._register(sql.relations(s.plan.query()))
            rows, named = sql.insert_rows(self.spark, s)
        rows = conform(rows.toDF(*[f"_v{i}" for i in range(len(rows.columns))]), schema, named or [c.name for c in schema.columns])
        n = self.store(s.table).put(rows)
        self._after_write(s.table)
        return Result(affected=n, message=f"{n} row(s) inserted")

    def _matching(self, s: sql.Statement) -> tuple[TableStore, DataFrame, int]:
        """The store, the rows that the condition names, and the version they were read from."""
        condition = sql.condition(s)
        if condition is None:
            raise InvalidArgument(f"{s.kind} needs a WHERE condition")
        store = self.store(s.table)
        version = store.version()
        bounds = sql.bounds_of(condition, store.schema)
        files = [f for f in store.files(store.manifest(version)) if bounds.holds(f)]
        rows = store.read(files, few=bounds.keys is not None and len(bounds.keys) * len(files) <= self.router.threshold)
        self._register([n for n in s.tables if n != s.table])
        return store, rows.alias(s.table).where(F.expr(condition.sql())), version

    def _retried(self, change) -> Result:
        """Run a change that reads before it writes; if another commit came in between it is computed anew."""
        for attempt in range(ATTEMPTS):
            try:
                with self._views:
                    return change()
            except Aborted:
                if attempt == ATTEMPTS - 1:
                    raise
        raise Internal("unreachable")

    def _update(self, s: sql.Statement) -> Result:
        return self._retried(lambda: self._update_once(s))

    def _update_once(self, s: sql.Statement) -> Result:
        schema = self.catalog.get(s.table)
        store, rows, version = self._matching(s)
        changes = {schema.column(c.split(".")[-1].strip("`")).name: F.expr(v) for c, v in sql.assignments(s)}
        key = store.key
        old = F.col(key).alias("_old")
        new = conform(rows.select(*(changes.get(c.name, F.col(c.name)).alias(c.name) for c in schema.columns)), schema)
        if key not in changes:
            n = store.commit(new, since=version)
        else:
            # a changed key leaves a tombstone under the old one; both go in one commit
            if rows.select(changes[key].alias("k")).groupBy("k").count().where("count > 1").limit(1).count():
                raise FailedPrecondition("the update gives several rows the same key")
            gone = rows.select(old, changes[key].alias("_new")).where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*(F.col("_old").alias(c.name) if c.name == key else F.lit(None).cast(c.type).alias(c.name) for c in schema.columns), F.lit(True).alias(merge.DELETED))
            n = rows.count()
            taken = new.join(store.read().select(key), key, "left_semi").join(rows.select(key), key, "left_anti").limit(1).count()
            if taken:
                raise FailedPrecondition("the new key is taken by another row")
            store.commit(gone.unionByName(new.withColumn(merge.DELETED, F.lit(False))), since=version)
        self._after_write(s.table)
        return Result(affected=n, message=f"{n} row(s) updated" if n else "0 rows matching WHERE condition")

    def _delete(self, s: sql.Statement) -> Result:
        return self._retried(lambda: self._delete_once(s))

    def _delete_once(self, s: sql.Statement) -> Result:
        store, rows, version = self._matching(s)
        n = store.delete(rows.select(store.key), since=version)
        self._after_write(s.table)
        return Result(affected=n, message=f"{n} row(s) deleted" if n else "0 rows matching WHERE condition")

    def _explain(self, s: sql.Statement) -> Result:
        lines = self.explain(s.text).splitlines()
        return Result(rows=self.spark.createDataFrame([(x,) for x in lines], "plan string"))

    def explain(self, text: str, physical: bool = False) -> str:
        """The router's plan of a SELECT, and Spark's if asked."""
        s = sql.parse(self.spark, text)
        if s.kind != "SELECT":
            raise Unimplemented("EXPLAIN takes a SELECT statement")
        for name in s.tables:
            self.catalog.get(name)
        request = self._request(s)
        out = self.router.plan(request, self.store(request.table)).explain() if request else "Query Plan:\n  Type: GENERAL (planned by Catalyst)"
        if physical:
            out += "\n" + self._select(s).rows._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return out

    # keys ---------------------------------------------------------------------------------------------------------

    def put(self, table: str, rows: DataFrame) -> int:
        n = self.store(table).put(conform(rows, self.catalog.get(table)))
        self._after_write(table)
        return n

    def delete_keys(self, table: str, keys: DataFrame) -> int:
        store = self.store(table)
        n = store.delete(keys.select(F.col(keys.columns[0]).cast(store.schema.column(store.key).type).alias(store.key)).where(F.col(store.key).isNotNull()))
        self._after_write(table)
        return n

    def get(self, table: str, key) -> DataFrame:
        return self.store(table).get(key)

    def run_request(self, request: router.QueryRequest) -> DataFrame:
        """Build the DataFrame of a request by its plan."""
        plan = self.router.plan(request, self.store(request.table))
        key, df = F.col(plan.store.key), plan.frame()
        if request.key is not None:
            df = df.where(key == F.lit(request.key))
        if request.keys is not None:
            df = df.where(key.isin(request.keys))
        if request.low is not None:
            df = df.where(key >= F.lit(request.low))
        if request.high is not None:
            df = df.where(key <= F.lit(request.high))
        if request.prefix:
            df = df.where(key.cast("string").startswith(request.prefix))
        df = df.where(request.filter) if request.filter else df
        if request.kind == router.AGGREGATION:
            return df.selectExpr(request.aggregate)
        return df.select(*request.columns) if request.columns else df

    # maintenance --------------------------------------------------------------------------------------------------

    def _after_write(self, table: str) -> None:
        if self.auto_compact and not self.paused:
            store = self.store(table)
            if (level := store.due()) is not None:
                try:
                    store.compact(level)
                except Aborted:
                    pass  # another writer compacted these files; the next write looks again

    def compact(self, table: str | None = None) -> dict:
        """Push each table's rows into one level; statistics by table."""
        if self.paused:
            raise FailedPrecondition("compaction is paused")
        return {n: self.store(n).compact_all() for n in ([table] if table else self.catalog.names())}

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def buffered(self, table: str, mode: str = "BATCHED", **group) -> BufferedTable:
        """The table's log for small writes. Opening it takes what an earlier process left in the log."""
        name = self.catalog.get(table).name
        if name not in self._buffers:
            self._buffers[name] = BufferedTable(self.store(name), mode, **group)
        return self._buffers[name]

    def flush(self) -> dict:
        """Move what the logs hold into the tables; rows flushed by table. Other commits are durable when they return."""
        return {n: self.buffered(n).flush() if n in self._buffers or durable.exists(self.spark, f"{self.store(n).path}/_wal") else 0 for n in self.catalog.names()}

    def stats(self) -> dict:
        tables = [self.store(n).stats() for n in self.catalog.names()]
        return {"tables": tables, "files": sum(t["files"] for t in tables), "entries": sum(t["entries"] for t in tables), "bytes": sum(t["bytes"] for t in tables), "compaction_paused": self.paused}


def _ctes(text: str) -> set[str]:
    import re

    return {x.lower() for x in re.findall(r"(?i)(?:\bwith|,)\s+(\w+)\s*(?:\([^)]*\))?\s+as\s*\(", text)}
