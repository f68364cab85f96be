"""Session helpers: shared working folder, parallelism, and tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SCRATCH: list[list[str]] = []


def build_session(app: str = "stratalog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; anything in ``conf`` wins."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=base).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the session names one.

    Where it is unset, a local session gets a temporary folder of its own (removed at exit) and a cluster
    session gets a folder in the warehouse, which is shared by definition.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return qualified(spark, found.rstrip("/"))
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master.startswith("local"):
            own = tempfile.mkdtemp(prefix="stratalog-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN[app] = f"file://{own}"
        else:
            _OWN[app] = os.path.join(spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), f"_shared/{app}")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, so that workers open the same place as Spark does."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, lost executors cost nothing upstream.

    The table goes when the ``scratch`` around the call ends, or else with the application.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that were settled inside when the block ends; what is to stay must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    """Tasks that one wave should have at least."""
    return max(int(spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Give an input of very few splits (a single small file) one partition per core before costly per-row work.

    An input of ordinary size already has more splits than cores and is left where it is: no shuffle. So is one that is
    shuffled anyway, as counting its partitions would run it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = int(df.sparkSession.sparkContext.defaultParallelism)
    splits = df.rdd.getNumPartitions()
    return df if splits * 2 > cores else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, wherever it is installed on the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="stratalog-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; its queries may run code of this package on the executors."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
