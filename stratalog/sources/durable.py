"""Small atomic files on any Hadoop file system, driven from the driver."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, content: Any) -> bool:
    """Write JSON to ``path`` in one step; False if the path is taken. Readers see all of it or nothing."""
    jvm, fs, tmp = spark.sparkContext._jvm, _fs(spark, path), f"{path}.{uuid.uuid4().hex}.tmp"
    out = fs.create(_path(spark, tmp), True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(_path(spark, tmp), _path(spark, path), kinds)
        return True
    except Exception as e:  # py4j wraps the Java exception
        fs.delete(_path(spark, tmp), False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


def read_json(spark: SparkSession, path: str) -> Any:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def listing(spark: SparkSession, path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(full path, bytes) of the files directly in ``path``, sorted; [] if there is no such folder."""
    fs, p = _fs(spark, path), _path(spark, path)
    if not fs.exists(p):
        return []
    found = [(str(s.getPath().toString()), int(s.getLen())) for s in fs.listStatus(p) if s.isFile()]
    return sorted(x for x in found if x[0].endswith(suffix))


def listing_below(spark: SparkSession, path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(full path, bytes) of the files at any depth of ``path``, sorted; [] if there is no such folder."""
    fs, p = _fs(spark, path), _path(spark, path)
    if not fs.exists(p):
        return []
    found, each = [], fs.listFiles(p, True)
    while each.hasNext():
        s = each.next()
        found.append((str(s.getPath().toString()), int(s.getLen())))
    return sorted(x for x in found if x[0].endswith(suffix))
