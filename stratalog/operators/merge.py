"""Latest-version-wins merge of a keyed change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQ, ORD, DELETED = "_seq", "_ord", "_deleted"


def latest(log: DataFrame, key: str, order: list[Column], columns: list[str], unique: bool = False) -> DataFrame:
    """One row per key: the version that is last by ``order``. Aggregates on the map side, so a key of many versions is no hot spot.

    A filter on the key passes below the aggregate to the scan; one on other columns can't, which keeps it right. ``unique`` says that
    no two versions of a key have the same order: then each column is picked for itself, and columns that nobody asks for are not read.
    """
    rest = [c for c in columns if c != key]
    if unique and rest:
        return log.groupBy(key).agg(*(F.max_by(c, F.struct(*order)).alias(c) for c in rest)).select(*columns)
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_m"))
    return best.select(key, *(F.col("_m")[c].alias(c) for c in rest)).select(*columns)


def live(log: DataFrame, key: str, columns: list[str], unique: bool = False) -> DataFrame:
    """The current rows: tombstones removed."""
    return latest(log, key, [F.col(SEQ), F.col(ORD)], [*columns, DELETED], unique).where(~F.col(DELETED)).drop(DELETED)


def with_tombstones(log: DataFrame, key: str, columns: list[str], unique: bool = False) -> DataFrame:
    """Current version of every key, deleted ones too."""
    return latest(log, key, [F.col(SEQ), F.col(ORD)], [*columns, DELETED], unique)
