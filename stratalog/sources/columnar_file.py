"""Parquet as the columnar file: written in row groups, read by column and group, summed up from its footers.

A footer read opens the end of each file only. Footers are read by tasks over the list of files, so many files are no driver work.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.session import qualified, ship
from stratalog.sources import durable

ZONES = "file string, row_group int, `rows` bigint, column_name string, nulls bigint, min_value double, max_value double, bytes bigint, encodings string"
#: Codec of each preferred compression; the encodings themselves (dictionary, run length, delta) are Parquet's own choice per column.
CODECS = {"NONE": "uncompressed", "RLE": "snappy", "DICTIONARY": "snappy", "DELTA": "zstd", "BITPACKING": "zstd"}


def write(df: DataFrame, path: str, rows_per_group: int = 1_000_000, compression: str = "RLE", dictionary: dict[str, bool] | None = None, bloom: list[str] | None = None) -> None:
    """Write row groups of ``rows_per_group`` rows; dictionary encoding and bloom filters can be set by column.

    Sums of numeric columns, which footers lack, are observed while the rows are written and kept beside the files.
    """
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    seen = Observation()
    if numeric:
        df = df.observe(seen, F.count("*").alias("rows"), *(F.sum(F.col(f"`{c}`")).cast("string").alias(f"s{i}") for i, c in enumerate(numeric)))
    writer = df.write.option("compression", CODECS[compression]).option("parquet.block.row.count.limit", rows_per_group)
    for column, on in (dictionary or {}).items():
        writer = writer.option(f"parquet.enable.dictionary#{column}", str(on).lower())
    for column in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
    if numeric:
        got = seen.get
        durable.put_if_absent(df.sparkSession, f"{path}/_sums/{uuid.uuid4().hex}.json", {c: got[f"s{i}"] for i, c in enumerate(numeric)})


def _sum(spark: SparkSession, path: str, column: str) -> str | None:
    """The column's sum as it was written, null if the files were not written here."""
    found = [durable.read_json(spark, p).get(column) for p, _ in durable.listing(spark, f"{path}/_sums", ".json")]
    return found[0] if found else None


def _footers(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    for b in batches:
        out = {k: [] for k in ("file", "row_group", "rows", "column_name", "nulls", "min_value", "max_value", "bytes", "encodings")}
        for uri in b.column("file").to_pylist():
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as f:
                meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    column = group.column(c)
                    s = column.statistics
                    number = s is not None and s.has_min_max and isinstance(s.min, (int, float)) and not isinstance(s.min, bool)
                    values = (uri, g, group.num_rows, column.path_in_schema, s.null_count if s is not None and s.has_null_count else None, float(s.min) if number else None, float(s.max) if number else None, column.total_compressed_size, ",".join(sorted(column.encodings)))
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
        types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})


def zones(spark: SparkSession, path: str) -> DataFrame:
    """One row per row group and column: rows, nulls and the numeric extremes of the footers."""
    ship(spark)
    path = qualified(spark, path)
    files = durable.listing(spark, path, ".parquet") or [(path, 0)]
    names = [(qualified(spark, p),) for p, _ in files]
    return spark.createDataFrame(names, "file string").repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism * 4))).mapInArrow(_footers, ZONES)


def aggregate(spark: SparkSession, path: str, column: str) -> DataFrame:
    """total, nulls, min_value, max_value, sum_value and avg_value of a numeric column without reading a value of it."""
    z = zones(spark, path).where(F.col("column_name") == column)
    out = z.agg(F.sum("rows").alias("total"), F.sum("nulls").alias("nulls"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))
    known = F.lit(_sum(spark, path, column)).cast("double")
    return out.withColumns({"sum_value": known, "avg_value": known / (F.col("total") - F.col("nulls"))})


def numeric_extremes(spark: SparkSession, path: str, column: str) -> tuple[float | None, float | None]:
    """Lowest and highest value of a numeric column of a folder's files, by footers that the driver reads; for the few files of one append."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    low = high = None
    for p, _ in durable.listing(spark, path, ".parquet"):
        system, at = fs.FileSystem.from_uri(qualified(spark, p))
        with system.open_input_file(at) as f:
            meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                s = meta.row_group(g).column(c).statistics
                if meta.row_group(g).column(c).path_in_schema == column and s is not None and s.has_min_max:
                    low, high = s.min if low is None else min(low, s.min), s.max if high is None else max(high, s.max)
    return low, high


def groups_that_may_contain(spark: SparkSession, path: str, column: str, low: float, high: float) -> DataFrame:
    """(file, row_group) whose range meets [low, high]; groups without statistics may contain anything."""
    z = zones(spark, path).where(F.col("column_name") == column)
    return z.where(F.col("min_value").isNull() | ((F.col("min_value") <= high) & (F.col("max_value") >= low))).select("file", "row_group")


def read_column(spark: SparkSession, path: str, column: str, row_group: int | None = None) -> DataFrame:
    """One column, of all row groups or of the ones with the given number."""
    if row_group is None:
        return spark.read.parquet(path).select(column)
    ship(spark)
    kind = spark.read.parquet(path).schema[column].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for b in batches:
            for uri in b.column("file").to_pylist():
                system, at = fs.FileSystem.from_uri(uri)
                with system.open_input_file(at) as f:
                    source = pq.ParquetFile(f)
                    if row_group < source.metadata.num_row_groups:
                        yield from source.read_row_group(row_group, columns=[column]).to_batches()

    path = qualified(spark, path)
    names = [(qualified(spark, p),) for p, _ in durable.listing(spark, path, ".parquet")] or [(path,)]
    return spark.createDataFrame(names, "file string").mapInArrow(run, f"`{column}` {kind}")
