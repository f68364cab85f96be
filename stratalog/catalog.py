"""Declared tables: ordered columns, a primary key, and their JSON on the file system."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog import types
from stratalog.errors import AlreadyExists, InvalidArgument, NotFound
from stratalog.sources import durable


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: T.DataType
    nullable: bool = True
    compression: str = "NONE"


@dataclass
class TableSchema:
    name: str
    columns: list[ColumnSpec]
    primary_key: str = ""
    incarnation: str = field(default="")
    #: Do writes bring an order value of their own (see TableStore)?
    ordered: bool = False

    def __post_init__(self):
        self.name = self.name.lower()
        if not self.columns:
            raise InvalidArgument("a table needs at least one column")
        names = [c.name.lower() for c in self.columns]
        if len(set(names)) < len(names):
            raise InvalidArgument("a column name is used twice")
        if not self.primary_key:
            self.primary_key = self.columns[0].name  # the first column is the key unless one is named
        self.primary_key = self.column(self.primary_key).name

    def column(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise InvalidArgument(f"unknown column {name} in table {self.name}")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable) for c in self.columns])

    def to_json(self) -> dict:
        columns = [{"name": c.name, "type": types.type_name(c.type), "nullable": c.nullable, "compression": c.compression} for c in self.columns]
        return {"name": self.name, "primary_key": self.primary_key, "incarnation": self.incarnation, "ordered": self.ordered, "columns": columns}

    @classmethod
    def from_json(cls, d: dict) -> TableSchema:
        return cls(d["name"], [ColumnSpec(c["name"], types.parse_type(c["type"]), c["nullable"], c.get("compression", "NONE")) for c in d["columns"]], d["primary_key"], d.get("incarnation", ""), d.get("ordered", False))


class Catalog:
    """Tables by name (any case). Each change publishes a new numbered file, so a crash leaves the state before or after."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables: dict[str, TableSchema] = {}
        self.reload()

    def reload(self) -> None:
        found = durable.listing(self.spark, f"{self.path}/_catalog", ".json")
        self.version = int(found[-1][0].rsplit("/", 1)[1][:20]) if found else 0
        self.tables = {d["name"]: TableSchema.from_json(d) for d in durable.read_json(self.spark, found[-1][0])["tables"]} if found else {}

    def _save(self) -> None:
        self.version += 1
        if not durable.put_if_absent(self.spark, f"{self.path}/_catalog/{self.version:020d}.json", {"tables": [t.to_json() for t in self.tables.values()]}):
            self.reload()
            raise AlreadyExists("the catalog was changed by another writer")

    def create(self, schema: TableSchema) -> None:
        if schema.name in self.tables:
            raise AlreadyExists(f"table {schema.name} already exists")
        self.tables[schema.name] = schema
        self._save()

    def drop(self, name: str) -> TableSchema:
        schema = self.get(name)
        del self.tables[schema.name]
        self._save()
        return schema

    def exists(self, name: str) -> bool:
        return name.lower() in self.tables

    def get(self, name: str) -> TableSchema:
        if name.lower() not in self.tables:
            raise NotFound(f"table {name} does not exist")
        return self.tables[name.lower()]

    def names(self) -> list[str]:
        return sorted(self.tables)

    def show(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.names()], "Tables string")

    def describe(self, name: str) -> DataFrame:
        t = self.get(name)
        rows = [(c.name, types.type_name(c.type), c.nullable, c.compression, c.name == t.primary_key) for c in t.columns]
        return self.spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean, compression string, primary_key boolean")


def encode_key(table: str, key: Column) -> Column:
    """The textual row key ``table:pk``."""
    return F.concat(F.lit(table.lower() + ":"), key.cast("string"))


def table_prefix(table: str) -> str:
    return table.lower() + ":"


def decode_key(table: str, key: Column) -> Column:
    """The primary key's text of a row key, null for another table's."""
    n = len(table_prefix(table))
    return F.when(key.startswith(table_prefix(table)), F.substring(key, n + 1, 1 << 30))
