"""SQL type names and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from stratalog.errors import InvalidArgument

#: Accepted spellings (fixed values). DECIMAL is stored as a double and lengths of VARCHAR and CHAR are not enforced.
ALIASES = {
    "INT64": T.LongType(), "BIGINT": T.LongType(), "LONG": T.LongType(),
    "INT32": T.IntegerType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(),
    "DOUBLE": T.DoubleType(), "DECIMAL": T.DoubleType(),
    "FLOAT": T.FloatType(), "REAL": T.FloatType(),
    "STRING": T.StringType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(), "CHAR": T.StringType(),
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "BYTES": T.BinaryType(), "BLOB": T.BinaryType(), "BINARY": T.BinaryType(),
    "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
}
#: Bytes of a value; strings and bytes vary.
WIDTHS = {T.LongType: 8, T.DoubleType: 8, T.BooleanType: 1, T.IntegerType: 4, T.FloatType: 4, T.TimestampNTZType: 8}
COMPRESSIONS = ("NONE", "RLE", "DICTIONARY", "DELTA", "BITPACKING")


def parse_type(name: str) -> T.DataType:
    """Spark type of a SQL spelling, any case, any length or precision."""
    found = ALIASES.get(name.strip().split("(")[0].strip().upper())
    if found is None:
        raise InvalidArgument(f"unknown type {name}")
    return found


def stored_type(kind: T.DataType) -> T.DataType:
    """The type the engine keeps for a declared one."""
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    if isinstance(kind, (T.VarcharType, T.CharType)):
        return T.StringType()
    if isinstance(kind, T.TimestampType):
        return T.TimestampNTZType()
    if type(kind) in {type(x) for x in ALIASES.values()}:
        return kind
    raise InvalidArgument(f"type {kind.simpleString()} is not supported")


def type_name(kind: T.DataType) -> str:
    """The engine's own name of a type."""
    return next(k for k, v in ALIASES.items() if type(v) is type(kind))


def is_fixed_size(kind: T.DataType) -> bool:
    return type(kind) in WIDTHS


def value_size(kind: T.DataType) -> int:
    """Bytes of a value of fixed size, else 0."""
    return WIDTHS.get(type(kind), 0)
