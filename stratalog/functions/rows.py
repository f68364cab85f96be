"""Row values as text: encoding, decoding and checks, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.catalog import TableSchema
from stratalog.errors import InvalidArgument


def encode_row(columns: list[str]) -> Column:
    """A row as a JSON blob; nulls stay nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def decode_row(blob: Column, schema: T.StructType) -> Column:
    """A blob as a struct; fields that an old row lacks are null, an undecodable row is null."""
    return F.from_json(blob, schema, {"mode": "PERMISSIVE"})


def column_value(blob: Column, name: str) -> Column:
    return F.get_json_object(blob, f"$.{name}")


def is_valid(value: Column, kind: T.DataType) -> Column:
    """Does the text of ``value`` read as ``kind``? Null does."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(True)
    text = value.cast("string")
    if isinstance(kind, T.BooleanType):
        return text.isNull() | F.lower(text).isin("true", "false", "1", "0")
    return text.isNull() | text.try_cast(kind).isNotNull()


def is_numeric(value: Column) -> Column:
    return value.cast("string").try_cast("double").isNotNull()


def with_default(value: Column, kind: T.DataType) -> Column:
    """Null as the zero of its type."""
    if isinstance(kind, T.StringType):
        return F.coalesce(value, F.lit(""))
    return F.coalesce(value, F.lit(0).cast(kind) if not isinstance(kind, T.BooleanType) else F.lit(False))


def conform(df: DataFrame, schema: TableSchema, named: list[str] | None = None, keep: list[str] | None = None, skip: list[str] | None = None, unchecked: str | None = None) -> DataFrame:
    """``df`` with the table's columns and types; missing ones are null. Unknown columns are an error here, bad values when the plan runs.

    Columns in ``keep`` go along as they are, those in ``skip`` are left out; rows whose column ``unchecked`` is true (tombstones)
    need no more than their key.
    """
    aside = [*(keep or []), *(skip or [])]
    values = [c for c in df.columns if c not in aside]
    names = named or values
    if len(names) != len(values):
        raise InvalidArgument(f"{len(names)} columns but {len(values)} values")
    free = F.coalesce(F.col(unchecked), F.lit(False)) if unchecked else F.lit(False)
    given = {schema.column(n).name: F.col(f"`_in{i}`") for i, n in enumerate(names)}
    if len(given) < len(names):
        raise InvalidArgument("a column is given twice")
    if schema.primary_key not in given:
        raise InvalidArgument(f"no value for primary key {schema.primary_key}")
    src = df.select(*(F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(values)), *(keep or []))
    kinds = {f"_in{i}": f.dataType for i, f in enumerate(src.schema)}
    out = []
    for c in schema.columns:
        value = given.get(c.name, F.lit(None))
        kind = kinds.get(f"_in{names.index(next(n for n in names if n.lower() == c.name.lower()))}") if c.name in given else T.NullType()
        if isinstance(kind, type(c.type)) or isinstance(kind, T.NullType):
            typed = value.cast(c.type)
        elif isinstance(c.type, T.BooleanType):
            typed = F.when(F.lower(value.cast("string")).isin("true", "1"), True).when(F.lower(value.cast("string")).isin("false", "0"), False)
        else:
            typed = value.cast("string").try_cast(c.type)
        bad = value.isNotNull() & typed.isNull()
        typed = F.when(bad, F.raise_error(F.concat(F.lit(f"type mismatch in column {c.name}: "), value.cast("string")))).otherwise(typed)
        if not c.nullable or c.name == schema.primary_key:
            typed = F.when(value.isNull() & (F.lit(c.name == schema.primary_key) | ~free), F.raise_error(F.lit(f"column {c.name} may not be null")).cast(c.type)).otherwise(typed)
        out.append(typed.cast(c.type).alias(c.name))
    return src.select(*out, *(keep or []))
