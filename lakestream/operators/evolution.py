"""Schema evolution: new columns, wider types, everything nullable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The promotions a table accepts.
WIDENS = {("integer", "long"), ("float", "double")}


class IncompatibleSchema(ValueError):
    """A column changed to a type the table cannot hold."""


def wider_type(old: T.DataType, new: T.DataType, path: str) -> T.DataType:
    """The type that holds both, where one is a promotion of the other."""
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return evolve(old, new, path + ".")
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(wider_type(old.elementType, new.elementType, path + "[]"), True)
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        if old.keyType != new.keyType:
            raise IncompatibleSchema(f"{path}: map key changed")
        return T.MapType(old.keyType, wider_type(old.valueType, new.valueType, path + "{}"), True)
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType) and old.scale == new.scale:
        return old if old.precision >= new.precision else new
    names = (old.typeName(), new.typeName())
    if old == new or names[::-1] in WIDENS:
        return old
    if names in WIDENS:
        return new
    raise IncompatibleSchema(f"{path}: {old.simpleString()} cannot become {new.simpleString()}")


def evolve(table: T.StructType, batch: T.StructType, prefix: str = "") -> T.StructType:
    """Table schema after a batch: old columns first, widened where needed, then the new ones; all nullable."""
    incoming = {f.name: f for f in batch.fields}
    fields = [
        T.StructField(
            f.name,
            wider_type(f.dataType, incoming[f.name].dataType, prefix + f.name) if f.name in incoming else f.dataType,
            True,
        )
        for f in table.fields
    ]
    known = set(table.names)
    fields += [f for f in batch.fields if f.name not in known]
    return force_optional(T.StructType(fields))


def _optional(data_type: T.DataType) -> T.DataType:
    if isinstance(data_type, T.StructType):
        return force_optional(data_type)
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(_optional(data_type.elementType), True)
    if isinstance(data_type, T.MapType):
        return T.MapType(data_type.keyType, _optional(data_type.valueType), True)
    return data_type


def force_optional(schema: T.StructType) -> T.StructType:
    """Same schema with every column, nested ones too, nullable."""
    return T.StructType([T.StructField(f.name, _optional(f.dataType), True, f.metadata) for f in schema.fields])


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order: cast where present, null where missing."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def union_evolved(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Append a batch whose schema may differ: evolve the table, then align both sides."""
    schema = evolve(table.schema, batch.schema)
    return align(table, schema).unionByName(align(batch, schema))
