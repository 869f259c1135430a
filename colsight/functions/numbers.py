"""Numeric helpers on columns and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, INTEGRAL)


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, INTEGRAL + FRACTIONAL)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere, so it becomes null once, at the start."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *(
            F.when(~F.isnan(col(name)), col(name)).alias(name) if name in floats else col(name)
            for name in df.columns
        )
    )


def as_number(df: DataFrame, name: str) -> Column:
    """A column as double with NaN and unreadable text as null; booleans count 0 and 1."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.BooleanType):
        return col(name).cast("int").cast("double")
    number = col(name).try_cast("double")
    if is_integral(data_type) or isinstance(data_type, T.DecimalType):
        return number
    return F.when(~F.isnan(number), number)


def unpivot(df: DataFrame, names: list[str], to_value, value_name: str = "value") -> DataFrame:
    """One row per cell: (position, column, value), made with one explode over an array of structs."""
    cells = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column"),
                to_value(df, name).alias(value_name),
            )
            for i, name in enumerate(names)
        )
    )
    return df.select(F.inline(cells))


def string_value(df: DataFrame, name: str) -> Column:
    """A column as text; binary and nested values by their JSON form."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(col(name)))
    if isinstance(data_type, T.BinaryType):
        return F.hex(col(name))
    return col(name).cast("string")
