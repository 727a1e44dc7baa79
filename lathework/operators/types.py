"""Column types and their Spark and Python counterparts."""

from __future__ import annotations

import datetime as dt
from enum import Enum
from typing import Any

from pyspark.sql import types as T


class DataType(str, Enum):
    BOOL = "BOOL"
    CHAR = "CHAR"
    VARCHAR = "VARCHAR"
    SMALLINT = "SMALLINT"
    INTEGER = "INTEGER"
    BIGINT = "BIGINT"
    FLOAT = "FLOAT"
    DOUBLE = "DOUBLE"
    NUMBER = "NUMBER"
    DATE = "DATE"
    TIMESTAMP = "TIMESTAMP"
    TIMESTAMPTZ = "TIMESTAMPTZ"
    TIME = "TIME"
    BINARY = "BINARY"
    TEXT = "TEXT"
    GUID = "GUID"
    JSON = "JSON"


_SPARK = {
    DataType.BOOL: T.BooleanType(), DataType.SMALLINT: T.ShortType(), DataType.INTEGER: T.IntegerType(), DataType.BIGINT: T.LongType(),
    DataType.FLOAT: T.FloatType(), DataType.DOUBLE: T.DoubleType(), DataType.DATE: T.DateType(), DataType.TIMESTAMP: T.TimestampNTZType(),
    DataType.TIMESTAMPTZ: T.TimestampType(), DataType.BINARY: T.BinaryType(),
}


def spark_type(data_type: DataType, is_array: bool = False, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """Spark's type; NUMBER is decimal if it has a precision, all text-like types and TIME are strings."""
    if data_type is DataType.NUMBER:
        own: T.DataType = T.DecimalType(precision, scale or 0) if precision else T.DoubleType()
    else:
        own = _SPARK.get(data_type, T.StringType())
    return T.ArrayType(own) if is_array else own


def from_spark(kind: T.DataType) -> tuple[DataType, bool]:
    """(data type, is an array) of a Spark type; structs and maps are JSON."""
    if isinstance(kind, T.ArrayType):
        return from_spark(kind.elementType)[0], True
    if isinstance(kind, T.DecimalType):
        return DataType.NUMBER, False
    for ours, theirs in _SPARK.items():
        if isinstance(kind, type(theirs)):
            return ours, False
    return (DataType.JSON if isinstance(kind, (T.StructType, T.MapType, T.VariantType)) else DataType.VARCHAR), False


def from_python(kind: Any) -> tuple[DataType, bool]:
    """Type of a column from its Python annotation."""
    known = {bool: DataType.BOOL, int: DataType.BIGINT, float: DataType.NUMBER, dt.datetime: DataType.TIMESTAMP, dt.date: DataType.DATE, bytes: DataType.BINARY, dict: DataType.JSON}
    if kind is list or getattr(kind, "__origin__", None) is list:
        inner = getattr(kind, "__args__", (str,))[0]
        return known.get(inner, DataType.VARCHAR), True
    return known.get(kind, DataType.VARCHAR), False
