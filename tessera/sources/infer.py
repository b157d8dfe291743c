"""createDataFrame with narrow integers, widening across rows and exact nullability."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_RANK = [T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()]


def value_type(value: Any) -> T.DataType:
    """The narrowest type of a Python value: integers fit 32 bits or become bigint."""
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.IntegerType() if -(2**31) <= value < 2**31 else T.LongType()
    for kind, out in ((float, T.DoubleType()), (str, T.StringType()), (dt.datetime, T.TimestampType()), (dt.date, T.DateType())):
        if isinstance(value, kind):
            return out
    if isinstance(value, list | tuple):
        inner: T.DataType = T.NullType()
        for v in value:
            inner = common_type(inner, value_type(v))
        return T.ArrayType(inner, any(v is None for v in value))
    if isinstance(value, Mapping):
        key, inner = T.NullType(), T.NullType()
        for k, v in value.items():
            key, inner = common_type(key, value_type(k)), common_type(inner, value_type(v))
        return T.MapType(key, inner, any(v is None for v in value.values()))
    raise TypeError(f"no type for {type(value).__name__}")


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type both fit: null with anything, int < bigint < double < string, strings with anything atomic."""
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType), common_type(a.valueType, b.valueType), a.valueContainsNull or b.valueContainsNull)
    if a in _RANK and b in _RANK:
        return max(a, b, key=_RANK.index)
    if T.StringType() in (a, b) and not any(isinstance(t, T.ArrayType | T.MapType | T.StructType) for t in (a, b)):
        return T.StringType()
    raise TypeError(f"{a.simpleString()} and {b.simpleString()} have no common type")


def _fit(value: Any, kind: T.DataType) -> Any:
    """A Python value as Spark takes it for a type; NaN is null, as everywhere in rows that come from Python."""
    if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(kind, T.ArrayType):
        return [_fit(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {_fit(k, kind.keyType): _fit(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.StructType):
        cells = [value.get(f.name) for f in kind.fields] if isinstance(value, Mapping) else value
        return tuple(_fit(v, f.dataType) for v, f in zip(cells, kind.fields, strict=True))
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return str(value).lower() if isinstance(value, bool) else str(value)
    if isinstance(kind, T.DoubleType | T.FloatType):
        return float(value)
    return int(value) if isinstance(kind, T.IntegralType) and not isinstance(value, bool) else value


def create_dataframe(spark: SparkSession, rows: Sequence[Sequence[Any] | Mapping[str, Any]] | pd.DataFrame, schema: T.StructType | str | Sequence[str] | None = None) -> DataFrame:
    """A frame of Python rows, of mappings whose keys become columns in the order first seen, or of a pandas frame (with a schema, by position).

    ``schema`` is a type, its DDL string, or names alone, whose types follow from the rows.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if isinstance(rows, pd.DataFrame):
        if not isinstance(schema, T.StructType):
            raise TypeError("a pandas frame needs a schema with types")
        rows = [list(r) for r in rows.itertuples(index=False, name=None)]
    if rows and isinstance(rows[0], Mapping):
        names = schema.names if isinstance(schema, T.StructType) else list(dict.fromkeys(k for r in rows for k in r))
        rows = [[r.get(k) for k in names] for r in rows]
        schema = schema if isinstance(schema, T.StructType) else names
    if not isinstance(schema, T.StructType):
        width = len(rows[0]) if rows else len(schema or ())
        fields = []
        for i, name in enumerate(schema or [f"_{i + 1}" for i in range(width)]):
            kind: T.DataType = T.NullType()
            for r in rows:
                kind = common_type(kind, value_type(r[i]))
            fields.append(T.StructField(name, kind, any(r[i] is None for r in rows)))
        schema = T.StructType(fields)
    return spark.createDataFrame([tuple(_fit(v, f.dataType) for v, f in zip(r, schema.fields, strict=True)) for r in rows], schema)
