"""Recursive rounding of every floating value inside structs, arrays and maps; integers
and strings untouched (response formatting as a column expression)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _round(c: Column, dt: T.DataType, digits: int) -> Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        scale = float(10**digits)
        return F.rint(c * scale) / scale
    if isinstance(dt, T.StructType):
        return F.struct(*[_round(c.getField(f.name), f.dataType, digits).alias(f.name) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda e: _round(e, dt.elementType, digits))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda k, v: _round(v, dt.valueType, digits))
    return c


def round_nested(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*[_round(F.col(f"`{f.name}`"), f.dataType, digits).alias(f.name) for f in df.schema.fields])
