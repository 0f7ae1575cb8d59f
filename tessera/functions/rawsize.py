"""Raw data size: bytes a value takes before encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIXED = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 12, T.TimestampNTZType: 12}


def size(c: Column, t: T.DataType) -> Column:
    """NULL 1; fixed widths by type; strings and binaries their bytes; nested values the sum of what they hold."""
    if type(t) in _FIXED:
        inner = F.lit(_FIXED[type(t)]).cast("long")
    elif isinstance(t, (T.StringType, T.BinaryType)):
        inner = F.octet_length(c).cast("long")
    elif isinstance(t, T.ArrayType):
        inner = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + size(x, t.elementType))
    elif isinstance(t, T.MapType):
        inner = F.aggregate(F.map_entries(c), F.lit(0).cast("long"), lambda a, e: a + size(e["key"], t.keyType) + size(e["value"], t.valueType))
    elif isinstance(t, T.StructType):
        if [f.name for f in t][:1] == ["tag"]:  # a union: the chosen child and one byte
            inner = F.lit(1).cast("long")
            for i, f in enumerate(t.fields[1:]):
                inner = inner + F.when(c["tag"] == i, size(c[f.name], f.dataType)).otherwise(F.lit(0).cast("long"))
        else:
            inner = sum((size(c[f.name], f.dataType) for f in t), F.lit(0).cast("long"))
    else:
        raise TypeError(f"no raw size for {t.simpleString()}")
    return F.when(c.isNull(), F.lit(1).cast("long")).otherwise(inner)


def row_size(df: DataFrame) -> Column:
    """Raw size of a row."""
    return sum((size(F.col(f.name), f.dataType) for f in df.schema), F.lit(0).cast("long"))


def total(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``raw_size`` of a table."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row_size(df)), F.lit(0)).cast("long").alias("raw_size"))
