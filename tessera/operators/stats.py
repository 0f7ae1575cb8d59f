"""Column statistics: one aggregate per table, unpivoted; mergeable partials by stride; text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType)


def kind_of(t: T.DataType) -> str:
    """Class of statistics a type gets: boolean, integer, double, string or count."""
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, INT):
        return "integer"
    if isinstance(t, REAL):
        return "double"
    return "string" if isinstance(t, T.StringType) else "count"


def _unpivot(df: DataFrame, aggs: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """Aggregate once, then a row per column: ``aggs`` has each column's aggregates in the order of ``names``."""
    flat = [a.alias(f"{c}_{i}") for c, cols in aggs.items() for i, a in enumerate(cols)]
    row = df.agg(*flat)
    parts = ", ".join(f"'{c}', " + ", ".join(f"`{c}_{i}`" for i in range(len(cols))) for c, cols in aggs.items())
    return row.selectExpr(f"stack({len(aggs)}, {parts}) AS (column, {', '.join(names)})")


def counts(df: DataFrame) -> DataFrame:
    """column, value_count, null_count."""
    return _unpivot(df, {c: [F.count(c), F.count("*") - F.count(c)] for c in df.columns}, ["value_count", "null_count"])


def integers(df: DataFrame, *columns: str) -> DataFrame:
    """column, value_count, minimum, maximum, total; the total is NULL when it overflows."""
    return _unpivot(df, {c: [F.count(c), F.min(F.col(c).cast("long")), F.max(F.col(c).cast("long")), F.try_sum(F.col(c).cast("long"))] for c in columns}, ["value_count", "minimum", "maximum", "total"])


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    """column, value_count, minimum, maximum, total: a sum of doubles, whose last digits depend on the order of rows."""
    return _unpivot(df, {c: [F.count(c), F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double")), F.sum(F.col(c).cast("double"))] for c in columns}, ["value_count", "minimum", "maximum", "total"])


def strings(df: DataFrame, *columns: str) -> DataFrame:
    """column, value_count, minimum, maximum, in byte order."""
    return _unpivot(df, {c: [F.count(c), F.min(c), F.max(c)] for c in columns}, ["value_count", "minimum", "maximum"])


def booleans(df: DataFrame, **columns: Column) -> DataFrame:
    """column, value_count, true_count, false_count."""
    return _unpivot(df, {n: [F.count(c), F.count_if(c), F.count(c) - F.count_if(c)] for n, c in columns.items()}, ["value_count", "true_count", "false_count"])


def by_stride(laid: DataFrame, column: str) -> DataFrame:
    """Partials of an integer column by stripe and stride: n, lo, hi, total."""
    v = F.col(column).cast("long")
    return laid.groupBy("stripe", "stride").agg(F.count(column).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.try_sum(v).alias("total"))


def merge(partials: DataFrame, *keys: str) -> DataFrame:
    """Merge partials: an undefined total makes the result's undefined."""
    total = F.when(F.count_if((F.col("n") > 0) & F.col("total").isNull()) == 0, F.try_sum("total"))
    return partials.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), total.alias("total"))


def text(n: Column, lo: Column | None = None, hi: Column | None = None, total: Column | None = None, true: Column | None = None) -> Column:
    """``count: n min: a max: b sum: s`` with undefined parts left out; booleans have ``true: t``."""
    parts = [F.concat(F.lit("count: "), n.cast("string"))]
    for label, part in (("true: ", true), ("min: ", lo), ("max: ", hi), ("sum: ", total)):
        if part is not None:
            parts.append(F.concat(F.lit(label), part.cast("string")))
    return F.concat_ws(" ", *parts)


def _short(v: Column) -> Column:
    """A double to the hundredth where that shows it, else as it is."""
    return F.when((F.abs(v) < 1e18) & ((F.abs(v) >= 0.01) | (v == 0)), F.round(v, 2).cast("decimal(22,2)").cast("string")).otherwise(v.cast("string"))


def texts(df: DataFrame) -> DataFrame:
    """column, stats: the text form for every column of a table, in one pass."""
    aggs = {}
    for f in df.schema:
        c, kind = F.col(f.name), kind_of(f.dataType)
        if kind == "boolean":
            aggs[f.name] = [text(F.count(c), true=F.count_if(c))]
        elif kind == "integer":
            v = c.cast("long")
            aggs[f.name] = [text(F.count(c), F.min(v), F.max(v), F.try_sum(v))]
        elif kind == "double":
            v = c.cast("double")
            aggs[f.name] = [text(F.count(c), *[_short(x) for x in (F.min(v), F.max(v), F.sum(v))])]
        elif kind == "string":
            aggs[f.name] = [text(F.count(c), F.min(c), F.max(c))]
        else:
            aggs[f.name] = [text(F.count(c))]
    return _unpivot(df, aggs, ["stats"])
