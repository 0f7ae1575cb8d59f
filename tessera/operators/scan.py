"""Scans: projection, splits, seeks, null padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project_ids(df: DataFrame, ids: Sequence[int] | None) -> DataFrame:
    """Top-level columns by ordinal; none given means all."""
    return df.select(*[df.columns[i] for i in ids]) if ids else df


def null_padded(df: DataFrame, ids: Sequence[int]) -> DataFrame:
    """All columns in place; those not chosen read as NULL of their type."""
    keep = set(ids)
    return df.select(*[F.col(f.name) if i in keep else F.lit(None).cast(f.dataType).alias(f.name) for i, f in enumerate(df.schema)])


def conform(df: DataFrame, table: T.StructType) -> DataFrame:
    """Positional schema evolution: columns past the file's last read as NULL, names come from the table."""
    have = df.columns
    return df.select(*[(F.col(have[i]) if i < len(have) else F.lit(None)).cast(f.dataType).alias(f.name) for i, f in enumerate(table)])


def split(laid: DataFrame, first: int, length: int, stripe_rows: int) -> DataFrame:
    """Rows of stripes whose first row lies in [first, first + length).

    As bounds on the position, so that a table whose key is its position gets them as pushed filters.
    """
    low, high = (-(-x // stripe_rows) * stripe_rows for x in (first, first + length))
    return laid.where((F.col("pos") >= low) & (F.col("pos") < high))


def seek(laid: DataFrame, row: int) -> DataFrame:
    """Rows from a position on; a negative position is an error."""
    if row < 0:
        raise ValueError("seek before the first row")
    return laid.where(F.col("pos") >= row)


def strict(df: DataFrame, column: str, kind: str) -> F.Column:
    """A typed read without widening: the column must have the type asked for, and a NULL value raises."""
    have = df.schema[column].dataType.simpleString()
    if have != kind:
        raise TypeError(f"{column} is {have}, not {kind}")
    return F.when(F.col(column).isNull(), F.raise_error(F.lit(f"no value in {column}"))).otherwise(F.col(column))


def prune_strides(laid: DataFrame, stats: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows with low <= column <= high, reading only strides whose value range can hold one.

    ``stats`` has stripe, stride, lo and hi: one row for every few thousand of the table's.
    """
    can = stats.where((F.col("lo") <= high) & (F.col("hi") >= low)).select("stripe", "stride")
    return laid.join(can, ["stripe", "stride"], "left_semi").where(F.col(column).between(low, high))
