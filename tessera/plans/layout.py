"""Row positions, stripes and strides.

A stripe is a fixed number of rows and a stride a fixed number of rows within it, so both are functions of a row's
position.  Tables with a dense key have the key as position: no sort and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.session import settle

STRIPE_ROWS, STRIDE_ROWS, MIN_STRIDE = 4096, 1000, 1000


def lay_out(df: DataFrame, pos: str | Column, stripe_rows: int = STRIPE_ROWS, stride_rows: int = STRIDE_ROWS) -> DataFrame:
    """Add ``pos``, ``stripe`` and ``stride``.  A stride of 0 means no index: one stride per stripe."""
    if stride_rows and stride_rows < MIN_STRIDE:
        raise ValueError(f"a stride has at least {MIN_STRIDE} rows")
    p = (F.col(pos) if isinstance(pos, str) else pos).cast("long")
    out = df.withColumn("pos", p)
    stride = F.expr(f"(pos % {stripe_rows}L) div {stride_rows}L") if stride_rows else F.lit(0).cast("long")
    return out.withColumn("stripe", F.expr(f"pos div {stripe_rows}L")).withColumn("stride", stride)


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """Add a gapless ``pos`` from 0 in the given order, for tables without a dense key.

    Rows are dealt by ranges of the order and numbered within each range; the ranges' sizes give offsets.  The ranges
    are settled first, since drawing them twice might cut them differently.  Only one number per range reaches the
    driver.
    """
    dealt = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id())
    dealt = settle(dealt, "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row per range
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_local", local).join(F.broadcast(starts.select("_range", "start")), "_range").withColumn("pos", (F.col("start") + F.col("_local")).cast("long")).drop("_range", "_local", "start")
