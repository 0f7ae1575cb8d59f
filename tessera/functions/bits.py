"""Bit-level forms of values: zigzag, variable-length sizes, packed bits, split timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    """Signed to unsigned with small magnitudes small: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    """The inverse of ``zigzag``."""
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1).cast("long"))))


def varint_bytes(u: Column) -> Column:
    """Bytes of an unsigned value in groups of seven bits; a negative one has its top bit set and takes ten."""
    out = F.when(u < 0, F.lit(10))
    for k in range(1, 9):
        out = out.when(u < (1 << (7 * k)), F.lit(k))
    return out.otherwise(F.lit(9))


def pack_bits(positioned: DataFrame, bit: Column) -> DataFrame:
    """byte_index and value: eight bits per byte, the first row's bit highest; rows carry ``pos`` from 0."""
    shifted = F.when(bit, F.element_at(F.array(*[F.lit(1 << k) for k in range(7, -1, -1)]), (F.col("pos") % 8 + 1).cast("int"))).otherwise(0)
    return positioned.groupBy(F.expr("pos div 8").alias("byte_index")).agg(F.sum(shifted).cast("long").alias("value"))


def split_timestamp(micros: Column, base_micros: int) -> tuple[Column, Column]:
    """(seconds since the base, scaled nanoseconds): trailing zeros beyond one go to a count in the low three bits."""
    seconds = F.floor((micros - F.lit(base_micros)) / F.lit(1_000_000))
    nanos = F.pmod(micros, F.lit(1_000_000)) * 1000
    out = F.when(nanos == 0, F.lit(0).cast("long"))
    for zeros in range(8, 1, -1):
        out = out.when(nanos % 10**zeros == 0, F.shiftleft((nanos / 10**zeros).cast("long"), 3).bitwiseOR(F.lit(zeros - 1).cast("long")))
    return seconds.cast("long"), out.otherwise(F.shiftleft(nanos.cast("long"), 3))
