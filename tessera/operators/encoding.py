"""How columns would be encoded: dictionaries, encoding choice, carry-over, stride dictionaries, runs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.session import ship
from tessera.sources import codec as K


@dataclass(frozen=True)
class EncodingConfig:
    """Thresholds in tenths where they are ratios, so that comparisons stay in integers."""

    numeric_tenths: int = 7
    string_tenths: int = 8
    key_tenths: int = 9
    min_chars: int = 20
    interval: int = 30
    low_memory: bool = False


DEFAULT = EncodingConfig()


def dictionary(laid: DataFrame, column: str, *by: str) -> DataFrame:
    """Distinct non-null values with count, first position and stride of first appearance; per ``by`` (stripe, say)."""
    return laid.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.min_by("stride", "pos").alias("first_stride"))


def ordered(d: DataFrame, by: list[str], mode: str = "sorted") -> DataFrame:
    """Add ``id`` from 0.  Modes: sorted (by value), inserted (by first position), stride (values that occur once first, by
    stride and value, then the others by value).  ``by`` names the dictionary; a dictionary is no larger than a stripe.
    """
    keys = {
        "sorted": [F.col("value")],
        "inserted": [F.col("first_pos")],
        "stride": [(F.col("n") > 1).cast("int"), F.when(F.col("n") == 1, F.col("first_stride")), F.col("value")],
    }[mode]
    return d.withColumn("id", (F.row_number().over(Window.partitionBy(*by).orderBy(*keys)) - 1).cast("long"))


def encoded(laid: DataFrame, column: str, d: DataFrame) -> DataFrame:
    """stripe, pos and id of every row; NULL values have no id.  Joined by stripe and value."""
    return laid.select("stripe", "pos", F.col(column).alias("value")).join(d.select("stripe", "value", "id"), ["stripe", "value"], "left").select("stripe", "pos", "id")


def decoded(ids: DataFrame, d: DataFrame) -> DataFrame:
    """stripe, pos and value: the inverse of ``encoded``."""
    return ids.join(d.select("stripe", "id", "value"), ["stripe", "id"], "left").select("stripe", "pos", "value")


def numeric_choice(laid: DataFrame, column: str, config: EncodingConfig = DEFAULT) -> DataFrame:
    """Per stripe: rows (non-null), distinct_values, encoding.  Low memory always means DIRECT."""
    s = laid.groupBy("stripe").agg(F.count(column).alias("rows"), F.count_distinct(F.col(column)).alias("distinct_values"))
    use = (F.col("rows") > 0) & (10 * F.col("distinct_values") <= config.numeric_tenths * F.col("rows")) & F.lit(not config.low_memory)
    return s.withColumn("encoding", F.when(use, "DICTIONARY").otherwise("DIRECT"))


def characters(d: DataFrame, *by: str) -> DataFrame:
    """Distinct characters over all dictionary entries: ``chars`` per ``by``."""
    chars = d.select(*by, F.explode(F.array_distinct(F.split("value", ""))).alias("c")).where("c <> ''").distinct()
    return chars.groupBy(*by).agg(F.count("*").alias("chars"))


def string_choice(laid: DataFrame, column: str, config: EncodingConfig = DEFAULT) -> DataFrame:
    """Per stripe: rows (non-null), distinct_values, chars, encoding (NULL: no values, so the choice before stays).

    A dictionary is used if more than 1 - threshold of the values repeat, and either nearly all do or the dictionary's
    characters are varied.  The whole dictionary is looked at, not a random part of it.
    """
    d = dictionary(laid, column, "stripe")
    s = d.groupBy("stripe").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_values"))
    s = laid.select("stripe").distinct().join(s, "stripe", "left").join(characters(d, "stripe"), "stripe", "left").na.fill(0)
    repeats = 10 * (F.col("rows") - F.col("distinct_values"))
    use = ((repeats > config.key_tenths * F.col("rows")) | (F.col("chars") > config.min_chars)) & (repeats > (10 - config.string_tenths) * F.col("rows")) & F.lit(not config.low_memory)
    return s.withColumn("encoding", F.when(F.col("rows") == 0, None).when(use, "DICTIONARY").otherwise("DIRECT"))


def carried(choices: DataFrame, config: EncodingConfig = DEFAULT) -> DataFrame:
    """stripe and the encoding in force: decided every ``interval`` stripes and kept in between.

    A deciding stripe without values (NULL) leaves the decision before in force, DIRECT at the start.  A row per stripe;
    the deciding stripes, one in ``interval``, are put in order and joined on.
    """
    before = Window.orderBy("decided_at").rowsBetween(Window.unboundedPreceding, 0)  # a row for every ``interval`` stripes
    decide = choices.where(F.col("stripe") % config.interval == 0).select(F.col("stripe").alias("decided_at"), "encoding")
    decide = decide.select("decided_at", F.coalesce(F.last("encoding", ignorenulls=True).over(before), F.lit("DIRECT")).alias("effective"))
    at = F.expr(f"(stripe div {config.interval}) * {config.interval}")
    return choices.withColumn("decided_at", at).join(decide, "decided_at").select("stripe", "decided_at", "encoding", "effective")


def stride_dictionary(laid: DataFrame, column: str) -> DataFrame:
    """Per stripe and stride: values, those that occur once in the stripe (left out of its dictionary), the others."""
    once = F.count("*").over(Window.partitionBy("stripe", column)) == 1
    marked = laid.where(F.col(column).isNotNull()).select("stripe", "stride", once.alias("once"))
    return marked.groupBy("stripe", "stride").agg(F.count("*").alias("n_values"), F.count_if("once").alias("n_once"), F.count_if(~F.col("once")).alias("n_in_dictionary"))


def null_mask(laid: DataFrame, value: Column) -> DataFrame:
    """Per stripe: rows, rows with a value, and whether the mask is dropped because nothing is null."""
    return laid.groupBy("stripe").agg(F.count("*").alias("rows"), F.count(value).alias("present"), (F.count("*") == F.count(value)).alias("suppressed"))


LONGEST_RUN, SHORTEST_RUN = 130, 3


def equal_runs(laid: DataFrame, column: str) -> DataFrame:
    """Runs of equal neighbours within a stripe, cut at 130: stripe, start_pos, value, length, kind (run or literal)."""
    w = Window.partitionBy("stripe").orderBy("pos")
    starts = laid.select("stripe", "pos", F.col(column).alias("value")).withColumn("new", (~F.col("value").eqNullSafe(F.lag("value").over(w)) | F.lag("pos").over(w).isNull()).cast("long"))
    runs = starts.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("stripe", "run").agg(F.min("pos").alias("first_pos"), F.count("*").alias("total"), F.first("value").alias("value"))
    return _cut(runs)


def _cut(runs: DataFrame, *more: str) -> DataFrame:
    """Cut runs of ``total`` rows at ``first_pos`` into parts of at most ``LONGEST_RUN``."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {LONGEST_RUN}"))).alias("part")
    cut = runs.select("stripe", "first_pos", "total", "value", *more, part)
    length = F.least(F.lit(LONGEST_RUN).cast("long"), F.col("total") - F.col("part") * LONGEST_RUN)
    return cut.select("stripe", (F.col("first_pos") + F.col("part") * LONGEST_RUN).alias("start_pos"), "value", *more, length.alias("length")).withColumn("kind", F.when(F.col("length") >= SHORTEST_RUN, "run").otherwise("literal"))


def coded_runs(laid: DataFrame, column: str) -> DataFrame:
    """Runs and literals of the integer code of each stripe: stripe, start_pos, value (the first), delta, length, kind.

    As the writer makes them, greedily from a stripe's first value: runs of 3 to 130 values with one difference from
    -128 to 127, literals of up to 128 values.  NULL values aren't coded; positions are those of the rows.
    """
    ship(laid.sparkSession)

    def runs(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        stripe, pos, v = (table.column(i).to_numpy() for i in range(3))
        code = K.integer_code(v)
        ends = np.append(code.values[1:], len(v))
        size = ends - code.values
        control = np.frombuffer(code.data, np.uint8)[code.bytes_]
        run = control < 128
        delta = pa.array(np.frombuffer(code.data + b"\0", np.int8)[code.bytes_ + 1].astype(np.int64), mask=~run)
        return pa.table({"stripe": stripe[code.values], "start_pos": pos[code.values], "value": v[code.values], "delta": delta, "length": size, "kind": np.where(run, "run", "literal")})

    rows = laid.select("stripe", "pos", F.col(column).cast("long").alias("value")).where("value IS NOT NULL")
    return rows.groupBy("stripe").applyInArrow(runs, "stripe long, start_pos long, value long, delta long, length long, kind string")


def byte_runs(values: list[int]) -> bytes:
    """Byte run-length code: a run of 3 to 130 is (length - 3, value), a stretch of literals (-length, values...)."""
    out, i, pending = bytearray(), 0, []

    def flush():
        for k in range(0, len(pending), 128):
            some = pending[k : k + 128]
            out.append((-len(some)) & 0xFF)
            out.extend(v & 0xFF for v in some)
        pending.clear()

    while i < len(values):
        j = i
        while j < len(values) and values[j] == values[i] and j - i < LONGEST_RUN:
            j += 1
        if j - i >= SHORTEST_RUN:
            flush()
            out += bytes([j - i - SHORTEST_RUN, values[i] & 0xFF])
            i = j
        else:
            pending.append(values[i])
            i += 1
    flush()
    return bytes(out)


def byte_values(code: bytes) -> list[int]:
    """The values of a byte run-length code, as unsigned bytes."""
    out, i = [], 0
    while i < len(code):
        n = code[i]
        if n < 128:
            out += [code[i + 1]] * (n + SHORTEST_RUN)
            i += 2
        else:
            out += code[i + 1 : i + 1 + 256 - n]
            i += 1 + 256 - n
    return out


def _varint(u: int) -> bytes:
    out = bytearray()
    while u > 127:
        out.append(u & 127 | 128)
        u >>= 7
    return bytes([*out, u])


def integer_runs(values: list[int], signed: bool = True) -> bytes:
    """Integer run-length code: (length - 3, difference, first value) for 3 to 130 values of one difference from -128 to
    127, and (-length, values...) for up to 128 others; values are variable-length, zigzag where signed.
    """
    number = (lambda v: _varint(2 * v if v >= 0 else -2 * v - 1)) if signed else _varint
    out, i, pending = bytearray(), 0, []

    def flush():
        for k in range(0, len(pending), 128):
            some = pending[k : k + 128]
            out.append((-len(some)) & 0xFF)
            for v in some:
                out.extend(number(v))
        pending.clear()

    while i < len(values):
        j = i + 1
        d = values[j] - values[i] if j < len(values) else 0
        while -128 <= d <= 127 and j < len(values) and values[j] - values[j - 1] == d and j - i < LONGEST_RUN:
            j += 1
        if j - i >= SHORTEST_RUN:
            flush()
            out += bytes([j - i - SHORTEST_RUN, d & 0xFF]) + number(values[i])
            i = j
        else:
            pending.append(values[i])
            i += 1
    flush()
    return bytes(out)


def integer_values(code: bytes, signed: bool = True) -> list[int]:
    """The values of an integer run-length code."""
    out, i = [], 0

    def number() -> int:
        nonlocal i
        u = shift = 0
        while True:
            b = code[i]
            i += 1
            u |= (b & 127) << shift
            shift += 7
            if b < 128:
                return (u >> 1) ^ -(u & 1) if signed else u

    while i < len(code):
        n = code[i]
        i += 1
        if n < 128:
            d = code[i] - 256 if code[i] > 127 else code[i]
            i += 1
            v = number()
            out += [v + k * d for k in range(n + SHORTEST_RUN)]
        else:
            out += [number() for _ in range(256 - n)]
    return out
