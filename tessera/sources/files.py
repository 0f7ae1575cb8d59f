"""Files: write, read back, merge, describe; layout options; user metadata; validation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.session import fresh_path

#: option -> default
DEFAULTS: dict[str, str] = {"stripe_size": "268435456", "compress": "ZLIB", "buffer_size": "262144", "row_index_stride": "10000", "create_index": "true"}
CODECS = ("NONE", "ZLIB", "SNAPPY", "LZO", "ZSTD", "LZ4")


class NotReadableError(ValueError):
    """A file is not of the format asked for."""


def resolve_options(table: Mapping[str, str], conf: Mapping[str, str]) -> dict[str, str]:
    """Table properties win over configuration, which wins over defaults; without an index the stride is 0."""
    out = {k: table.get(k, conf.get(k, v)) for k, v in DEFAULTS.items()}
    if out["compress"].upper() not in CODECS:
        raise ValueError(f"unknown codec {out['compress']}")
    if out["create_index"].lower() == "false":
        out["row_index_stride"] = "0"
    return out


def write(df: DataFrame, path: str, fmt: str = "orc", table: Mapping[str, str] | None = None, conf: Mapping[str, str] | None = None) -> None:
    """Write a table with resolved layout options."""
    o = resolve_options(table or {}, conf or {})
    out = df.write.option("compression", o["compress"].lower())
    if fmt == "orc":
        out = out.option("orc.stripe.size", o["stripe_size"]).option("orc.compress.size", o["buffer_size"]).option("orc.row.index.stride", o["row_index_stride"]).option("orc.create.index", o["create_index"])
    elif o["compress"].upper() == "ZLIB":
        out = df.write.option("compression", "zstd")
    out.format(fmt).save(path)


def open_table(spark: SparkSession, path: str, fmt: str = "orc") -> DataFrame:
    """Read a table; a file of another format is an error of our own."""
    try:
        return spark.read.format(fmt).load(path)
    except (PySparkException, Py4JJavaError) as e:
        raise NotReadableError(f"{path} is not {fmt}") from e


def validate(spark: SparkSession, paths: Iterable[str], fmt: str = "parquet") -> bool:
    """False for no paths at all or any that can't be read."""
    paths = list(paths)
    for p in paths:
        try:
            open_table(spark, p, fmt).schema  # noqa: B018
        except NotReadableError:
            return False
    return bool(paths)


def round_trip(df: DataFrame, fmt: str = "orc", table: Mapping[str, str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; zero rows keep their schema."""
    path = fresh_path(df.sparkSession, "table")
    write(df, path, fmt, table)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def merge(*parts: DataFrame, files: int | None = None) -> DataFrame:
    """Rows of several tables in one, by name; with ``files``, compacted to that many without a shuffle."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.coalesce(files) if files else out


def with_metadata(entries: DataFrame) -> DataFrame:
    """User metadata: of entries (seq, name, value) the last value of each name stays."""
    w = Window.partitionBy("name").orderBy(F.col("seq").desc())
    return entries.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("name", "value")


def metadata_value(metadata: DataFrame, name: str) -> bytes:
    """One value; an unknown name is an error."""
    row = metadata.where(F.col("name") == name).select("value").first()
    if row is None:
        raise KeyError(name)
    return row["value"]


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of constants."""
    return spark.createDataFrame(rows, T.StructType.fromDDL(schema) if schema.lower().startswith("struct") else schema)
