"""Tables of stripe files: written, listed, scanned, joined and described by tasks.

A table is a folder of files and a manifest, which Spark commits and which names the files of the attempts that
succeeded, in the order of rows.  Whatever is read of a file (footers, stripe lists, streams) is read by a task; the
driver sees one number or one row a file at most.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.session import ship
from tessera.sources import stripes as S

MANIFEST = "part long, seq long, path string, rows long, bytes long"
STRIPES = "part long, seq long, path string, stripe long, start long, index_bytes long, data_bytes long, footer_bytes long, rows long, first_row long, raw_size long"
FILES = "part long, seq long, path string, rows long, codec string, block long, stride long, content long, stripes long, raw_size long, type string, metadata map<string, binary>"
STATS = "part long, seq long, path string, stripe long, stride long, column long, name string, kind string, n long, low_integer long, high_integer long, sum_integer long, low_double double, high_double double, sum_double double, low_string string, high_string string, n_true long, has_null boolean, text string"
STREAMS = "part long, seq long, path string, stripe long, place long, column long, name string, stream string, bytes long, encoding string, dictionary_size long"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it, for file:, hdfs:, s3:, gs: and plain paths."""
    return pafs.FileSystem.from_uri(re.sub("^file:/(?=[^/])", "file:///", uri))


def spark_type(n: S.Node, keep: frozenset[int] | None = None) -> T.DataType:
    """The Spark type of a file's type; of structs only fields with a number in ``keep``."""
    if n.kind == "STRUCT":
        return T.StructType([T.StructField(x, spark_type(k, keep)) for x, k in zip(n.names, n.kids, strict=True) if keep is None or k.id in keep])
    if n.kind == "UNION":
        return T.StructType([T.StructField("tag", T.ByteType()), *[T.StructField(f"f{i}", spark_type(k, keep)) for i, k in enumerate(n.kids)]])
    if n.kind == "LIST":
        return T.ArrayType(spark_type(n.kids[0], keep))
    if n.kind == "MAP":
        return T.MapType(spark_type(n.kids[0], keep), spark_type(n.kids[1], keep))
    return {"BOOLEAN": T.BooleanType(), "BYTE": T.ByteType(), "SHORT": T.ShortType(), "INT": T.IntegerType(), "LONG": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BINARY": T.BinaryType(), "TIMESTAMP": T.TimestampNTZType(), "DATE": T.DateType()}[n.kind]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    """The Arrow schema of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    S.tree(pa.struct(list(out)))  # types that the format lacks are an error here, not in a task
    return out


def paths_of(root: S.Node) -> dict[int, str]:
    """number -> dotted name of every type; the root's is empty."""
    out = {root.id: ""}

    def walk(n: S.Node) -> None:
        names = n.names if n.kind == "STRUCT" else [f"f{i}" for i in range(len(n.kids))] if n.kind == "UNION" else ["_elem"] if n.kind == "LIST" else ["_key", "_value"]
        for x, k in zip(names, n.kids, strict=False):
            out[k.id] = f"{out[n.id]}.{x}" if out[n.id] else x
            walk(k)

    walk(root)
    return out


def _batch(rows: Sequence[tuple], ddl: str) -> pa.RecordBatch:
    """Rows as a batch of a flat schema."""
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "map<string, binary>": pa.map_(pa.string(), pa.binary())}
    fields = [x.split(" ", 1) for x in re.split(r", (?=\w+ (?:long|string|double|boolean|binary|map))", ddl)]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


# --- writing ----------------------------------------------------------------------------------------------------


def _create(folder: str):
    """An open file of this attempt, and what puts it in place and gives its manifest row."""
    task = TaskContext.get()
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.orc"
    sink = fs.open_output_stream(f"{root}/.{name}", compression=None)

    def done(part: int, rows: int, size: int) -> pa.RecordBatch:
        fs.move(f"{root}/.{name}", f"{root}/{name}")
        return _batch([(part, 0, f"{folder}/{name}", rows, size)], MANIFEST)

    return sink, done


def _write(folder: str, schema: pa.Schema, options: S.Options, metadata: dict[str, bytes], even_empty: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        writer = None
        for batch in batches:
            if writer is None and (batch.num_rows or even_empty):
                sink, done = _create(folder)
                writer = S.Writer(sink, schema, options, metadata)
            if batch.num_rows and not even_empty:
                writer.add(pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns, schema, strict=True)], schema=schema))
        if writer is not None:
            writer.close()
            yield done(TaskContext.get().partitionId(), sum(s[4] for s in writer.stripes), writer.at)

    return run


def write(df: DataFrame, folder: str, options: S.Options | None = None, metadata: dict[str, bytes] | None = None) -> DataFrame:
    """Write a table, a file a partition that has rows; its manifest.  Of no rows, a file that has the schema."""
    spark = df.sparkSession
    ship(spark)
    schema = arrow_schema(df.schema)
    options, metadata = options or S.Options(), metadata or {}
    df.mapInArrow(_write(folder, schema, options, metadata, False), MANIFEST).write.parquet(f"{folder}/_manifest")
    out = manifest(spark, folder)
    if out.isEmpty():
        spark.range(1, numPartitions=1).mapInArrow(_write(folder, schema, options, metadata, True), MANIFEST).write.mode("append").parquet(f"{folder}/_manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a table, a row each."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


# --- footers ----------------------------------------------------------------------------------------------------


def _per_file(ddl: str, rows_of):
    """mapInArrow over (part, seq, path): the rows that ``rows_of`` gives for each file's reader."""

    def run(batches):
        for batch in batches:
            for part, seq, path in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    rows = [(part, seq, path, *r) for r in rows_of(S.Reader(f, path))]
                if rows:
                    yield _batch(rows, ddl)

    return run


def _listing(files: DataFrame, ddl: str, rows_of) -> DataFrame:
    ship(files.sparkSession)
    return files.select("part", "seq", "path").mapInArrow(_per_file(ddl, rows_of), ddl)


def stripe_list(files: DataFrame) -> DataFrame:
    """``STRIPES`` of a manifest's files."""
    return _listing(files, STRIPES, lambda r: [(s.number, s.start, s.index, s.data, s.footer, s.rows, s.first_row, s.raw_size) for s in r.stripes])


def file_list(files: DataFrame) -> DataFrame:
    """``FILES``: what each file's footer says of the file."""
    return _listing(files, FILES, lambda r: [(r.rows, r.codec, r.block, r.stride, r.content, len(r.stripes), sum(s.raw_size for s in r.stripes), spark_type(r.root).simpleString(), list(r.metadata.items()))])


def _stat_row(where: tuple[int, int], column: int, name: str, s: S.Stats) -> tuple:
    integer, real, text = s.kind in S.INTEGERS, s.kind in ("FLOAT", "DOUBLE"), s.kind == "STRING"
    pick = lambda on, *v: v if on else (None,) * len(v)
    show = lambda v: None if v is None else v.decode()
    return (*where, column, name, s.kind, s.n, *pick(integer, s.low, s.high, s.total), *pick(real, s.low, s.high, s.total), *(pick(text, show(s.low), show(s.high)) if text else (None, None)), s.true, s.has_null, s.text())


def file_stats(files: DataFrame) -> DataFrame:
    """``STATS`` of every column of each file, from its footer (stripe and stride null)."""
    return _listing(files, STATS, lambda r: [_stat_row((None, None), c, paths_of(r.root)[c], s) for c, s in r.stats.items()])


def stride_stats(files: DataFrame, *columns: str) -> DataFrame:
    """``STATS`` of the named columns by stripe and stride, from the files' indexes; of all columns if none is named."""

    def rows_of(r: S.Reader):
        for c, name in paths_of(r.root).items():
            if name in columns or not columns:
                for s in r.stripes:
                    for k, (_, stats) in enumerate(r.index(s, c)):
                        yield _stat_row((s.number, k), c, name, stats)

    return _listing(files, STATS, rows_of)


def merge_stats(stats: DataFrame, *keys: str) -> DataFrame:
    """Merge ``STATS`` by column and keys; an undefined integer sum makes the result's undefined, as does an overflow."""
    total = F.when(F.count_if((F.col("n") > 0) & F.col("sum_integer").isNull()) == 0, F.try_sum("sum_integer"))
    low, high = ([F.expr(f"{f}({n}_{k})").alias(f"{n}_{k}") for k in ("integer", "double", "string")] for f, n in (("min", "low"), ("max", "high")))
    return stats.groupBy(*keys, "column", "name", "kind").agg(F.sum("n").alias("n"), *low, *high, total.alias("sum_integer"), F.sum("sum_double").alias("sum_double"), F.sum("n_true").alias("n_true"), F.bool_or("has_null").alias("has_null"))


def stream_list(files: DataFrame) -> DataFrame:
    """``STREAMS``: the streams of each stripe in the file's order, with the encoding of their column."""

    def rows_of(r: S.Reader):
        names = paths_of(r.root)
        for s in r.stripes:
            streams, encodings = r.layout(s)
            for k, (kind, c, _, n) in enumerate(streams):
                yield s.number, k, c, names[c], kind, n, *encodings[c]

    return _listing(files, STREAMS, rows_of)


def metadata_value(files: DataFrame, name: str) -> bytes:
    """User metadata stored in a table's files; an unknown name is an error."""
    row = file_list(files).where(F.array_contains(F.map_keys("metadata"), name)).select(F.col("metadata")[name].alias("v")).first()
    if row is None:
        raise KeyError(name)
    return bytes(row["v"])


def validate(spark: SparkSession, paths: Sequence[str]) -> bool:
    """False for no files at all or if any of them is no stripe file; each one's tail is read, by tasks."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for path in batch.column(2).to_pylist():
                try:
                    fs, at = filesystem(path)
                    with fs.open_input_file(at) as f:
                        S.Reader(f, path)
                    good = True
                except (OSError, S.NotAStripeFileError):
                    good = False
                yield pa.RecordBatch.from_arrays([pa.array([good])], names=["good"])

    if not paths:
        return False
    files = spark.createDataFrame([(i, 0, p) for i, p in enumerate(paths)], "part long, seq long, path string")
    return files.mapInArrow(run, "good boolean").where("NOT good").isEmpty()


def dump(files: DataFrame) -> DataFrame:
    """path, line, text: what a person wants to know of a file."""

    def rows_of(r: S.Reader):
        names, out = paths_of(r.root), []
        out += [f"Rows: {r.rows}", f"Compression: {r.codec}", f"Compression size: {r.block}", f"Raw data size: {sum(s.raw_size for s in r.stripes)}", f"Stride: {r.stride}", f"Type: {spark_type(r.root).simpleString()}"]
        out += [f"Metadata {k}: {len(v)} bytes" for k, v in sorted(r.metadata.items())]
        out += [f"Column {c} {names[c]} {s.text()}".replace("  ", " ") for c, s in r.stats.items()]
        for s in r.stripes:
            streams, encodings = r.layout(s)
            out.append(f"Stripe {s.number}: offset {s.start} data {s.data} index {s.index} tail {s.footer} rows {s.rows} raw {s.raw_size}")
            out += [f"Stream: column {c} {kind} start {at} length {n}" for kind, c, at, n in streams]
            out += [f"Encoding column {c}: {kind}" + f"[{n}]" * (kind == "DICTIONARY") for c, (kind, n) in enumerate(encodings)]
        return enumerate(out)

    return _listing(files, "part long, seq long, path string, line long, text string", rows_of)


# --- scans ------------------------------------------------------------------------------------------------------


def schema_of(files: DataFrame) -> S.Node:
    """The types of a table, from its first file."""
    first = files.orderBy("part", "seq").select("path").first()
    if first is None:
        raise S.NotAStripeFileError("no files")
    row = files.where(F.col("path") == first["path"])
    ship(files.sparkSession)

    def run(batches):
        import pickle

        for batch in batches:
            for path in batch.column(2).to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(S.Reader(f, path).root)])], names=["root"])

    import pickle

    return pickle.loads(row.select("part", "seq", "path").mapInArrow(run, "root binary").first()["root"])


def _fits(s: S.Stats, low, high) -> bool:
    """Whether values between low and high can be among those of the statistics."""
    if not s.n:
        return False
    if s.low is None:
        return True
    low, high = (x.encode() if isinstance(x, str) else x for x in (low, high))
    return (high is None or s.low <= high) and (low is None or s.high >= low)


def _scan(ids: Sequence[int] | None, where: tuple[str, int, object, object] | None, seek: int, positions: bool):
    """mapInArrow over (path, stripe, first position): rows of the stripes."""

    def spans_of(reader: S.Reader, s: S.Stripe, first: int) -> list[tuple[int, int]]:
        """Ranges of the stripe's rows that are looked at: strides that can have wanted values, from the position on."""
        step, spans = reader.stride or s.rows, [(0, s.rows)]
        if where is not None and (index := reader.index(s, where[1])):
            spans = [(k * step, min((k + 1) * step, s.rows)) for k, (_, stats) in enumerate(index) if _fits(stats, *where[2:])]
        return [(max(a, seek - first), b) for a, b in spans if first + b > seek]

    def rows_of(reader: S.Reader, number: int, first: int):
        s = reader.stripes[number]
        spans = spans_of(reader, s, first)
        if not spans:
            return
        rows = reader.read(s, ids if where is None or ids is None else [*ids, where[1]])
        names = [f.name for f in reader.root.arrow(S.chosen(reader.root, ids))]
        for a, b in spans:
            part, at = rows.slice(a, b - a), pa.array(range(first + a, first + b), pa.int64())
            if where is not None:
                column = part.field(where[0])
                least, most = (pa.scalar(x, column.type) for x in where[2:])
                keep = pc.fill_null(pc.and_kleene(pc.greater_equal(column, least), pc.less_equal(column, most)), False)
                part, at = part.filter(keep), at.filter(keep)
            cols = {n: part.field(n) for n in names} | ({"pos": at} if positions else {})
            for k in range(0, len(part), 10_000):
                yield pa.RecordBatch.from_arrays([c.slice(k, 10_000) for c in cols.values()], names=list(cols))

    def run(batches):
        uri, source, reader = "", None, None
        try:
            for batch in batches:
                for path, number, first in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    if path != uri:
                        if source is not None:
                            source.close()
                        fs, at = filesystem(path)
                        uri, source = path, fs.open_input_file(at)
                        reader = S.Reader(source, path)
                    yield from rows_of(reader, number, first)
        finally:
            if source is not None:
                source.close()

    return run


def scan(files: DataFrame, *, ids: Sequence[int] | None = None, split: tuple[int, int] | None = None, where: tuple[str, object, object] | None = None, seek: int = 0, positions: bool = False) -> DataFrame:
    """Rows of a table.

    ``ids``: numbers of the types to read, in the order of the type tree; a chosen one brings what is below it, a field of
    a struct only itself.  ``split``: of each file, stripes that begin in so many bytes from an offset.  ``where``: a
    top-level column with a least and a largest value; strides whose statistics exclude these are passed over, stripes
    without a stride that fits aren't read.  ``seek``: the first row wanted, counted over the table; negative ones and
    those past the end are errors.  ``positions``: a column ``pos`` with a row's number in the table.  Tasks get stripes of about ``spark.sql.files.maxPartitionBytes``.

    Spark takes the rows for as few bytes as the manifest has, so a join by equal keys is told to sort, not to broadcast them.
    """
    spark = files.sparkSession
    root = schema_of(files)
    schema = spark_type(root, S.chosen(root, ids))
    names = paths_of(root)
    test = None
    if where is not None:
        test = (where[0], next(k.id for k in root.kids if names[k.id] == where[0]), *where[1:])
    stripes = stripe_list(files)
    if seek < 0:
        raise ValueError("seek before the first row")
    if seek:
        rows = files.agg(F.sum("rows").alias("n")).first()["n"] or 0
        if seek >= rows:
            raise ValueError(f"seek to row {seek} of {rows}")
    if seek or positions:
        before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
        starts = files.select("path", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
        stripes = stripes.join(starts, "path").withColumn("first", F.col("before") + F.col("first_row")).where(F.col("first") + F.col("rows") > seek)
    else:
        stripes = stripes.withColumn("first", F.col("first_row"))
    if split is not None:
        stripes = stripes.where((F.col("start") >= split[0]) & (F.col("start") < split[0] + split[1]))
    size = files.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    stripes = stripes.select("part", "seq", "path", "stripe", "first").repartitionByRange(max(1, -(-size // most)), "part", "seq", "stripe").sortWithinPartitions("part", "seq", "stripe")
    more = [T.StructField("pos", T.LongType())] * positions
    return stripes.select("path", "stripe", "first").mapInArrow(_scan(ids, test, seek, positions), T.StructType([*schema.fields, *more])).hint("merge")


def raw_stripes(files: DataFrame) -> DataFrame:
    """path, stripe, rows, content: stripes as bytes."""
    return _listing(files, "part long, seq long, path string, stripe long, rows long, content binary", lambda r: [(s.number, s.rows, r.raw(s)) for s in r.stripes])


def concatenate(files: DataFrame, folder: str, per_file: int = 8) -> DataFrame:
    """One file for every ``per_file`` files of a manifest, in their order: stripes are copied as bytes and statistics
    merged, nothing is decoded.  The new table's manifest.
    """
    spark = files.sparkSession
    ship(spark)

    def run(batches):
        for batch in batches:
            for group, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sources = []
                try:
                    for p in paths:
                        fs, at = filesystem(p["path"])
                        sources.append(fs.open_input_file(at))
                    readers = [S.Reader(f, p["path"]) for f, p in zip(sources, paths, strict=True)]
                    sink, done = _create(folder)
                    S.concatenate(readers, sink, S.Options(codec=readers[0].codec, block=readers[0].block, stride=readers[0].stride))
                    yield done(group, sum(r.rows for r in readers), sum(r.content for r in readers))
                finally:
                    for f in sources:
                        f.close()

    number = F.row_number().over(Window.orderBy("part", "seq")) - 1  # a row a file
    groups = files.withColumn("group", F.floor(number / per_file))
    groups = groups.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "path"))).alias("paths"))  # per_file rows each
    groups.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    return manifest(spark, folder)
