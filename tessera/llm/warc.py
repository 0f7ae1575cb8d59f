"""WARC archives as seekable Zstandard bundles.

A bundle is one file: independent Zstandard frames, each of a group of whole WARC records, and a footer frame with the
seek table (the skippable frame that the seekable format defines: compressed and uncompressed size of every frame).
The index maps each record to its bundle, frame and offset within the frame's content, so one record costs one frame.

Executors write bundles straight to a shared folder and rename them into place.  Their names carry the attempt of the
task, and the index, which Spark commits, only names those of attempts that succeeded; others are left over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: Content gathered before a frame is closed, and before a bundle is; level of compression.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 3
INDEX = "record_id long, bundle string, frame long, frame_start long, frame_bytes long, frame_content long, at long, length long"
#: The seek table has 32 bits for a frame's sizes; with a record of up to 2 GiB on top, a frame stays below 4 GiB.
MOST_FRAME_BYTES = 1 << 30
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it, for file:, hdfs:, s3:, gs: and plain paths."""
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match("file:/[^/]", uri) else uri)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block and names the record it refers to.

    A record is named by its page and payload, so pages that share an id have records of their own.
    """
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}:{sha}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head.append("WARC-Target-URI: " + (url or "").translate({10: None, 13: None}))
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}:{sha}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = payload if refers_to is None else b""
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; checks the framing."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("bad record length")
    return fields, rest[:n]


class Bundle:
    """Writes one bundle: ``add`` records, then ``close``."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        if not 0 < frame_bytes <= MOST_FRAME_BYTES:
            raise ValueError(f"a frame holds up to {MOST_FRAME_BYTES} bytes")
        self.sink, self.limit, self.codec = sink, frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.size = self.start = self.content = 0
        self.table: list[tuple[int, int]] = []

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset in its content) of the record."""
        if self.size and self.size + len(raw) > self.limit:
            self.flush()
        at = self.size
        self.held.append(raw)
        self.size += len(raw)
        self.content += len(raw)
        return len(self.table), at

    def flush(self) -> None:
        if self.held:
            frame = self.codec.compress(b"".join(self.held))
            self.sink.write(frame)
            self.table.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.sink.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """(start, compressed size, content size) of each frame of an open, seekable bundle, read from its footer."""
    size = source.size()
    source.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    source.seek(size - 9 - 8 * n)
    raw, out, at = source.read(8 * n), [], 0
    for c, d in struct.iter_unpack("<II", raw):
        out.append((at, c, d))
        at += c
    return out


def _frame(source, start: int, size: int) -> bytes:
    import zstandard

    source.seek(start)
    return zstandard.ZstdDecompressor().decompress(source.read(size), max_output_size=0)


def read_record(uri: str, frame: int, at: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: reads the footer and one frame."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        start, size, _ = seek_table(f)[frame]
        return parse(_frame(f, start, size)[at : at + length])


def _write(folder: str, frame_bytes: int, bundle_bytes: int):
    """mapInArrow over (record_id, url, payload, refers_to): the index rows."""

    def run(batches):
        task = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        tag, number, bundle, rows = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, []
        names = [f.split()[0] for f in INDEX.split(", ")]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]

        def finish():
            nonlocal bundle, number
            bundle.close()
            name = f"bundle-{tag}-{number:04d}.warc.zst"
            fs.move(bundle.path, f"{root}/{name}")
            starts = [0]
            for c, _ in bundle.table:
                starts.append(starts[-1] + c)
            out = [(i, f"{folder}/{name}", f, starts[f], *bundle.table[f], at, n) for i, f, at, n in rows]
            rows.clear()
            bundle, number = None, number + 1
            return pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for i, url, payload, ref in zip(*[batch.column(k) for k in range(4)], strict=True):
                i, url, payload, ref = i.as_py(), url.as_py(), payload.as_py(), ref.as_py()
                if bundle is None:
                    path = f"{root}/.part-{tag}-{number:04d}-{uuid.uuid4().hex}"
                    bundle = Bundle(fs.open_output_stream(path, compression=None), frame_bytes)
                    bundle.path = path
                raw = record(i, url, payload, digest(payload), ref)
                rows.append((i, *bundle.add(raw), len(raw)))
                if bundle.content >= bundle_bytes:
                    yield finish()
        if bundle is not None:
            yield finish()

    return run


def _read(batches):
    """mapInArrow over (bundle, frame, frame_start, frame_bytes): every record of each frame."""
    import zstandard

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "block_digest", "bundle", "frame", "at"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    codec = zstandard.ZstdDecompressor()
    uri, source = "", None
    try:
        for batch in batches:
            for wanted, frame, start, size in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if uri != wanted:
                    if source is not None:
                        source.close()
                    fs, path = filesystem(wanted)
                    uri, source = wanted, fs.open_input_file(path)
                source.seek(start)
                raw, at, out = codec.decompress(source.read(size)), 0, []
                while at < len(raw):
                    head = raw.index(b"\r\n\r\n", at) + 4
                    length = int(raw[at:head].rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                    fields, block = parse(raw[at : head + length + 4])
                    ref = fields.get("WARC-Refers-To")
                    ident = fields["WARC-Record-ID"][10:-1].split(":")[0]
                    out.append((None if ident == "None" else int(ident), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], int(ref[10:-1].split(":")[0]) if ref else None, block, digest(block) if ref is None else None, uri, frame, at))
                    at = head + length + 4
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)  # a frame at a time
    finally:
        if source is not None:
            source.close()


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one record per row into bundles below ``folder``; the index, a row per record, settled beside the bundles.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest id is a response and the others
    revisit it; rows that repeat that id are responses too.  Null payloads count as empty, null urls as empty.  A row
    with a null id is a response unless a row with an id has its payload.  An empty table gives no bundles.
    """
    spark = pages.sparkSession
    C.ship(spark)
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("record_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    sha = F.sha1("payload")
    p = p.withColumn("hex", sha)
    # only digests that repeat meet: counted in partial aggregates, and joined back by a join that can split a hot one
    first = p.where(F.octet_length("payload") >= least).groupBy("hex").agg(F.min("record_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("hex", "first")
    p = p.join(first, "hex", "left")
    ref = F.when((F.octet_length("payload") >= least) & ~F.col("first").eqNullSafe(F.col("record_id")), F.col("first"))
    rows = p.select("record_id", "url", "payload", ref.alias("refers_to"))
    index = rows.mapInArrow(_write(folder, frame_bytes, bundle_bytes), INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read(index: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """All records of the bundles that an index names, frame by frame.

    A frame's first record stands for it, so the frames cost no aggregate.  They are dealt in the order of bundles to
    tasks of about ``task_bytes`` of content (by default what a task reads of other files,
    ``spark.sql.files.maxPartitionBytes``), so a task opens few bundles and the number of tasks grows with the content.
    """
    spark = index.sparkSession
    C.ship(spark)
    frames = index.where("at = 0").select("bundle", "frame", "frame_start", "frame_bytes", "frame_content")
    if task_bytes is None:
        task_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    total = frames.agg(F.sum("frame_content").alias("n")).first()["n"] or 0
    frames = frames.repartitionByRange(-(-total // task_bytes) or 1, "bundle", "frame").sortWithinPartitions("bundle", "frame")
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, block_digest string, bundle string, frame long, at long"
    return frames.drop("frame_content").mapInArrow(_read, kinds)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages, read the archives back, and check each response's block against its digest."""
    folder = folder or C.shared_path(pages.sparkSession, "warc")
    got = read(write(pages, folder, **options))
    whole = F.when((F.col("record_type") == "revisit") | (F.col("block_digest") == F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("payload_digest"))))
    return got.select("page_id", "payload_bytes", whole.alias("payload_digest"), "record_type", "refers_to")


#: DuckDB SQL for ``op4`` on the view ``pages``.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT page_id, h, x, list_reduce(list_transform(range(1, 41), lambda i: right(bin(CAST('0x' || x[i] AS INTEGER) + 16), 4)), lambda a, c: a || c) AS bits,
        min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_reduce(list_transform(range(1, 6), lambda k: CAST(bits[i * 5 + k] AS INTEGER)), lambda a, c: 2 * a + c)]), lambda a, c: a || c) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""

