"""Helpers shared by the training-data operators: checkpoint folder, column hygiene, vectorised word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}

#: A key is heavy if it has one of ``MOST`` equal shares of the rows, and ``LEAST`` rows; so there are ``MOST`` at most.
MOST, LEAST = 10_000, 256


def ship(spark: SparkSession) -> None:
    """Send this package to the executors as a zip, once per application, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # executors fetch from the driver's copy while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = f"{folder}/{root.name}_{sc.applicationId}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(to)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder for local masters (tests); on a cluster that is an error, since executors
    would not see each other's files.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="tessera-"))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives a lost executor."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Settled intermediate results of one operator, deleted when it says so."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        """Like ``settle``, remembered."""
        self.paths.append(shared_path(self.spark, label))
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self, keep: int = 0) -> None:
        """Delete all but the ``keep`` latest; nothing may read them any more."""
        for path in self.paths[: len(self.paths) - keep]:
            drop_path(self.spark, path)
        del self.paths[: len(self.paths) - keep]


# --- skewed keys ------------------------------------------------------------------------------------------------


def heavy(counts: DataFrame, total: int) -> DataFrame | None:
    """Of (keys ..., k rows), the keys with a large share of ``total`` rows: ``MOST`` at most, so they can be broadcast.

    None if there are too few rows for any.
    """
    return None if total < LEAST else counts.where(F.col("k") >= max(LEAST, -(-total // MOST)))


def counted(hot: DataFrame | None) -> DataFrame | None:
    """A frame from ``heavy`` counted now, its few rows kept with the driver, so that no later use counts them again.

    None if there are none.
    """
    rows = None if hot is None else hot.toArrow()
    return hot.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def salted_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` where keys in ``hot`` (keys ..., k; from ``heavy``) hold many of left's rows.

    Their rows are dealt to k / LEAST salts by a hash of left's column ``by``; right's rows of such keys, which should
    be one a key, are repeated for each salt, so right grows by a LEAST-th of left's rows at most.  Where no key is hot
    it is a plain join.
    """
    if hot is None or hot.isEmpty():
        return left.join(right, on, how)
    few = F.broadcast(hot.select(*on, F.ceil(F.col("k") / LEAST).alias("_salts")))
    a = left.join(few, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(F.col(by)), F.col("_salts")), F.lit(0).cast("long"))).drop("_salts")
    b = right.join(few, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1).cast("long")) - 1))).drop("_salts")
    return a.join(b, [*on, "_salt"], how).drop("_salt")


# --- vectorised words -------------------------------------------------------------------------------------------

#: Bytes that split words in ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that split words in ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after A-Z are lower-cased).
NON_ALNUM_BYTES = np.zeros(256, dtype=bool)
NON_ALNUM_BYTES[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Random words for a byte at a place in a word; later places are mixed as they come.
PLACES = 32
_TABLE = mix64(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _segment_hashes(low: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of lower-cased bytes.

    A word's hash is the sum of a random number for each pair of place and byte (tabulation, so no algebra of the bytes
    makes two words equal), mixed with its length.
    """
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    if word[-1]:
        edge = np.concatenate([edge, [len(word)]])
    start, stop = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    size = stop - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    own = low[word].astype(np.int64)
    if int(size.max()) <= PLACES:
        value = _TABLE[place * 256 + own]
    else:
        value = _TABLE[np.minimum(place, PLACES - 1) * 256 + own]
        far = np.flatnonzero(place >= PLACES)
        value[far] = mix64((place[far] * 256 + own[far] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def word_hashes(data: np.ndarray, ends: np.ndarray, splits: np.ndarray, segment: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a block of texts.

    ``data``: the texts' UTF-8 bytes, each followed by one splitting byte; ``ends``: the position after each text's
    splitting byte.  Returns the hashes and, per text, the number of words before its end (a running count).  Works
    through segments cut between words, so that a very long text needs little more than its hashes.
    """
    low = LOWER[data]
    word = ~splits[low]
    hashes, starts, at = [], [], 0
    while at < len(low):
        to = min(at + segment, len(low))
        if to < len(low):
            gaps = np.flatnonzero(~word[at:to])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:  # one word longer than a segment
                to = to + int(np.argmin(word[to:])) + 1
        h, s = _segment_hashes(low[at:to], word[at:to])
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends, side="left")


def block_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Join texts with a splitting byte; what ``word_hashes`` takes."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8) if texts else np.zeros(0, np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return data, ends


def text_blocks(texts, limit: int = 4 << 20):
    """Cut a list of byte strings into runs (first, last) of about ``limit`` bytes; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)
