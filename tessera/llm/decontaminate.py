"""Benchmark decontamination with suffix arrays of the training text.

A shard is a block of documents as word hashes.  Its suffix array has all its suffixes in the order of their first
``WINDOW`` words, built by doubling: ranks of words, of two, of four, of eight words.  Every suffix of the test set is
searched in it by binary search at each level, which gives all locations of its window (8 words, or a shorter item's
whole length) in the shard; from each place where a match begins it is followed word by word to its end.  Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common as C

WINDOW = 8
#: Test text kept in one block, in bytes; larger test sets are worked through block by block.
BLOCK_BYTES = 32 << 20
#: Training text in a shard, in bytes; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
_RUNS = "array<struct<start: long, length: long, item: string>>"
SCHEMA = f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, runs {_RUNS}"
_PART = f"row_id long, doc_id long, n_words long, hits array<long>, items array<string>, runs {_RUNS}"
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), _RUNS: pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string())]))}


def _find(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of values in a sorted array, by binary search; -1 where they are not."""
    if not len(known):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def _keys(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n words from each position on, as byte strings that compare like the words."""
    flat = np.empty((len(at), n), dtype=">u8")
    for j in range(n):
        flat[:, j] = words[at + j]
    return flat.view(f"S{8 * n}").ravel()


def _halves(n: int) -> tuple[int, int]:
    """How a run of n words is put together: the largest power of two below n, and the rest."""
    half = 1 << ((n - 1).bit_length() - 1)
    return half, n - half


class Shard:
    """Suffix array of a block of documents; ``text`` has a zero, which no word has, behind each document."""

    def __init__(self, words: np.ndarray, upto: np.ndarray, window: int = WINDOW):
        n = np.diff(upto, prepend=0)
        self.n = n
        self.first = upto - n + np.arange(len(n))
        self.text = np.zeros(len(words) + len(n), dtype=np.uint64)
        self.text[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
        values, rank = np.unique(self.text, return_inverse=True)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {1: (values, rank.astype(np.int64))}
        self.suffixes = np.argsort(self._level(window)[1], kind="stable")

    def _level(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct runs of n words, as sorted pairs of ranks in one number, and each position's rank among them."""
        if n not in self.levels:
            a, b = _halves(n)
            front, back = self._level(a)[1], self._level(b)
            behind = np.zeros_like(front)
            behind[:-a] = back[1][a:]
            values, rank = np.unique(front * len(back[0]) + behind, return_inverse=True)
            self.levels[n] = values, rank.astype(np.int64)
        return self.levels[n]

    def ranks(self, words: np.ndarray, n: int, cache: dict[int, np.ndarray]) -> np.ndarray:
        """For each position of other words, the rank of its run of n words in this shard; -1 if it isn't there."""
        if n not in cache:
            if n == 1:
                cache[1] = _find(self.levels[1][0], words)
            else:
                a, b = _halves(n)
                front, back = self.ranks(words, a, cache), self.ranks(words, b, cache)
                behind = np.full(len(words), -1, dtype=np.int64)
                behind[:-a] = back[a:]
                out = np.full(len(words), -1, dtype=np.int64)
                at = np.flatnonzero((front >= 0) & (behind >= 0))
                out[at] = _find(self._level(n)[0], front[at] * len(self._level(b)[0]) + behind[at])
                cache[n] = out
        return cache[n]

    def locations(self, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of the ranks, position) of all suffixes that begin with a run of n words of that rank."""
        order = self._level(n)[1][self.suffixes]
        left, right = np.searchsorted(order, rank, "left"), np.searchsorted(order, rank, "right")
        count = right - left
        where = self.suffixes[np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        return np.repeat(np.arange(len(rank)), count), where


class TestIndex:
    """Words of the test items with a zero between items, and their distinct windows: places and items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        data, ends = C.block_of([t.encode() for _, t in items])
        words, upto = C.word_hashes(data, ends, C.NON_ALNUM_BYTES)
        n = np.diff(upto, prepend=0)
        self.ids = [i for i, _ in items]
        first = (upto - n) + np.arange(len(n)) + 1
        self.words = np.zeros(len(words) + len(n) + 1, dtype=np.uint64)
        owner = np.repeat(np.arange(len(n)), n)
        self.words[np.arange(len(words)) + owner + 1] = words
        self.classes = []
        for size in sorted(set(np.minimum(n[n > 0], window).tolist())):
            mine = np.flatnonzero(n >= size) if size == window else np.flatnonzero(n == size)
            count = n[mine] - size + 1
            at = np.repeat(first[mine], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            keys = _keys(self.words, at, size)
            order = np.argsort(keys, kind="stable")
            keys, at, who = keys[order], at[order], np.repeat(mine, count)[order]
            head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            to = np.append(head[1:], len(at))
            # the window that follows a window wherever it stands, -1 if there is none such
            window_at = np.full(len(self.words) + 1, -1, dtype=np.int64)
            window_at[at] = np.repeat(np.arange(len(head)), to - head)
            low, high = np.minimum.reduceat(window_at[at + 1], head), np.maximum.reduceat(window_at[at + 1], head)
            follow = np.where((low == high) & (low >= 0) & ((to - head)[low] == to - head), low, -1)
            self.classes.append({"size": size, "from": head, "to": to, "at": at, "who": who, "next": follow})

    def matches(self, shard: Shard):
        """Per class of windows that the shard has: the class, and (window, position in the shard's text) arrays."""
        cache: dict[int, np.ndarray] = {}
        for c in self.classes:
            rank = shard.ranks(self.words, c["size"], cache)[c["at"][c["from"]]]
            found = np.flatnonzero(rank >= 0)
            if len(found):
                which, where = shard.locations(rank[found], c["size"])
                yield c, found[which], where

    def begins(self, c: dict, window: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Which locations, in order of position, begin a match: not the next word of the one before in all its items."""
        goes_on = (where[1:] == where[:-1] + 1) & (c["next"][window[:-1]] == window[1:])
        return np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(where) else np.zeros(0, np.int64)

    def follow(self, c: dict, window: int, text: np.ndarray, at: int) -> tuple[int, str]:
        """Length in words of the longest match from a location on, and the first by name of the items that have it."""
        places = range(int(c["from"][window]), int(c["to"][window]))
        best, items = 0, []
        for k in places:
            n, step, i = c["size"], 64, int(c["at"][k])
            while True:
                a, b = self.words[i + n : i + n + step], text[at + n : at + n + step]
                k_ = min(len(a), len(b))
                other = np.flatnonzero((a[:k_] != b[:k_]) | (a[:k_] == 0))
                n += int(other[0]) if len(other) else k_
                if len(other) or k_ < step:
                    break
                step *= 2
            if n > best:
                best, items = n, []
            if n == best:
                items.append(self.ids[c["who"][k]])
        return best, min(items)


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _shard_rows(ix: TestIndex, texts: list[bytes]):
    """Per text of a shard: words, which are hit, items found and runs (start, length, item), the longest first."""
    shard = Shard(*C.word_hashes(*C.block_of(texts), C.NON_ALNUM_BYTES))
    cover = np.zeros(len(shard.text) + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    runs: dict[int, list[tuple[int, int, str]]] = {}
    for c, window, where in ix.matches(shard):
        np.add.at(cover, where, 1)
        np.add.at(cover, where + c["size"], -1)
        doc = np.searchsorted(shard.first, where, "right") - 1
        for d, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():
            items.setdefault(d, set()).update(ix.ids[i] for i in c["who"][c["from"][w] : c["to"][w]])
        order = np.argsort(where, kind="stable")
        window, where, doc = window[order], where[order], doc[order]
        done = -1
        for k in ix.begins(c, window, where).tolist():
            at, d = int(where[k]), int(doc[k])
            length, item = ix.follow(c, int(window[k]), shard.text, at)
            if at + length > done:  # not inside the run before
                done = at + length
                runs.setdefault(d, []).append((at - int(shard.first[d]), length, item))
    hit = np.cumsum(cover[:-1]) > 0
    for d, (first, n) in enumerate(zip(shard.first.tolist(), shard.n.tolist(), strict=True)):
        yield n, hit[first : first + n], items.get(d, set()), sorted(runs.get(d, ()), key=lambda x: (-x[1], x[0], x[2]))


def _scan(index, raw: bool, clean: int = 0, min_items: int = 2):
    """mapInArrow over (row_id, doc_id, text, more).

    With ``clean``, column 3 holds the items found before; rows with a match of so many words or ``min_items`` items are
    left out, the others pass with the items found so far.
    """
    fields = [f.split(" ", 1) for f in (_PART if raw else SCHEMA).replace(_RUNS, "RUNS").split(", ")]
    names, kinds = [f[0] for f in fields], [_KINDS[_RUNS if f[1] == "RUNS" else f[1]] for f in fields]

    def run(batches):
        ix = index.value
        for batch in batches:
            rows, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            out, clear, so_far = [], [], []
            before = batch.column(3).to_pylist() if clean else []
            for a, b in C.text_blocks(texts, SHARD_BYTES):
                for i, (n, hit, items, runs) in enumerate(_shard_rows(ix, texts[a:b]), a):
                    longest = runs[0][1] if runs else 0
                    if clean:
                        items |= set(before[i])
                        so_far.append(sorted(items))
                        clear.append(longest < clean and len(items) < min_items)
                        continue
                    runs = [dict(zip(("start", "length", "item"), x, strict=True)) for x in runs]
                    if raw:
                        out.append((rows[i], docs[i], n, np.flatnonzero(hit).tolist() if items else [], sorted(items), runs))
                    else:
                        out.append((docs[i], n, int(hit.sum()), len(items), _digest(items), len(items) >= min_items, longest, runs))
            if clean:
                yield batch.set_column(3, batch.schema.field(3), pa.array(so_far, batch.schema.field(3).type)).filter(pa.array(clear, pa.bool_()))
            elif out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int):
    """Broadcast indexes of the test items, one block of about ``block_bytes`` after the other; items without id left out."""
    bench = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text")).where("item is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("s")).first()["s"]
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        some = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield k == blocks - 1, benchmark.sparkSession.sparkContext.broadcast(TestIndex([(r["item"], r["text"]) for r in some.collect()]))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, min_items: int = 2) -> DataFrame:
    """One row per document: words, words inside matches, items found, their digest, verdict, longest match in words, and
    its maximal verbatim matches (first word, words, an item), the longest first.

    Null text has no words; a document without words has no hits and the digest of no items.  Items without words or
    without an id are ignored; rows with one item id count as one item.  Repeated documents give repeated rows.  Empty
    tables are fine.  Extra columns are ignored.  The test set's size is measured first: up to ``block_bytes`` it goes
    to the executors as one index; beyond that in blocks of about that size, one after the other, each a pass over the
    documents whose hits are settled before the next block is sent; they are merged by row.
    """
    spark = docs.sparkSession
    C.ship(spark)
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marked = parts = None
    for last, index in _blocks(benchmark, item_col, item_text, block_bytes):
        if last and parts is None:
            return narrow.select(F.lit(0).cast("long").alias("row_id"), "doc_id", "text").mapInArrow(_scan(index, raw=False, min_items=min_items), SCHEMA)
        if marked is None:
            marked = C.settle(narrow.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"), "decontaminate")
        part = C.settle(marked.mapInArrow(_scan(index, raw=True), _PART), "matches")
        index.destroy()
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"),
    )  # one row of a document and block each: as many as there are blocks
    return merged.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"),
        F.coalesce(F.expr("array_max(transform(runs, x -> x.length))"), F.lit(0)).alias("longest_match"),
        F.expr("transform(array_sort(transform(runs, x -> struct(-x.length AS n, x.start AS start, x.item AS item))), x -> struct(x.start AS start, -x.n AS length, x.item AS item))").alias("runs"),
    ).to(T.StructType.fromDDL(SCHEMA))


def without_matches(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = WINDOW, min_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that share no run of ``min_words`` words (``WINDOW`` at least) with an item and hold fewer than
    ``min_items`` items as ``contamination`` counts them (shorter items whole); columns unchanged.

    Null and empty texts stay.  A test set beyond ``block_bytes`` is worked through in blocks, each a pass over what
    the one before left, settled, with the items found so far.
    """
    C.ship(docs.sparkSession)
    out = docs.select(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"), F.array().cast("array<string>").alias("f"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(docs.columns)])
    for last, index in _blocks(benchmark, item_col, item_text, block_bytes):
        out = out.mapInArrow(_scan(index, raw=False, clean=max(min_words, WINDOW), min_items=min_items), out.schema)
        if not last:
            out = C.settle(out, "clean")
            index.destroy()
    return out.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(docs.columns)])
