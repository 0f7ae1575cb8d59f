"""Sequence packing by non-negative least squares over a length histogram.

Every document becomes token ids plus one end id.  Whole windows are cut off at once; what is left (shorter than a
window) is gathered into blocks of a fixed number of tokens.  In a block the lengths form a histogram of at most
``window - 1`` entries.  All combinations of up to three of its lengths that fill a window exactly are the columns of a
non-negative least squares problem whose solution says how often to use each.  It is solved by coordinate descent over
the columns in use; all triples are priced by the residual again and again, and those that would still be used enter,
until none would be.  The counts are rounded down, used as far as the histogram goes, and the rest is packed greedily
(largest first, best fit), cutting a piece where nothing fits.
The last sequence of a block is cut at powers of two, which need no padding.

One pass and no shuffle: a block lives in one task, so nothing grows with the corpus, and a task that runs again after
an executor is lost gives the same rows, since it only depends on its own split.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Uses of a pattern that count as none when the solution has settled (uses are whole numbers in the end).
SETTLED = 0.25
#: Tokens gathered before a block is packed; bounds a task's memory (2 bytes a token).
BLOCK_TOKENS = 1 << 24


class _Odd(Exception):
    """White space next to white space: chunks do not stand alone."""


class ChunkEncoder:
    """Byte-level BPE ids, with a bounded cache from space-delimited chunks to ids.

    Byte-level BPE never merges across a space that stands between two non-space characters, so such a text's ids are
    those of its first chunk and of each later chunk with a space before it.  Other texts are encoded whole.  Chunks
    go to tiktoken (same vocabulary as ranks) where they hold only characters below U+0250, whose classes all
    versions of Unicode share; others go to ``tokenizers``.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, cache: int = 250_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        #: Strings that ``tokenizers`` takes for one id wherever they stand; such texts are encoded whole.
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.single = self.fast._core_bpe.encode_single_piece
        self.marks = {c: self._encode(c) for c in ".,;:!?"}
        self.cache, self.young, self.old = cache, {}, {}

    def _encode(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if max(chunk) < "\u0250":
            ids = self.fast.encode_ordinary(chunk)
        else:
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        return array("H", ids).tobytes()

    def _miss(self, chunk: str) -> bytes:
        """A later chunk's ids; raises ``_Odd`` where white space touches white space."""
        got = self.old.get(chunk)
        if got is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise _Odd
            if chunk.isalpha() and max(chunk) < "\u0250":  # one pre-token
                got = array("H", self.single((" " + chunk).encode())).tobytes()
            elif chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():  # two
                word = chunk[:-1]
                return (self.young.get(word) or self._miss(word)) + self.marks[chunk[-1]]
            else:
                got = self._encode(" " + chunk)
        if len(chunk) <= 64:
            if len(self.young) >= self.cache:
                self.old, self.young = self.young, {}
            self.young[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 16-bit integers."""
        if any(x in text for x in self.special):
            return array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        chunks = text.split(" ")
        first = chunks[0]
        if len(chunks) == 1 or not first or first[-1].isspace():
            return self._encode(text)
        get, miss = self.young.get, self._miss
        try:
            rest = [get(c) or miss(c) for c in chunks[1:]]
        except _Odd:
            return self._encode(text)
        return self._encode(first) + b"".join(rest)


def pairs(present: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of one or two of the lengths that fill the window exactly."""
    have = np.zeros(window + 1, dtype=bool)
    have[present] = True
    a = present[(present * 2 <= window) & have[window - present]]
    return ([(window,)] if have[window] else []) + list(zip(a.tolist(), (window - a).tolist(), strict=True))


def triples(present: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All combinations x <= y <= z of three of the lengths that fill the window exactly, by ascending x."""
    have = np.zeros(window + 1, dtype=bool)
    have[present] = True
    out = []
    for x in present[present * 3 <= window].tolist():
        y = present[(present >= x) & (present * 2 <= window - x)]
        y = y[have[window - x - y]]
        out.append(np.stack([np.full(len(y), x), y, window - x - y]))
    return tuple(np.concatenate([*out, np.zeros((3, 0), np.int64)], axis=1).astype(np.int64))


def _descend(cols: list[tuple], norm: list[int], x: list[float], rest: list[float], tol: float) -> None:
    """Coordinate descent until a sweep changes no use by more than ``tol``."""
    most = tol + 1.0
    while most > tol:
        most = 0.0
        for j, c in enumerate(cols):
            g = 0.0
            for v, k in c:
                g += k * rest[v]
            d = max(x[j] + g / norm[j], 0.0) - x[j]
            if d:
                x[j] += d
                for v, k in c:
                    rest[v] -= d * k
                most = max(most, abs(d))


def nnls(histogram: np.ndarray, window: int, tol: float = SETTLED) -> tuple[list[tuple[int, ...]], list[float]]:
    """The patterns in use and how often: min ||A x - h||, x >= 0, over all patterns of up to three lengths.

    Column p of A counts each length in pattern p.  A triple enters while its use, by the residual alone, would rise
    by more than ``tol``; at the end no column's would.
    """
    present = np.flatnonzero(histogram)
    patterns = pairs(present, window)
    counted = lambda p: tuple({v: p.count(v) for v in p}.items())
    cols = [counted(p) for p in patterns]
    norm = [sum(k * k for _, k in c) for c in cols]
    x, rest = [0.0] * len(cols), histogram.astype(float).tolist()
    a, b, c = triples(present, window)
    weight = np.where((a == b) & (b == c), 9.0, np.where((a == b) | (b == c), 5.0, 3.0))
    head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else a
    known = np.zeros(len(a), dtype=bool)
    while True:
        _descend(cols, norm, x, rest, tol)
        if not len(a):
            return patterns, x
        r = np.array(rest)
        rise = np.where(known, 0.0, (r[a] + r[b] + r[c]) / weight)
        top = np.maximum.reduceat(rise, head)
        at = np.flatnonzero((rise > tol) & (rise == np.repeat(top, np.diff(np.append(head, len(a))))))
        at = at[np.unique(a[at], return_index=True)[1]]  # the best triple of each smallest length
        if not len(at):
            return patterns, x
        known[at] = True
        for i in at.tolist():
            patterns.append((int(a[i]), int(b[i]), int(c[i])))
            cols.append(counted(patterns[-1]))
            norm.append(int(weight[i]))
            x.append(0.0)


def pack_block(lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length); each item lies in pieces once, each sequence is full or a power of two long.

    No items: no sequences.  Items of one length are taken in their order.
    """
    order = np.argsort(lengths, kind="stable")
    histogram = np.bincount(lengths, minlength=window + 1)
    stacks: dict[int, list[tuple[int, int]]] = {}
    at = 0
    for v in np.flatnonzero(histogram).tolist():
        stacks[v] = [(i, 0) for i in order[at : at + histogram[v]].tolist()[::-1]]
        at += int(histogram[v])
    patterns, x = nnls(histogram, window)
    out: list[list[tuple[int, int, int]]] = []
    for j in sorted((j for j in range(len(patterns)) if x[j] >= 1.0), key=lambda j: -x[j]):
        need = {v: patterns[j].count(v) for v in patterns[j]}
        times = min(int(x[j]), *(len(stacks.get(v, ())) // k for v, k in need.items()))
        for _ in range(times):
            out.append([(*stacks[v].pop(), v) for v in patterns[j]])
    pool = sorted(v for v, s in stacks.items() if s)

    def take(i: int) -> tuple[int, int, int]:
        v = pool[i]
        item, start = stacks[v].pop()
        if not stacks[v]:
            pool.pop(i)
        return item, start, v

    def put(item: int, start: int, length: int) -> None:
        s = stacks.setdefault(length, [])
        if not s:
            bisect.insort(pool, length)
        s.append((item, start))

    while pool:
        bin_, gap = [], window
        while gap and pool:
            i = bisect.bisect_right(pool, gap) - 1
            if i >= 0:
                piece = take(i)
            else:
                item, start, length = take(0)
                put(item, start + gap, length - gap)
                piece = (item, start, gap)
            bin_.append(piece)
            gap -= piece[2]
        if not gap:
            out.append(bin_)
            continue
        left = window - gap
        for k in range(left.bit_length() - 1, -1, -1):  # the last one: cut at powers of two
            size = left & (1 << k)
            short = []
            while size:
                item, start, length = bin_.pop()
                if length > size:
                    bin_.append((item, start + size, length - size))
                    length = size
                short.append((item, start, length))
                size -= length
            if short:
                out.append(short)
    return out


def _pack_partition(paths: tuple[str, str, str], window: int, end_id: int, block_tokens: int):
    def run(batches):
        from itertools import count

        enc = ChunkEncoder(*paths)
        task = TaskContext.get()
        seq = count((task.partitionId() if task else 0) << 40)
        rows: list[tuple] = []
        tails: list[tuple] = []  # doc_id, start, doc_tokens, ids
        held = 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        end = np.array([end_id], dtype="<u2").tobytes()

        def crc(raw: bytes) -> int:
            return zlib.crc32(np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes())

        def emit():
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=names)

        def flush():
            nonlocal held
            lengths = np.fromiter((len(t[3]) // 2 for t in tails), dtype=np.int64, count=len(tails))
            for pieces in pack_block(lengths, window):
                s, offset = next(seq), 0
                for item, start, length in pieces:
                    doc, base, n, raw = tails[item]
                    rows.append((doc, base + start, length, crc(raw[2 * start : 2 * (start + length)]), n, s, offset))
                    offset += length
            tails.clear()
            held = 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = enc.ids(text.as_py() or "") + end
                n = len(raw) // 2
                full = n - n % window
                for at in range(0, full, window):
                    rows.append((doc, at, window, crc(raw[2 * at : 2 * (at + window)]), n, next(seq), 0))
                if full < n:
                    tails.append((doc, full, n, raw[2 * full :]))
                    held += n - full
                if held >= block_tokens:
                    flush()
                if len(rows) >= 20_000:
                    yield emit()
        flush()
        while rows:
            yield emit()

    return run


def vocabulary_paths(json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str, str]:
    """Paths of the public vocabulary on this machine; they are parameters of ``pack``."""
    import public_tokenizers

    return public_tokenizers.path(json_name), public_tokenizers.path(ranks_name), public_tokenizers.PATTERN


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str, str] | None = None, window: int = 2048, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pack documents into sequences of at most ``window`` tokens; one row per piece.

    Null text counts as empty: one piece that holds the end id.  Null and repeated ids are packed like others and keep
    their id.  Very long texts are cut into whole windows as they come.  An empty table gives no rows.  Extra columns
    are ignored.  A sequence is ``window`` tokens long or, at the end of a block, a power of two.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    C.ship(docs.sparkSession)
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.mapInArrow(_pack_partition(paths or vocabulary_paths(), window, end_id, block_tokens), SCHEMA)
