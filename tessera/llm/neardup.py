"""Near-duplicate detection with SetSketch registers.

A document's set is its distinct word shingles.  Documents with equal sets form a class, represented by one row, so
exact copies cost one row however many there are.  Each class gets ``BANDS * ROWS`` registers: minima of hashed
exponentials, truncated to exponentially spaced values (base ``BASE``), mergeable by maximum.  A band of registers is a
bucket key; classes in one bucket are candidates.  Candidates pass a joint likelihood test on their registers and
known set sizes, then their full sets are compared.

Components need no pair twice and no pair inside one component, which keeps a large bucket linear:

1. Star: each bucket's members are compared with its smallest member only; links give components.
2. Rest: buckets that still hold several components compare members outside the bucket's main component with all
   others, in cells of bounded size: first their registers, then the full sets of those that have a likely partner in
   the cell; a cell returns at most one link between two components.

All pairs that share a bucket are thus linked, known to be unlinked, or in one component already.  A pair at the
threshold shares no bucket with probability ``(1 - 0.8**ROWS)**BANDS`` (1e-7 here).

Keys with many rows (a bucket, a star's center, a node, a component, a set with many copies) are counted before they
are joined and dealt to salts (``common.salted_join``).  What is compared in full is shipped as text: its lines compress
where hashes of shingles, one of eight bytes a word, don't.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common as C

ROWS, BANDS = 5, 40
M = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: The likelihood test lets pass what is estimated above threshold minus this many standard deviations.
SIGMAS = 5.0
#: Members of a hot center that are compared with it in one salt.
SALT = 64
#: Members and outsiders of a bucket that one block compares.
BLOCK, CHUNK = 256, 256

_g = np.random.Generator(np.random.PCG64(7))
_A = (_g.integers(0, 2**32, size=M, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _g.integers(0, 2**32, size=M, dtype=np.uint64).astype(np.uint32)
_BAND = C.mix64(np.arange(1, M + 1, dtype=np.uint64)) | np.uint64(1)


# --- sets and registers -----------------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than ``size``, the whole sequence as one."""
    data, ends = C.block_of(texts)
    words, upto = C.word_hashes(data, ends, C.SPACE_BYTES)
    n = np.diff(upto, prepend=0)
    if len(words) >= size:
        g = words[: len(words) - size + 1].copy()
        for j in range(1, size):
            g = C.mix64(g) + words[j : len(words) - size + 1 + j]
        g = C.mix64(g)
    else:
        g = words[:0]
    out = []
    for end, k in zip(upto.tolist(), n.tolist(), strict=True):
        if k >= size:
            s = np.sort(g[end - k : end - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif k:
            h = words[end - k : end - k + 1].copy()
            for j in range(end - k + 1, end):
                h = C.mix64(h) + words[j : j + 1]
            out.append(C.mix64(h + np.uint64(k)))  # a shorter sequence never equals a shingle
        else:
            out.append(words[:0])
    return out


def registers(s: np.ndarray) -> np.ndarray:
    """The set's registers; unsigned 16-bit."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(M, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(low, (x[at : at + 256, None] * _A + _B).min(axis=0), out=low)
    e = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1.0 - np.log(e) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, at: float) -> np.ndarray:
    """Whether the likelihood of the registers' order still rises at this similarity, so that its maximum lies above.

    ``a``, ``b``: registers, a row per pair; ``na``, ``nb``: set sizes.  The log-likelihood is concave, so the sign of
    its derivative tells on which side of ``at`` the estimate is.
    """
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = na / (na + nb)
    v = 1.0 - u
    c, log_b = (BASE - 1.0) / BASE, np.log(BASE)

    def p(x):
        return -np.log1p(-c * x) / log_b, c / ((1.0 - c * x) * log_b)

    eps = 1e-9
    p_up, d_up = p(np.maximum(u - v * at, eps))
    p_dn, d_dn = p(np.maximum(v - u * at, eps))
    p_eq = np.maximum(1.0 - p_up - p_dn, eps)
    slope = -up * v * d_up / np.maximum(p_up, eps) - down * u * d_dn / np.maximum(p_dn, eps) + same * (v * d_up + u * d_dn) / p_eq
    return slope >= 0


def test_level(threshold: float) -> float:
    return max(0.05, threshold - SIGMAS * float(np.sqrt(threshold * (1 - threshold) / M)))


def _sketch(size: int):
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            n, f1, f2, sk = [], [], [], []
            for a, b in C.text_blocks(texts):
                for s in shingle_sets(texts[a:b], size):
                    n.append(len(s))
                    if len(s):
                        m = C.mix64(s)
                        f1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                        f2.append(int((m * (m | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)))
                        sk.append(registers(s).tobytes())
                    else:
                        f1.append(None)
                        f2.append(None)
                        sk.append(None)
            cols = [*batch.columns, pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sk, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "n", "f1", "f2", "sketch"])

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, M)


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        k = C.mix64(_matrix(batch.column(1)).astype(np.uint64) + _BAND) .reshape(batch.num_rows, BANDS, ROWS)
        key = C.mix64(k.sum(axis=2, dtype=np.uint64)).view(np.int64)
        node = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node)], names=["bucket", "node"])


# --- verification ---------------------------------------------------------------------------------------------


def _passing(level: float, ratio: float):
    """mapInArrow over (a, na, ra, b, nb, rb): the pairs whose registers let a link be likely."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column(1).to_numpy().astype(float), batch.column(4).to_numpy().astype(float)
            ok = np.minimum(na, nb) >= ratio * np.maximum(na, nb)
            at = np.flatnonzero(ok)
            if len(at):
                few = batch.take(pa.array(at))
                ok = likely(_matrix(few.column(2)), _matrix(few.column(5)), na[at], nb[at], level)
                at = at[ok]
            few = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([few.column(0), few.column(3)], names=["a", "b"])

    return run


def _verify(size: int, percent: int):
    """mapInArrow over (a, salt, b, text) sorted so; b = -1 brings the text of a, which the others are compared with."""

    def run(batches):
        center, who = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = [t or b"" for t in batch.column(3).cast(pa.binary()).to_pylist()]
            left, right = [], []
            for x, y in C.text_blocks(texts, 1 << 20):
                for i, s in zip(range(x, y), shingle_sets(texts[x:y], size), strict=True):
                    if b[i] == -1:
                        center, who = s, a[i]
                    elif who == a[i]:
                        at = np.searchsorted(center, s)
                        at[at == len(center)] = 0
                        both = int((center[at] == s).sum())
                        if 100 * both >= percent * (len(center) + len(s) - both):
                            left.append(a[i])
                            right.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, hot: DataFrame | None, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough.  Members of a center in ``hot`` go to salts of SALT."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hot is None:
        pairs = pairs.withColumn("salts", F.lit(1).cast("long"))
    else:
        pairs = pairs.join(F.broadcast(hot.select("a", F.ceil(F.col("k") / SALT).alias("salts"))), "a", "left")
    salted = pairs.select("a", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0).cast("long")).alias("salt"), "b")
    centers = salted.select("a", "salt").distinct().select("a", "salt", F.lit(-1).cast("long").alias("b"), F.col("a").alias("node"))
    rows = salted.withColumn("node", F.col("b")).unionByName(centers).join(texts, "node").select("a", "salt", "b", "text")
    return rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "b").mapInArrow(_verify(size, percent), "a long, b long")


# --- components -------------------------------------------------------------------------------------------------


def components(edges: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Connected components: (node, comp), comp the smallest node reachable; nodes without links have no row.

    Minimum labels with pointer jumping; each round is written to the shared folder.  The edges of hubs and the nodes of
    large components are salted; minima are partial aggregates.
    """
    own = C.Scratch(scratch.spark)
    both = own.settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    hubs = C.counted(C.heavy(both.groupBy("b").agg(F.count("*").alias("k")), both.count()))
    label = own.settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    nodes, keep = label.count(), len(own.paths) - 1
    while True:
        near = C.salted_join(both, label.select(F.col("node").alias("b"), "comp"), ["b"], hubs, by="a").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        step = label.join(near, "node")
        large = C.counted(C.heavy(label.groupBy("comp").agg(F.count("*").alias("k")), nodes))
        step = C.salted_join(step, label.select(F.col("node").alias("comp"), F.col("comp").alias("up")), ["comp"], large, by="node")
        step = own.settle(step.select("node", F.least("comp", "low", "up").alias("comp"), F.col("comp").alias("was")), "labels")
        C.drop_path(own.spark, own.paths.pop(keep))
        label = step.select("node", "comp")
        if step.where("comp < was").isEmpty():
            scratch.paths.append(own.paths.pop())
            own.drop()
            return label


# --- what the stars leave -----------------------------------------------------------------------------------


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _cells(batches, width: int):
    """The rows after the first three columns, for each value of these; ``width`` columns, the last one binary."""
    key, held = None, []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(width - 1)] + [batch.column(width - 1).cast(pa.binary()).to_pylist()]
        for row in zip(*cols, strict=True):
            if row[:3] != key:
                if held:
                    yield key, held
                key, held = row[:3], []
            held.append(row[3:])
    if held:
        yield key, held


def _screen(level: float, ratio: float):
    """mapInArrow over (bucket, blk, chunk, outside, node, comp, n, sketch), sorted by the first four: the rows whose
    registers let a link with a row of the cell's other side and of another component be likely, without n and sketch.
    """

    def run(batches):
        for key, held in _cells(batches, 8):
            outside, node, comp, n, sketch = zip(*held, strict=True)
            first = outside.index(True) if outside[-1] else len(held)
            if not 0 < first < len(held):
                continue
            regs, n, comps = np.frombuffer(b"".join(sketch), dtype="<u2").reshape(-1, M), np.array(n, float), np.array(comp)
            keep = np.zeros(len(held), dtype=bool)
            for o in range(first, len(held)):
                at = np.flatnonzero((comps[:first] != comps[o]) & (np.minimum(n[:first], n[o]) >= ratio * np.maximum(n[:first], n[o])))
                at = at[likely(regs[at], regs[o], n[at], n[o], level)]
                keep[at] = True
                keep[o] = len(at) > 0
            at = np.flatnonzero(keep)
            if len(at):
                kept = [held[i] for i in at]
                cols = [[k] * len(at) for k in key] + [[r[i] for r in kept] for i in range(3)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "blk", "chunk", "outside", "node", "comp"])

    return run


def _cross(size: int, percent: int):
    """mapInArrow over (bucket, blk, chunk, outside, node, comp, text), sorted by the first four: links (a, b).

    A cell holds some of a bucket's outsiders and some of its members.  Each outsider's full set is compared with those
    of all the cell's members at once, over shingles numbered within the cell; of several links between two components
    one is returned, so a cell gives fewer links than it has components.
    """

    def cell(outside, node, comp, texts, out):
        place: dict[int, int] = {}
        for i, x in enumerate(node):
            place.setdefault(x, i)
        first = sorted(place.values())
        sets: list[np.ndarray] = []
        for a, b in C.text_blocks([texts[i] for i in first], 1 << 20):
            sets += shingle_sets([texts[i] for i in first[a:b]], size)
        of = {node[i]: s for i, s in zip(first, sets, strict=True)}
        members = [i for i in range(len(node)) if not outside[i]]
        rows = [of[node[i]] for i in members]
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        known, ids = np.unique(np.concatenate(rows), return_inverse=True)
        mark = np.zeros(len(known), dtype=bool)
        comps = np.array([comp[i] for i in members])
        joined = _Union()
        for o in (i for i in range(len(node)) if outside[i]):
            s = of[node[o]]
            at = np.searchsorted(known, s)
            at[at == len(known)] = 0
            at = at[known[at] == s]
            mark[at] = True
            both = np.add.reduceat(mark[ids].astype(np.int64), starts)
            mark[at] = False
            ok = np.flatnonzero((100 * both >= percent * (lengths + len(s) - both)) & (comps != comp[o]))
            for m in ok[np.unique(comps[ok], return_index=True)[1]].tolist():
                if joined.find(comp[o]) != joined.find(int(comps[m])):
                    joined.join(comp[o], int(comps[m]))
                    out.append((node[o], node[members[m]]))

    def run(batches):
        out: list[tuple[int, int]] = []
        for _, held in _cells(batches, 7):
            if held[0][0] != held[-1][0]:  # there are members, which come first, and outsiders
                cell(*zip(*held, strict=True), out)
            if len(out) >= 10_000:
                yield emit(out)
        yield emit(out)

    def emit(out):
        a, b = [x[0] for x in out], [x[1] for x in out]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _rest(multi: DataFrame, hot: DataFrame | None, comp: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int, scratch: C.Scratch) -> DataFrame | None:
    """Links (a, b) between components that share a bucket, None if none do; ``hot`` has the buckets with many members."""
    parts = int(multi.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = scratch.settle(multi.where("cnt >= 3").join(comp, "node", "left").select("bucket", "node", "cnt", F.coalesce("comp", "node").alias("comp")), "members")
    shares = m.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    main = shares.groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1").select("bucket", F.col("top.comp").alias("main"), F.col("top.k").alias("inside"))
    m = scratch.settle(C.salted_join(m, main, ["bucket"], hot, by="node"), "mixed")
    if m.isEmpty():
        return None
    m = m.withColumn("blocks", F.ceil(F.col("cnt") / BLOCK)).withColumn("chunks", F.ceil((F.col("cnt") - F.col("inside")) / CHUNK))
    h = F.xxhash64("node", "bucket")
    members = m.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("bucket", F.pmod(h, F.col("blocks")).alias("blk"), "chunk", F.lit(False).alias("outside"), "node", "comp")
    out = m.where("comp != main").withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("bucket", "blk", F.pmod(h, F.col("chunks")).alias("chunk"), F.lit(True).alias("outside"), "node", "comp")
    key = ["bucket", "blk", "chunk"]
    cells = members.unionByName(out).join(sketches, "node").select(*key, "outside", "node", "comp", "n", "sketch")
    cells = cells.repartition(parts, *key).sortWithinPartitions(*key, "outside").mapInArrow(_screen(test_level(percent / 100), percent / 100), "bucket long, blk long, chunk long, outside boolean, node long, comp long")
    cells = scratch.settle(cells, "likely").join(texts, "node").select(*key, "outside", "node", "comp", "text")
    return cells.repartition(parts, *key).sortWithinPartitions(*key, "outside").mapInArrow(_cross(size, percent), "a long, b long").distinct()


# --- the operator ----------------------------------------------------------------------------------------------


def _classes(docs: DataFrame, id_col: str, text_col: str, extra: list[str], shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The documents with set size, fingerprint and row number, ``extra`` columns as x0 and so on; per class of equal
    sets, its fingerprint, its component's smallest doc_id and the row that stands for the component; and the
    fingerprints of classes with many documents.
    """
    spark = docs.sparkSession
    C.ship(spark)
    tmp = C.Scratch(spark)
    level, ratio = test_level(percent / 100), percent / 100
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra)])
    schema = T.StructType([*narrow.schema.fields, *T.StructType.fromDDL("n long, f1 long, f2 long, sketch binary").fields])
    base = C.settle(narrow.mapInArrow(_sketch(shingle), schema).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    reps = base.where("n > 0").groupBy("f1", "f2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("low"), F.min_by("rid", "doc_id").alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    reps = tmp.settle(reps.withColumn("row", F.coalesce("row", "node")), "classes")
    copied = C.counted(C.heavy(reps.select("f1", "f2", F.col("copies").alias("k")), base.count()))

    bands = reps.select("node", "sketch").mapInArrow(_bands, "bucket long, node long")
    lead = tmp.settle(bands.groupBy("bucket").agg(F.count("*").alias("cnt"), F.min("node").alias("lead")).where("cnt > 1"), "leads")
    hot = C.counted(C.heavy(lead.select("bucket", F.col("cnt").alias("k")), BANDS * reps.count()))
    multi = tmp.settle(C.salted_join(bands, lead, ["bucket"], hot, by="node"), "buckets")
    star = tmp.settle(multi.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    n_star = star.count()
    if not n_star:  # no bucket has two members
        classes = C.settle(reps.select("f1", "f2", F.col("low").alias("component"), F.col("row").alias("stay")), "classes")
        tmp.drop()
        return base, classes, copied
    # the only texts and registers that are looked at again: those that share a bucket with another
    members = tmp.settle(base.select(F.col("rid").alias("node"), "text", "n", "sketch").join(multi.select("node").distinct(), "node", "left_semi"), "texts")
    texts, r = members.select("node", "text"), members.select("node", "n", "sketch")
    left = r.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ra"))
    right = r.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("rb"))
    hubs = C.counted(C.heavy(star.groupBy("a").agg(F.count("*").alias("k")), n_star))
    pairs = C.salted_join(star, left, ["a"], hubs, by="b").join(right, "b").select("a", "na", "ra", "b", "nb", "rb").mapInArrow(_passing(level, ratio), "a long, b long")
    edges = tmp.settle(_linked(tmp.settle(pairs, "pairs"), hubs, texts, shingle, percent), "links")
    comp = components(edges, tmp)
    more = _rest(multi, hot, comp, r, texts, shingle, percent, tmp)
    more = more and tmp.settle(more, "links")
    if more is not None and not more.isEmpty():
        comp = components(edges.unionByName(more), tmp)

    named = reps.select("node", "f1", "f2", "low", "row").join(comp, "node", "left")
    smallest = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("low").alias("first"), F.min_by("row", "low").alias("stay"), F.min("row").alias("any"), F.count("*").alias("k"))
    smallest = tmp.settle(smallest, "smallest")
    classes = C.salted_join(named, smallest.drop("k"), ["comp"], C.counted(C.heavy(smallest.select("comp", "k"), reps.count())), by="node", how="left").select(
        "f1", "f2", F.when(F.col("comp").isNull(), F.col("low")).otherwise(F.col("first")).alias("component"),
        F.when(F.col("comp").isNull(), F.col("row")).otherwise(F.coalesce("stay", "any")).alias("stay"),
    )
    classes = C.settle(classes, "classes")
    tmp.drop()
    return base, classes, copied


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links documents whose shingle sets have ``100 * intersection >= percent * union``; component_id is the smallest
    doc_id reachable.  Null and empty texts have an empty set, are linked with nothing and stand for themselves.  Rows
    with a null doc_id take part; a component with null ids only has a null component_id, and its rows are kept.
    Repeated rows are copies of each other: the same component_id, kept alike.  Very long texts are hashed in segments.
    An empty table gives no rows.  Extra columns are ignored.
    """
    base, classes, copied = _classes(docs, id_col, text_col, [], shingle, percent)
    out = C.salted_join(base.select("doc_id", "n", "f1", "f2", "rid"), classes, ["f1", "f2"], copied, by="rid", how="left")
    cid = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), cid.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, one row of each component (that with the smallest doc_id); texts without words all stay.

    Of repeated rows one stays.  Columns are those of ``docs``.
    """
    extra = [c for c in docs.columns if c != text_col]
    base, classes, _ = _classes(docs, id_col, text_col, extra, shingle, percent)
    stay = classes.select(F.col("stay").alias("rid")).distinct()
    kept = base.where("n > 0").join(stay, "rid", "left_semi").unionByName(base.where("n = 0"))
    names = {c: F.col(f"x{i}").alias(c) for i, c in enumerate(extra)} | {text_col: F.col("text").alias(text_col)}
    return kept.select(*[names[c] for c in docs.columns])
