"""Language identification with unigram piece models, marginalised over segmentations.

The pieces come from a fixed public vocabulary; each language only has its own piece probabilities, fitted by
expectation maximisation on a bounded sample of labelled texts.  A word's probability is the sum over all its
segmentations, by the forward algorithm.  Pieces do not reach over word borders, so a text's log-likelihood is the sum
over its words, and a word's values are computed once per task and kept.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common as C

#: Labelled documents per language that the models are fitted on, about (chosen by a hash of the id).
SAMPLE_DOCS = 250
#: Rounds of expectation maximisation; added count of each piece; probability of a character outside the vocabulary.
ROUNDS, ADDED, UNKNOWN = 3, 0.1, 1e-7
#: Words whose values a task keeps.  Words beyond ``LONG`` characters are worked through with logarithms, as are all in
#: training: runs of letters in languages without spaces.
CACHE, LONG = 300_000, 40
#: Cells (positions times words) of a block's lattices.
CELLS = 1 << 19

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Lower-case letter pieces of the vocabulary; a leading U+2581 marks a word's start."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if "<" not in p and p == p.lower() and "▁" not in p[1:] and (p.removeprefix("▁").isalpha() or p == "▁"):
            out[p] = len(out)
    return out


def _add(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add values to rows; ``rows`` ascend."""
    if len(rows):
        head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[head]] += np.add.reduceat(values, head, axis=0)


@dataclass
class Model:
    """Piece ids and, per language, piece probabilities; the last row is for unknown characters."""

    pieces: dict[str, int]
    langs: list[str]
    prob: np.ndarray  # (pieces + 1, languages)

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        nodes = {"": 0}
        for p in sorted(self.pieces):
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        steps = sorted((nodes[x[:-1]] << 21 | ord(x[-1]), n) for x, n in nodes.items() if x)
        #: The trie of the pieces as sorted (node, character) keys and the nodes they lead to; a node's piece, or -1.
        self.keys, self.leads = (np.array([x[k] for x in steps], dtype=np.int64) for k in (0, 1))
        self.piece_at = np.array([self.pieces.get(x, -1) for x in nodes], dtype=np.int64)

    def lattice(self, words: list[str]):
        """Edges of all words' lattices as arrays (word, start, end, piece), by ascending end and word; and lengths.

        The trie is walked from all starts of all words at once, a character a step.
        """
        unk = len(self.pieces)
        text = np.array(["▁" + x for x in words])
        codes = text.view(np.uint32).reshape(len(words), -1).astype(np.int64)
        sizes = np.fromiter((len(x) + 1 for x in words), dtype=np.int64, count=len(words))
        w = np.repeat(np.arange(len(words)), sizes)
        s = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        node, e, edges = np.zeros(len(w), dtype=np.int64), s.copy(), []
        while len(w):
            key = node << 21 | codes[w, e]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            ok = self.keys[at] == key if len(self.keys) else np.zeros(len(w), dtype=bool)
            piece = np.where(ok, self.piece_at[self.leads[at]], -1) if len(self.keys) else np.full(len(w), -1)
            if not edges:  # characters that are no piece
                edges.append((w[piece < 0], s[piece < 0], e[piece < 0] + 1, np.full(int((piece < 0).sum()), unk)))
            edges.append((w[piece >= 0], s[piece >= 0], e[piece >= 0] + 1, piece[piece >= 0]))
            ok &= e + 1 < sizes[w]
            w, s, e, node = w[ok], s[ok], e[ok] + 1, self.leads[at[ok]]
        w, s, e, p = (np.concatenate([x[k] for x in edges]) for k in range(4))
        order = np.argsort(e * len(words) + w, kind="stable")
        return w[order], s[order], e[order], p[order], sizes

    def forward(self, lattice) -> np.ndarray:
        """alpha[position, word, language]: probability of all segmentations of the first characters."""
        w, s, e, p, sizes = lattice
        alpha = np.zeros((int(sizes.max(initial=0)) + 1, len(sizes), len(self.langs)))
        alpha[0] = 1.0
        ends = np.searchsorted(e, np.arange(1, alpha.shape[0] + 1))
        for j in range(1, alpha.shape[0]):
            part = slice(ends[j - 1], ends[j])
            _add(alpha[j], w[part], alpha[s[part], w[part]] * self.prob[p[part]])
        return alpha

    def log_forward(self, lattice) -> np.ndarray:
        """Logarithms of ``forward``, for words of any length.  A position's sum is taken relative to the position before."""
        w, s, e, p, sizes = lattice
        out = np.zeros((int(sizes.max(initial=0)) + 1, len(sizes), len(self.langs)))
        ends = np.searchsorted(e, np.arange(1, out.shape[0] + 1))
        for j in range(1, out.shape[0]):
            part = slice(ends[j - 1], ends[j])
            who = w[part]
            total = np.zeros(out.shape[1:])
            _add(total, who, np.exp(out[s[part], who] - out[j - 1, who]) * self.prob[p[part]])
            out[j] = out[j - 1] + np.log(np.maximum(total, 1e-300))
        return out

    def posterior(self, lattice) -> np.ndarray:
        """For each edge and language, the probability that a segmentation of its word takes it.

        ``behind`` is the probability of what follows a position, divided by that of the whole word and multiplied by
        that of what precedes it; so it stays between 0 and 1 whatever the word's length.
        """
        w, s, e, p, sizes = lattice
        front = self.log_forward(lattice)
        share = np.exp(front[s, w] - front[e, w]) * self.prob[p]  # of an end's sum, this edge's part
        behind = np.zeros_like(front)
        behind[sizes, np.arange(len(sizes))] = 1.0
        by_start = np.lexsort((w, -s))
        at = -s[by_start]
        places = -np.arange(front.shape[0])
        first, last = np.searchsorted(at, places, "left"), np.searchsorted(at, places, "right")
        for j in range(front.shape[0] - 1, -1, -1):
            part = by_start[first[j] : last[j]]
            _add(behind[j], w[part], behind[e[part], w[part]] * share[part])
        return share * behind[e, w]

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language, summed over segmentations."""
        out = np.zeros((len(words), len(self.langs)))
        for some in _blocks(words):
            lat = self.lattice([words[i] for i in some])
            last = lat[4], np.arange(len(some))
            if len(words[some[-1]]) <= LONG:
                out[some] = np.log(np.maximum(self.forward(lat)[last], 1e-300))
            else:
                out[some] = self.log_forward(lat)[last]
        return out


def _blocks(words: list[str]):
    """Indexes of words of like length, in blocks of bounded size; words beyond ``LONG`` apart."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    some: list[int] = []
    for i in order:
        n = len(words[i])
        if some and (len(some) >= 4096 or (len(some) + 1) * (n + 2) > CELLS or len(words[some[-1]]) <= LONG < n):
            yield some
            some = []
        some.append(i)
    if some:
        yield some


def fit(counts: dict[str, Counter], pieces: dict[str, int], rounds: int = ROUNDS) -> Model:
    """Expectation maximisation per language from word counts, words of all lengths; no languages: a model without any."""
    langs = sorted(counts)
    words = list(dict.fromkeys(w for c in counts.values() for w in c))
    unk = len(pieces)
    model = Model(pieces, langs, np.full((unk + 1, len(langs)), 1.0 / (unk + 1)))
    model.prob[unk] = UNKNOWN
    if not langs or not words:
        return model
    c = np.array([[counts[x][w] for x in langs] for w in words], dtype=float)
    blocks = list(_blocks(words))
    lattices = [model.lattice([words[i] for i in b]) for b in blocks]
    for _ in range(rounds):
        expected = np.full((unk + 1, len(langs)), ADDED)
        for b, lat in zip(blocks, lattices, strict=True):
            share = model.posterior(lat) * c[b][lat[0]]
            for k in range(len(langs)):
                expected[:, k] += np.bincount(lat[3], weights=share[:, k], minlength=unk + 1)
        expected[unk] = 0
        prob = expected / expected.sum(axis=0)
        prob[unk] = UNKNOWN
        model = Model(pieces, langs, prob)
    return model


def _count_words(batches):
    for batch in batches:
        got: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        rows = [(lang, w, n) for lang, c in got.items() for w, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "word", "n"])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, vocab_path: str | None = None) -> Model:
    """Fit on documents whose ``crc32(id) % 4`` is not 2 and whose language is known, about ``sample_docs`` per language."""
    C.ship(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    d = d.where("crc32(id) % 4 != 2 AND lang IS NOT NULL")  # counted without reading any text
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit({}, vocabulary(vocab_path))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / n))) for lang, n in sizes.items()])
    some = d.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000))
    words = some.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
    table = words.toArrow()
    for lang, word, n in zip(*[table.column(i).to_pylist() for i in range(3)], strict=True):
        counts[lang][word] = n
    return fit(counts, vocabulary(vocab_path))


def _predict(shared, n_extra: int):
    """mapInArrow over (text, passed on ...): the passed columns, then lang_pred and score."""

    def run(batches):
        model = shared.value
        k = len(model.langs)
        index: dict[str, int] = {}
        values = np.zeros((1024, max(k, 1)))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            pred, score = [], []
            raw = [t or "" for t in texts]
            for a, b in C.text_blocks(raw, 2 << 20):
                words = [WORD.findall(t.lower()) for t in raw[a:b]]
                if k:
                    if len(index) > CACHE:
                        index = {}
                    new = list({w for ws in words for w in ws if w not in index})
                    if len(index) + len(new) > len(values):
                        values = np.concatenate([values[: len(index)], np.zeros((len(index) + 2 * len(new), k))])
                    values[len(index) : len(index) + len(new)] = model.scores(new)
                    index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
                for ws in words:
                    if not k or not any(c.isalpha() for w in ws for c in w):
                        pred.append(UNDETERMINED)
                        score.append(0.0)
                        continue
                    ll = values[np.fromiter(map(index.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0)
                    best = int(ll.argmax())
                    pred.append(model.langs[best])
                    score.append(float(1.0 / np.exp(ll - ll[best]).sum()))
            cols = [batch.column(i) for i in range(1, 1 + n_extra)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*[f"c{i}" for i in range(n_extra)], "lang_pred", "score"])

    return run


def classify(docs: DataFrame, model: Model, text_col: str = "text", passed: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The passed columns (all by default), and under ``names`` the language and its score (posterior with equal priors)
    of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, as are all where no language was learned.  An empty
    table gives no rows.
    """
    C.ship(docs.sparkSession)
    passed = docs.columns if passed is None else passed
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(passed)])
    schema = T.StructType([*narrow.schema.fields[1:], *T.StructType.fromDDL("lang_pred string, score double").fields])
    out = narrow.mapInArrow(_predict(shared, len(passed)), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(passed)], F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))


def predict(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, vocab_path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from the others as ``train`` says.

    A null id is not held out and not learned from.  Repeated rows give equal rows.  Extra columns are ignored.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample_docs=sample_docs, vocab_path=vocab_path)
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    got = classify(d, model, passed=["doc_id"])
    return got.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
