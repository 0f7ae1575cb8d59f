"""Personal data: candidate spans scored by gradient-boosted trees, as DataFrame functions.

Base patterns with validity checks always stay.  High-recall generators propose further, overlapping spans (obfuscated
addresses, numbers in other layouts, secrets).  Each candidate gets format and context features; boosted trees, fitted
on generated labelled sentences and compiled to a SQL expression, score it; a sigmoid calibrates the score, and a
threshold per kind selects.  Calibration and thresholds come from sentences made of other words and layouts than those
that the trees are fitted on.  From left to right, of two overlapping candidates the likelier stays.

Offsets come from splitting a text by a pattern: pieces and matches alternate, so their lengths add up to positions.
The patterns are written so that a text is read in linear time: a match can only begin where a run of its characters
begins, or where the match before ended.  Spans are summed up, compared and cut out in order, in chunks of ``CHUNK``
(Spark's arrays are copied when one element is added), and texts are cut at blocks of ``BLOCK`` characters, so a text
with many spans takes little more than linear time too.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")

#: Base patterns, leftmost and greedy; possessive where that can't change a match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Generators of the method: kind, pattern, what a text must hold to be searched.
GENERATORS: list[tuple[str, str, str]] = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[\[({](?:at|AT|@)[\])}] ?[A-Za-z0-9-]++(?: ?[\[({](?:dot|DOT|\.)[\])}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++", r"[\[({](?:at|AT|@)[\])}]"),
    ("phone", r"(?:\G|(?<![0-9+A-Za-z.-]))(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])", r"[0-9]{3}[ .-][0-9]{3,4}"),
    ("card", r"(?:\G|(?<![0-9A-Za-z.]))[0-9]{4}(?:[.][0-9]{4}){3}(?![0-9A-Za-z])", r"[0-9]{4}\.[0-9]{4}\."),
    ("secret", r"(?:\G|(?<![A-Za-z0-9_]))(?i:password|passwd|pwd|token|secret|api_key|apikey) ?[=:] ?\"?[A-Za-z0-9+/_-]{8,}+\"?", r"[=:]"),
    ("secret", r"(?:\G|(?<![A-Za-z0-9]))A(?:KIA|SIA)[A-Z0-9]{12,20}(?![A-Za-z0-9])", r"A(?:KIA|SIA)"),
]

#: Features of a candidate: name -> SQL over c.s (surface), c.lo and c.ro (up to 24 characters before, 12 after), c.g (generator).
FEATURES: dict[str, str] = {
    "generator": "c.g",
    "length": "length(c.s)",
    "digits": "length(regexp_replace(c.s, '[^0-9]', ''))",
    "letters": "length(regexp_replace(c.s, '[^A-Za-z]', ''))",
    "upper": "length(regexp_replace(c.s, '[^A-Z]', ''))",
    "marks": "length(regexp_replace(c.s, '[A-Za-z0-9 ]', ''))",
    "spaces": "length(c.s) - length(replace(c.s, ' ', ''))",
    "mixed": "int(c.s RLIKE '[0-9][A-Za-z]') + int(c.s RLIKE '[A-Za-z][0-9]')",
    "contact_left": "int(lower(c.lo) RLIKE '(call|tel|phone|fax|mobile|mail|contact|reach)')",
    "number_left": "int(lower(c.lo) RLIKE '(no|nr|order|part|version|isbn|item|lot|ref|page|id)[.:# ]*$')",
    "pay_left": "int(lower(c.lo) RLIKE '(card|visa|pay|credit|charge)')",
    "digit_right": "int(c.ro RLIKE '^[ .,-]?[0-9]')",
}

# --- the classifier -------------------------------------------------------------------------------------------


def _sentences(n: int, seed: int, held_out: bool = False) -> list[tuple[int, str, str, str, int]]:
    """Generated candidates (generator, left, surface, right, label): what people write, and look-alikes.

    Held-out ones have other syllables, leading words, key names and top-level domains.
    """
    r = random.Random(seed)
    pick = lambda *parts: r.choice(parts[held_out])
    syll = ["an", "er", "on", "re", "ti", "es", "la"] if not held_out else ["de", "ch", "en", "st", "ou", "mi", "ra"]
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    some = lambda abc, k: "".join(r.choice(abc) for _ in range(k))
    hexa, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    out = []
    for _ in range(n):
        g, good = r.randrange(len(GENERATORS)), r.random() < 0.5
        left, right = f"{word()} {word()} ", f" {word()} {word()}"
        if g == 0:
            o, c = r.choice(["[]", "()", "{}"])
            s = f"{word()}{r.choice(['', '.', '_'])}{word()} {o}at{c} {word()} {o}dot{c} {pick(['com', 'org'], ['net', 'de', 'co.uk'])}"
            if not good:
                s = f"{word()} {o}at{c} {pick(['1.5', '2.0', '10.25'], ['3.14', '10.2', '99.9'])}"
        elif g == 1:
            s = r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"({digits(4)}) {digits(4)} {digits(4)}"])
            if good and r.random() < 0.6:
                left += pick(["call ", "tel: ", "reach me at "], ["phone ", "fax ", "mobile: "])
            if not good:
                s = r.choice([s, f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(3)}.{digits(3)}.{digits(3)}"])
                left += pick(["order no ", "part ", "ref. "], ["lot ", "item #", "version "])
        elif g == 2:
            s = ".".join(digits(4) for _ in range(4))
            left += pick(["card ", "pay with "], ["visa ", "credit "]) if good else pick(["version ", "page "], ["id ", "ref "])
        elif g == 3:
            k = pick(["password", "token", "api_key"], ["secret", "passwd", "apikey"])
            k = r.choice([k, k, k.capitalize(), k.upper()])
            v = r.choice([some(hexa, r.randint(16, 64)), some(base + base.lower(), r.randint(12, 48))])
            if r.random() < 0.1:  # whole keys
                v = some(base + base.lower() + "+/", r.randint(257, 3000))
            s = r.choice([f"{k}={v}", f'{k} = "{v}"', f"{k}: {v}"])
            if not good:
                s = f"{k}{r.choice([': ', '=', ' = '])}{pick(['required', 'optional', 'sequence'], ['forgotten', 'authentication']) if r.random() < 0.6 else (word() + word() + word() + word()).ljust(8, 'a')}"
        else:
            s = "AKIA" + (some(base, 16) if good else some("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r.choice([12, 14, 16])))
        out.append((g, left[-24:], s, right[:12], int(good)))
    return out


def _feature_row(g: int, lo: str, s: str, ro: str) -> list[float]:
    n = lambda p: len(re.sub(p, "", s))
    low = lo.lower()
    has = lambda p, t: float(bool(re.search(p, t)))
    return [
        float(g), float(len(s)), float(n("[^0-9]")), float(n("[^A-Za-z]")), float(n("[^A-Z]")), float(n("[A-Za-z0-9 ]")), float(s.count(" ")),
        has("[0-9][A-Za-z]", s) + has("[A-Za-z][0-9]", s), has("(call|tel|phone|fax|mobile|mail|contact|reach)", low), has(r"(no|nr|order|part|version|isbn|item|lot|ref|page|id)[.:# ]*$", low),
        has("(card|visa|pay|credit|charge)", low), has(r"^[ .,-]?[0-9]", ro),
    ]


def _split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int):
    """A regression tree: (feature, cut, left, right) or a leaf's value; x[feature] <= cut goes left."""
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = -g / (h + 1.0)
    if depth == 0 or len(rows) < 20:
        return leaf
    best = (1e-6, None)
    for f in range(x.shape[1]):
        v = x[rows, f]
        order = np.argsort(v, kind="stable")
        last = np.flatnonzero(v[order[1:]] != v[order[:-1]])  # the last row of each value but the largest
        if not len(last):
            continue
        gl, hl = np.cumsum(grad[rows[order]])[last], np.cumsum(hess[rows[order]])[last]
        gain = gl * gl / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g * g / (h + 1.0)
        top = int(gain.argmax())
        if gain[top] > best[0]:
            cut = float(v[order[last[top]]])
            best = (float(gain[top]), (f, cut, v <= cut))
    if best[1] is None:
        return leaf
    f, cut, go = best[1]
    return f, cut, _split(x, grad, hess, rows[go], depth - 1), _split(x, grad, hess, rows[~go], depth - 1)


def _run(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _values(tree, x: np.ndarray) -> np.ndarray:
    """The tree's value for each row of features."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _values(tree[2], x), _values(tree[3], x))


@functools.cache
def model(n: int = 2400, rounds: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.98, seed: int = 11):
    """(trees, slope, offset, thresholds by kind, report): boosted on ``n`` generated candidates, calibrated on ``n`` held-out ones.

    A threshold is the lowest at which a kind reaches ``precision`` on the held-out candidates, an error if none does;
    the report has (threshold, precision, recall) by kind on further held-out ones.
    """
    fit, hold, test = _sentences(n, seed), _sentences(n, seed + 1, True), _sentences(n, seed + 2, True)
    x, y = np.array([_feature_row(*c[:4]) for c in fit]), np.array([c[4] for c in fit], float)
    score, trees = np.zeros(n), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _split(x, p - y, p * (1 - p), np.arange(n), depth)
        trees.append(tree)
        score += rate * _values(tree, x)
    hx, tx = (np.array([_feature_row(*c[:4]) for c in cs]) for cs in (hold, test))
    raw = lambda x: rate * sum(_values(t, x) for t in trees)
    hs, hy = raw(hx), np.array([c[4] for c in hold], float)
    a, b = 1.0, 0.0
    for _ in range(300):  # sigmoid calibration
        p = 1 / (1 + np.exp(-(a * hs + b)))
        a -= 0.05 * float(((p - hy) * hs).mean())
        b -= 0.05 * float((p - hy).mean())
    hp, tp, ty = 1 / (1 + np.exp(-(a * hs + b))), 1 / (1 + np.exp(-(a * raw(tx) + b))), np.array([c[4] for c in test], float)
    cuts, report = {}, {}
    for kind in dict.fromkeys(k for k, _, _ in GENERATORS):
        mine = np.array([GENERATORS[c[0]][0] == kind for c in hold])
        reached = [t / 100 for t in range(50, 100) if (take := mine & (hp >= t / 100)).any() and hy[take].mean() >= precision]
        if not reached:
            raise ValueError(f"no threshold gives {kind} a precision of {precision}")
        cuts[kind] = reached[0]
        mine = np.array([GENERATORS[c[0]][0] == kind for c in test])
        take = mine & (tp >= cuts[kind])
        report[kind] = (cuts[kind], float(ty[take].mean()), float(ty[take].sum() / ty[mine].sum()))
    return trees, a * rate, b, cuts, report


def _tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree:.8f}D"
    names = list(FEATURES)
    return f"CASE WHEN f.{names[tree[0]]} <= {tree[1]:.4f}D THEN {_tree_sql(tree[2])} ELSE {_tree_sql(tree[3])} END"


# --- spans -----------------------------------------------------------------------------------------------------


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Elements that are gathered before they are appended to the chunks before; characters of a block of text.
CHUNK, BLOCK = 256, 1024


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` stands for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _fold(items: str, state: str, kind: str, step: str, out: str) -> str:
    """SQL that goes through the array ``items`` in order: x.st is the state, y the item; ``step`` gives the next state and
    ``out`` an array of ``kind``, appended to the result.
    """
    none = f"CAST(array() AS ARRAY<{kind}>)"
    inner = f"aggregate(slice(v, CAST(j * {CHUNK} AS INT) + 1, {CHUNK}), struct(acc.st AS st, {none} AS o), (x, y) -> struct({step} AS st, concat(x.o, {out}) AS o))"
    outer = _let(inner, "z", "struct(z.st AS st, concat(acc.o, array(z.o)) AS o)")
    whole = f"aggregate(sequence(0L, CAST((size(v) - 1) div {CHUNK} AS BIGINT)), struct({state} AS st, CAST(array() AS ARRAY<ARRAY<{kind}>>) AS o), (acc, j) -> {outer}, acc -> flatten(acc.o))"
    return _let(items, "v", f"CASE WHEN size(v) > 0 THEN {whole} ELSE {none} END")


_SPAN = "STRUCT<a: INT, e: INT, s: STRING>"


def _spans(pattern: str, need: str) -> str:
    """SQL for array<struct<a, e, s>> of a pattern's matches in column t (start, end, surface); ``need`` gates the search."""
    q = _quote(pattern)
    items = _let(f"regexp_extract_all(t, {q}, 0)", "m", f"zip_with(m, slice(split(t, {q}, -1), 1, size(m)), (s, g) -> struct(length(g) AS g, length(s) AS n, s AS s))")
    made = _fold(items, "0", _SPAN, "x.st + y.g + y.n", "array(struct(x.st + y.g AS a, x.st + y.g + y.n AS e, y.s AS s))")
    return f"CASE WHEN {need} THEN {made} ELSE CAST(array() AS ARRAY<{_SPAN}>) END"


def _cut(start: str, end: str) -> str:
    """SQL for the characters from start to end of the text whose blocks are column b."""
    i, j = f"CAST(({start}) div {BLOCK} AS INT)", f"CAST((({end}) - 1) div {BLOCK} AS INT)"
    head, tail = f"substring(get(b, {i}), ({start}) % {BLOCK} + 1", f"substring(get(b, {j}), 1, (({end}) - 1) % {BLOCK} + 1)"
    return f"CASE WHEN ({end}) <= ({start}) THEN '' WHEN {i} = {j} THEN {head}, ({end}) - ({start})) ELSE concat({head}), array_join(slice(b, {i} + 2, {j} - {i} - 1), ''), {tail}) END"


_BLOCKS = f"regexp_extract_all(t, '(?s).{{1,{BLOCK}}}', 0)"


def _has(pattern: str) -> str:
    return f"regexp_like(t, {_quote(pattern)})"


_DIGITS = "regexp_replace(x.s, '[^0-9]', '')"
_LUHN = f"""(CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN
  aggregate(sequence(1, length({_DIGITS})), 0, (c, i) -> c +
    CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST(substring({_DIGITS}, i, 1) AS INT)
    ELSE CASE WHEN CAST(substring({_DIGITS}, i, 1) AS INT) > 4 THEN 2 * CAST(substring({_DIGITS}, i, 1) AS INT) - 9 ELSE 2 * CAST(substring({_DIGITS}, i, 1) AS INT) END END) % 10 = 0
  ELSE false END)"""
_OCTETS = "forall(split(x.s, '[.]'), p -> length(ltrim('0', p)) <= 2 OR (length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255'))"
_PHONE = f"length({_DIGITS}) BETWEEN 8 AND 15"

BASE: list[tuple[str, str, str, str]] = [
    ("email", EMAIL, "contains(t, '@')", "true"),
    ("ip", IP, _has(r"[0-9]\.[0-9]"), _OCTETS),
    ("card", CARD, _has(r"[0-9][ -]?[0-9]"), _LUHN),
    ("phone", PHONE, _has(r"\+[0-9]"), _PHONE),
]

_MARKED = "STRUCT<a: INT, e: INT, p: DOUBLE, k: STRING, s: STRING>"
#: Of candidates and base spans (k = '') in order, the candidates that stay: y begins behind the one before, or is likelier.
_APART = "y.a >= x.st.e"
_SELECT = _fold(
    "concat(sort_array(concat(cand, transform(all_base, c -> struct(c.a AS a, c.e AS e, 2D AS p, '' AS k, '' AS s)))), array(struct(2147483647 AS a, 2147483647 AS e, 2D AS p, '' AS k, '' AS s)))",
    "struct(0 AS a, 0 AS e, 2D AS p, '' AS k, '' AS s)",
    _MARKED,
    f"CASE WHEN {_APART} OR y.p > x.st.p OR (y.p = x.st.p AND y.k != '' AND y.a = x.st.a AND y.e > x.st.e) THEN y WHEN x.st.k = '' AND y.k = '' THEN struct(x.st.a AS a, greatest(x.st.e, y.e) AS e, 2D AS p, '' AS k, '' AS s) ELSE x.st END",
    f"CASE WHEN {_APART} AND x.st.k != '' THEN array(x.st) ELSE CAST(array() AS ARRAY<{_MARKED}>) END",
)
_GAP = "STRUCT<a: INT, e: INT, k: STRING>"
#: Spans (a, e, k) in order, those that overlap joined under the first one's kind.
_GAPS = _fold(
    "concat(sp, array(struct(2147483647 AS a, 2147483647 AS e, '' AS k)))",
    "struct(-1 AS a, 0 AS e, '' AS k)",
    _GAP,
    f"CASE WHEN {_APART} THEN y ELSE struct(x.st.a AS a, greatest(x.st.e, y.e) AS e, x.st.k AS k) END",
    f"CASE WHEN {_APART} AND x.st.a >= 0 THEN array(x.st) ELSE CAST(array() AS ARRAY<{_GAP}>) END",
)


def find_spans(docs: DataFrame, text_col: str = "text", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Add ``base_<kind>`` and ``spans_<kind>``: arrays of (a, e, s), sorted, for every whole text; null counts as empty.

    ``spans_<kind>`` holds the base spans and the selected candidates that overlap no base span of any kind.
    """
    trees, slope, offset, cuts, _ = model()
    d = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    names = list(keep)
    for kind, pattern, need, valid in BASE:
        d = d.withColumn(f"m_{kind}", F.expr(_spans(pattern, f"({need}) AND {_has(pattern)}")))
    d = d.select(*[F.col(f"`{c}`") for c in names], "t", *[F.expr(f"filter(m_{k}, x -> {valid})").alias(f"base_{k}") for k, _, _, valid in BASE], F.expr(f"CAST(array() AS ARRAY<{_SPAN}>)").alias("base_secret"))
    features = ", ".join(f"CAST({sql} AS DOUBLE) AS {n}" for n, sql in FEATURES.items())
    for i, (_, pattern, need) in enumerate(GENERATORS):  # most texts have no match
        d = d.withColumn(f"g_{i}", F.expr(_spans(pattern, f"({_has(need)}) AND {_has(pattern)}")))
    found = ", ".join(f"transform(g_{i}, x -> named_struct('g', {i}, 'k', '{kind}', 'a', x.a, 'e', x.e, 's', x.s))" for i, (kind, _, _) in enumerate(GENERATORS))
    around = f"transform(c, x -> struct(x.g AS g, x.k AS k, x.a AS a, x.e AS e, x.s AS s, {_cut('greatest(x.a - 24, 0)', 'x.a')} AS lo, {_cut('x.e', 'least(x.e + 12, n)')} AS ro))"
    around = _let("length(t)", "n", _let(_BLOCKS, "b", around))
    d = d.withColumn("cand", F.expr(_let(f"concat({found})", "c", f"CASE WHEN size(c) > 0 THEN {around} ELSE transform(c, x -> struct(x.g AS g, x.k AS k, x.a AS a, x.e AS e, x.s AS s, '' AS lo, '' AS ro)) END")))
    d = d.withColumn("cand", F.expr(f"transform(cand, c -> struct(c.k AS k, c.a AS a, c.e AS e, c.s AS s, struct({features}) AS f))"))
    total = " + ".join(_tree_sql(t).replace("f.", "c.f.") for t in trees)
    d = d.withColumn("cand", F.expr(f"transform(cand, c -> struct(c.a AS a, c.e AS e, 1D / (1D + exp(-({slope:.8f}D * ({total}) + {offset:.8f}D))) AS p, c.k AS k, c.s AS s))"))
    by_kind = " OR ".join(f"(c.k = '{k}' AND c.p >= {v}D)" for k, v in cuts.items())
    d = d.withColumn("cand", F.expr(f"filter(cand, c -> {by_kind})")).withColumn("all_base", F.expr("concat(base_email, base_ip, base_card, base_phone)"))
    d = d.withColumn("cand", F.expr(f"CASE WHEN size(cand) > 0 THEN {_SELECT} ELSE cand END"))
    spans = [F.expr(f"sort_array(concat(base_{k}, transform(filter(cand, c -> c.k = '{k}'), c -> struct(c.a AS a, c.e AS e, c.s AS s))))").alias(f"spans_{k}") for k in KINDS]
    return d.select(*[F.col(f"`{c}`") for c in names], "t", *[f"base_{k}" for k in KINDS[:4]], *spans)


def _text(column: str, kind: str) -> str:
    return f"transform({column}, x -> concat('{kind}:', x.a, ':', x.e))"


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans and all spans, a row per document.

    Null and empty texts have no spans.  Ids may be null or repeat; an empty table gives no rows; extra columns are
    ignored; very long texts are searched whole.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    s = find_spans(named, "text", keep=("doc_id",))
    base = ", ".join(_text(f"base_{k}", k) for k in KINDS[:4])
    every = ", ".join(_text(f"spans_{k}", k) for k in KINDS)
    return s.select(
        "doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.expr(f"sha2(concat_ws(',', {base}), 256)").alias("base_sha256"), F.expr(f"concat_ws(',', {every})").alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; other columns stay, null text stays null.

    Overlapping spans of different kinds become one gap, named after the first.  Empty texts and texts without spans
    stay as they are, repeated rows repeat, an empty table gives no rows, very long texts are cut whole.
    """
    cols = [c for c in docs.columns if c != text_col]
    d = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.col(f"`{text_col}`").alias("text"))
    s = find_spans(d.withColumn("null_text", F.col("text").isNull()), "text", keep=(*[f"c{i}" for i in range(len(cols))], "null_text"))
    every = ", ".join(f"transform(spans_{k}, x -> struct(x.a AS a, x.e AS e, '{k}' AS k))" for k in KINDS)
    s = s.withColumn("sp", F.expr(f"sort_array(concat({every}))"))
    before = "CASE WHEN i > 0 THEN get(w, i - 1).e ELSE 0 END"
    pieces = f"concat(array_join(transform(w, (x, i) -> concat({_cut(before, 'x.a')}, '[', upper(x.k), ']')), ''), {_cut('get(w, size(w) - 1).e', 'n')})"
    cut = F.expr(f"CASE WHEN size(sp) = 0 THEN t ELSE {_let('length(t)', 'n', _let(_BLOCKS, 'b', _let(_GAPS, 'w', pieces)))} END")
    out = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(cols)} | {text_col: F.when(F.col("null_text"), None).otherwise(cut).alias(text_col)}
    return s.select(*[out[c] for c in docs.columns])
