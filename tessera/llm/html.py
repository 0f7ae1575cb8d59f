"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and blocks of words.  The words of a block score by its shape (element, length, share of
links, punctuation) and its surroundings (the nearest class, id, role or element name that tells content from the
rest); tags score by their name, never above zero.  All weights, and what names tell, are fitted on labelled pages:
logistic regression over blocks, log-odds of tags.  The contiguous run with the largest sum is the content region (one
linear scan); of it, text under a name that tells against content is left out.
"""

from __future__ import annotations

import functools
import html as htmllib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

TAG = re.compile(r"<!--|<[a-zA-Z/!?]")
#: What matters inside a tag: its end, or an attribute's value, quoted (group 1) or not.
EDGE = re.compile(r"[<>]|=\s*+(?:([\"'])|[^\s\"'<>][^\s<>]*+)")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"(?<![^\s\"'<>/=])([^\s\"'<>/=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]+))")
MARK = re.compile(r"\b(?:class|id|role)$", re.I)
#: Their content is no markup.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "button", "title")
INLINE = frozenset("a abbr b bdi bdo big cite code dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that can hold a page's parts.
CONTAINERS = frozenset("head body nav header footer aside form article main section div ul ol table figure dialog menu blockquote".split())
#: Elements that are the content where a page has them.
CONTENT = frozenset(("article", "main"))
#: Class names with one of these words describe the page, not a part of it.
WRAPPERS = frozenset("page wrap wrapper container layout site body has with no without".split())
_SPACE = re.compile(r"\s+")


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends whose name begins before ``at``: after ``>``, or before a ``<`` outside values.

    Quoted values are read whole; a quote that never closes (``last`` has each quote's last place) counts as a character.
    """
    while m := EDGE.search(page, at):
        quote = m[1]
        if quote is None and m[0] in "<>":
            return m.end() if m[0] == ">" else m.start()
        at = m.end()
        if quote and last[quote] >= at:
            at = page.index(quote, at) + 1
    return len(page)


class Block:
    """A run of text between block-level tags: the pieces of text, counts of words and linked words, and where it stands."""

    __slots__ = ("at", "tag", "names", "content", "form", "parts", "words", "linked")

    def __init__(self, at: int, tag: str, names: tuple[str, ...], content: bool, form: bool):
        self.at, self.tag, self.names, self.content, self.form = at, tag, names, content, form
        self.parts: list[str] = []
        self.words = self.linked = 0


def parse(page: str) -> list[tuple[str, bool] | Block]:
    """The page as block-level tags (name or /name, whether in content) and blocks of text, in order.

    A block's names are those of the elements around it that have any, the nearest last.  A closing tag without an open
    element is passed over; which elements are open is counted by name, so no tag makes the stack be searched in vain.
    """
    stack: list[tuple[str, int, bool, bool]] = []  # element, its names begin at, in content, in a form
    names: list[tuple[str, ...]] = []
    is_open: Counter = Counter()
    out: list[tuple[str, bool] | Block] = []
    block: Block | None = None
    tag, linked, at = "body", 0, 0
    last = {q: page.rfind(q) for q in "\"'"}

    def text(start: int, end: int) -> None:
        nonlocal block
        value = htmllib.unescape(page[start:end])
        if block is None:
            if not value.strip():
                return
            block = Block(start, tag, names[-1] if names else (), bool(stack) and stack[-1][2], bool(stack) and stack[-1][3])
            out.append(block)
        block.parts.append(value)
        n = len(value.split())
        block.words += n
        block.linked += n * linked

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            text(at, len(page))
            break
        if m.start() > at:
            text(at, m.start())
        if m.group() == "<!--":
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        at = _tag_end(page, m.end(), last)
        whole = page[m.start() : at]
        n = NAME.match(whole)
        if n is None:
            continue
        close, name = n[1], n[2].lower()
        if name in INLINE:
            if name == "a":
                linked = 0 if close else 1
            continue
        block, tag = None, "body" if close else name
        if name in RAW and not close:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            out.append((name, bool(stack) and stack[-1][2]))
            continue
        if close:
            out.append(("/" + name, bool(stack) and stack[-1][2]))
        if name in CONTAINERS:
            if close and is_open[name]:
                while True:
                    gone = stack.pop()
                    names.pop()
                    is_open[gone[0]] -= 1
                    if gone[0] == name:
                        break
            elif not close:
                outer = stack[-1] if stack else ("", 0, False, False)
                is_open[name] += 1
                stack.append((name, 0, outer[2] or name in CONTENT, outer[3] or name == "form"))
                names.append((*(names[-1] if names else ())[-DEPTH:], *_names(name, whole, outer[2])))
        if not close:
            out.append((name, bool(stack) and stack[-1][2]))
    return out


#: Names around a block that are looked at, the nearest ones.
DEPTH = 16
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


def _names(element: str, tag: str, in_content: bool) -> tuple[str, ...]:
    """What an element is called: the words of its class, id and role, and its own name unless that says nothing.

    Names of the whole page (of ``body`` and ``main``, or with a word like *layout*) are passed over, and so is a header
    inside the content, which has the title.
    """
    own = () if element in ("div", "section", "ul", "ol", "table", "figure", "blockquote", "body", "form") or (element == "header" and in_content) else (element,)
    if element in ("body", "main"):
        return own
    marks = []
    for m in ATTRIBUTE.finditer(tag):
        if MARK.search(m[1]):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                words = [w for w in re.split(r"[^a-z]+", name) if w]
                if not WRAPPERS.intersection(words):
                    marks += words
    return (*own, *marks)


def features(page: list[tuple[str, bool] | Block], told: dict[str, float]) -> list[tuple[Block, list[str]]]:
    """Each block with its features, the last one what names tell; ``told`` has the names that tell, above zero for content.

    Where a page has content elements, a block's shape says nothing.  A form around half of the page's words or more is
    the page, and not a part of it.
    """
    blocks = [b for b in page if isinstance(b, Block)]
    total = sum(b.words for b in blocks)
    whole_form = 2 * sum(b.words for b in blocks if b.form) >= total
    has_content = any(b.content for b in blocks)
    out = []
    for b in blocks:
        share = b.linked / max(b.words, 1)
        links = "links " + ("none" if share == 0 else "some" if share < 0.5 else "most")
        if has_content:
            f = ["inside" if b.content else "outside"]
        else:
            end = b.parts[-1].rstrip()[-1:]
            f = ["one", links, "tag " + (b.tag if b.tag in SHAPES else "other"), f"words {min(int(math.log2(max(b.words, 1))), 6)}", "ends" if end and end in ".!?:;\u2026\u3002" else "open"]
        f.append("name " + side(b, told, whole_form))
        out.append((b, f))
    return out


SHAPES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dd dt pre label legend body div br".split())


def side(b: Block, told: dict[str, float], whole_form: bool) -> str:
    """What the names around a block tell: *not* if any within the content, or the nearest telling one, says so."""
    if b.form and not whole_form:
        return "not"
    known = [told[n] for n in b.names if n in told]
    if any(v < 0 for v in known):  # inside a left-out part all is left out
        return "not"
    return "content" if known else "nothing"


# --- labelled pages -------------------------------------------------------------------------------------------


def labelled_pages(n: int = 120, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated pages with the ranges of their content, in layouts of common page templates.

    A third of the pages have telling names, a third names that say nothing, a third no names but of elements.
    """
    r = random.Random(seed)
    good = ["article", "content", "post", "entry", "story", "text"]
    bad = ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "sidebar", "menu", "navbar", "navigation", "breadcrumb", "cookie", "notice", "consent", "newsletter", "subscribe", "comments", "comment", "share", "social", "related", "widget", "login", "search", "footer", "header", "masthead", "copyright", "popup", "modal"]
    element = {"footer": "footer", "header": "header", "masthead": "header", "menu": "nav", "navbar": "nav", "navigation": "nav", "sidebar": "aside", "related": "aside", "login": "form", "search": "form", "newsletter": "form"}

    def text(k: int) -> str:
        return " ".join("".join(r.choice(("an", "er", "on", "re", "ti", "la")) for _ in range(r.randint(1, 3))) for _ in range(k))

    out = []
    for i in range(n):
        style = ("names", "codes", "bare")[i % 3]
        parts: list[tuple[str, bool]] = []

        def attr(name: str, style=style) -> str:
            if style == "codes":
                return f' class="css-{r.choice("abcdefghk")}{r.randrange(99)}"'
            return f' class="{r.choice(["", "c-", "main-"])}{name}"' if style == "names" else ""

        def boiler(name: str, style=style) -> str:
            tag = element.get(name, "div") if r.random() < 0.7 else "div"
            kind = r.random()
            if name in ("menu", "navbar", "navigation", "breadcrumb", "related", "social", "share", "sidebar") and kind < 0.8:
                inner = "<ul>" + "".join(f'<li><a href="/{text(1)}">{text(r.randint(1, 4))}</a></li>' for _ in range(r.randint(2, 9))) + "</ul>"
            elif tag == "form":
                inner = "".join(f"<label>{text(r.randint(1, 3))}</label><input>" for _ in range(r.randint(1, 4))) + (f"<p>{text(r.randint(2, 12))}</p>" if kind < 0.5 else "")
            elif name in ("comments", "comment"):
                inner = "".join(f"<p>{text(r.randint(2, 30))}.</p>" for _ in range(r.randint(1, 5)))
            else:
                inner = "".join(r.choice([f"<p>{text(r.randint(2, 14))}.</p>", text(r.randint(2, 9)), f'<p><a href="/x">{text(r.randint(1, 4))}</a> {text(2)}</p>']) for _ in range(r.randint(1, 3)))
            return f"<{tag}{attr(name)}>{inner}</{tag}>"

        for name in r.sample(["navigation", "menu", "header", "masthead", "ad", "cookie", "search", "breadcrumb", "banner"], r.randint(2, 4)):
            parts.append((boiler(name), False))
        holder = r.choice(["article", "main"]) if r.random() < (0.5 if style != "codes" else 0.2) else "div"
        parts.append((f"<{holder}{attr(r.choice(good))}>", True))
        if r.random() < 0.8:
            parts.append((f"<h1>{text(r.randint(2, 12))}</h1>", True))
        for _ in range(r.randint(2, 14)):
            parts.append((r.choice([f"<p>{text(r.randint(12, 90))}.</p>"] * 8 + [f"<h2>{text(r.randint(1, 6))}</h2>", f"<p>{text(r.randint(1, 8))}.</p>", f"<ul><li>{text(r.randint(1, 12))}</li><li>{text(r.randint(3, 12))}</li></ul>", f'<p>{text(20)} <a href="/">{text(3)}</a> {text(9)}.</p>']), True))
            if r.random() < 0.06:
                parts.append((boiler(r.choice(["ad", "newsletter", "related", "share"])), False))
        parts.append((f"</{holder}>", True))
        for name in r.sample(bad, r.randint(1, 4)):
            parts.append((boiler(name), False))
        parts.append((f"<footer{attr('footer')}>&copy; {text(r.randint(2, 12))}</footer>" if r.random() < 0.6 else f"<div{attr('copyright')}><p>&copy; 2020 {text(r.randint(2, 12))}.</p></div>", False))
        wrap = ("<form>", "</form>") if i % 10 == 9 else ("", "")
        page, ranges = f"<html><head><title>{text(4)}</title></head><body>{wrap[0]}", []
        for x, inside in parts:
            if inside:
                ranges.append((len(page), len(page) + len(x)))
            page += x
        out.append((page + wrap[1] + "</body></html>", ranges))
    return out


@functools.cache
def weights() -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """From the labelled pages: what names tell (log-odds), weights of blocks' features, weights of tags (below zero).

    A name tells if it stands around four blocks or more, nine in ten of them in the content, or outside.
    """
    pages = []
    for page, ranges in labelled_pages():
        tokens, inside = parse(page), set()
        for a, b in ranges:
            inside.update(x.at for x in tokens if isinstance(x, Block) and a <= x.at < b)
        pages.append((tokens, inside))
    around, tags = (Counter(), Counter()), (Counter(), Counter())
    for tokens, inside in pages:
        before, waiting = False, []  # a closing tag belongs to the block before, an opening one to the next
        for x in tokens:
            if isinstance(x, Block):
                before = x.at in inside
                around[before].update(set(x.names))
                tags[before].update(waiting)
                waiting = []
            elif x[0][0] == "/":
                tags[before][x[0]] += 1
            else:
                waiting.append(x[0])
    told = {}
    for name in {*around[0], *around[1]}:
        no, yes = around[0][name], around[1][name]
        if yes + no >= 4 and (yes >= 9 * no or no >= 9 * yes):
            told[name] = math.log((yes + 0.5) / (no + 0.5))
    sums = [sum(c.values()) + 1.0 for c in tags]
    tag_w = {t: max(-3.0, min(-0.1, math.log((tags[1][t] + 0.5) / sums[1]) - math.log((tags[0][t] + 0.5) / sums[0]))) for t in {*tags[0], *tags[1]}}
    rows = [(f, float(b.at in inside)) for tokens, inside in pages for b, f in features(tokens, told)]
    columns = {f: k for k, f in enumerate(sorted({x for f, _ in rows for x in f}))}
    x, y = np.zeros((len(rows), len(columns))), np.array([v for _, v in rows])
    for i, (f, _) in enumerate(rows):
        x[i, [columns[k] for k in f]] = 1.0
    w = np.zeros(len(columns))
    for _ in range(30):  # Newton's method, with a small penalty
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (q - y) + 0.1 * w)
    return told, dict(zip(columns, w.tolist(), strict=True)), tag_w


def score(x: tuple[str, bool] | Block, feature: dict[int, list[str]]) -> float:
    """What a tag or a block adds to a run; tags in a content element only a little, whatever their name."""
    _, word_w, tag_w = weights()
    if not isinstance(x, Block):
        return -0.1 if x[1] else tag_w.get(x[0], -0.1)
    f = feature[id(x)]
    if f[-1] == "name not" and x.content:
        return 0.0  # left out anyway, so it must not part the content
    return x.words * max(-4.0, min(2.0, sum(word_w.get(k, 0.0) for k in f)))


def main_text(page: str) -> str:
    """The content's text.

    A page in which no run of tokens scores above zero is content whole, but for what names tell against and for links;
    empty if nothing is left.
    """
    tokens = parse(page)
    feature = {id(b): f for b, f in features(tokens, weights()[0])}
    best, best_at, run, start = 0.0, None, 0.0, 0
    for i, x in enumerate(tokens):
        if run <= 0:
            run, start = 0.0, i
        run += score(x, feature)
        if run > best:
            best, best_at = run, (start, i + 1)
    blocks = [x for x in (tokens[slice(*best_at)] if best_at else tokens) if isinstance(x, Block) and feature[id(x)][-1] != "name not"]
    if best_at is None:
        blocks = [] if any(b.content for b in blocks) else [b for b in blocks if not b.linked]
    return _SPACE.sub(" ", " ".join("".join(x.parts) for x in blocks)).strip()


def _extract(batches):
    for batch in batches:
        text = [main_text(h or "") for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and empty pages, and pages without content, have empty text.  Ids and urls may be null or repeat and are
    passed on, repeated pages give equal rows.  A very long page is read and scanned once.  An empty table gives no rows; extra columns are ignored.
    """
    C.ship(pages.sparkSession)
    narrow = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return narrow.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
