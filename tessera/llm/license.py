"""Licence scan by canonical digests of entire texts.

A text is brought to a canonical form (lower case, equivalent spellings, no copyright lines, no punctuation of any kind,
single spaces).  Digests of forms are joined with those of known licences and notices: the digest of the whole document,
of each of its lines, and of each run of words as long as a known full text that begins with the same words, so that a
licence inside a longer document is found.  What can't be known by its length is not looked up.  The known texts are the
notices of ``KNOWN`` and the full licences of the folder ``licences``, unless a table of others is given.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: (licence id, kind, text): short public licences and the notices that refer to longer ones.
KNOWN: list[tuple[str, str, str]] = [
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "This project is licensed under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "notice", "SPDX-License-Identifier: CC0-1.0"),
    ("ISC", "license", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "license", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "license", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]

#: Full texts without title and copyright lines where these differ; ``<licence id>[~variant].txt``.
TEXTS = Path(__file__).parent / "licences"
#: What may stand above a short text.
TITLES: dict[str, list[str]] = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "The 2-Clause BSD License", "FreeBSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "Revised BSD License", "The 3-Clause BSD License", "BSD License", "The BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
}
#: Wordings in use of one text: a phrase and its alternatives.
WORDINGS: dict[str, list[tuple[str, list[str]]]] = {
    "ISC": [("and/or distribute", ["and distribute"])],
    "BSD-2-Clause": [("COPYRIGHT HOLDER OR", ["COPYRIGHT OWNER OR", "COPYRIGHT HOLDERS OR"])],
    "BSD-3-Clause": [
        ("COPYRIGHT HOLDER OR", ["COPYRIGHT OWNER OR", "COPYRIGHT HOLDERS OR"]),
        ("name of the copyright holder nor", ["name of the copyright owner nor", "name of the copyright holders nor", "name of the author nor", "name of the organization nor", "name of the owner nor"]),
    ],
}

#: Equivalent spellings: words of the canonical form and what they become.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("merchantibility", "merchantability"),
    ("noncommercial", "nc"), ("whilst", "while"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"), ("non infringement", "noninfringement"), ("and or", "or"),
]


_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_COPYRIGHT = re.compile(r"[ \t]*(?:copyright|\(c\)|©)")
_OTHER = re.compile(r"[^\w]+")
#: Known texts of so many words or more are looked for inside documents too, by their first ``ANCHOR`` words.
FULL_WORDS, ANCHOR = 30, 8
#: Known texts whose beginnings are sent to executors at once; a table of more goes in blocks, a pass over the documents each.
BLOCK = 1_000_000


def _spelled(form: str) -> str:
    form = f" {form} "
    for a, b in SPELLINGS:
        form = form.replace(f" {a} ", f" {b} ")
    return form.strip()


def canonical_lines(text: str) -> list[str]:
    """The lines' words before spellings are changed; lines with a copyright notice are empty."""
    low = text.encode("utf-8", "surrogatepass").translate(_AZ).decode("utf-8", "surrogatepass")
    return ["" if _COPYRIGHT.match(x) else _OTHER.sub(" ", x.replace("_", " ")).strip() for x in low.split("\n")]


def canonical(text: str) -> str:
    """The canonical form: what is neither letter nor number parts words."""
    return _spelled(" ".join(x for x in canonical_lines(text) if x))


def digest(form: str) -> str:
    return hashlib.sha256(form.encode("utf-8", "surrogatepass")).hexdigest()


def _grams(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ANCHOR words."""
    m = len(words) - ANCHOR + 1
    out = words[: max(m, 0)].copy()
    for j in range(1, ANCHOR):
        out = C.mix64(out) + words[j : j + max(m, 0)]
    return C.mix64(out)


def describe(text: str) -> tuple[str, int, int | None, int]:
    """Digest, length of the form, hash of its first words (none for short texts), number of words."""
    form = canonical(text)
    words, upto = C.word_hashes(*C.block_of([form.encode("utf-8", "surrogatepass")]), C.SPACE_BYTES)
    n = int(upto[0])
    return digest(form), len(form), int(_grams(words)[0].view(np.int64)) if n >= FULL_WORDS else None, n


def _forms(license_id: str, text: str) -> set[str]:
    """A full text with its wordings, titles and layouts (as wrapped, a line per paragraph, one line)."""
    texts = [text]
    for phrase, others in WORDINGS.get(license_id, []):
        texts += [t.replace(phrase, o) for t in texts for o in others if phrase in t]
    if license_id.startswith("BSD-"):
        texts += [re.sub(r"(?m)^\s*[0-9]\. ", "", t) for t in texts]
    end = "END OF TERMS AND CONDITIONS"  # what follows, how to apply the licence, is often left out
    texts += [t[: t.index(end) + k] for t in texts if end in t for k in (0, len(end))]
    out = set()
    for t, title, reserved in itertools.product(texts, ["", *TITLES.get(license_id, [])], ["", "All rights reserved."] if license_id in TITLES else [""]):
        paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", t)]
        out |= {"\n".join([title, reserved, x]) for x in (t, "\n".join(paragraphs), " ".join(paragraphs))} | {" ".join([title, reserved, *paragraphs])}
    return out


def known_texts() -> list[tuple[str, str, str]]:
    """(licence id, kind, text): the notices and full texts that ``scan`` knows by itself."""
    full = [(f.stem.split("~")[0], f.read_text("utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    return [*KNOWN, *[(i, "license", form) for i, t in full for form in sorted(_forms(i, t))]]


KNOWN_TEXT = "license_id string, digest string, length long, anchor long, words long"


@functools.cache
def _built_in() -> list[tuple]:
    rows = {}
    for i, _, t in known_texts():
        d = describe(t)
        rows[d[0]] = min(rows.get(d[0], (i, *d)), (i, *d))
    return sorted(rows.values())


def _describe(batches):
    for batch in batches:
        rows = [(i, *describe(t or "")) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["license_id", "digest", "length", "anchor", "words"])


def digests(known: DataFrame) -> DataFrame:
    """``KNOWN_TEXT`` of a table (license_id, text), a row per digest; no empty forms, no null names."""
    C.ship(known.sparkSession)
    d = known.select(F.col("license_id").cast("string"), F.col("text").cast("string")).where("license_id IS NOT NULL").mapInArrow(_describe, KNOWN_TEXT).where("length > 0")
    return d.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.first("length").alias("length"), F.first("anchor").alias("anchor"), F.first("words").alias("words"))


def _candidates(shared, first: bool):
    """mapInArrow over (rid, doc_id, text, digest, found): digest and found filled in.

    ``found`` gets (kind, digest) of what could be a known text by its length: *whole*, *line* (both only if ``first``),
    and *inside*, runs of words that begin like a full text and have its number of words.
    """

    def run(batches):
        lengths, anchors, counts = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            had = batch.column(4).to_pylist()
            digests, found = batch.column(3).to_pylist(), []
            for a, b in C.text_blocks(texts, 1 << 20):
                forms = []
                for i in range(a, b):
                    lines, got = canonical_lines(texts[i]), set()
                    form = _spelled(" ".join(x for x in lines if x))
                    forms.append(form.encode("utf-8", "surrogatepass"))
                    if first:
                        digests[i] = hashlib.sha256(forms[-1]).hexdigest()
                        if len(form) in lengths:
                            got.add(("whole", digests[i]))
                        for x in dict.fromkeys(lines):
                            if x and len(x := _spelled(x)) in lengths:
                                got.add(("line", digest(x)))
                    found.append(got)
                data, ends = C.block_of(forms)
                words, upto = C.word_hashes(data, ends, C.SPACE_BYTES)
                g = _grams(words).view(np.int64)
                if not len(g) or not len(anchors):
                    continue
                at = np.minimum(np.searchsorted(anchors, g), len(anchors) - 1)
                place, own = -1, []
                for q in np.flatnonzero(anchors[at] == g).tolist():
                    d = int(np.searchsorted(upto, q, "right"))
                    if d != place:
                        place, own = d, forms[d].split(b" ")
                    p = q - (int(upto[d - 1]) if d else 0)
                    some = slice(np.searchsorted(anchors, g[q], "left"), np.searchsorted(anchors, g[q], "right"))
                    for n in counts[some].tolist():
                        if p + n <= len(own):
                            found[a + d].add(("inside", hashlib.sha256(b" ".join(own[p : p + n])).hexdigest()))
            found = [[*(h or ()), *({"kind": k, "digest": x} for k, x in sorted(f))] for h, f in zip(had, found, strict=True)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("digest", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(digests, pa.string()), pa.array(found, kind)], names=["rid", "doc_id", "t", "digest", "found"])

    return run


def scan(docs: DataFrame, known: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id (of the entire text, null if unknown), line_licenses and inside_licenses (sorted names of
    known texts that are one of its lines; of known full texts that stand in it, itself included).

    Null and empty texts, and those with only copyright lines, have the digest of the empty form and no licence.  Ids
    may be null or repeat; repeated rows give equal rows; an empty table gives no rows; extra columns are ignored; whole
    texts are digested.  ``known`` (license_id, text), of any size, takes the place of ``known_texts``.
    """
    spark = docs.sparkSession
    C.ship(spark)
    table = spark.createDataFrame(_built_in(), KNOWN_TEXT) if known is None else C.settle(digests(known), "licences")
    size = table.count()
    blocks = max(1, -(-size // BLOCK))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"), F.lit("").alias("digest"), F.expr("CAST(NULL AS ARRAY<STRUCT<kind: STRING, digest: STRING>>)").alias("found"))
    schema = base.schema
    # a length is a number of characters, so there are far fewer than texts
    lengths = {r["length"] for r in table.select("length").distinct().collect()}
    for k in range(blocks):
        some = table.where("anchor IS NOT NULL").where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == k).select("anchor", "words").distinct()
        rows = sorted((r["anchor"], r["words"]) for r in some.collect())
        shared = spark.sparkContext.broadcast((lengths, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)))
        base = base.mapInArrow(_candidates(shared, k == 0), schema)
    base = C.settle(base.drop("t"), "licence-candidates")
    wanted = C.settle(base.select("rid", F.explode("found").alias("c")).select("rid", "c.kind", "c.digest"), "licence-digests")
    hot = C.heavy(wanted.groupBy("digest").agg(F.count("*").alias("k")), wanted.count())
    hits = C.salted_join(wanted, table.select("digest", "license_id"), ["digest"], hot, by="rid")
    names = lambda kind: F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("license_id")))))
    hits = hits.groupBy("rid").agg(F.max(F.when(F.col("kind") == "whole", F.col("license_id"))).alias("license_id"), names("line").alias("line_licenses"), names("inside").alias("inside_licenses"))
    return base.select("rid", "doc_id", "digest").join(hits, "rid", "left").select("doc_id", "digest", "license_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("line_licenses", "inside_licenses")])
