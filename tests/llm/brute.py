"""Plain Python versions that the operators are compared with."""

import hashlib
import re
from itertools import combinations

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = {i: i + 32 for i in range(65, 91)}


def shingles(text, n):
    w = SPACE_WORD.findall((text or "").translate(AZ))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, percent=80):
    """rows: (doc_id, text); per row (doc_id, set size, smallest id reachable)."""
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
            up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), d if not sets[i] else low.get(find(i))) for i, (d, _) in enumerate(rows)]


def hits(text, items, window=8):
    """(words, words hit, items found) of a text against (item, text) pairs."""
    w = ALNUM_WORD.findall((text or "").translate(AZ))
    cover, found = set(), set()
    for item, t in items:
        v = ALNUM_WORD.findall((t or "").translate(AZ))
        n = min(window, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in wins:
                cover |= set(range(k, k + n))
                found.add(str(item))
    return len(w), len(cover), found


def digest(items):
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), luhn),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 8 <= sum(c.isdigit() for c in s) <= 15),
]


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, r, ok in BASE for m in r.finditer(text or "") if ok(m[0])]
