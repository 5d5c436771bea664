"""Small tables with the awkward rows, and plain readings of the contracts."""

from __future__ import annotations

import random
from collections import defaultdict

DOCS = "doc_id long, text string, source string, kept string, n_words string, marks string, size int, vector string, key string, label string"


def frame(spark, rows):
    """(doc_id, text) as documents with further columns, some named like columns of the operators."""
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}" if i != 5 else None, "x", "y", "z", 1, "v", "k", "l") for i, t in rows], DOCS)


def words(text):
    return (text or "").encode().split()


def corpus(seed: int = 5) -> list[tuple[int | None, str | None]]:
    """Texts over a small vocabulary with copies, near copies, shared passages, repeats, odd spacing, empty, null and long ones."""
    rng = random.Random(seed)
    make = lambda n, v=40: [f"w{rng.randrange(v)}" for _ in range(n)]
    passage, base = make(45), make(120, 400)
    rows: list[tuple[int | None, str | None]] = []
    for k in range(70):
        kind = k % 7
        body = make(rng.randrange(1, 90), 300)
        if kind == 1:
            body = body + passage + make(10)
        elif kind == 2:
            body = list(base)
            for _ in range(rng.randrange(0, 4)):
                body[rng.randrange(len(body))] = f"Edit{rng.randrange(999)}"
        elif kind == 3:
            body = body + body
        elif kind == 4:
            body = list(base)
        rows.append((k * 3 + 1, rng.choice([" ", "\n", "  ", "\t "]).join(body)))
    rows += [(5, None), (6, ""), (8, " \n\t"), (9, "one"), (11, "one"), (12, "two words"), (14, "Two Words"), (15, "é́ <|endoftext|> ﬁ ▁x\x00y 日本 " * 4), (None, "null id " + " ".join(passage))]
    rows += [rows[1], rows[1], (900, " ".join(make(20_000, 5_000)))]
    return rows


def components(links: dict) -> dict:
    """Smallest reachable node of each node."""
    parent = {n: n for n in links}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, others in links.items():
        for b in others:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in links}


def repeats(docs: list[tuple[int | None, str | None]], window: int = 20) -> dict[int, list[bytes]]:
    """Words that are left of each document, read straight from the rule; null ids come first."""
    seen, left = set(), {}
    for doc, text in sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        ws = words(text)
        gone = set()
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            if k in seen:
                gone.update(range(i, i + window))
            seen.add(k)
        left[doc] = [w for i, w in enumerate(ws) if i not in gone]
    return left


def shingles(text, size: int):
    ws = [bytes(w) for w in (text or "").encode().lower().split()]
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)) if len(ws) >= size else frozenset([tuple(ws)] if ws else [])


def near(docs, size: int, num: int, den: int) -> dict:
    sets = {d: shingles(t, size) for d, t in docs if d is not None}
    links = defaultdict(list, {d: [] for d in sets})
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and den * len(x & y) >= num * len(x | y):
                links[a].append(b)
    return components(dict(links))
