from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from partloom.llm import prefix_trie
from partloom.llm.prefix_trie import conversation_trie, rank_list, suffix_sums

SCHEMA = "conv_id long, turn long, role string, text string, depth string, part int, p1 string, n_convs int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _brute(rows, family=5, most=9):
    turns: dict = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    turns = {c: [t[1:] for t in sorted(x)] for c, x in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(np.fmod(c, family))
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    members: dict = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children: dict = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, cs in members.items():
        own = (len(cs) - 1) * (len(p[-1][1]) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += own
    out = []
    for p, cs in members.items():
        ends = sorted(c for c in cs if len(rebuilt[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def _rows(seed):
    """Families with shared turns, a deep conversation, many copies of one conversation, ties, nulls, empty and long texts, repeated rows, ids below zero."""
    rng = random.Random(seed)
    text = lambda: rng.choice(["", None, "a", "b", "ä", "c" * rng.randrange(3)])
    rows = [(rng.randrange(-40, 60), rng.choice([None, *range(7)]), rng.choice(["user", "assistant", None]), text()) for _ in range(260)]
    rows += [(200, k, "user", f"t{k % 3}") for k in range(45)] + [(c, k, "user", f"t{k % 3}") for c in (1000, 1003, 1011) for k in range(40 + c % 7)]
    rows += [(c, k, "user", "same") for c in range(2000, 2060) for k in range(6)]
    rows += [(None, 0, "user", "no id"), (77_777, 0, "user", "long " * 300_000), (5, 0, None, None), *rows[:6]]
    return [(*r, "x", 1, "y", 2) for r in rows]


def _got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_equals_brute_force(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, SCHEMA)
    found = conversation_trie(df)
    want = _brute(rows)
    assert _got(found) == want
    # The tour visits each arc once, and a subtree's arcs lie between those of its top.
    places = {(r.conv_id, r.depth): (r.tour_start, r.tour_end, r.parent_conv_id) for r in found.collect()}
    assert sorted(x for a, b, _ in places.values() for x in (a, b)) == list(range(2 * len(want)))
    for (_, depth), (a, b, parent) in places.items():
        if depth:
            above = places[parent, depth - 1]
            assert above[0] < a < b < above[1]


def test_small_blocks_chunks_and_rounds(spark, monkeypatch):
    """Everything that only large inputs reach: several blocks of a prefix, several chunks of a digest, rounds of coin tosses."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    rows = _rows(2)
    df = spark.createDataFrame(rows, SCHEMA)
    assert _got(conversation_trie(df, one_task=8)) == _brute(rows)


def test_digests_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 5)
    schema, (_, *fields) = prefix_trie._CHUNKS, prefix_trie._CHUNKS.split(", ")
    assert schema and fields
    import pyarrow as pa

    nodes = [(0, 0, 0)] * 23 + [(0, 0, 1)] * 4 + [(0, 1, 1)] * 17 + [(2, 0, 0)] * 1
    ids = [*range(23), *range(4), *range(17), 5]
    batch = pa.RecordBatch.from_pydict({"p1": [n[0] for n in nodes], "p2": [n[1] for n in nodes], "depth": [n[2] for n in nodes], "conv_id": ids})
    parts = [r for b in prefix_trie._chunked([batch.slice(0, 11), batch.slice(11, 20), batch.slice(31)]) for r in b.to_pylist()]
    done = {(r["p1"], r["p2"], r["depth"]): r["digest"] for r in parts if r["digest"]}
    assert set(done) == {(0, 0, 1), (0, 1, 1)}
    rest = [{k: r[k] for k in ("p1", "p2", "depth", "ids")} for r in sorted((r for r in parts if r["ids"]), key=lambda r: (r["p1"], r["p2"], r["depth"], r["first"]))]
    assert len(rest) == 6
    for b in prefix_trie._joined([pa.RecordBatch.from_pylist(rest)]):
        done |= {(r["p1"], r["p2"], r["depth"]): r["digest"] for r in b.to_pylist()}
    for node in set(nodes):
        told = ",".join(str(i) for n, i in zip(nodes, ids) if n == node)
        assert done[node] == hashlib.sha256(told.encode()).hexdigest()


def test_list_ranking(spark):
    rng = random.Random(4)
    order = list(range(500))
    rng.shuffle(order)
    rows = [(c, 0, nxt, None if nxt is None else 0, 1, rng.randrange(3), rng.randrange(9)) for c, nxt in zip(order, [*order[1:], None])]
    df = spark.createDataFrame(rows, "conv long, code long, to_conv long, to_code long, arcs long, leaves long, saving long")
    want, left = {}, [0, 0, 0]
    for r in reversed(rows):
        left = [a + b for a, b in zip(left, r[4:])]
        want[r[0]] = tuple(left)
    for limit in (1000, 120):
        assert {r.conv: (r.arcs, r.leaves, r.saving) for r in rank_list(df, limit).collect()} == want


def test_suffix_sums():
    total, end = suffix_sums(np.array([2, -1, 1, -1]), np.array([[1], [10], [100], [7]]))
    assert total.ravel().tolist() == [111, 10, 110, 7] and end.tolist() == [1, 1, 1, 3]


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x", "x", 1, "y", 2)], [(4, 0, "user", "x", "x", 1, "y", 2)]])
def test_tiny_tables(spark, rows):
    assert _got(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == _brute(rows)
