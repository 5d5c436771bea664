from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from partloom.llm import collocations as op
from partloom.llm.collocations import MARK, _frequent, collocations, parse_chunks, symbols

SCHEMA = "doc_id long, text string, lang string, slice int, chunk string, n string, phrase string, pair string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _pieces(text):
    return [[w for w in re.split("[\x20\x09]+", p) if w] for p in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))]


def _brute(rows, least=10, top=2000, share=50):
    f: dict = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for ws in _pieces(text):
            for size in (1, 2, 3):
                f[lang or "und"].update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, counts in f.items():
        total = sum(c for g, c in counts.items() if len(g) == 1)
        good = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        kept = []
        for g, a in good.items():
            if any(100 * b >= share * a and g in (h[:-1], h[1:]) for h, b in good.items() if len(h) > len(g)):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def _rows(seed):
    """Copies, phrases over ends and marks, capitals beyond A-Z, odd blanks, one word repeated, null, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["Ärger", "STRASSE", "x\x00y", "日本", "a b", "\x1c"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", ";", "\x0b"]) for _ in range(n))
    base = make(300)
    rows = [(k, base if k % 3 == 0 else make(rng.randrange(0, 80)), rng.choice(["en", "de", None])) for k in range(90)]
    rows += [(500, None, "en"), (501, "", "en"), (502, " \t\n", "fr"), (503, "one", "fr"), (504, "again " * 5_000, "fr"), (505, "Great Old Ones rise. " * 12, "it"), (None, make(50), "en"), rows[1], rows[1], (506, make(40_000), "en")]
    return [(*r, 1, "x", "y", "z", "p") for r in rows]


def _got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("mean, slice_bytes", [(32, 1 << 20), (1, 500), (4, 2_000), (10**9, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, mean, slice_bytes):
    """At every size of chunks, from one word to whole texts, and with few and many slices."""
    monkeypatch.setattr(op.parse_chunks, "__defaults__", (mean, slice_bytes))
    rows = _rows(mean % 7)
    df = spark.createDataFrame(rows, SCHEMA)
    assert _got(collocations(df, mean=mean)) == _brute(rows)


def test_limits_and_empty_table(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert _got(collocations(df, least=4, top=15, share=90)) == _brute(rows, 4, 15, 90)
    assert collocations(df.limit(0)).count() == 0
    assert collocations(df.filter("text IS NULL")).count() == 0


def test_scores_need_more_than_64_bits(spark):
    a, left, right = 3_000_000_007, 3_000_000_011, 5_000_000_029
    [row] = spark.sql(f"SELECT {a}L AS a, {left}L AS l, {right}L AS r").selectExpr(f"{op.SCORE} AS score").collect()
    assert row.score == 1_000_000 * a * a // (left * right)


def test_parse_covers_each_word_once(spark):
    """Own words of all chunks, weighted, are the words of all texts, and copies add no chunks."""
    rows = _rows(6)
    chunks = parse_chunks(spark.createDataFrame(rows, SCHEMA)).collect()
    own: Counter = Counter()
    for r in chunks:
        ws = bytes(r.chunk).split(b" ")
        for w in ws[: len(ws) - r.over]:
            own[r.lang, w] += r.n
    want = Counter((lang or "und", w) for _, text, lang, *_ in rows for w in symbols((text or "").encode()))
    assert own == want and MARK in {w for _, w in own}
    assert len({(r.lang, r.over, bytes(r.chunk)) for r in chunks}) == len(chunks)


def test_pairs_over_batches():
    rows = [(1, 1, 4), (1, 2, 6), (2, 1, 9), (3, 1, 2), (3, 1, 3), (3, 4, 5), (9, 1, 10)]
    for step in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("pair", "slice", "n"), r)) for r in rows[i : i + step]]) for i in range(0, len(rows), step)]
        got = [(r["slice"], r["pair"]) for b in _frequent(batches, 10) for r in b.to_pylist()]
        assert got == [(1, 1), (2, 1), (1, 3), (1, 3), (4, 3), (1, 9)]


def test_pairs_and_chunks_travel_small():
    """A pair costs a slice under four bytes on its way (12 as a row of its own), and what arrives is what was sent; chunks go as one compressed block."""
    rng = random.Random(8)
    chunks = [" ".join(f"w{min(int(rng.paretovariate(0.5)), 50_000)}" for _ in range(40)).encode() for _ in range(6_000)]
    schema = pa.schema([("slice", pa.int64()), ("lang", pa.string()), ("over", pa.int32()), ("chunk", pa.binary()), ("n", pa.int64())])
    rows = pa.RecordBatch.from_arrays([pa.array([7] * 3_000 + [9] * 3_000), pa.array(["en"] * 6_000), pa.array([2] * 6_000, pa.int32()), pa.array(chunks, pa.binary()), pa.array([1] * 6_000)], schema=schema)
    sent = pa.Table.from_batches(op._slice_pairs([rows.slice(i, 500) for i in range(0, 6_000, 500)], 5, 10))
    total = sum(sent.column("m").to_pylist())
    assert set(zip(sent.column("part").to_pylist(), sent.column("slice").to_pylist())) == {(p, s) for p in range(5) for s in (7, 9)}
    assert sum(len(x) for c in ("pairs", "ns") for row in sent.column(c).to_pylist() for x in row) < 4 * total
    counts: Counter = Counter()
    for key, part in op._runs([rows], 1 << 30):
        pair, there = op.Slice(part).pairs()
        for h, n in zip(pair[there].tolist(), op.Slice(part).own[there].tolist()):
            counts[key, h] += n
    assert total == len(counts)
    both: Counter = Counter()
    for (_, h), n in counts.items():
        both[h] += min(n, 10)
    got = set()
    for part in range(5):
        kept = op._part_frequent(sent.filter(pc.equal(sent.column("part"), part)), 10)
        got |= {(r["slice"], h) for r in kept.to_pylist() for h in op._numbers(r["pairs"], r["m"]).cumsum().tolist()}
    assert got == {(s, h) for s, h in counts if both[h] >= 10} and got
    blocks = [b for batch in op._blocks([rows]) for b in batch.to_pylist()]
    assert [b["slice"] for b in blocks] == [7, 9] and sum(len(b["block"]) for b in blocks) < 0.6 * sum(map(len, chunks))
    assert pa.concat_tables([pa.ipc.open_stream(b["block"]).read_all() for b in blocks]).column("chunk").to_pylist() == chunks
