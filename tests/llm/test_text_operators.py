from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import DOCS, corpus, frame, near, repeats, shingles, words

from partloom.llm import ngram_join, token_files
from partloom.llm.near_copies import keep_one
from partloom.llm.ngram_join import Rule, jaccard_components
from partloom.llm.repetition import MIN_WORDS, longest_repeats, measure, repetition_rules
from partloom.llm.sentencepieces import Pieces, decode_ids, piece_digests, piece_ids, words_of
from partloom.llm.substrings import remove_repeats
from partloom.llm.token_counts import token_counts
from partloom.llm.tokens import load_tokenizer, tokenizer_path

ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# op5


def test_pieces_equal_the_library(docs, empty):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = piece_digests(docs, path).collect()
    assert len(got) == len(ROWS)
    texts = dict(ROWS)
    for row in got:
        ids = library.encode(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids) and row.ids_sha256 == sha(",".join(map(str, ids)).encode())
        assert row.decoded_sha256 == sha(library.decode(ids).encode())
    back = {r.doc_id: r.text for r in decode_ids(piece_ids(docs, path), path).collect()}
    assert back[15] == library.decode(library.encode(texts[15])) and back[5] == ""
    assert piece_digests(empty, path).count() == 0


def test_merge_rounds_equal_the_queue():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=path), Pieces(path)
    rng = random.Random(1)
    cases = ["a" * 400, "ab" * 200, "aab" * 99, " " * 70, "=" * 120 + "x", "-----+++++" * 20, "x" + " " * 40 + "y", "é́日�\x00"]
    cases += ["".join(rng.choice("aab e=-*_é日\n") for _ in range(rng.randrange(1, 90))) for _ in range(400)]
    for text in cases:
        ids = pieces.encode(words_of(text))[0].tolist()
        assert ids == library.encode(text)
        assert pieces.decode(ids) == library.decode(ids)


# op6


def test_token_counts_equal_the_library(docs, empty, spark):
    path = tokenizer_path("byte_bpe_50k.json")
    library = load_tokenizer(path)
    texts = dict(ROWS)
    got = token_counts(docs, path, batch_bytes=500).collect()
    assert len(got) == len(ROWS)
    for row in got:
        n = len(library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len((texts[row.doc_id] or "").encode()), n > 1024)
    rng = random.Random(2)
    odd = [(i, "".join(rng.choice("abcde's  tll\n\t,.é日=01 \xa0\x1c|<>") for _ in range(rng.randrange(0, 80)))) for i in range(1000)]
    odd += [(1001, "a <|endoftext|> b"), (1002, "<|endoftext|>"), (1003, "Ab, ÀB. Ǆ! don't İx, ß"), (1004, "x <|endoftext|>  y")]
    for row in token_counts(frame(spark, odd), path).collect():
        assert row.n_tokens == len(library.encode(dict(odd)[row.doc_id], add_special_tokens=False).ids), dict(odd)[row.doc_id]
    assert token_counts(empty, path).count() == 0


# op10


@pytest.mark.parametrize("bits", [False, True])
def test_planes_come_back(bits):
    for n in (0, 1, 7, token_files.BLOCK, token_files.BLOCK + 3):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (token_files.unpack(token_files.pack(ids, bits), n) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_hold_the_ids_in_order(docs, spark, tmp_path, bits, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK", 300)
    path = tokenizer_path("word_bpe_49k.json")
    library = load_tokenizer(path)
    token_files.write_token_files(docs, path, str(tmp_path / "t"), bits=bits)
    rows = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert len(rows) == len(ROWS)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d or 0))
    texts, at = dict(ROWS), 0
    for row in rows:
        ids = [*library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (row.start, row.n_tokens) == (at, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert {r.doc_id: r.ids for r in token_files.read_ids(spark, str(tmp_path / "t")).collect()}[5] == [2]


def test_one_document_is_read_by_the_index(docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK", 300)
    path = str(tmp_path / "t")
    token_files.write_token_files(docs, tokenizer_path("word_bpe_49k.json"), path)
    whole = {r.doc_id: r.ids for r in token_files.read_ids(spark, path).collect()}
    assert [r.ids for r in token_files.read_ids(spark, path, 900).collect()] == [whole[900]]
    assert token_files.read_ids(spark, path, 3).count() == 0
    # Plans are printed with their filters cut short.
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = token_files.read_ids(spark, path, 900)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(first_doc,900)" in plan and "GreaterThanOrEqual(last_doc,900)" in plan


def test_rows_without_id_go_to_many_files(spark, tmp_path):
    rows = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('text ', id) AS text")
    token_files.write_token_files(rows, tokenizer_path("word_bpe_49k.json"), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).select("file").distinct().count() > 1
    got = sorted((r.start, r.n_tokens) for r in token_files.read_token_files(spark, str(tmp_path / "n")).collect())
    assert len(got) == 3000 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))


def test_files_that_describe_themselves_otherwise(docs, spark, tmp_path):
    """A tokenizer with other rules is given whole texts, by both operators."""
    import json

    for name, change in (("byte_bpe_50k.json", ("pre_tokenizer", "add_prefix_space", True)), ("word_bpe_49k.json", ("normalizer", "normalizers", [{"type": "NFC"}]))):
        with open(tokenizer_path(name), encoding="utf-8") as file:
            told = json.load(file)
        told[change[0]][change[1]] = change[2]
        path = str(tmp_path / name)
        with open(path, "w", encoding="utf-8") as file:
            json.dump(told, file)
        library = load_tokenizer(path)
        texts = dict(ROWS)
        want = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}
        assert {r.doc_id: r.n_tokens for r in token_counts(docs, path).collect()} == {d: len(x) for d, x in want.items()}
        token_files.write_token_files(docs, path, str(tmp_path / f"{name}.files"))
        assert {r.doc_id: list(r.ids) for r in token_files.read_ids(spark, str(tmp_path / f"{name}.files")).collect()} == {d: [*x, 2] for d, x in want.items()}


def test_token_files_of_an_empty_table(empty, spark, tmp_path):
    token_files.write_token_files(empty, tokenizer_path("word_bpe_49k.json"), str(tmp_path / "e"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


# op2


def _measures(text):
    ws = words(text)
    n = len(ws)

    def covered(k):
        at = defaultdict(list)
        for i in range(n - k + 1):
            at[tuple(ws[i : i + k])].append(i)
        return {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + k)}

    runs = [0]
    at = defaultdict(list)
    for i in range(n - MIN_WORDS + 1):
        at[tuple(ws[i : i + MIN_WORDS])].append(i)
    for places in at.values():
        for x, i in enumerate(places):
            for j in places[x + 1 :]:
                k = 0
                while j + k < n and ws[i + k] == ws[j + k]:
                    k += 1
                runs.append(k)
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return {
        "n_words": n, "word_chars": sum(len(w.decode()) for w in ws), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered(3)), "covered_words": len(covered(MIN_WORDS)), "longest_repeat": max(runs),
    }


def test_repetition_measures():
    rng = random.Random(3)
    texts = [t for _, t in ROWS if t and len(t) < 3000] + ["", " ", "a " * 60, "x\ny\nx\n\n \nx"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(80))) for _ in range(60)]
    got = measure([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items()} == _measures(text), text


def test_longest_repeats_of_one_word():
    assert longest_repeats(np.zeros(20, np.int64)).tolist() == [19, *range(19, 7, -1), *[0] * 7]


def test_repetition_rules(docs, empty, spark):
    got = by_id(repetition_rules(docs, keep_columns=True))
    assert not got[5].kept and got[5].base_failed and got[5].n_words == 0 and got[5].marks == "z"
    assert repetition_rules(docs).count() == len(ROWS) and repetition_rules(empty).count() == 0
    clean = " ".join(f"u{i}" for i in range(300))
    block = " ".join(f"b{i}" for i in range(120))
    rows = by_id(repetition_rules(frame(spark, [(1, clean), (2, f"{block} {clean} {block}"), (3, "a b " * 100)])))
    assert rows[1].kept and not rows[2].kept and not rows[2].base_failed and rows[3].base_failed


def test_each_repetition_limit_decides(spark):
    own = iter(range(100_000))
    make = lambda n: " ".join(f"u{next(own)}" for _ in range(n))
    passage, long = make(80), make(101)
    often = " ".join(f"{passage} {make(84)}" for _ in range(4))
    quoted = f"{make(10_000)} {long} {make(9_697)} {long}"
    once = f"{make(900)} {long} {make(900)} {long}"
    rows = by_id(repetition_rules(frame(spark, [(1, often), (2, quoted), (3, once)])))
    assert (rows[1].n_words, rows[1].covered_words, rows[1].longest_repeat) == (656, 320, 80) and not rows[1].base_failed and not rows[1].kept
    assert (rows[2].longest_repeat, rows[2].covered_words) == (101, 202) and rows[2].kept
    assert rows[3].covered_words <= 0.12 * rows[3].n_words and not rows[3].kept


# op3


@pytest.mark.parametrize("group_rows", [20_000, 1])
def test_repeats_go(docs, empty, group_rows):
    left = repeats(ROWS)
    got = remove_repeats(docs, group_rows=group_rows).collect()
    assert len(got) == len(ROWS)
    texts = dict(ROWS)
    for row in got:
        n = len(words(texts[row.doc_id]))
        assert (row.n_words, row.n_removed) == (n, n - len(left[row.doc_id])), row.doc_id
        assert row.kept_sha256 == sha(b" ".join(left[row.doc_id]))
    assert sum(r.n_removed for r in got) > 1000
    assert remove_repeats(empty, group_rows=group_rows).count() == 0


@pytest.mark.parametrize("group_rows", [20_000, 1])
def test_repeats_of_texts_that_share_an_id_or_have_none(spark, group_rows):
    rng = random.Random(8)
    make = lambda n: [f"v{rng.randrange(5_000)}" for _ in range(n)]
    passage = make(40)
    pieces = [(None, make(70) + passage + make(9)), (None, make(30)), (None, passage + make(200)), (4, make(25) + passage), (4, make(90)), (4, make(3) + passage + passage), (2, make(60)), (7, passage)]
    rows = [(i, " ".join(ws)) for i, ws in pieces]
    rows += [rows[0], rows[5], rows[5], (None, None), (None, ""), (4, None)]
    df = frame(spark, rows).repartition(4)
    key = {t: h for t, h in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    # The plain reading takes one text per id: number the documents in their order.
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, key[r[1]]))
    left = repeats(list(enumerate(text for _, text in order)))
    wanted = {row: b" ".join(left[n]).decode() for n, row in enumerate(order)}
    got = remove_repeats(df, keep_columns=True, group_rows=group_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.kept_text == wanted[(r.doc_id, r.text)], (r.doc_id, r.text)
    assert sum(r.n_removed > 0 for r in got) == 6


def test_repeats_keep_other_columns(docs):
    row = by_id(remove_repeats(docs, keep_columns=True))[1]
    assert row.source == "s1" and row.label == "l" and row.kept_text == dict(ROWS)[1]


# op7


def _checked(docs, rule, rows):
    got = jaccard_components(docs, rule).collect()
    assert len(got) == len(rows)
    want = near(rows, rule.words, rule.num, rule.den)
    for row in got:
        if row.doc_id is not None:
            assert row.component_id == want[row.doc_id]
            assert row.n_shingles == len(shingles(dict(rows)[row.doc_id], rule.words))
    return want


@pytest.mark.parametrize("rule", [Rule(3, 90, 100), Rule(5, 80, 100, 0.1)])
def test_components_equal_brute_force(docs, empty, rule):
    want = _checked(docs, rule, ROWS)
    assert max(Counter(want.values()).values()) > 10
    assert jaccard_components(empty, rule).count() == 0


def test_frequent_tokens_and_small_blocks(spark, monkeypatch):
    """Combinations of tokens, and lots that are cut into many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        body = list(base[: rng.randrange(120, 151)])
        for _ in range(rng.randrange(0, 9)):
            body[rng.randrange(len(body))] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(body)))
    want = _checked(frame(spark, rows).repartition(4), Rule(3, 90, 100), rows)
    assert 2 < len(set(want.values())) < 60


def test_lots_hold_sets_of_like_size(spark, monkeypatch):
    """A passage that texts of all lengths share does not bring them to one lot."""
    lots, blocks = [], ngram_join._blocks
    monkeypatch.setattr(ngram_join, "_blocks", lambda found, rule: lots.append(found) or blocks(found, rule))
    rng = random.Random(10)
    shared = [f"s{i}" for i in range(60)]
    make = lambda n: " ".join(shared + [f"o{rng.randrange(10**6)}" for _ in range(n)])
    rows = [(i, make(n)) for i, n in enumerate(range(10, 330, 4))]
    rows += [(100 + i, text + " tail") for i, text in rows[::8]]
    want = _checked(frame(spark, rows).repartition(4), Rule(3, 90, 100), rows)
    assert len(set(want.values())) == 80
    spans = lots[0].groupBy("lot").agg({"size": "min", "set_id": "count"}).join(lots[0].groupBy("lot").agg({"size": "max"}), "lot").collect()
    assert max(r["count(set_id)"] for r in spans) > 2
    assert all(90 * 90 * r["max(size)"] <= 100 * 100 * (r["min(size)"] + 1) for r in spans)


def test_a_set_in_many_blocks_is_sent_in_small_batches():
    text = " ".join(f"w{i}" for i in range(20_000))
    tasks = [[{"task": k, "side": k % 3} for k in range(200)], [], [{"task": -1, "side": 2}]]
    batch = pa.RecordBatch.from_pydict(
        {"text": [text, "a b c", "a b c d"], "set_id": pa.array([5, 6, 7], pa.int64()), "tasks": pa.array(tasks, pa.list_(pa.struct([("task", pa.int64()), ("side", pa.int32())])))}
    )
    sent = list(ngram_join._block_sets([batch], Rule()))
    assert max(b.nbytes for b in sent) < 4 << 20
    got = [(r["task"], r["side"], r["set_id"], len(r["tokens"])) for b in sent for r in b.to_pylist()]
    assert got == [(k, k % 3, 5, 19_998 * 8) for k in range(200)] + [(-1, 2, 7, 16)]


def test_full_blocks_are_compared_in_little_memory():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(1_000, 300, replace=False)).astype(np.uint64) for _ in range(1_500)]
    sets[7] = np.unique(np.r_[sets[3][:-2], np.uint64(5_000)])
    tracemalloc.start()
    out = ngram_join.linked(sets, Rule())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(*np.nonzero(out))) == [(3, 7), (7, 3)]
    assert peak < 70 << 20


def test_one_of_each_group_stays(docs, empty):
    rule = Rule(5, 80, 100, 0.1)
    want = near(ROWS, 5, 80, 100)
    kept = [r.doc_id for r in keep_one(docs, rule).collect()]
    assert sorted(d for d in kept if d is not None) == sorted(d for d in want if want[d] == d)
    assert kept.count(None) == 1 and keep_one(empty, rule).count() == 0


def test_hashes_of_slices_agree():
    """A window's hash does not depend on what else is in the batch."""
    a, _ = ngram_join.shingle_sets([b"q r s t", b"a b c d e"], 3)
    b, _ = ngram_join.shingle_sets([b"a b c d e"], 3)
    assert set(b.tolist()) <= set(a.tolist()) and pa.array(b).null_count == 0
