from __future__ import annotations

import random

import numpy as np
import pytest
from cases import DOCS, corpus, frame

import __spark_entry__ as entry
from partloom.llm import neighbours, urls, weak_labels
from partloom.llm.packing import Bins, pack_documents, pack_texts
from pyspark.sql import functions as F

ROWS = corpus()

# op1


def _exact(points, queries, k):
    out = {}
    for q in queries:
        scores = sorted((float(np.sqrt(((np.array(v) - np.array(points[q])) ** 2).sum())), i) for i, v in points.items() if i != q and len(v) == len(points[q]))
        out[q] = scores[:k]
    return out


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 3
    points = {i: (centres[i % 12] + rng.normal(size=16)).astype(np.float32).tolist() for i in range(1500)}
    for i in range(0, 600, 2):
        points[i] = points[0]  # a vector with a fifth of all rows
    rows = [(i, v) for i, v in points.items()] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [float("inf")] * 16), (9005, []), (None, points[1]), (9006, [1.0, 2.0]), (9007, [1.0, 2.5])]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = [i for i in points if i % 50 == 0] + [9006]
    got: dict = {}
    for r in neighbours.nearest(df, df.filter(F.col("vec_id").isin([*queries, 9001, 9002])), k=10, shard_rows=400).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = _exact(points | {9006: [1.0, 2.0], 9007: [1.0, 2.5]}, queries, 10)
    assert set(got) == set(queries)
    found = total = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [(m[1], m[2]) for m in mine] == sorted((m[1], m[2]) for m in mine)
        found += len({i for _, i in best} & {m[2] for m in mine})
        total += len(best)
    assert found / total >= 0.97
    assert [(m[1], m[2]) for m in sorted(got[0])] == [(0.0, i) for i in range(2, 22, 2)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    points = {r.vec_id: r.embedding for r in df.collect()}
    queries = [i for i in points if i % 20 == 0]
    got: dict = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0"), k=10, shard_rows=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = _exact(points, queries, 10)
    assert np.mean([len(got[q] & {i for _, i in best}) / len(best) for q, best in want.items()]) >= 0.95


@pytest.mark.parametrize(("offset", "scale", "outliers"), [(1e4, 1.0, []), (0.0, 1e20, []), (1e9, 1.0, []), (0.0, 1e-30, []), (0.0, 1.0, [1e20, -3e60, 1e150])])
def test_neighbours_whatever_the_offset_and_scale(spark, offset, scale, outliers):
    rng = np.random.default_rng(9)
    points = dict(enumerate((rng.normal(size=(1200, 24)) * scale + offset).tolist()))
    points |= {5000 + i: (rng.normal(size=24) * far).tolist() for i, far in enumerate(outliers)}
    df = spark.createDataFrame([(i, v, i, "x", 0.5) for i, v in points.items()], "vec_id long, embedding array<double>, id long, shard string, score double")
    queries = [i for i in points if i % 40 == 0]
    got: dict = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 40 = 0"), k=10, shard_rows=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(queries) and all(len(found) == 10 for found in got.values())
    want = _exact(points, queries, 10)
    assert np.mean([len(got[q] & {i for _, i in best}) / len(best) for q, best in want.items()]) >= 0.95


# op9


@pytest.mark.parametrize("segment_bits", [1 << 16, 1 << 10])
def test_cascade_is_exact(spark, monkeypatch, segment_bits):
    monkeypatch.setattr(urls, "SEGMENT_BITS", segment_bits)
    universe = spark.range(6000).selectExpr("concat('host', id) AS key").union(spark.sql("SELECT CAST(NULL AS STRING)")).union(spark.sql("SELECT 'host1'"))
    listed = spark.range(0, 6000, 7).selectExpr("concat('host', id) AS key").union(spark.sql("SELECT 'elsewhere'"))
    cascade = urls.build_cascade(spark, universe, listed)
    assert len(cascade.levels) > 1
    rows = cascade.listed(universe, "key", "hit").collect()
    assert len(rows) == 6002
    for r in rows:
        assert r.hit == (r.key is not None and int(r.key[4:]) % 7 == 0), r.key


def test_url_parts_and_rules(spark):
    cases = {
        "http://WWW.Example.com/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://b.net/es/x": ("b.net", "/es/x", "net/es/", "block"), "http://b.net": ("b.net", "", None, "allow"), "x://spam-farm.org?q=/": ("spam-farm.org", "", None, "block"),
        "no host": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "://É.COM/a://b": ("É.com", "/a://b", "com/", "allow"), "http://xnet/fr/": ("xnet", "/fr/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "h", "k")], "page_id long, url string, host string, key string")
    from partloom.llm.registry import URL_RULES

    keys = pages.select(urls.url_host(F.col("url")).alias("key"))
    cascade = urls.build_cascade(spark, keys, keys.filter("key LIKE '%spam%'"))
    rows = urls.judge_urls(pages, URL_RULES, cascade).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id]
    none = urls.build_cascade(spark, keys.limit(0), keys.limit(0))
    assert urls.judge_urls(pages.limit(0), URL_RULES, none).count() == 0


# op4


def _by_hand(items, capacity, most):
    """Best fit read plainly: of all bins without a conflict that have room, the fullest, then the first opened."""
    bins = []
    for size, source, cluster in items:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and (source is None or b["s"].count(source) < most) and (cluster is None or cluster not in b["c"])]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": [], "c": []})
        bins[i]["left"] -= size
        bins[i]["s"].append(source)
        bins[i]["c"].append(cluster)
        yield i


def test_best_fit_equals_the_plain_rule():
    rng = random.Random(6)
    items = sorted(((rng.randrange(1, 60), rng.choice([None, 0, 1, 2]), rng.choice([None, None, 0, 1, 2, 3])) for _ in range(400)), key=lambda x: -x[0])
    bins = Bins(60, 2)
    assert [bins.place(*x)[0] for x in items] == list(_by_hand(items, 60, 2))


def test_packing_holds_everything(spark):
    rows = ROWS + [(1000 + i, "same text here " + "x " * 30) for i in range(50)]
    got = pack_texts(frame(spark, rows), capacity=200, group_rows=40).collect()
    texts = dict(rows)
    per_doc: dict = {}
    bins: dict = {}
    for r in got:
        if r.bin_id is None:
            assert not (texts[r.doc_id] or "").split() and r.n_words == 0
            continue
        per_doc.setdefault(r.doc_id, []).append((r.start, r.n_words))
        bins.setdefault(r.bin_id, []).append(r)
    for doc, parts in per_doc.items():
        n = len((texts[doc] or "").encode().split())
        copies = sum(d == doc for d, _ in rows)
        assert sum(p[1] for p in parts) == n * copies
        assert {s for s, _ in parts} == set(range(0, n, 200))
    source = {r.doc_id: r.source for r in frame(spark, rows).collect()}
    for own in bins.values():
        own.sort(key=lambda r: r.bin_slot)
        assert [r.bin_slot for r in own] == list(range(len(own))) and sum(r.n_words for r in own) <= 200
        at = 0
        for r in own:
            assert r.bin_start == at
            at += r.n_words
        clusters = [" ".join((texts[r.doc_id] or "").lower().split()) for r in own]
        assert len(set(clusters)) == len(clusters)
        named = [source[r.doc_id] for r in own if source[r.doc_id] is not None]
        assert all(named.count(s) <= 2 for s in named)
    assert pack_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_by_given_sizes(spark):
    df = spark.createDataFrame([(1, 10, "a", "c"), (2, 10, "a", "c"), (3, 5, None, None), (4, None, "a", "d")], "doc_id long, size int, source string, cluster string")
    rows = {r.doc_id: r for r in pack_documents(df, F.col("size"), F.col("source"), F.col("cluster"), capacity=20).collect()}
    assert rows[1].bin_id != rows[2].bin_id and rows[3].bin_id in (rows[1].bin_id, rows[2].bin_id) and rows[4].bin_id is None


# op8


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(8)
    truth = rng.random(40_000) < 0.2
    bad, good = np.array([0.9, 0.7, 0.6, 0.8]), np.array([0.02, 0.05, 0.01, 0.1])
    votes = (rng.random((len(truth), 4)) < np.where(truth[:, None], bad, good)).astype(np.int64)
    code, count = np.unique(votes @ (1 << np.arange(4)), return_counts=True)
    posterior, found = weak_labels.fit_labellers(weak_labels._bits(code, 4), count.astype(float))
    assert abs(found["prior"] - 0.2) < 0.02 and np.abs(found["bad"] - bad).max() < 0.05 and np.abs(found["good"] - good).max() < 0.02
    assert posterior[code == 15] > 0.99 and posterior[code == 0] < 0.05


def test_classifier_on_held_out_labels(spark):
    """The lexicon is made from half of the labelled documents, accuracy is taken on the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = weak_labels.classify(docs, labels.filter("doc_id % 2 = 0"))
    t = judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").selectExpr("quality = 1 AND toxic = 0 AS clean", "toxic = 1 AS toxic", "quality = 0 AS junk", "kept").toPandas()
    assert t[t.clean].kept.mean() > 0.99
    assert t[t.junk].kept.mean() < 0.05
    assert t[t.toxic].kept.mean() < 0.25


def test_classifier_on_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, ROWS)
    assert weak_labels.classify(docs, labels).count() == len(ROWS)
    rows = weak_labels.classify(docs, labels, keep_columns=True)
    assert rows.columns == [c for c in docs.columns if c != "kept"] + ["p_junk", "p_toxic", "kept"]
    assert weak_labels.classify(spark.createDataFrame([], DOCS), labels).count() == 0
    assert weak_labels.classify(docs, labels.limit(0)).count() == len(ROWS)


def test_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names
