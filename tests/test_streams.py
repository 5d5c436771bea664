from __future__ import annotations

import datetime

from conftest import rows
from pyspark.sql import functions as F

from partloom import schemas as sc
from partloom.operators import dedup, upsert
from partloom.streaming import jobs


def _crawl(spark, path, *pages):
    spark.createDataFrame(list(pages), "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(path)


def test_only_new_and_changed_pages_pass(spark, tmp_path):
    root = f"file:{tmp_path}"
    handler = jobs.page_changes(root, compact_every=2)
    schema = "page_id long, url string, html string"
    crawls = [
        [(1, "a", "x"), (2, "b", "x"), (3, "a", "y")],
        [(4, "a", "y"), (5, "b", "z"), (6, "c", '<meta content="t1">')],
        [(7, "a", "x"), (8, "b", "z"), (9, "c", '<meta content="t2">')],
        [(10, "a", "x"), (11, "b", "new")],
    ]
    for crawl in crawls:
        _crawl(spark, f"{root}/in", *crawl)
        stream = jobs.read_files(spark, f"{root}/in", sc.T.StructType.fromDDL(schema))
        jobs.run_available(stream, handler, f"{root}/check")
    kept = rows(jobs.read_page_changes(spark, root), "page_id")
    assert kept == sorted([(i,) for i in (2, 3, 5, 6, 7, 11)], key=str)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    root = f"file:{tmp_path}"
    handler = jobs.page_changes(root)
    first = spark.createDataFrame([(1, "a", "x")], "page_id long, url string, html string")
    second = spark.createDataFrame([(2, "a", "y"), (3, "b", "x")], "page_id long, url string, html string")
    handler(first, 0)
    handler(second, 1)
    once = rows(jobs.read_page_changes(spark, root), "page_id", "url")
    handler(second, 1)
    assert rows(jobs.read_page_changes(spark, root), "page_id", "url") == once == [(1, "a"), (2, "a"), (3, "b")]


def test_replay_of_compaction_batches(spark, tmp_path):
    """Every batch is replayed at once, with its own base complete, half written, or missing."""
    root = f"file:{tmp_path}"
    handler = jobs.page_changes(root, compact_every=2)
    batches = [
        [(1, "a", "x"), (2, "b", "x")], [(3, "a", "y")], [(4, "a", "y"), (5, "b", "z")], [(6, "c", "x"), (7, "b", "z")], [(8, "a", "x"), (9, "b", "z")],
    ]
    for i, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, "page_id long, url string, html string")
        handler(frame, i)
        once = rows(jobs.read_page_changes(spark, root), "page_id", "url")
        handler(frame, i)
        assert rows(jobs.read_page_changes(spark, root), "page_id", "url") == once
        marker = tmp_path / "base" / f"batch_id={i}" / "_SUCCESS"
        if marker.exists():
            marker.unlink()
            handler(frame, i)
            assert rows(jobs.read_page_changes(spark, root), "page_id", "url") == once
    assert rows(jobs.read_page_changes(spark, root), "page_id") == [(1,), (2,), (3,), (5,), (6,), (8,)]


def test_compacted_deltas_equal_plain_ones(spark, tmp_path):
    columns = ["sku", "name", "category", "price", "manufacturer", "position", "in_stock", "features", "images", "specifications"]
    baseline = lambda s: _listing(s, ("a", "n", "M", "o", 2000, None, 0)).select(*columns)
    steps = [[("a", "n"), ("b", "n")], [("b", "n")], [("b", "m"), ("c", "n")], [("a", "n"), ("c", "n")], [("a", "m"), ("b", "m")], [("b", "n")]]
    found = []
    for every in (0, 2):
        root = f"file:{tmp_path}/{every}"
        handler = jobs.publish_deltas(root, baseline, ["pos"], compact_every=every)
        for i, step in enumerate(steps):
            frame = _listing(spark, *[(s, n, "M", "o", 2000, None, 1) for s, n in step]).select(*columns, "pos")
            handler(frame, i)
            handler(frame, i)
        found.append(rows(spark.read.parquet(f"{root}/published"), "batch_id", "sku", "name"))
    assert found[0] == found[1] == [(0, "b", "n"), (2, "b", "m"), (2, "c", "n"), (4, "a", "m"), (5, "b", "n")]


def test_a_drop_is_imported_once(spark, tmp_path):
    root = f"file:{tmp_path}"
    drop = lambda name, text: (tmp_path / "drops" / name).write_text(text)
    (tmp_path / "drops").mkdir()

    def run():
        jobs.run_available(jobs.read_drops(spark, f"{root}/drops"), jobs.import_drops(root), f"{root}/check")
        return rows(upsert.read_version(spark, f"{root}/catalog", sc.CATALOG), "id", "sku", "name")

    drop("1.json", '{"parts": [{"sku": "a", "name": "n", "price": "$1,000.50"}, {"sku": "", "name": "x"}]}\n')
    assert run() == [(1, "a", "n")]
    assert run() == [(1, "a", "n")]
    drop("2.json", '{"data": [{"sku": "a", "name": "n2"}]}\n{"sku": "b", "name": "m"}\n')
    assert run() == [(1, "a", "n2"), (2, "b", "m")]
    assert upsert.versions(spark, f"{root}/catalog") == [1, 2]


def _listing(spark, *records):
    frame = spark.createDataFrame(list(records), "sku string, name string, make string, model string, year int, engine string, pos int")
    return frame.withColumns(
        {"aspiration": F.lit(None).cast("string"), "qualifiers": F.array().cast("array<string>"), "category": F.lit("c"), "price": F.lit(None).cast("decimal(10,2)"),
         "manufacturer": F.lit("m"), "position": F.lit(None).cast("string"), "in_stock": F.lit(True), "features": F.array().cast("array<string>"),
         "images": F.array().cast("array<string>"), "specifications": F.create_map().cast("map<string,string>")}
    )


def test_incremental_dedup_equals_one_pass(spark, tmp_path):
    root = f"file:{tmp_path}"
    data = [(f"s{i % 5}", f"n{i}", "M", f"o{i % 3}", 2000 + i % 2, None if i % 4 else "e", i) for i in range(60)]
    handler = jobs.dedup_listings(root, ["pos"])
    for batch_id in range(3):
        handler(_listing(spark, *data[batch_id * 20 : (batch_id + 1) * 20]), batch_id)
    whole = _listing(spark, *data)
    read = lambda table: upsert.read_version(spark, f"{root}/{table}", whole.schema)
    parts, fits = read("parts"), read("fitments")
    folded = rows(parts, "sku", "name")
    assert folded == rows(dedup.dedup_parts(whole, ["pos"]), "sku", "name")
    key = ("sku", "make", "model", "year", "engine", "pos")
    assert rows(fits, *key) == rows(dedup.dedup_fitments(whole.select(*key), ["pos"]), *key)
    handler(_listing(spark, *data[40:]), 2)
    assert rows(read("parts"), "sku", "name") == folded


def test_deltas_hold_only_changes(spark, tmp_path):
    root = f"file:{tmp_path}"
    first = _listing(spark, ("a", "n", "M", "o", 2000, None, 1), ("b", "n", "M", "o", 2000, None, 2))
    columns = ["sku", "name", "category", "price", "manufacturer", "position", "in_stock", "features", "images", "specifications"]
    baseline = lambda s: _listing(s, ("a", "n", "M", "o", 2000, None, 0)).select(*columns)
    handler = jobs.publish_deltas(root, baseline, ["pos"])
    batch = lambda df: df.select(*columns, "pos")
    handler(batch(first), 0)
    handler(batch(first), 1)
    handler(batch(_listing(spark, ("a", "n2", "M", "o", 2000, None, 1))), 2)
    assert sorted(p.name for p in (tmp_path / "delta").iterdir()) == ["batch_id=0", "batch_id=2"]
    read = lambda i: rows(spark.read.schema("sku string, name string").json(f"{root}/delta/batch_id={i}/rows"))
    assert read(0) == [("b", "n")] and read(2) == [("a", "n2")]


def test_listings_meet_the_wide_part_last(spark, tmp_path):
    """The same rows as of occurrences joined with fitments, repeated and null keys too; only the join by part carries the part's columns."""
    from partloom.registry import streams
    from partloom.sources import adapters

    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double, l_returnflag string, l_linestatus string, l_tax double"
    day = datetime.date(2000, 1, 2)
    lines = [(1, 7, 1, 10, day, 9.0, "A", "F", 0.0), (1, 7, 1, 10, day, 1.0, "A", "F", 0.08), (2, 1, 2, 3, day, 9.0, "N", "O", 0.0), (None, 1, 2, 3, day, 9.0, "N", "O", 0.0), (3, 1, None, 3, day, 9.0, "N", "O", 0.0)]
    tables = {
        "lineitem": (lines, line), "supplier": ([(10, 1), (3, 1), (3, 1)], "s_suppkey long, s_nationkey long"), "nation": ([(1, "X")], "n_nationkey long, n_name string"),
        "part": ([(1, "p", "t", "b", 3, 5.0), (1, "q", "t", "b", 4, 6.0), (2, "r", "t", "b", 5, 7.0)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double"),
    }
    for name, (records, schema) in tables.items():
        spark.createDataFrame(records, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    order, vehicle = list(adapters.ORDER), ["make", "model", "year", "engine", "aspiration", "qualifiers"]
    parts = adapters.occurrences(spark, str(tmp_path)).select(*streams.PART_COLUMNS, *order)
    plain = parts.join(adapters.fitments(spark, str(tmp_path)).select(*vehicle, *order), order)
    found = streams._listings(spark, str(tmp_path))
    assert found.columns == plain.columns
    assert rows(found) == rows(plain) and found.count() == 10
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert "o3#" in joins[0] and "o1#" not in joins[0]


def test_listings_read_the_sightings_once(spark, tmp_path):
    """No join of the sightings with themselves, and what a part's join deals are plain columns, not the vehicle made from them."""
    from partloom.registry import streams

    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double, l_returnflag string, l_linestatus string, l_tax double"
    part = "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double"
    for name, schema in {"lineitem": line, "supplier": "s_suppkey long, s_nationkey long", "nation": "n_nationkey long, n_name string", "part": part}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = streams._listings(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    joined = [x for x in plan.splitlines() if " Join " in x or "- Join " in x]
    assert len(joined) == 3 and plan.count("l_returnflag#") and "Model " not in plan.split(joined[0], 1)[1]


def test_known_fitments_send_only_their_keys(spark, tmp_path):
    """The first sighting stays with all its columns, a missing engine or sku is met again, and replays give the same."""
    root = f"file:{tmp_path}"
    handler = jobs.dedup_listings(root, ["pos"])
    first = [("a", "n", "M", "o", 2000, None, 5), (None, "n", "M", "o", 2000, "e", 6), ("b", "n", "M", None, None, "e", 7)]
    second = [("a", "n", "M", "o", 2000, None, 1), (None, "n", "M", "o", 2000, "e", 2), ("b", "n", "M", None, None, "e", 3), ("b", "n", "M", None, 2001, "e", 4)]
    for batch_id, data in ((0, first), (1, second), (1, second)):
        handler(_listing(spark, *data), batch_id)
    read = upsert.read_version(spark, f"{root}/fitments", _listing(spark, *first).select("sku", "year", "engine", "pos").schema)
    assert rows(read) == [("a", 2000, None, 5), ("b", 2001, "e", 4), ("b", None, "e", 7), (None, 2000, "e", 6)]
