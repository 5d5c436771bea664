from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F

from partloom.operators import dedup, joins, paging

ORDER = ["pos"]


def _fits(spark, *records):
    return spark.createDataFrame(list(records), "sku string, make string, model string, year int, engine string, aspiration string, pos int")


def test_last_write_wins(spark):
    frame = spark.createDataFrame([("a", "1", 1), ("a", "2", 3), ("a", "3", 2), ("b", "x", 1)], "sku string, name string, pos int")
    assert rows(dedup.dedup_parts(frame, ORDER), "sku", "name") == [("a", "2"), ("b", "x")]


def test_first_fitment_wins_and_null_engines_are_equal(spark):
    frame = _fits(spark, ("a", "m", "o", 1, None, "late", 2), ("a", "m", "o", 1, None, "early", 1), ("a", "m", "o", 1, "e", "x", 3))
    assert rows(dedup.dedup_fitments(frame, ORDER), "engine", "aspiration") == [("e", "x"), (None, "early")]


def test_dedup_is_idempotent_and_independent_of_partitions(spark):
    rng = random.Random(7)
    data = [(f"s{rng.randint(0, 5)}", "m", "o", rng.randint(1, 3), rng.choice([None, "e"]), str(i), i) for i in range(200)]
    once = dedup.dedup_fitments(_fits(spark, *data), ORDER)
    rng.shuffle(data)
    again = dedup.dedup_fitments(dedup.dedup_fitments(_fits(spark, *data).repartition(7), ORDER), ORDER)
    assert rows(once) == rows(again)


def test_hot_key_is_combined_before_the_shuffle(spark):
    hot = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 500).cast("string"))).alias("sku"),
        F.col("id").cast("string").alias("name"), F.col("id").alias("pos"),
    )
    found = dedup.dedup_parts(hot, ORDER)
    assert found.where("sku = 'hot'").first().name == "29997"
    assert found.count() == hot.select("sku").distinct().count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_qualifier_groups_in_order_of_appearance(spark):
    frame = spark.createDataFrame(
        [(1, 0, "e", None, ["q"]), (1, 1, None, None, []), (1, 2, "e", None, ["q"])],
        "page_id int, page_pos int, engine string, aspiration string, qualifiers array<string>",
    )
    assert rows(dedup.qualifier_groups(frame), "qualifier_key", "group_pos", "parts") == [("::::", 1, 1), ("e::::q", 0, 2)]
    assert rows(dedup.with_group_position(frame), "page_pos", "group_pos") == [(0, 0), (1, 1), (2, 0)]


def _content(frame):
    return frame.withColumns(
        {"category": F.lit("c"), "manufacturer": F.lit("m"), "position": F.lit(None).cast("string"), "in_stock": F.lit(True), "price": F.lit(None).cast("string"),
         "specifications": F.create_map().cast("map<string,string>"), "images": F.array().cast("array<string>"), "features": F.array().cast("array<string>")}
    )


def test_any_differing_sighting_counts_as_change(spark):
    previous = _content(spark.createDataFrame([("a", "n"), ("b", "n"), ("gone", "n")], "sku string, name string"))
    seen = _content(spark.createDataFrame([("a", "n"), ("a", "other"), ("a", "n"), ("b", "n"), ("c", "n")], "sku string, name string"))
    changes = dedup.detect_changes(seen, previous)
    assert rows(changes) == [("a", "changed"), ("c", "new")]
    assert rows(dedup.delta_set(changes)) == [("a",), ("c",)]
    fates = rows(dedup.sku_sets(previous, seen, changes))
    assert fates == [("b", "preserved"), ("c", "new"), ("gone", "missing"), ("gone", "preserved")]
    assert rows(dedup.load_baseline(previous, seen), "sku").count(("gone",)) == 1


def test_no_change_gives_no_delta(spark):
    previous = _content(spark.createDataFrame([("a", "n")], "sku string, name string"))
    assert dedup.detect_changes(previous, previous).count() == 0


def test_page_reasons(spark):
    pages = spark.createDataFrame([("u1", "h"), ("u2", "h"), ("u3", "h"), ("u4", None), ("u5", "h")], "url string, hash string")
    state = spark.createDataFrame([("u1", "h"), ("u2", "old"), ("u4", "x"), ("u5", "h"), ("far", "z")], "url string, hash string")
    done = spark.createDataFrame([("u1",), ("u2",), ("u4",)], "url string")
    judged = joins.changed_pages(pages, state, done)
    assert rows(judged, "url", "reason") == [("u1", "unchanged"), ("u2", "changed"), ("u3", "first_seen"), ("u4", "check_failed"), ("u5", "unprocessed")]
    assert rows(joins.next_page_state(pages, state)) == [("far", "z"), ("u1", "h"), ("u2", "h"), ("u3", "h"), ("u4", "x"), ("u5", "h")]


def test_snapshot_diff(spark):
    frame = lambda *s: spark.createDataFrame([(x,) for x in s], "sku string")
    assert rows(joins.snapshot_diff(frame("a", "b", "b"), frame("b", "c"))) == [("a", "missing"), ("c", "new")]


def test_failed_download_is_no_image(spark):
    parts = spark.createDataFrame([("CSF-1",), ("CSF-2",), ("CSF-3",)], "sku string")
    manifest = spark.createDataFrame([("CSF-1_0.avif", "true"), ("CSF-2_0.avif", "failed")], "filename string, synced string")
    assert rows(joins.missing_images(parts, manifest)) == [("CSF-2",), ("CSF-3",)]


def test_positions_are_global_and_dense(spark):
    frame = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(5)
    got = [tuple(r) for r in paging.with_position(frame, "k").orderBy("k").collect()]
    assert got == [(i, i) for i in range(1000)]


def test_query_clamps_and_whitelists(spark):
    query = paging.CatalogQuery(orderby="price; drop", per_page=1000, page=0)
    assert (query.size, query.offset) == (100, 0)
    parts = spark.createDataFrame([(1, "s1", "b", "c", None, "m"), (2, "s2", "a", "c", None, "m"), (3, "s3", "a", "d", None, "m")],
                                  "id long, sku string, name string, category string, description string, manufacturer string")
    parts = parts.withColumn("interchange_numbers", F.array().cast("array<struct<reference_number:string,reference_type:string>>"))
    fits = spark.createDataFrame([("s1", "A", "X", 2000), ("s1", "B", "Y", 2001), ("s2", "A", "Y", 2001)], "sku string, make string, model string, year int")
    page = lambda **q: [r.sku for r in paging.query_catalog(parts, fits, paging.CatalogQuery(**q)).collect()]
    for order in ("asc", "desc"):
        whole = paging.query_catalog(parts, fits, paging.CatalogQuery(order=order)).select("name", "id", "sku").collect()
        for k, row in enumerate(whole):
            assert page(order=order, after=(row.name, row.id)) == [r.sku for r in whole[k + 1 :]]
    assert page() == ["s2", "s3", "s1"] and page(order="desc") == ["s1", "s3", "s2"]
    assert page(makes=["A"], models=["Y"]) == ["s2"], "both tests have to hold on one vehicle"
    assert page(years=["2001"]) == ["s2", "s1"] and page(categories=["D"]) == ["s3"]
    assert page(search="%") == [] and page(search="S3") == ["s3"]
    assert page(per_page=2, page=2) == ["s1"]
    totals = paging.count_matches(paging.matching_parts(parts, fits, paging.CatalogQuery()), 2, 1).first()
    assert (totals.total, totals.total_pages, totals.has_more) == (3, 2, True)
