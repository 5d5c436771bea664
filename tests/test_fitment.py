from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from partloom.operators import fitment, joins, projections
from partloom.operators.filters import ExportFilter, relativize_images, resolve_images


def _fits(spark, *records):
    return spark.createDataFrame(
        list(records), "sku string, make string, model string, year int, engine string, aspiration string, qualifiers array<string>"
    )


@pytest.mark.parametrize(
    ("years", "text"),
    [([2000], "2000"), ([2000, 2001, 2002], "2000, 2001, 2002"), ([2000, 2001, 2002, 2003], "2000–2003"), ([1999, 2001, 2002, 2003, 2004, 2010], "1999, 2001–2004, 2010")],
)
def test_spans(spark, years, text):
    frame = spark.createDataFrame([(years,)], "y array<int>")
    assert frame.select(fitment.format_spans(F.col("y")).alias("t")).first().t == text


def test_cards_share_a_year_set(spark):
    fits = _fits(
        spark,
        ("a", "H", "C", 2000, "e1", "None", []), ("a", "H", "C", 2001, "e1", None, []), ("a", "H", "C", 2001, "e1", None, []),
        ("a", "H", "C", 2001, "e2", "T", ["q"]), ("a", "H", "C", 2000, "e2", "T", ["q"]), ("a", "H", "C", 2005, "e3", None, None),
    )
    cards = fitment.fitment_cards(fits)
    got = sorted([(r.years, [tuple(v) for v in r.variants]) for r in cards.collect()])
    assert got == [([2000, 2001], [("e1", "", ""), ("e2", "T", "q")]), ([2005], [("e3", "", "")])]

    badge = lambda **k: {tuple(r.years): r.badge for r in fitment.match_badges(cards, "h", "c", **k).collect()}
    assert badge(year=2001) == {(2000, 2001): "Possible Match", (2005,): None}
    assert badge(year=2005) == {(2000, 2001): None, (2005,): "Your Vehicle"}
    assert badge(year=2001, engine="E2", mode="interactive")[(2000, 2001)] == "Your Vehicle"
    assert badge(year=2001, engine="zz", mode="interactive")[(2000, 2001)] is None
    inline = {tuple(r.years): (r.badge, r.hidden) for r in fitment.match_badges(cards, "H", "C", engine="e3", mode="inline").collect()}
    assert inline == {(2000, 2001): (None, True), (2005,): ("Your Vehicle", False)}


def test_searched_vehicle_ranks_first(spark):
    fits = _fits(spark, ("a", "Audi", "A4", 2000, None, None, []), ("a", "BMW", "X", 1999, None, None, []), ("a", "BMW", "X", 2005, "e", None, []))
    ranked = fitment.rank_cards(fitment.fitment_cards(fits), "bmw", "x", 2005)
    assert rows(ranked, "rank", "make", "years") == [(1, "BMW", [2005]), (2, "Audi", [2000]), (3, "BMW", [1999])]


IMAGES = "array<struct<url:string,alt_text:string,is_primary:boolean>>"


def test_images(spark):
    frame = spark.createDataFrame(
        [("a", [("u0", "", False), ("u1", "", False), ("u2", "", True)]), ("b", [("v0", "", False)]), ("c", []), ("d", [("", "", False), ("w1", "", False)])],
        f"sku string, images {IMAGES}",
    )
    assert rows(fitment.primary_images(frame)) == [("a", "u2", "u1"), ("b", "v0", "v0"), ("c", None, None), ("d", "", "w1")]
    assert rows(fitment.image_names(frame.where("sku = 'd'")), "position", "filename") == [(1, "d_1.avif")]


def test_image_urls_both_ways(spark):
    frame = spark.createDataFrame([("a", [("https://h/x/images/avif/a_0.avif", "", True)]), ("b", [("images/avif/b.avif", "", True), ("//cdn/x", "", False)])], f"sku string, images {IMAGES}")
    assert rows(relativize_images(frame).selectExpr("sku", "images[0].url", "images_changed")) == [("a", "images/avif/a_0.avif", True), ("b", "images/avif/b.avif", False)]
    assert rows(resolve_images(frame, "https://s/up").where("sku = 'b'").selectExpr("images[0].url", "images[1].url")) == [("https://s/up/images/avif/b.avif", "//cdn/x")]


def test_key_specs_prefer_text_over_sizes(spark):
    specs = {"Inlet Length (in)": "2 1/2", "Inlet Width (in)": "1", "Outlet": "ONE barb", "Flow Direction": "DOWN", "CSF-99": "Radiator", "Rows": ""}
    row = projections.key_specs(spark.createDataFrame([("a", specs)], "sku string, specifications map<string,string>")).first()
    assert row.part_type == "Radiator"
    assert [tuple(e) for e in row.key_specs] == [("Flow", "Down"), ("Inlet", '2 ½" × 1"'), ("Outlet", "One Barb")]


def test_import_cleanup(spark):
    frame = spark.createDataFrame([("Drive Motor Inverter Cooler", "", "full", "CSFCSF-3764", "2.0L Eng.")], "category string, description string, full_description string, name string, e string")
    frame = frame.withColumn("compatibility", F.array(F.struct(F.col("e").alias("engine"))))
    row = projections.cleanup_import(frame).first()
    assert (row.category, row.description, row.name, row.compatibility[0].engine) == ("Inverter Cooler", "full", "CSF3764", "2.0L")


def test_export_filter_is_checked():
    assert ExportFilter(makes=[" honda ", ""], years=[2001, 1999]).makes == ["Honda"]
    for bad in ({"years": [1949]}, {"min_price": -1.0}, {"min_price": 5.0, "max_price": 4.0}):
        with pytest.raises(ValueError):
            ExportFilter(**bad)


def test_grouped_vehicles_carry_each_field_once(spark):
    """Sort columns that are fields travel once, and the vehicles come in the order of the whole record all the same."""
    rows = [
        ("A", "Kia", "Rio", 2001, None, "Turbo", ["b"]), ("A", "Kia", "Rio", 2001, None, "Turbo", ["a"]), ("A", "Kia", "Rio", 2001, None, None, ["z"]), ("A", "Audi", None, None, "x", "", []),
        ("A", None, "Q", 1999, "y", None, None), ("B", "Kia", "Rio", 2000, "y", None, []), ("B", "Kia", "Rio", 2000, "y", None, []), (None, "Kia", "Rio", 2000, "y", None, []),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "sku string, make string, model string, year int, engine string, aspiration string, qualifiers array<string>, seen int")
    for order in (None, ["year", "seen"], ["model"]):
        names = [f for f in joins.VEHICLE_FIELDS if f in df.columns]
        sort = order or ["make", "model", "year", "engine"]
        whole = F.sort_array(F.collect_list(F.struct(F.struct(*sort).alias("k"), F.struct(*names).alias("v"))))
        want = df.groupBy("sku").agg(F.transform(whole, lambda e: e["v"]).alias("vehicles"))
        got = joins.group_fitments(df, order)
        assert {r.sku: r.vehicles for r in got.collect()} == {r.sku: r.vehicles for r in want.collect()}
        assert got.schema["vehicles"].dataType.elementType.names == names
        listed = got._jdf.queryExecution().optimizedPlan().toString().split("collect_list(", 1)[1].split("AS vehicles", 1)[0].split("lambdafunction", 1)[0]
        assert listed.count("model#") == 1
