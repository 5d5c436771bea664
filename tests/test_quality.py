from __future__ import annotations

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partloom import schemas as sc
from partloom.operators import quality
from partloom.plans.build import complete_record

FIELDS = "sku string, name string, price string, category string"


def _parts(spark, *records):
    return complete_record(spark.createDataFrame(list(records), FIELDS))


@pytest.mark.parametrize(
    ("price", "fault"),
    [
        ("299.99", None), ("None", None), (None, None), ("10.500", None), ("1e3", None), ("abc", "is not a number"),
        ("50000.01", "is unreasonably high"), ("50000.00", None), ("0", "must be greater than 0"), ("-1", "must be greater than 0"),
        ("12.345", "has more than 2 decimal places"), ("12.3e-2", "has more than 2 decimal places"), ("", "is not a number"),
    ],
)
def test_price_rules(spark, price, fault):
    judged = quality.check_parts(_parts(spark, ("CSF-1", "n", price, "c")))
    assert rows(quality.issue_rows(judged, "sku"), "message") == ([(fault,)] if fault else [])


def test_part_rules(spark):
    judged = quality.check_parts(_parts(spark, ("x-1", "  ", "1", ""), (" csf-1 ", "n" * 501, "1", "c"), ("", "n", "1", "c"), (None, "n", "1", "c")))
    got = rows(quality.issue_rows(judged, "sku"), "key", "field", "message")
    assert got == sorted(
        [
            ("x-1", "sku", "must start with 'CSF-'"), ("x-1", "name", "is required"), ("x-1", "category", "is required"),
            (" csf-1 ", "name", "is longer than 500"), ("", "sku", "is required"), (None, "sku", "is required"),
        ],
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


def test_stored_form(spark):
    valid, rejected = quality.validate_batch(_parts(spark, (" csf-9 ", " a ", "$1,299.99", "OIL coolers"), ("CSF-2", "b", "call", "c")))
    row = valid.first()
    assert (row.sku, row.name, str(row.price), row.category) == ("CSF-9", "a", "1299.99", "Oil Coolers")
    assert (row.manufacturer, row.in_stock, row.features, row.specifications) == ("CSF", True, [], {})
    assert rejected.count() == 1 and rejected.first().issues[0].message == "cannot be read"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["CSF-1", "csf-2", "x", ""]), st.sampled_from(["n", " "]), st.sampled_from(["1", "z", None])), min_size=1, max_size=6))
def test_batch_splits_without_loss(spark, given_rows):
    raw = _parts(spark, *[(s, n, p, "c") for s, n, p in given_rows])
    valid, rejected = quality.validate_batch(raw)
    assert valid.count() + rejected.count() == len(given_rows)
    assert valid.count() == sum(s.upper().startswith("CSF-") and n.strip() != "" and p != "z" for s, n, p in given_rows)


@pytest.mark.parametrize(
    ("year", "fault"),
    [(1949, "must be 1950 or later"), (1899, "is outside 1900..2030"), (2031, "is outside 1900..2030"), (2027, "is more than 2 years ahead"), (2026, None), (None, "is required")],
)
def test_vehicle_years(spark, year, fault):
    frame = spark.createDataFrame([("k", "Honda", "Civic", year)], "key string, make string, model string, year int")
    judged = quality.check_vehicles(frame, current_year=2024)
    assert rows(quality.issue_rows(judged, "key"), "message") == ([(fault,)] if fault else [])


def test_compat_needs_vehicles(spark):
    frame = spark.createDataFrame([("CSF-1", [{"make": "a"}]), ("CSF-2", []), ("B", None)], sc.T.StructType(
        [sc.T.StructField("part_sku", sc.S), sc.T.StructField("vehicles", sc.T.ArrayType(sc.T.StructType([sc.T.StructField("make", sc.S)])))]
    ))
    assert rows(quality.issue_rows(quality.check_compat(frame), "part_sku"), "key", "field") == [("B", "part_sku"), ("B", "vehicles"), ("CSF-2", "vehicles")]


def test_declared_count_is_a_warning_only_in_lenient_mode(spark):
    parts = _parts(spark, ("CSF-1", "n", "1", "c")).withColumns(
        {"images": F.array(F.struct(F.lit("u").alias("url"), F.lit("a").alias("alt_text"), F.lit(True).alias("is_primary"))),
         "description": F.lit("d"), "specifications": F.create_map(F.lit("k"), F.lit("v"))}
    )
    meta = spark.createDataFrame([("2025", 5)], "export_date string, total_parts long")
    issues, lenient = quality.check_parts_export(parts, meta)
    assert rows(issues, "severity", "field") == [("warning", "metadata.total_parts")]
    assert lenient.first().is_valid is True
    assert quality.check_parts_export(parts, meta, strict=True)[1].first().is_valid is False
    none = spark.createDataFrame([], "export_date string, total_parts long")
    assert rows(quality.check_parts_export(parts, none)[0], "message") == [("Missing required key: 'metadata'",)]


def test_bad_row_fails_its_page_or_only_itself(spark):
    raw = complete_record(spark.createDataFrame([(1, "CSF-1", "a", None, "c"), (1, "bad", "a", None, "c"), (2, "CSF-2", "a", None, "c")], "page_id int, " + FIELDS))
    judged = quality.check_parts(raw)
    assert rows(quality.drop_invalid_pages(judged), "sku") == [("CSF-2",)]
    assert rows(quality.drop_invalid_pages(judged, on_invalid="drop_row"), "sku") == [("CSF-1",), ("CSF-2",)]


def test_import_structure(spark):
    errors, usable = quality.check_import(_parts(spark, ("", "n", None, "c"), ("1", None, None, None)))
    assert errors.count() == 0 and usable.where("importable").count() == 1
    assert quality.check_import(_parts(spark, ("a", "", "", "")).limit(0))[0].count() == 1
    found = spark.createDataFrame([("f", "parts"), ("f", "none"), ("g", "broken"), ("g", "broken")], "source_file string, container string")
    assert rows(quality.check_import(_parts(spark, ("a", "n", None, "c")), found)[0], "source_file", "documents") == [("f", 1), ("g", 2)]


def test_every_metadata_row_is_judged(spark):
    parts = _parts(spark, *[("CSF-1", "n", "1", "c")] * 4).withColumn("source_file", F.when(F.rand(1) >= 0, "f"))
    meta = spark.createDataFrame([("2025", 4), ("2025", 9)], "export_date string, total_parts long")
    assert [m for m in rows(quality.check_parts_export(parts.drop("source_file"), meta)[0], "message") if "declares" in m[0]] == [("Metadata declares 9 but found 4",)]
    files = meta.withColumn("source_file", F.when(F.col("total_parts") == 4, "f").otherwise("g"))
    assert [m for m in rows(quality.check_parts_export(parts, files)[0], "message") if "declares" in m[0]] == [("Metadata declares 9 but found 0",)]


def test_import_sample_vehicle_years(spark):
    cars = spark.createDataFrame([("CSF-1", "a", "b", 2101), ("CSF-1", None, "b", 2000)], "sku string, make string, model string, year int")
    parts = _parts(spark, ("3951", "n", "-4", "c")).withColumns({"in_stock": F.lit(True), "description": F.lit("d"), "manufacturer": F.lit("m")})
    got = rows(quality.check_import_sample(parts, cars), "severity", "field")
    assert got == [("error", "price"), ("error", "vehicles.make"), ("error", "vehicles.year"), ("warning", "sku")]


def test_health(spark):
    frame = lambda *s: spark.createDataFrame([(x,) for x in s], "sku string")
    got = dict(rows(quality.health_thresholds(frame("a", "b"), frame("a"), export_age_seconds=5, min_parts=1), "alarm", "raised"))
    assert got == {"parts_decreased": True, "export_stale": False, "many_new_parts": False, "too_few_parts": False}


def test_hierarchical_files_are_judged_each_by_its_own_years(spark):
    leaf = "sku string, name string, category string, price string, year string, make string, model string, leaf_pos int, source_file string"
    rows = [("CSF-1", "n", "c", "1.00", y, "M", "X", 0, f) for f, y in (("a", "2001"), ("b", "2002"), ("b", "2003"), ("b", "2003"))]
    meta = spark.createDataFrame([("a", "d", "s", 1), ("b", "d", "s", 1), ("c", "d", "s", 0)], "source_file string, export_date string, structure string, total_years long")
    issues = quality.check_hierarchical(complete_record(spark.createDataFrame(rows, leaf)), meta)[0].where("key = 'file'").collect()
    assert [r.message for r in issues] == ["Metadata declares 1 but found 2"]
