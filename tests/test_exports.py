from __future__ import annotations

import datetime
import json
import os

import pytest
from conftest import rows

from partloom import schemas as sc
from partloom.operators import aggregates, dedup
from partloom.sources import exports

PART = {"sku": "csf-1", "name": " n ", "price": "1.50", "category": "oil coolers", "images": [], "scraped_at": "2025"}
META = {"export_date": "2025-10-28", "total_parts": 1, "version": "1.0"}


def _put(tmp_path, name, value):
    (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value, indent=2))
    return f"file:{tmp_path}/{name}"


@pytest.mark.parametrize("wrap", [lambda p: {"metadata": META, "parts": [p]}, lambda p: {"data": [p]}, lambda p: [p], lambda p: p])
def test_every_envelope(spark, tmp_path, wrap):
    path = _put(tmp_path, "parts.json", wrap(PART))
    assert rows(exports.read_parts_export(spark, path, multi_line=True), "sku", "name", "category") == [("CSF-1", "n", "Oil Coolers")]
    line = _put(tmp_path, "line.json", json.dumps(wrap(PART)) + "\n" + json.dumps(wrap({**PART, "sku": "CSF-2"})))
    assert rows(exports.read_parts_export(spark, line), "sku") == [("CSF-1",), ("CSF-2",)]


def test_defaults_read_every_row_that_was_written(spark, tmp_path):
    exports.write_parts(_parts(spark, *[(f"CSF-{i}", "n", "1") for i in range(10)]), f"file:{tmp_path}/e")
    assert exports.read_parts_export(spark, f"file:{tmp_path}/e/rows", check=False).count() == 10
    assert exports.read_export_dir(spark, f"file:{tmp_path}/e/rows").count() == 10
    exports.write_parts(_parts(spark, *[(f"CSF-{i}", "n", "1") for i in range(10)]).coalesce(1), f"file:{tmp_path}/one")
    with pytest.raises(ValueError, match="10 documents"):
        exports.read_parts_export(spark, f"file:{tmp_path}/one/rows", check=False, multi_line=True)


_TWO = {**PART, "sku": "CSF-2"}


@pytest.mark.parametrize(
    ("text", "n"),
    [
        (json.dumps(PART, indent=2) + "\n" + json.dumps(_TWO, indent=2), 2),
        (f"{json.dumps([PART])}\n{json.dumps([_TWO])}\n{json.dumps([_TWO])}", 3),
        (json.dumps(PART) + '\n{"sku": "CSF-2",\n', 2),
        (json.dumps(PART) + " trailing", 2),
        (json.dumps({"parts": [PART]}, indent=1).replace('"', "'") + "\n{'parts': []}", 2),
    ],
)
def test_a_multi_line_file_that_holds_more_is_refused(spark, tmp_path, text, n):
    path = _put(tmp_path, "m.json", text)
    for read in (exports.read_parts_export, exports.read_structure):
        with pytest.raises(ValueError, match=f"{n} documents"):
            read(spark, path, multi_line=True)


def test_a_multi_line_file_of_one_document_is_read(spark, tmp_path):
    odd = {**PART, "name": "a } ] { \" ' \\"}
    for i, text in enumerate(("\ufeff" + json.dumps({"parts": [odd]}, indent=2) + "\n\n", json.dumps([odd], indent=0), json.dumps({"parts": [odd]}).replace(", ", ",\n"))):
        path = _put(tmp_path, f"{i}.json", text)
        assert rows(exports.read_parts_export(spark, path, multi_line=True), "sku") == [("CSF-1",)]


def test_structure_tells_what_was_found(spark, tmp_path):
    lines = [{"parts": [PART]}, {"data": [PART]}, PART, {"summary": {"unique_skus": 3, "total_parts_found": 5}}, {"metadata": META}]
    path = _put(tmp_path, "s.json", "\n".join(map(json.dumps, lines)) + '\n{"parts": [\n{"metadata": "x", "parts": []}')
    got = rows(exports.read_structure(spark, path).groupBy("container").count())
    assert got == [("broken", 2), ("data", 1), ("metadata", 1), ("none", 1), ("parts", 1), ("record", 1)]
    assert exports.read_parts_export(spark, path).count() == 3
    assert rows(exports.read_summaries(spark, path), "total_parts", "unique_skus", "deduplication_rate") == [(5, 3, 0.0)]
    stats = dict(rows(aggregates.summary_stats(exports.read_summaries(spark, path)), "metric", "value"))
    assert (stats["total_parts"], stats["unique_skus"], stats["duplicate_count"]) == (5.0, 3.0, 0.0)


def test_import_stops_before_a_version_is_written(spark, tmp_path):
    from partloom.plans.imports import import_exports

    path = _put(tmp_path, "i.json", json.dumps({"parts": [PART]}) + "\n" + json.dumps({"metadata": META, "summary": {}}))
    with pytest.raises(ValueError, match="parts"):
        import_exports(spark, path, f"file:{tmp_path}/table")
    assert not (tmp_path / "table").exists()
    good = _put(tmp_path, "g.json", json.dumps({"parts": [PART, {**PART, "sku": ""}]}))
    assert rows(import_exports(spark, good, f"file:{tmp_path}/table").where("parts > 0"), "status", "parts") == [("created", 1), ("skipped", 1)]


def test_maps_from_sku_to_vehicles(spark, tmp_path):
    text = json.dumps({"CSF-1": [{"make": "a", "year": 2000}], "csf-2": [{"make": "b", "year": 2001}, {"make": "c", "year": 2002}]})
    path = _put(tmp_path, "m.json", text + "\n" + json.dumps({"part_sku": "CSF-3", "vehicles": [{"make": "d", "year": 2003}]}))
    got = rows(exports.read_compat_export(spark, path, check=False), "sku", "make")
    assert got == [("CSF-1", "a"), ("CSF-2", "b"), ("CSF-2", "c"), ("CSF-3", "d")]


def test_bad_records_and_files_are_left_out(spark, tmp_path):
    _put(tmp_path, "a.json", {"parts": [PART, {**PART, "sku": "bad"}]})
    _put(tmp_path, "b.json", '{"parts": [{"sku"')
    assert rows(exports.read_parts_export(spark, f"file:{tmp_path}", glob="*.json", multi_line=True), "sku") == [("CSF-1",)]


@pytest.mark.parametrize("wrap", [lambda c: {"metadata": META, "compatibility": [c]}, lambda c: {"data": [c]}, lambda c: [c], lambda c: c])
def test_compat_envelopes(spark, tmp_path, wrap):
    entry = {"part_sku": "CSF-1", "vehicles": [{"make": "a", "model": "b", "year": 2000}, {"make": "a", "model": "b", "year": 2001}]}
    path = _put(tmp_path, "compatibility.json", wrap(entry))
    assert rows(exports.read_compat_export(spark, path, multi_line=True), "sku", "vehicle_pos", "year") == [("CSF-1", 0, 2000), ("CSF-1", 1, 2001)]


def test_hierarchical_document(spark, tmp_path):
    path = _put(tmp_path, "h.json", {"metadata": {}, "data": {"2020": {"Honda": {"Civic": [PART, PART]}}}})
    assert rows(exports.read_hierarchical_export(spark, path, multi_line=True), "year", "make", "model", "leaf_pos", "sku") == [
        ("2020", "Honda", "Civic", 0, "csf-1"), ("2020", "Honda", "Civic", 1, "csf-1")
    ]


def test_directory_verdicts(spark, tmp_path):
    _put(tmp_path, "p.json", {"metadata": META, "parts": [PART, {**PART, "name": ""}]})
    _put(tmp_path, "c.json", {"compatibility": [{"part_sku": "CSF-1", "vehicles": [{"make": "a"}]}]})
    _put(tmp_path, "h.json", {"data": {"2020": {"Honda": {"Civic": [PART]}}}})
    _put(tmp_path, "u.json", {"else": 1})
    _put(tmp_path, "x.json", "{broken")
    got = rows(exports.judge_directory(spark, f"file:{tmp_path}", multi_line=True), "filename", "kind", "total", "valid", "errors", "is_valid")
    assert got == [
        ("c.json", "compatibility", 1, 1, 0, True), ("h.json", "hierarchical", 1, 1, 0, True), ("p.json", "parts", 2, 1, 1, False),
        ("u.json", "unknown", 0, 0, 1, False), ("x.json", "unreadable", 0, 0, 1, False),
    ]


def test_audit(spark, tmp_path):
    _put(tmp_path, "p.json", {"metadata": META, "parts": []})
    _put(tmp_path, "x.json", "{broken")
    got = rows(exports.export_audit(spark, f"file:{tmp_path}", multi_line=True), "filename", "total_parts", "version", "valid_json")
    assert got == [("p.json", 1, "1.0", True), ("x.json", 0, None, False)]


def test_latest_drop(spark, tmp_path):
    for i, name in enumerate(("old.json", "new.json", "mid.json")):
        _put(tmp_path, name, "{}")
        stamp = 1_700_000_000 + {"old.json": 0, "mid.json": 50, "new.json": 100}[name]
        os.utime(tmp_path / name, (stamp, stamp))
    newest = exports.latest_drop(spark, f"file:{tmp_path}")
    assert newest.first().path.endswith("/new.json")
    log = newest.selectExpr("path AS filename", "current_timestamp() AS completed_at")
    assert exports.latest_drop(spark, f"file:{tmp_path}", log).count() == 0


def _parts(spark, *records):
    return spark.createDataFrame(list(records), "sku string, name string, price string")


def test_append_replaces_adds_and_counts(spark, tmp_path):
    path = f"file:{tmp_path}/e"
    with pytest.raises(ValueError, match="missing export"):
        exports.append_export(_parts(spark, ("a", "n", "1")), path, sc.EXPORT_PART)
    exports.write_parts(_parts(spark, ("a", "1", "1"), ("b", "1", "2")), path)
    merged = exports.append_export(_parts(spark, ("b", "2", "3"), ("c", "2", "4")), path, sc.EXPORT_PART)
    assert merged == exports.current_export(spark, path)
    written = spark.read.schema(sc.EXPORT_PART).json(f"{merged}/rows")
    assert rows(written, "sku", "name", "price") == [("a", "1", "1"), ("b", "2", "3"), ("c", "2", "4")]
    assert spark.read.schema(sc.METADATA).json(f"{merged}/metadata").first().total_parts == 3


@pytest.mark.parametrize("left", [[], ["rows/part-0.json"], ["rows/_SUCCESS"], ["rows/_SUCCESS", "metadata/part-0.json"]])
def test_append_after_one_that_died(spark, tmp_path, left):
    """An unfinished version is not read, and the next append takes its place."""
    path, folder = f"file:{tmp_path}/e", tmp_path / "e"
    exports.write_parts(_parts(spark, ("a", "1", "1")), path)
    exports.append_export(_parts(spark, ("b", "1", "1")), path, sc.EXPORT_PART)
    for name in left:
        (folder / "version=2" / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / "version=2" / name).write_text('{"sku": "wrong"}')
    assert exports.current_export(spark, path).endswith("version=1")
    merged = exports.append_export(_parts(spark, ("c", "1", "1")), path, sc.EXPORT_PART)
    assert rows(spark.read.schema(sc.EXPORT_PART).json(f"{merged}/rows"), "sku") == [("a",), ("b",), ("c",)]
    assert merged.endswith("version=2")


def test_writers_count_what_they_write(spark, tmp_path):
    none = _parts(spark, ("a", "1", "1")).where("false")
    exports.write_parts(none, f"file:{tmp_path}/none")
    assert spark.read.schema(sc.METADATA).json(f"file:{tmp_path}/none/metadata").first().total_parts == 0
    fits = spark.createDataFrame([("a", "m", "o", 2000), ("a", "m", "o", 2001), ("b", "m", "o", 2001)], "sku string, make string, model string, year int")
    exports.write_hierarchical(fits, _parts(spark, ("a", "1", "1"), ("b", "1", "1")), f"file:{tmp_path}/h")
    assert json.loads(next((tmp_path / "h" / "metadata").glob("part-*.json")).read_text())["total_years"] == 2
    exports.write_compat(fits, f"file:{tmp_path}/c")
    assert json.loads(next((tmp_path / "c" / "metadata").glob("part-*.json")).read_text())["total_mappings"] == 2


def test_delta_is_written_only_when_needed(spark, tmp_path):
    parts, changes = _parts(spark, ("a", "1", "1")), spark.createDataFrame([], "sku string, change string")
    assert exports.write_delta(parts, changes, f"file:{tmp_path}/d") is False and not (tmp_path / "d").exists()
    assert exports.write_delta(parts, spark.createDataFrame([("a", "new")], "sku string, change string"), f"file:{tmp_path}/d")


def test_complete_and_hierarchical_rows(spark):
    parts = _parts(spark, ("a", "1", "1"), ("b", "1", "2"))
    fits = spark.createDataFrame([("a", "m", "o", 2000), ("zz", "m", "o", 2000)], "sku string, make string, model string, year int")
    assert rows(exports.complete_rows(parts, fits).selectExpr("sku", "size(compatibility) n")) == [("a", 1), ("b", 0)]
    assert rows(exports.hierarchical_rows(fits, parts), "year", "make", "model", "sku") == [(2000, "m", "o", "a")]
    assert dedup.concat_exports(parts, parts.select("sku")).count() == 4


def test_append_makes_its_batch_once(spark, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    path, schema = f"file:{tmp_path}/e", "sku string, name string"
    exports._write(spark.createDataFrame([("a", "old"), ("b", "old")], schema), path, "total_parts")
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda sku: (made.add(1), sku)[1], "string").asNondeterministic()
    batch = spark.createDataFrame([("b", "new"), ("c", "new"), (None, "new")], schema).withColumn("sku", seen("sku")).withColumn("note", F.lit(None))
    merged = exports.append_export(batch, path, T.StructType.fromDDL(f"{schema}, note string"))
    assert rows(spark.read.schema(schema).json(f"{merged}/rows")) == [("a", "old"), ("b", "new"), ("c", "new"), (None, "new")]
    assert made.value == 3


def test_fitments_dealt_by_sku_are_listed_where_they_are(spark, tmp_path):
    """The same rows as of the other deal, and one exchange from the sightings to a sku's vehicles."""
    from partloom.sources import adapters

    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double, l_returnflag string, l_linestatus string, l_tax double"
    day = datetime.date(2000, 1, 2)
    lines = [(i // 3, i % 7, i % 5 if i % 11 else None, 10 + i % 2, day, float(i % 9), "A", "F", i % 3 / 25) for i in range(60)] + [(None, 1, 2, 10, None, None, None, "O", None)] * 2
    tables = {"lineitem": (lines, line), "supplier": ([(10, 1), (11, 2), (11, 2)], "s_suppkey long, s_nationkey long"), "nation": ([(1, "X"), (2, "Y")], "n_nationkey long, n_name string")}
    for name, (records, schema) in tables.items():
        spark.createDataFrame(records, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    dealt, plain = (adapters.fitments(spark, str(tmp_path), by_sku=b) for b in (True, False))
    assert dealt.columns == plain.columns and rows(dealt) == rows(plain) and dealt.count() > 60
    listed = exports.compat_rows(dedup.dedup_fitments(dealt, list(adapters.ORDER)))
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "Broadcast" not in x]) == 1
