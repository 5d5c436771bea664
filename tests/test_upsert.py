from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from partloom import schemas as sc
from partloom.operators import upsert


def _catalog(spark, *records):
    frame = spark.createDataFrame(list(records), "id long, sku string, name string, price string")
    return upsert.evolve_schema(frame.withColumn("price", F.col("price").cast("decimal(10,2)")), sc.CATALOG)


def _batch(spark, *records):
    frame = spark.createDataFrame(list(records), "sku string, name string, price string")
    return frame.withColumn("price", F.col("price").cast("decimal(12,4)"))


def test_created_updated_unchanged_kept(spark):
    now = F.lit("2030-01-01").cast("timestamp")
    stored = _catalog(spark, (1, "a", "n", "1.00"), (2, "b", "n", "2.00"), (3, "c", "n", "3.00"))
    merged = upsert.upsert_catalog(stored, _batch(spark, ("a", "n", "1.0000"), ("b", "n2", "2"), ("d", "new", "4")), now=now)
    got = {r.sku: r for r in merged.collect()}
    assert {s: r.status for s, r in got.items()} == {"a": "unchanged", "b": "updated", "c": "kept", "d": "created"}
    assert got["b"].name == "n2" and got["c"].last_synced is None and got["a"].updated_at is None
    assert got["a"].last_synced == got["b"].updated_at == got["d"].created_at
    assert got["d"].id is None and {r.sku: r.id for r in upsert.assign_ids(merged).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_second_upsert_changes_nothing(spark):
    batch = _batch(spark, ("a", "n", "1"), ("b", "n", None))
    once = upsert.upsert_catalog(_catalog(spark), batch).drop("status")
    assert rows(upsert.upsert_catalog(once, batch).groupBy("status").count()) == [("unchanged", 2)]


def test_missing_text_equals_empty_text(spark):
    stored = _catalog(spark, (1, "a", None, None))
    assert upsert.upsert_catalog(stored, _batch(spark, ("a", "", None))).first().status == "unchanged"


def test_manifest(spark):
    manifest = spark.createDataFrame(
        [("a", "h", "e", "true", None), ("b", "h", None, "true", None), ("c", None, None, "failed", "x"), ("k", "h", None, "true", None)], sc.MANIFEST
    )
    fetched = spark.createDataFrame(
        [("a", "h", "e2", None), ("b", "h2", None, None), ("c", "h", None, None), ("d", "h", None, None), ("e", None, None, "gone")],
        "filename string, source_hash string, etag string, error string",
    )
    got = rows(upsert.update_manifest(manifest, fetched), "filename", "change", "synced")
    assert got == [("a", "unchanged", "false"), ("b", "changed", "false"), ("c", "changed", "false"), ("d", "new", "false"), ("e", "failed", "failed"), ("k", "kept", "true")]


def test_versions_and_retry(spark, tmp_path):
    root = f"file:{tmp_path}/t"
    assert upsert.read_version(spark, root, sc.CATALOG) is None
    upsert.write_version(_catalog(spark, (1, "a", "n", "1")).drop("interchange_numbers", "last_synced"), root)
    upsert.write_version(_catalog(spark, (1, "b", "n", "1")), root)
    upsert.write_version(_catalog(spark, (1, "c", "n", "1")), root, 2)
    assert upsert.versions(spark, root) == [1, 2]
    assert upsert.read_version(spark, root, sc.CATALOG).first().sku == "c"
    old = upsert.read_version(spark, root, sc.CATALOG, before=2).first()
    assert old.sku == "a" and old.interchange_numbers is None and old.last_synced is None
    (tmp_path / "t" / "version=3").mkdir()
    assert upsert.versions(spark, root) == [1, 2], "an unfinished version is not read"


def test_checkpoint_needs_processed_ids(spark, tmp_path):
    root, ids = f"file:{tmp_path}/c", spark.range(3).withColumnRenamed("id", "application_id")
    upsert.save_checkpoint(root, "r", {"processed": ids})
    assert set(upsert.restore_checkpoint(spark, root, "r")) == {"processed"}
    upsert.save_checkpoint(root, "q", {"parts": ids})
    with pytest.raises(ValueError, match="processed"):
        upsert.restore_checkpoint(spark, root, "q")


def test_a_save_that_dies_leaves_the_one_before(spark, tmp_path):
    root, first, second = f"file:{tmp_path}/c", spark.range(3), spark.range(5)
    upsert.save_checkpoint(root, "r", {"processed": first, "parts": first, "failures": first})
    upsert.save_checkpoint(root, "r", {"parts": second})
    state = upsert.restore_checkpoint(spark, root, "r")
    assert {k: v.count() for k, v in state.items()} == {"processed": 3, "parts": 3, "failures": 3}
    upsert.save_checkpoint(root, "r", {"processed": second, "parts": second})
    assert {k: v.count() for k, v in upsert.restore_checkpoint(spark, root, "r").items()} == {"processed": 5, "parts": 5}


def test_delete_and_clear(spark):
    stored = _catalog(spark, (1, "a", "n", "1"), (2, "b", "n", "1"))
    assert rows(upsert.delete_parts(stored, spark.createDataFrame([(1,), (9,)], "id long")), "sku") == [("b",)]
    assert upsert.clear_parts(stored).count() == 0
