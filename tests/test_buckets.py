from __future__ import annotations

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from partloom import schemas as sc
from partloom.operators import buckets, upsert


def _batch(spark, *records):
    frame = spark.createDataFrame(list(records), "sku string, name string, price string")
    return frame.withColumn("price", F.col("price").cast("decimal(12,4)"))


def _all(spark, root, *columns):
    return rows(buckets.read_buckets(spark, root, sc.CATALOG), *(columns or ("id", "sku", "name", "price")))


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_equals_the_whole_upsert(spark, tmp_path):
    root = f"file:{tmp_path}/t"
    now = F.lit("2030-01-01").cast("timestamp")
    loads = [[(f"s{k}", f"n{k}", "1") for k in range(200)], [(f"s{k}", "new", "2") for k in range(150, 260)], [("s3", "n3", "1.0000"), ("s4", None, None), ("zz", "z", "9")]]
    whole = spark.createDataFrame([], sc.CATALOG)
    for load in loads:
        batch = _batch(spark, *load)
        merged = upsert.assign_ids(upsert.upsert_catalog(whole, batch, now=now))
        _, written = buckets.upsert_buckets(root, batch, sc.CATALOG, now=now, n_buckets=8)
        changed = lambda df: rows(df.where("status <> 'kept'"), "sku", "status")
        assert changed(written) == changed(merged)
        whole = spark.createDataFrame(merged.drop("status").collect(), sc.CATALOG)
        assert _all(spark, root, *sc.CATALOG.names[:4], "last_synced", "created_at", "updated_at") == rows(whole, *sc.CATALOG.names[:4], "last_synced", "created_at", "updated_at")


def test_only_touched_buckets_are_written_and_read(spark, tmp_path):
    root = f"file:{tmp_path}/t"
    buckets.upsert_buckets(root, _batch(spark, *[(f"s{k}", "n", "1") for k in range(1000)]), sc.CATALOG, n_buckets=100)
    before = _files(tmp_path / "t" / "rows")
    batch = _batch(spark, *[(f"s{k}", "changed", "1") for k in range(10)])
    n = batch.select(buckets.bucket_of(F.col("sku"), 100)).distinct().count()
    version, written = buckets.upsert_buckets(root, batch, sc.CATALOG)
    added = _files(tmp_path / "t" / "rows") - before
    assert version == 2 and len({os.path.dirname(f) for f in added}) == n <= 10 and all("version=2" in f for f in added)
    assert before <= _files(tmp_path / "t" / "rows"), "files of other buckets stay as they are"
    old = buckets.read_manifest(spark, root, before=2)
    assert written.count() == sum(old.n_rows[b] for b, v in buckets.read_manifest(spark, root).wrote.items() if v == 2)
    assert rows(buckets.read_buckets(spark, root, sc.CATALOG).groupBy("name").count()) == [("changed", 10), ("n", 990)]
    one = buckets.lookup_buckets(spark, root, sc.CATALOG, ["s3", "s700", "none"])
    assert rows(one, "sku", "name") == [("s3", "changed"), ("s700", "n")]
    assert len(one.inputFiles()) <= 3


def test_replay_and_crash(spark, tmp_path):
    root, now = f"file:{tmp_path}/t", F.lit("2030-01-01").cast("timestamp")
    first, second = _batch(spark, ("a", "n", "1"), ("b", "n", "1")), _batch(spark, ("b", "m", "1"), ("c", "n", "1"), ("d", "n", "2"))
    for version, batch in ((1, first), (2, second)):
        buckets.upsert_buckets(root, batch, sc.CATALOG, now=now, version=version, n_buckets=4)
    once = _all(spark, root)
    buckets.upsert_buckets(root, second, sc.CATALOG, now=now, version=2)
    assert _all(spark, root) == once and [r[0] for r in once] == [1, 2, 3, 4]
    # Rows without their manifest are not there.
    (tmp_path / "t" / "version=2" / "_SUCCESS").unlink()
    assert _all(spark, root, "sku", "name") == [("a", "n"), ("b", "n")]
    buckets.upsert_buckets(root, second, sc.CATALOG, now=now, version=2)
    assert _all(spark, root) == once
    assert upsert.versions(spark, root) == [1, 2]
    assert rows(upsert.read_version(spark, root, sc.CATALOG, before=2), "sku", "name") == [("a", "n"), ("b", "n")]


def test_retired_versions_leave_what_is_current(spark, tmp_path):
    root = f"file:{tmp_path}/t"
    for k in range(6):
        buckets.upsert_buckets(root, _batch(spark, ("always", f"n{k}", "1"), (f"s{k}", "n", "1")), sc.CATALOG, n_buckets=50)
        buckets.retire_buckets(spark, root, keep=2)
    assert upsert.versions(spark, root) == [5, 6]
    assert _all(spark, root, "sku", "name") == [("always", "n5"), *[(f"s{k}", "n") for k in range(6)]]
    assert rows(buckets.read_buckets(spark, root, sc.CATALOG, before=6).where("sku = 'always'"), "name") == [("n4",)]
    left = {f.split("/bucket=")[0].rsplit("=", 1)[1] for f in _files(tmp_path / "t" / "rows") if "bucket=" in f}
    home = buckets.read_manifest(spark, root)
    assert left <= {str(v) for v in home.wrote.values()} | {"5"}
    # Rows of a writer that has not finished stay.
    (tmp_path / "t" / "rows" / "version=9" / "bucket=1").mkdir(parents=True)
    buckets.retire_buckets(spark, root, keep=2)
    assert (tmp_path / "t" / "rows" / "version=9" / "bucket=1").exists()


def test_delete_down_to_nothing(spark, tmp_path):
    root = f"file:{tmp_path}/t"
    buckets.upsert_buckets(root, _batch(spark, ("a", "n", "1"), ("b", "n", "1")), sc.CATALOG, n_buckets=3)
    buckets.delete_from_buckets(root, spark.createDataFrame([("a",), ("x",)], "sku string"), sc.CATALOG)
    assert _all(spark, root, "sku", "name") == [("b", "n")]
    buckets.merge_buckets(root, _batch(spark, ("b", "", "1")), lambda old, new: old.limit(0), sc.CATALOG)
    assert _all(spark, root) == [] and buckets.read_manifest(spark, root).n_buckets == 3
    buckets.upsert_buckets(root, _batch(spark, ("c", "n", "1")), sc.CATALOG)
    assert _all(spark, root, "sku") == [("c",)]


def test_empty_batch_and_bad_number(spark, tmp_path):
    root = f"file:{tmp_path}/t"
    assert buckets.read_buckets(spark, root, sc.CATALOG) is None
    buckets.upsert_buckets(root, spark.createDataFrame([], "sku string, name string, price decimal(12,4)"), sc.CATALOG)
    assert _all(spark, root) == []
    with pytest.raises(ValueError, match="buckets"):
        buckets.upsert_buckets(f"{root}2", _batch(spark, ("a", "n", "1")), sc.CATALOG, n_buckets=1 << 20)


def test_few_buckets_are_written_by_many_tasks(spark, tmp_path):
    root = f"file:{tmp_path}/t"
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        buckets.upsert_buckets(root, _batch(spark, *[(f"s{k}", "n", "1") for k in range(600)]), sc.CATALOG, n_buckets=2)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    files = _files(tmp_path / "t" / "rows")
    assert len({os.path.dirname(f) for f in files}) == 2 and 6 <= len(files) <= 12
    assert sorted(r[0] for r in _all(spark, root, "id")) == list(range(1, 601))
    buckets.upsert_buckets(root, _batch(spark, ("s5", "m", "1")), sc.CATALOG)
    assert rows(buckets.read_buckets(spark, root, sc.CATALOG).groupBy("name").count()) == [("m", 1), ("n", 599)]
