"""Keyed tables in hash buckets: an import writes the buckets it touches, and a small manifest says which files are current.

    root/rows/version=7/bucket=12/…   rows of bucket 12 as version 7 wrote them
    root/version=7/…                  the manifest of version 7: one row per bucket that has rows (bucket, version, n_rows, max_id)

The manifest is the commit. A job that dies before its manifest is complete leaves the version before it current, whatever rows it has written;
writing a version again starts from the version before it and replaces both its rows and its manifest, so a replay ends as the first run did.

The number of buckets is fixed when a table is made and kept in every row of its manifest. Choose it so that a bucket is some hundred megabytes; what the driver sees of a table is
``n_buckets`` rows of four numbers, never more than ``MOST_BUCKETS``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.operators import upsert
from partloom.session import work_path

MOST_BUCKETS = 1 << 16
#: Buckets of a table whose maker names no number.
BUCKETS = 64
MANIFEST = "bucket long, version long, n_rows long, max_id long, n_buckets long"

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Manifest:
    """What is current: the version that wrote each bucket, its rows and its highest id (None in a table without ids)."""

    version: int
    n_buckets: int
    wrote: dict[int, int]
    n_rows: dict[int, int]
    max_id: dict[int, int | None]

    def highest_id(self) -> int:
        return max((i for i in self.max_id.values() if i is not None), default=0)

    def folders(self, root: str, buckets: Iterable[int] | None = None) -> list[str]:
        chosen = self.wrote if buckets is None else [b for b in buckets if b in self.wrote]
        return [f"{root}/rows/version={self.wrote[b]}/bucket={b}" for b in sorted(chosen)]


def is_bucketed(spark: SparkSession, root: str) -> bool:
    fs, path = upsert._fs(spark, f"{root}/rows")
    return fs.exists(path)


def read_manifest(spark: SparkSession, root: str, *, before: int | None = None) -> Manifest | None:
    """The newest complete manifest, or the newest older than ``before``."""
    usable = [v for v in upsert.versions(spark, root) if before is None or v < before]
    if not usable:
        return None
    rows = _bounded(spark.read.schema(MANIFEST).parquet(f"{root}/version={usable[-1]}"))
    held = [r for r in rows if r["n_rows"]]
    wrote, n_rows, max_id = ({r["bucket"]: r[c] for r in held} for c in ("version", "n_rows", "max_id"))
    return Manifest(usable[-1], rows[0]["n_buckets"] if rows else 0, wrote, n_rows, max_id)


def _bounded(rows: DataFrame) -> list[dict]:
    """A row per bucket at most, ``MOST_BUCKETS`` in all: the only rows that the driver sees."""
    return rows.toArrow().to_pylist()


def bucket_of(key: Column, n_buckets: int) -> Column:
    """Null keys are a bucket's rows like others."""
    return F.pmod(F.xxhash64(key), F.lit(n_buckets))


def read_buckets(spark: SparkSession, root: str, schema: T.StructType, *, before: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame | None:
    """The current rows, or those of some buckets only, brought to ``schema``; None when no version is complete."""
    manifest = read_manifest(spark, root, before=before)
    return None if manifest is None else _rows(spark, root, manifest, schema, buckets)


def lookup_buckets(spark: SparkSession, root: str, schema: T.StructType, keys: list[str], *, key: str = "sku") -> DataFrame | None:
    """The rows of some keys; only their buckets' files are opened."""
    manifest = read_manifest(spark, root)
    if manifest is None:
        return None
    wanted = spark.createDataFrame([(k,) for k in keys], f"{key} string")
    at = {r["b"] for r in _bounded(wanted.select(bucket_of(F.col(key), manifest.n_buckets or 1).alias("b")).distinct())}
    return _rows(spark, root, manifest, schema, at).where(F.col(key).isin(keys))


def _rows(spark: SparkSession, root: str, manifest: Manifest, schema: T.StructType, buckets: Iterable[int] | None) -> DataFrame:
    folders = manifest.folders(root, buckets)
    if not folders:
        return spark.createDataFrame([], schema)
    # Files of older versions may lack columns of later ones; each version's files have one schema.
    by_version: dict[str, list[str]] = defaultdict(list)
    for folder in folders:
        by_version[folder.rsplit("/", 2)[1]].append(folder)
    frames = [upsert.evolve_schema(spark.read.parquet(*paths), schema) for _, paths in sorted(by_version.items())]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def merge_buckets(
    root: str, batch: DataFrame, merge: Merge, schema: T.StructType, *, key: str = "sku", version: int | None = None, n_buckets: int | None = None, id_column: str | None = None,
) -> tuple[int, DataFrame]:
    """Write the next version of a table from ``merge(old rows, batch rows)``, both of the touched buckets only.

    Returns the version and the rows it wrote, with whatever further columns ``merge`` gave them. ``merge`` must keep each row's key. Buckets without a row in the batch are
    neither read nor written: the new manifest points to where they are. ``version`` makes a stream's batch write under its own number; older versions alone are read.
    """
    spark = batch.sparkSession
    manifest = read_manifest(spark, root, before=version)
    if version is None:
        version = manifest.version + 1 if manifest else 1
    n = manifest.n_buckets if manifest and manifest.n_buckets else n_buckets or BUCKETS
    if not 0 < n <= MOST_BUCKETS:
        raise ValueError(f"a table has 1 to {MOST_BUCKETS} buckets")
    staged = work_path(spark, "bucket-batch")
    batch.withColumn("bucket", bucket_of(F.col(key), n)).write.parquet(staged)
    fresh = spark.read.parquet(staged)
    touched = {r["bucket"] for r in _bounded(fresh.select("bucket").distinct())}
    old = _rows(spark, root, manifest, schema, touched) if manifest else spark.createDataFrame([], schema)
    merged = merge(old, fresh.drop("bucket"))
    target = f"{root}/rows/version={version}"
    # With fewer buckets than partitions several tasks write one, each its own file; small ones meet in one task again (AQE).
    share = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(touched)))
    keyed = merged.withColumn("bucket", bucket_of(F.col(key), n)).repartition("bucket", F.pmod(F.hash(key), F.lit(share))).sortWithinPartitions("bucket")
    keyed.write.mode("overwrite").partitionBy("bucket").parquet(target)
    fields = [*merged.schema.fields, T.StructField("bucket", T.LongType())]
    written = spark.read.schema(T.StructType(fields)).parquet(target)
    highest = F.max(id_column) if id_column else F.lit(None)
    counts = {r["bucket"]: r for r in _bounded(written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), highest.cast("long").alias("top")))}
    rows = [(b, version, counts[b]["n"], counts[b]["top"], n) for b in sorted(counts)]
    if manifest:
        rows += [(b, v, manifest.n_rows[b], manifest.max_id[b], n) for b, v in manifest.wrote.items() if b not in touched]
    # A table that is emptied still says how many buckets it has.
    rows = rows or [(0, version, 0, None, n)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/version={version}")
    return version, written.drop("bucket")


def upsert_buckets(root: str, batch: DataFrame, schema: T.StructType, *, now: Column | None = None, version: int | None = None, n_buckets: int | None = None) -> tuple[int, DataFrame]:
    """``upsert_catalog`` with new ids, on the buckets that the batch touches. The rows returned have a ``status``; untouched buckets' rows, all kept, are not among them."""
    manifest = read_manifest(batch.sparkSession, root, before=version)
    highest = manifest.highest_id() if manifest else 0

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return upsert.assign_ids(upsert.upsert_catalog(old, new, now=now), highest=highest)

    return merge_buckets(root, batch, merge, schema, version=version, n_buckets=n_buckets, id_column="id")


def delete_from_buckets(root: str, doomed: DataFrame, schema: T.StructType, *, key: str = "sku", version: int | None = None) -> int:
    """Write a version without the rows whose key is in ``doomed``."""
    keys = doomed.select(key).distinct()
    return merge_buckets(root, keys, lambda old, gone: old.join(gone, key, "left_anti"), schema, key=key, version=version, id_column="id" if "id" in schema.names else None)[0]


def retire_buckets(spark: SparkSession, root: str, keep: int = 3) -> None:
    """Remove all complete manifests but the newest ``keep``, and then the rows that no manifest left points to.

    Rows of versions beyond the newest manifest belong to a writer that has not finished, and stay.
    """
    upsert.retire_versions(spark, root, keep)
    left = upsert.versions(spark, root)
    if not left:
        return
    kept: set[tuple[int, int]] = set()
    for v in left:
        manifest = read_manifest(spark, root, before=v + 1)
        kept |= {(w, b) for b, w in manifest.wrote.items()}
    fs, path = upsert._fs(spark, f"{root}/rows")
    for status in fs.listStatus(path):
        wrote = int(status.getPath().getName().split("=", 1)[1])
        if wrote > left[-1]:
            continue
        if wrote not in {w for w, _ in kept}:
            fs.delete(status.getPath(), True)
            continue
        for bucket in fs.listStatus(status.getPath()):
            name = bucket.getPath().getName()
            if name.startswith("bucket=") and (wrote, int(name.split("=", 1)[1])) not in kept:
                fs.delete(bucket.getPath(), True)
