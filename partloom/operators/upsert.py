"""Upserts of the catalog, the image manifest and the stored tables behind them.

Plain Parquet has no MERGE, so an upsert is a full outer join on the key that writes a new version of what it was given; ``buckets`` gives it
the hash buckets that a batch touches only. A version becomes current only when its marker file is written, so a job that dies half way leaves the old one in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom import constants as K
from partloom.functions import values as vx
from partloom.operators.paging import with_position
from partloom.session import work_path


def _comparable(df: DataFrame, name: str) -> Column:
    """A field as it is compared: prices at two places, nested values by content, missing text equal to empty text."""
    kind = df.schema[name].dataType
    col = F.col(name)
    if name == "price":
        return col.cast("decimal(10,2)").cast("string")
    if isinstance(kind, T.MapType):
        return F.to_json(vx.sorted_entries(col))
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(col)
    return F.coalesce(col.cast("string"), F.lit(""))


def row_digest(df: DataFrame, fields: list[str]) -> Column:
    return vx.content_hash({name: _comparable(df, name) for name in fields})


def upsert_catalog(
    catalog: DataFrame, batch: DataFrame, *, now: Column | None = None, compare: list[str] | None = None
) -> DataFrame:
    """Next version of the catalog with a ``status`` per row.

    ``created``, ``updated`` and ``unchanged`` rows are those of the batch; ``kept`` rows were not in it. Updated rows
    take every batch field. An unchanged row only moves its ``last_synced``. ``batch`` holds each sku once. By default
    ``scraped_at`` is not compared, since it differs on every crawl; pass ``compare`` to decide otherwise.
    """
    now = now if now is not None else F.current_timestamp()
    shared = [c for c in batch.columns if c in catalog.columns and c != "id"]
    fields = compare or [c for c in K.CONTENT_FIELDS if c in shared and c != "scraped_at"]
    old = catalog.select(
        F.col("sku"), F.struct(*catalog.columns).alias("_old"), row_digest(catalog, fields).alias("_old_hash")
    )
    new = batch.select(
        F.col("sku"), F.struct(*shared).alias("_new"), row_digest(batch, fields).alias("_new_hash")
    )
    status = (
        F.when(F.col("_new").isNull(), "kept")
        .when(F.col("_old").isNull(), "created")
        .when(F.col("_old_hash") == F.col("_new_hash"), "unchanged")
        .otherwise("updated")
    )
    joined = old.join(new, "sku", "full_outer").withColumn("status", status)
    writes = F.col("status").isin("created", "updated")
    columns = []
    for name in catalog.columns:
        previous = F.col(f"_old.{name}")
        if name == "sku":
            value = F.col("sku")
        elif name == "last_synced":
            value = F.when(F.col("status") != "kept", now).otherwise(previous)
        elif name == "created_at":
            value = F.when(F.col("status") == "created", now).otherwise(previous)
        elif name == "updated_at":
            value = F.when(writes, now).otherwise(previous)
        elif name == "id":
            value = previous
        elif name in shared:
            value = F.when(writes, F.col(f"_new.{name}")).otherwise(previous)
        else:
            value = previous
        columns.append(value.alias(name))
    return joined.select(*columns, "status")


def assign_ids(merged: DataFrame, *, highest: int | None = None) -> DataFrame:
    """Number the created rows after the highest id in use, in sku order, without gaps.

    ``highest`` is that id where ``merged`` is a part of the table only. The merged rows are staged once; only the skus of created rows are sorted, and their numbers are joined back.
    """
    staged = work_path(merged.sparkSession, "merged")
    merged.write.parquet(staged)
    fixed = merged.sparkSession.read.parquet(staged)
    created = fixed.where(F.col("id").isNull())
    numbers = with_position(created.select("sku"), "sku", name="_number")
    top = F.lit(highest) if highest is not None else fixed.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    columns = [(top + F.col("_number") + 1).alias("id") if c == "id" else F.col(c) for c in merged.columns]
    return fixed.where(F.col("id").isNotNull()).unionByName(created.join(numbers, "sku").select(*columns))


def update_manifest(manifest: DataFrame, fetched: DataFrame) -> DataFrame:
    """Next image manifest with a ``change`` per file.

    ``fetched`` has filename, source_hash, etag and error. An equal hash keeps the entry (its etag may still be new and
    it has to be synced again); another hash or a new file resets the sync state; an error makes the state failed.
    """
    new = fetched.select(
        "filename", F.lit(True).alias("_seen"), F.col("source_hash").alias("_hash"), F.col("etag").alias("_etag"),
        F.col("error").alias("_error"),
    )
    joined = manifest.withColumn("_known", F.lit(True)).join(new, "filename", "full_outer")
    change = (
        F.when(F.col("_seen").isNull(), "kept")
        .when(F.col("_error").isNotNull(), "failed")
        .when(F.col("_known").isNull(), "new")
        .when(F.col("source_hash").eqNullSafe(F.col("_hash")), "unchanged")
        .otherwise("changed")
    )
    kept, failed = F.col("change") == "kept", F.col("change") == "failed"
    pick = lambda old, new: F.when(kept, F.col(old)).when(~failed, F.col(new))
    return joined.withColumn("change", change).select(
        "filename",
        pick("source_hash", "_hash").alias("source_hash"),
        pick("etag", "_etag").alias("etag"),
        F.when(kept, F.col("synced")).when(failed, "failed").otherwise("false").alias("synced"),
        F.when(kept, F.col("error")).otherwise(F.col("_error")).alias("error"),
        "change",
    )


def read_legacy_manifest(entries: DataFrame) -> DataFrame:
    """Manifest rows from (filename, value) JSON text. A bare string is a hash of an entry that was never synced."""
    parsed = F.from_json("value", "source_hash string, etag string, synced string, error string")
    bare = F.startswith(F.trim("value"), F.lit('"'))
    legacy = F.btrim(F.trim("value"), F.lit('"'))
    known = entries.where(bare | F.startswith(F.trim("value"), F.lit("{")))
    return known.select(
        "filename",
        F.when(bare, legacy).otherwise(parsed.source_hash).alias("source_hash"),
        F.when(~bare, parsed.etag).alias("etag"),
        F.when(bare, "false").otherwise(F.coalesce(parsed.synced, F.lit("false"))).alias("synced"),
        F.when(~bare, parsed.error).alias("error"),
    )


def mark_synced(manifest: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Entries whose file was uploaded become synced."""
    done = uploaded.select("filename").distinct().withColumn("_done", F.lit(True))
    return manifest.join(done, "filename", "left").withColumn(
        "synced", F.when(F.col("_done"), "true").otherwise(F.col("synced"))
    ).drop("_done")


def reset_synced(manifest: DataFrame) -> DataFrame:
    """Forget what was synced, so that every file goes out again."""
    return manifest.withColumn("synced", F.lit("false"))


def delete_parts(catalog: DataFrame, doomed: DataFrame) -> DataFrame:
    """The catalog without the listed ids."""
    return catalog.join(doomed.select("id").distinct(), "id", "left_anti")


def clear_parts(catalog: DataFrame) -> DataFrame:
    return catalog.limit(0)


def evolve_schema(catalog: DataFrame, target: T.StructType) -> DataFrame:
    """Bring rows of an older version to the current schema: columns it lacks are added as null."""
    have = set(catalog.columns)
    return catalog.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


# --- versioned tables -----------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def versions(spark: SparkSession, root: str, marker: str = "_SUCCESS") -> list[int]:
    """Complete versions of a table: those whose writer got as far as its success marker."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), marker)):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def write_version(df: DataFrame, root: str, version: int | None = None) -> int:
    """Write the next version beside the current one. Writing a version again replaces it, so retries are harmless."""
    spark = df.sparkSession
    if version is None:
        version = (versions(spark, root) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    return version


def retire_versions(spark: SparkSession, root: str, keep: int = 3, marker: str = "_SUCCESS") -> None:
    """Remove all complete versions but the newest ``keep``. A batch that is replayed reads the version before its own."""
    fs, _ = _fs(spark, root)
    for version in versions(spark, root, marker)[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version={version}"), True)


def read_version(
    spark: SparkSession, root: str, schema: T.StructType, *, before: int | None = None
) -> DataFrame | None:
    """The newest complete version (or the newest older than ``before``), brought to ``schema``; of a table in buckets, too."""
    from partloom.operators import buckets

    if buckets.is_bucketed(spark, root):
        return buckets.read_buckets(spark, root, schema, before=before)
    usable = [v for v in versions(spark, root) if before is None or v < before]
    if not usable:
        return None
    return evolve_schema(spark.read.parquet(f"{root}/version={usable[-1]}"), schema)


# --- run checkpoints ------------------------------------------------------------------------------------------------

CHECKPOINT_TABLES = ("processed", "parts", "fitments", "failures")


def save_checkpoint(root: str, run_id: str, tables: dict[str, DataFrame]) -> None:
    """Write the state of a run as a new version, one folder per table. ``processed`` goes last and marks the version complete.

    A save that dies half way leaves the one before it as it was. The newest two stay.
    """
    spark = next(iter(tables.values())).sparkSession
    base, done = f"{root}/run_id={run_id}", "processed/_SUCCESS"
    version = (versions(spark, base, done) or [0])[-1] + 1
    fs, target = _fs(spark, f"{base}/version={version}")
    fs.delete(target, True)
    for name in sorted(tables, key=lambda n: n == "processed"):
        tables[name].write.mode("overwrite").parquet(f"{base}/version={version}/{name}")
    retire_versions(spark, base, keep=2, marker=done)


def restore_checkpoint(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """Read a run's newest complete state. Without processed ids there is nothing to resume from; other tables are optional."""
    found = versions(spark, f"{root}/run_id={run_id}", "processed/_SUCCESS")
    if not found:
        raise ValueError(f"checkpoint {run_id} has no processed ids")
    base, out = f"{root}/run_id={run_id}/version={found[-1]}", {}
    for name in CHECKPOINT_TABLES:
        fs, path = _fs(spark, f"{base}/{name}/_SUCCESS")
        if fs.exists(path):
            out[name] = spark.read.parquet(f"{base}/{name}")
    return out
