"""Incremental runs as file streams.

Each job hands its micro-batches to a function that writes under the batch's own id. A batch that is replayed after a
failure overwrites what it wrote before and reads only what older batches wrote, so every job is exactly-once. State is
kept in Parquet tables in the shared folder: any executor may be lost at any time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from partloom import schemas as sc
from partloom.functions import values as vx
from partloom.operators import aggregates, buckets, dedup, joins, upsert
from partloom.sources import exports

Handler = Callable[[DataFrame, int], None]


def read_files(spark: SparkSession, path: str, schema: T.StructType, *, kind: str = "parquet", per_batch: int | None = None, **options: str) -> DataFrame:
    """A stream over the files of a directory; each file is read once."""
    reader = spark.readStream.schema(schema).options(**options)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.format(kind).load(path)


def run_available(stream: DataFrame, handler: Handler, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived, in micro-batches, and stop. Start it again for later arrivals."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handler)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _batches(spark: SparkSession, root: str, before: int) -> list[int]:
    """Ids of the complete batches a table holds, older than ``before``."""
    fs, path = upsert._fs(spark, root)
    if not fs.exists(path):
        return []
    marker = spark._jvm.org.apache.hadoop.fs.Path
    ids = [
        int(s.getPath().getName().split("=", 1)[1])
        for s in fs.listStatus(path)
        if s.getPath().getName().startswith("batch_id=") and fs.exists(marker(s.getPath(), "_SUCCESS"))
    ]
    return sorted(i for i in ids if i < before)


def _read_batches(spark: SparkSession, root: str, ids: list[int]) -> DataFrame | None:
    if not ids:
        return None
    return spark.read.option("basePath", root).parquet(*[f"{root}/batch_id={i}" for i in ids])


def _older(spark: SparkSession, rows: str, base: str, batch_id: int) -> DataFrame | None:
    """Rows of all batches older than ``batch_id``, by way of the newest base that is older: it stands for all batches before its own."""
    bases = _batches(spark, base, batch_id)
    start = bases[-1] if bases else 0
    frames = [_read_batches(spark, rows, [i for i in _batches(spark, rows, batch_id) if i >= start])]
    if bases:
        frames.append(spark.read.parquet(f"{base}/batch_id={start}").withColumn("batch_id", F.lit(start - 1)))
    frames = [f.withColumn("batch_id", F.col("batch_id").cast("long")) for f in frames if f is not None]
    if not frames:
        return None
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return dedup.concat_exports(*[f.select(*shared) for f in frames])


def _retire_bases(spark: SparkSession, base: str, batch_id: int) -> None:
    """Remove bases that no batch from here on reads, nor this one when it is replayed."""
    fs, _ = upsert._fs(spark, base)
    for old in _batches(spark, base, batch_id)[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/batch_id={old}"), True)


# --- page changes ---------------------------------------------------------------------------------------------------


def page_changes(root: str, *, version: str = "page_id", compact_every: int = 20) -> Handler:
    """Per url, keep a page only when it is new or its content hash differs from the last one kept.

    What was kept is the state: older batches' rows say what each url last looked like. Every ``compact_every`` batches
    the latest row per url is written as a base, so the state to read does not grow with the number of batches. A batch reads only
    what is older than itself, its own base too, so a replay finds what the first run found.
    """
    changes, base = f"{root}/changes", f"{root}/base"

    def known(spark: SparkSession, batch_id: int) -> DataFrame | None:
        seen = _older(spark, changes, base, batch_id)
        if seen is None:
            return None
        return seen.groupBy("url").agg(F.max_by("hash", "batch_id").alias("_stored"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("hash", vx.page_hash(F.col("html"))).drop("html")
        latest = dedup.last_per_key(hashed, ("url",), [version])
        stored = known(spark, batch_id)
        if stored is not None:
            if compact_every and batch_id % compact_every == 0:
                stored.select("url", F.col("_stored").alias("hash")).write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")
                _retire_bases(spark, base, batch_id)
            joined = latest.join(stored, "url", "left")
            latest = joined.where(~F.col("hash").eqNullSafe(F.col("_stored"))).drop("_stored")
        latest.write.mode("overwrite").parquet(f"{changes}/batch_id={batch_id}")

    return handle


def read_page_changes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/changes")


# --- imports --------------------------------------------------------------------------------------------------------


def import_drops(root: str, *, schema: T.StructType = sc.CATALOG, n_buckets: int | None = None) -> Handler:
    """Upsert each dropped export into the catalog in buckets; a batch writes the version of its own number, and of it only the buckets it touches.

    When several dropped files hold a sku, the newest file's record counts. Outcomes are kept per batch.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = f"{root}/catalog"
        records = batch.select("file_time", "source_file", "sku", "name", "category", "description", "manufacturer",
                               vx.price_of(F.col("price")).alias("price"))
        usable = records.where(F.coalesce("sku", F.lit("")) != "")
        latest = dedup.last_per_key(usable, ("sku",), ["file_time", "source_file", "name"]).drop("file_time", "source_file")
        _, written = buckets.upsert_buckets(table, latest, schema, version=batch_id + 1, n_buckets=n_buckets)
        aggregates.import_outcome(written.select("status")).write.mode("overwrite").parquet(f"{root}/outcome/batch_id={batch_id}")
        buckets.retire_buckets(spark, table)

    return handle


def read_drops(spark: SparkSession, path: str, *, per_batch: int = 1) -> DataFrame:
    """Exports arriving in a drop directory, one document per line, as flat records with their file."""
    stream = read_files(spark, path, sc.PARTS_DOCUMENT, kind="json", per_batch=per_batch)
    kept = [f.name for f in sc.EXPORT_PART.fields]
    held = F.coalesce("parts", "data", F.array(F.struct(*kept)))
    return stream.select(
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("source_file"),
        F.explode(held).alias("r"),
    ).select("file_time", "source_file", "r.*")


# --- dedup ----------------------------------------------------------------------------------------------------------


def dedup_listings(root: str, order: list[str], *, keep_changes: bool = True, n_buckets: int | None = None) -> Handler:
    """Fold listing rows (part columns, vehicle columns, order columns) into deduplicated parts and fitments.

    Later batches win for parts, earlier ones for fitments. New and changed skus are judged against the parts of older
    batches. Both tables are in buckets by sku: a batch reads and writes those of its own skus.
    """
    vehicle = [c for c in dedup.FITMENT_KEY if c != "sku"] + ["aspiration", "qualifiers"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        part_columns = [c for c in batch.columns if c not in vehicle]
        fresh = dedup.dedup_parts(batch.select(*part_columns), order).drop(*order)
        seen = dedup.dedup_fitments(batch.select("sku", *vehicle, *order), order).withColumn("generation", F.lit(version))

        def newer(before: DataFrame, parts: DataFrame) -> DataFrame:
            if keep_changes:
                changes = dedup.detect_changes(batch.select(*part_columns).drop(*order), before)
                changes.write.mode("overwrite").parquet(f"{root}/changes/batch_id={batch_id}")
            return exports.appended(before, parts)

        def older(known: DataFrame, fitments: DataFrame) -> DataFrame:
            # Both are deduplicated and what is known is older: it stays as it is, and only its keys meet the new rows.
            keys = known.select(*[F.col(c).alias(f"_{c}") for c in dedup.FITMENT_KEY])
            same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in dedup.FITMENT_KEY])
            return known.unionByName(fitments.join(keys, same, "left_anti"))

        for table, rows, merge in ((f"{root}/parts", fresh, newer), (f"{root}/fitments", seen, older)):
            buckets.merge_buckets(table, rows, merge, rows.schema, version=version, n_buckets=n_buckets)
            buckets.retire_buckets(batch.sparkSession, table)

    return handle


# --- failures -------------------------------------------------------------------------------------------------------


def failure_counts(stream: DataFrame) -> DataFrame:
    """Running counts per phase. Phases are a small fixed set, so the state stays small without a watermark."""
    return stream.groupBy("phase").agg(
        F.count(F.lit(1)).alias("failures"),
        F.count_if("is_retryable").alias("retryable"),
        F.count_if(~F.col("is_retryable")).alias("permanent"),
    )


def keep_latest(root: str) -> Handler:
    """Write each batch's complete result as the table's next version."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        upsert.write_version(batch, root, batch_id + 1)
        upsert.retire_versions(batch.sparkSession, root)

    return handle


# --- deltas ---------------------------------------------------------------------------------------------------------


def publish_deltas(root: str, baseline: Callable[[SparkSession], DataFrame], order: list[str], *, compact_every: int = 20) -> Handler:
    """Write the new and changed parts of each batch to its own folder; a batch without any writes nothing.

    ``baseline`` gives the parts published before the stream began; older batches' deltas replace their rows. Every ``compact_every`` batches
    the latest row per sku of all older deltas is written as a base, so a batch does not read all deltas again.
    """
    published, base = f"{root}/published", f"{root}/published-base"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        older = _older(spark, published, base, batch_id)
        before = baseline(spark)
        columns = before.columns
        if older is not None:
            latest = dedup.last_per_key(older.select("sku", *[c for c in columns if c != "sku"], "batch_id"), ("sku",), ["batch_id"])
            if compact_every and batch_id % compact_every == 0:
                latest.drop("batch_id").write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")
                _retire_bases(spark, base, batch_id)
            before = exports.appended(before, latest.select(*columns))
        changes = dedup.detect_changes(batch.drop(*order), before)
        parts = dedup.dedup_parts(batch, order).select(*columns)
        joins.delta_rows(parts, changes).write.mode("overwrite").parquet(f"{published}/batch_id={batch_id}")
        written = spark.read.schema(parts.schema).parquet(f"{published}/batch_id={batch_id}")
        if not written.isEmpty():
            exports.write_parts(written, f"{root}/delta/batch_id={batch_id}")

    return handle
