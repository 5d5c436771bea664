"""JSON exports: readers that accept every envelope, and partitioned writers.

Files are read with an explicit schema, one document per line, as the writers here make them; Spark then splits large files. A JSON array
is split by Spark itself, so a document may be a list, an envelope or a single record. A file that is one document over many
lines is read with ``multi_line=True``; Spark would read the first of several documents there, so such a file is refused.
``read_structure`` tells what each document holds, broken lines included. Writers produce JSON lines in parallel next to a one-row metadata file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom import constants as K
from partloom import schemas as sc
from partloom.functions import values as vx
from partloom.operators import dedup, joins, quality
from partloom.session import work_path

BROKEN = "_corrupt_record"


def _documents(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None, multi_line: bool = False
) -> DataFrame:
    if multi_line:
        _refuse_several(spark, path, glob)
    reader = (
        spark.read.schema(schema.add(BROKEN, "string"))
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path).withColumn("source_file", F.col("_metadata.file_path"))


#: Strings, also in single quotes as Spark reads them, and brackets; an open string goes to the end.
_JSON_MARK = re.compile(r"""\"(?:[^"\\]++|\\.)*+"?|'(?:[^'\\]++|\\.)*+'?|[\[\]{}]""", re.DOTALL)


def _count_roots(raw: bytes) -> int:
    """How many objects and arrays a text holds side by side; what follows the last closed one counts as one more."""
    text = raw.decode(json.detect_encoding(raw), "replace").strip("\ufeff\x00 \t\r\n")
    if text[:1] not in ("{", "["):
        # The reader takes the whole file for broken.
        return min(len(text), 1)
    roots, depth, end = 0, 0, 0
    for mark in _JSON_MARK.finditer(text):
        if mark[0] in "{[":
            depth += 1
        elif mark[0] in "}]" and depth:
            depth -= 1
            if not depth:
                roots, end = roots + 1, mark.end()
    return roots + bool(text[end:].strip())


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [_count_roots(v.as_py() or b"") for v in batch.column("value")]
        yield pa.RecordBatch.from_pydict({"source_file": batch.column("source_file"), "n": pa.array(counts, pa.int64())})


def _refuse_several(spark: SparkSession, path: str, glob: str | None) -> None:
    """A file that holds more than one root value is no multi-line file: all but the first would be lost."""
    files = spark.read.option("pathGlobFilter", glob or "*").text(path, wholetext=True)
    held = files.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").cast("binary").alias("value"))
    several = held.mapInArrow(_roots, "source_file string, n long").where("n > 1").head(1)
    if several:
        raise ValueError(
            f"{several[0].source_file} holds {several[0].n} documents, of which one would be read: put each on a line and read it with multi_line=False"
        )


def _copy(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields))


def _items(documents: DataFrame, record: T.StructType, *containers: str) -> DataFrame:
    """One row per record from whichever container is filled; a bare record is its own container."""
    bare = F.when(_any_field(record), F.array(F.struct(*[F.col(f.name) for f in record.fields])))
    held = F.coalesce(*[F.col(c) for c in containers], bare)
    return documents.where(F.col(BROKEN).isNull()).select("source_file", F.posexplode(held).alias("pos", "r")).select(
        "source_file", "pos", "r.*"
    )


def _any_field(record: T.StructType) -> Column:
    found = F.lit(False)
    for f in record.fields:
        found = found | F.col(f.name).isNotNull()
    return found


def read_structure(spark: SparkSession, path: str, *, glob: str | None = None, multi_line: bool = False) -> DataFrame:
    """One row per document: source_file and container, one of parts, data, record, metadata (nothing else), none and broken."""
    documents = _documents(spark, path, _copy(sc.PARTS_DOCUMENT), glob, multi_line)
    container = (
        F.when(F.col(BROKEN).isNotNull(), "broken").when(F.col("parts").isNotNull(), "parts").when(F.col("data").isNotNull(), "data")
        .when(_any_field(sc.EXPORT_PART), "record").when(F.col("metadata").isNotNull(), "metadata").otherwise("none")
    )
    return documents.select("source_file", container.alias("container"))


def read_summaries(spark: SparkSession, path: str, *, glob: str | None = None) -> DataFrame:
    """Documents that hold only a run's summary, as (source_file, total_parts, unique_skus, deduplication_rate)."""
    summary = "summary struct<total_parts_found:bigint,unique_skus:bigint,deduplication_rate:double>"
    reader = spark.read.schema(summary)
    found = (reader.option("pathGlobFilter", glob) if glob else reader).json(path).where("summary IS NOT NULL")
    return found.select(
        F.col("_metadata.file_path").alias("source_file"), F.coalesce("summary.total_parts_found", F.lit(0)).alias("total_parts"),
        F.coalesce("summary.unique_skus", F.lit(0)).alias("unique_skus"), F.coalesce("summary.deduplication_rate", F.lit(0.0)).alias("deduplication_rate"),
    )


def read_parts_export(
    spark: SparkSession, path: str, *, glob: str | None = None, check: bool = True, multi_line: bool = False
) -> DataFrame:
    """Parts of exports in any envelope, in stored form. Records that fail the model and broken documents are left out.

    Documents without any part give no row; ``read_structure`` lists them and the broken ones.
    """
    documents = _documents(spark, path, _copy(sc.PARTS_DOCUMENT), glob, multi_line)
    rows = _items(documents, sc.EXPORT_PART, "parts", "data")
    if not check:
        return rows
    return quality.normalize_parts(quality.sound_parts(rows))


def _sku_maps(spark: SparkSession, path: str, glob: str | None, multi_line: bool) -> DataFrame:
    """Entries of documents that map a sku to its vehicles; the keys of every other document are no skus."""
    reader = spark.read.option("wholetext", multi_line)
    texts = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    kind = T.MapType(T.StringType(), T.ArrayType(sc.VEHICLE))
    found = texts.where(F.col("value").rlike(rf'^\s*\{{\s*"(?i:{K.SKU_PREFIX})')).select(
        F.col("_metadata.file_path").alias("source_file"), F.explode(F.from_json("value", kind)).alias("part_sku", "vehicles")
    )
    return found.where(F.startswith(F.upper("part_sku"), F.lit(K.SKU_PREFIX)))


def read_compat_export(
    spark: SparkSession, path: str, *, glob: str | None = None, check: bool = True, multi_line: bool = False
) -> DataFrame:
    """Fitments of exports in any envelope, or of documents that map a sku to its vehicles, one row per vehicle."""
    documents = _documents(spark, path, _copy(sc.COMPAT_DOCUMENT), glob, multi_line)
    rows = _items(documents, sc.EXPORT_COMPAT, "compatibility", "data")
    rows = rows.withColumn("part_sku", F.coalesce("part_sku", "sku")).drop("sku")
    rows = rows.unionByName(_sku_maps(spark, path, glob, multi_line), allowMissingColumns=True)
    if check:
        judged = quality.check_compat(rows)
        rows = judged.where(F.size("issues") == 0).drop("issues")
    return rows.select(
        "source_file", F.upper("part_sku").alias("sku"), "notes", F.posexplode("vehicles").alias("vehicle_pos", "v")
    ).select("source_file", "sku", "notes", "vehicle_pos", "v.*")


def read_hierarchical_export(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Leaf rows of a nested year/make/model export."""
    documents = _documents(spark, path, _copy(sc.HIERARCHY_DOCUMENT), None, multi_line)
    years = documents.select("source_file", F.explode("data").alias("year", "makes"))
    makes = years.select("source_file", "year", F.explode("makes").alias("make", "models"))
    models = makes.select("source_file", "year", "make", F.explode("models").alias("model", "parts"))
    return models.select("source_file", "year", "make", "model", F.posexplode("parts").alias("leaf_pos", "p")).select(
        "source_file", "year", "make", "model", "leaf_pos", "p.*"
    )


def read_export_dir(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Parts of every JSON file in a directory, duplicates kept, with the file each came from."""
    return read_parts_export(spark, path, glob="*.json", check=False, multi_line=multi_line)


def read_metadata(spark: SparkSession, path: str, *, glob: str | None = None, multi_line: bool = False) -> DataFrame:
    """Metadata row of each document that has one."""
    documents = _documents(spark, path, _copy(sc.PARTS_DOCUMENT), glob, multi_line)
    return documents.where(F.col("metadata").isNotNull()).select("source_file", "metadata.*")


def latest_drop(spark: SparkSession, path: str, import_log: DataFrame | None = None) -> DataFrame:
    """The newest JSON file of a drop directory; no row when that very file was the last one imported.

    Only paths, lengths and times are read, never the content.
    """
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
        .select("path", "modificationTime", "length")
    )
    newest = listing.agg(F.max_by(F.struct("path", "length"), F.struct("modificationTime", "path")).alias("f")).select("f.*")
    newest = newest.where(F.col("path").isNotNull())
    if import_log is None:
        return newest
    last = import_log.agg(F.max_by("filename", "completed_at").alias("path"))
    return newest.join(last, "path", "left_anti")


def export_audit(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Size, metadata and validity of every export file in a directory."""
    sizes = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
        .select(F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), F.col("length").alias("size_bytes"))
    )
    documents = _documents(spark, path, _copy(sc.PARTS_DOCUMENT), "*.json", multi_line)
    meta = documents.groupBy(F.regexp_extract("source_file", "([^/]+)$", 1).alias("filename")).agg(
        F.max("metadata.export_date").alias("export_date"),
        F.max("metadata.total_parts").alias("total_parts"),
        F.max("metadata.version").alias("version"),
        F.max(F.col(BROKEN).isNotNull()).alias("_broken"),
    )
    return sizes.join(meta, "filename", "left").select(
        "filename", "size_bytes", F.round(F.col("size_bytes") / (1024 * 1024), 2).alias("size_mb"), "export_date",
        F.coalesce("total_parts", F.lit(0)).alias("total_parts"), "version",
        (~F.coalesce("_broken", F.lit(True))).alias("valid_json"),
    )


def judge_directory(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Sniff the kind of every file and judge its items: one verdict row per file."""
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("filename")
    raw = (
        spark.read.schema("parts string, compatibility string, data string, _corrupt_record string")
        .option("multiLine", multi_line).option("pathGlobFilter", "*.json").json(path)
        .select("*", name)
    )
    kind = (
        F.when(F.col(BROKEN).isNotNull(), "unreadable")
        .when(F.col("parts").isNotNull(), "parts")
        .when(F.col("compatibility").isNotNull(), "compatibility")
        .when(F.startswith(F.ltrim("data"), F.lit("{")), "hierarchical")
        .otherwise("unknown")
    )
    kinds = raw.groupBy("filename").agg(F.max(kind).alias("kind"))
    level = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    filename = F.regexp_extract("source_file", "([^/]+)$", 1).alias("filename")
    counts = [level(quality.ERROR).alias("errors"), level(quality.WARNING).alias("warnings")]
    parts = quality.check_parts(
        _items(_documents(spark, path, _copy(sc.PARTS_DOCUMENT), "*.json", multi_line), sc.EXPORT_PART, "parts"),
        warnings=True,
    ).select(filename, F.lit("parts").alias("kind"), *counts)
    compat = quality.check_compat(
        _items(_documents(spark, path, _copy(sc.COMPAT_DOCUMENT), "*.json", multi_line), sc.EXPORT_COMPAT, "compatibility")
    ).select(filename, F.lit("compatibility").alias("kind"), *counts)
    leaves = quality.check_parts(read_hierarchical_export(spark, f"{path}/*.json", multi_line=multi_line), warnings=True).select(
        filename, F.lit("hierarchical").alias("kind"), *counts
    )
    # Counted per file before the join: a large file is many rows of one key only up to the partial counts.
    items = parts.unionByName(compat).unionByName(leaves).groupBy("filename", "kind").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("errors") == 0).alias("valid"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings")
    )
    return quality.check_files(kinds.join(items, ["filename", "kind"], "left"))


# --- writers --------------------------------------------------------------------------------------------------------


def export_rows(parts: DataFrame) -> DataFrame:
    """Parts as they are written: the price is text."""
    return parts.withColumn("price", vx.price_text(F.col("price")))


def _stamp() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def _write(rows: DataFrame, path: str, count_field: str, count: Column | None = None, partition_by: tuple[str, ...] = (), **extra: str) -> int:
    """Write rows, counting them on the way, then the metadata. The input is evaluated once."""
    seen = Observation()
    counted = rows.observe(seen, (count if count is not None else F.count(F.lit(1))).alias("n"))
    counted.write.mode("overwrite").partitionBy(*partition_by).json(f"{path}/rows")
    n = int(seen.get["n"] or 0)
    metadata = rows.sparkSession.range(1).select(
        _stamp().alias("export_date"), F.lit(n).cast("long").alias(count_field), F.lit(K.EXPORT_VERSION).alias("version"),
        *[F.lit(v).alias(k) for k, v in extra.items()],
    )
    metadata.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return n


def write_parts(parts: DataFrame, path: str) -> None:
    _write(export_rows(parts), path, "total_parts")


def compat_rows(fitments: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per sku with its vehicles; feed it deduplicated fitments."""
    return joins.group_fitments(fitments, order).withColumnRenamed("sku", "part_sku")


def write_compat(fitments: DataFrame, path: str, order: list[str] | None = None) -> None:
    _write(compat_rows(fitments, order), path, "total_mappings")


def hierarchical_rows(fitments: DataFrame, parts: DataFrame) -> DataFrame:
    """Year, make, model and the part, one row per vehicle and part."""
    return joins.fitment_to_parts(fitments.select("sku", "year", "make", "model"), export_rows(parts))


def write_hierarchical(fitments: DataFrame, parts: DataFrame, path: str) -> None:
    """Rows in year, make, model order, one folder per year.

    Nesting them into one document would gather whole branches in one task. The rows are range-partitioned instead, with
    the sku as last key, so a vehicle that holds much of the catalog is cut over several tasks and files stay sorted.
    """
    keys = ("year", "make", "model", "sku")
    rows = hierarchical_rows(fitments, parts)
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The distinct years are as many as there are model years.
    _write(ordered, path, "total_years", F.size(F.collect_set("year")), ("year",), structure=K.HIERARCHY_STRUCTURE)


def complete_rows(parts: DataFrame, fitments: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Parts with their vehicles inline; an empty list when there are none."""
    return joins.attach_fitment(export_rows(parts), joins.group_fitments(fitments, order))


def write_complete(parts: DataFrame, fitments: DataFrame, path: str, order: list[str] | None = None) -> None:
    _write(complete_rows(parts, fitments, order), path, "total_parts")


def write_delta(parts: DataFrame, changes: DataFrame, path: str) -> bool:
    """Write the new and changed parts; nothing is written, and false returned, when there are none."""
    staged = work_path(parts.sparkSession, "delta-rows")
    joins.delta_rows(parts, changes).write.parquet(staged)
    rows = parts.sparkSession.read.parquet(staged)
    if rows.isEmpty():
        return False
    write_parts(rows, path)
    return True


def appended(existing: DataFrame, batch: DataFrame, key: str = "sku", order: list[str] | None = None) -> DataFrame:
    """Last write wins: the batch replaces existing rows with the same key. ``order`` decides inside the batch."""
    latest = dedup.last_per_key(batch, (key,), order) if order else batch
    latest = latest.select(*[c for c in latest.columns if c in existing.columns])
    kept = existing.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def current_export(spark: SparkSession, path: str) -> str:
    """The folder with the newest complete rows and metadata of an export: its last appended version, else the export itself."""
    from partloom.operators.upsert import versions

    found = versions(spark, path, marker="metadata/_SUCCESS")
    return f"{path}/version={found[-1]}" if found else path


def append_export(batch: DataFrame, path: str, schema: T.StructType, key: str = "sku", order: list[str] | None = None) -> str:
    """Merge a batch into a written export, which has to exist, and return the folder of the result.

    The merged export is a new version beside the others, rows first and metadata last; it counts once the marker of its metadata is
    there. So a reader never sees half an export, and an append that died is simply done again over the version before it. The
    version that was read and the new one stay, older ones are removed.
    """
    from partloom.operators.upsert import _fs, retire_versions, versions

    spark = batch.sparkSession
    source = current_export(spark, path)
    fs, rows = _fs(spark, f"{source}/rows/_SUCCESS")
    if not fs.exists(rows):
        raise ValueError(f"cannot append to missing export: {path}")
    version = (versions(spark, path, marker="metadata/_SUCCESS") or [0])[-1] + 1
    target = f"{path}/version={version}"
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(target), True)
    existing = spark.read.schema(schema).json(f"{source}/rows")
    # The batch is asked for its keys and for its rows; without a stored copy it would be made twice. Columns without a type hold nothing.
    staged, typed = work_path(spark, "append-batch"), [f.name for f in batch.schema.fields if f.dataType != T.NullType()]
    fresh = batch.select(*[c for c in typed if c in existing.columns or c in (order or [])])
    fresh.write.parquet(staged)
    _write(appended(existing, spark.read.schema(fresh.schema).parquet(staged), key, order), target, "total_parts" if key == "sku" else "total_mappings")
    retire_versions(spark, path, keep=2, marker="metadata/_SUCCESS")
    return target
