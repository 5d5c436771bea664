"""Sources and sinks: every query writes the derived tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom import schemas as sc
from partloom.operators import dedup
from partloom.registry import query
from partloom.registry.base import sql, title
from partloom.registry.changes import _CHANGES, _VEHICLES, vehicles_digest
from partloom.session import work_path
from partloom.sources import adapters as A
from partloom.sources import exports

ORDER = list(A.ORDER)
WRITTEN_PART = sc.EXPORT_PART


def _fits(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_fitments(A.fitments(spark, sf), ORDER)


def _as_record(parts: DataFrame) -> Column:
    """A part row as the record an export file holds."""
    fields = []
    for f in sc.EXPORT_PART.fields:
        given = F.col(f.name) if f.name in parts.columns else F.lit(None)
        fields.append(given.cast(f.dataType).alias(f.name))
    return F.struct(*fields)


def _envelopes(parts: DataFrame, key: Column, path: str) -> None:
    """Write one JSON document per line, in turn as a parts envelope, a data envelope and a bare record."""
    record = _as_record(parts)
    date = F.lit("2025-10-28T00:00:00+00:00").alias("export_date")
    meta = F.struct(date, F.lit(1).cast("long").alias("total_parts"), F.lit("1.0").alias("version"))
    document = (
        F.when(key % 3 == 0, F.to_json(F.struct(meta.alias("metadata"), F.array(record).alias("parts"))))
        .when(key % 3 == 1, F.to_json(F.struct(F.array(record).alias("data"))))
        .otherwise(F.to_json(record))
    )
    parts.select(document.alias("value")).write.mode("overwrite").text(path)


# Rows of `raw` that pass the part model, and their stored form. Prices are text; 'None' reads as no price.
_NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
_GOOD = f"""upper(trim(sku)) LIKE 'CSF-%' AND trim(name) <> '' AND trim(category) <> '' AND NOT (has_image AND bad_image)
  AND NOT (has_ref AND bad_ref)"""
_PRICED = f"""(price IS NULL OR price = 'None' OR (regexp_matches(price, {_NUMBER}) AND TRY_CAST(price AS DOUBLE) > 0
  AND TRY_CAST(price AS DOUBLE) <= 50000 AND TRY_CAST(price AS DECIMAL(30,6)) = round(TRY_CAST(price AS DECIMAL(30,6)), 2)))"""


@query(
    "S1_read_parts_export",
    sql(
        f"""SELECT upper(trim(sku)) AS sku, trim(name) AS name, TRY_CAST(price AS DOUBLE) AS price, {title("trim(category)")} AS category,
        count(*) AS n FROM raw WHERE {_GOOD} AND {_PRICED} GROUP BY ALL""",
        "raw",
    ),
)
def s1(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "parts-export")
    raw = A.raw_parts(spark, sf)
    _envelopes(raw, F.regexp_extract("row_key", r"^(\d+)", 1).cast("long"), path)
    read = exports.read_parts_export(spark, path)
    return read.groupBy("sku", "name", F.col("price").cast("double").alias("price"), "category").agg(F.count(F.lit(1)).alias("n"))


@query("S2_read_compat_export", sql("SELECT sku, make, model, year, engine FROM fit1", "fit1"))
def s2(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by turns as compatibility envelope, data envelope, bare record and map from the sku to its vehicles."""
    path = work_path(spark, "compat-export")
    rows = exports.compat_rows(_fits(spark, sf))
    entry = F.struct("part_sku", "vehicles")
    key = F.regexp_replace("part_sku", "^CSF-", "").cast("long")
    document = (
        F.when(key % 4 == 0, F.to_json(F.struct(F.array(entry).alias("compatibility"))))
        .when(key % 4 == 1, F.to_json(F.struct(F.array(entry).alias("data"))))
        .when(key % 4 == 2, F.to_json(F.create_map("part_sku", "vehicles")))
        .otherwise(F.to_json(entry))
    )
    rows.select(document.alias("value")).write.mode("overwrite").text(path)
    return exports.read_compat_export(spark, path).select("sku", "make", "model", "year", "engine")


@query("S3_read_export_dir", sql("SELECT sku, count(*) AS n FROM (SELECT sku FROM prev UNION ALL SELECT sku FROM cur) GROUP BY sku", "prev", "cur"))
def s3(spark: SparkSession, sf: str) -> DataFrame:
    """Two exports in one directory; parts in both are read twice."""
    path = work_path(spark, "export-dir")
    for which in ("previous", "current"):
        A.snapshot(spark, sf, which).select("sku", "name", "category").write.mode("append").json(path)
    return exports.read_export_dir(spark, path).groupBy("sku").agg(F.count(F.lit(1)).alias("n"))


@query("S4_latest_drop", "SELECT CAST(1 AS BIGINT) AS first_run, CAST(0 AS BIGINT) AS second_run FROM part HAVING count(*) > 0")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    """The newest drop is offered once: after it was imported, nothing is left to do."""
    path = work_path(spark, "drops")
    A.catalog(spark, sf).select("sku", "name").write.json(path)
    A.catalog(spark, sf).select("sku", "category").write.mode("append").json(path)
    first = exports.latest_drop(spark, path)
    log = first.select(F.col("path").alias("filename"), F.current_timestamp().alias("completed_at"))
    second = exports.latest_drop(spark, path, log)
    runs = first.select(F.lit("first_run").alias("run")).unionByName(second.select(F.lit("second_run").alias("run")))
    return runs.agg(*[F.count_if(F.col("run") == r).alias(r) for r in ("first_run", "second_run")])


@query("S1_read_back", sql("SELECT sku, name, category, count(*) OVER () AS n FROM cat", "cat"))
def s1b(spark: SparkSession, sf: str) -> DataFrame:
    """What ``write_parts`` wrote, read with the defaults: every row comes back."""
    path = work_path(spark, "read-back")
    exports.write_parts(A.catalog(spark, sf), path)
    read = exports.read_parts_export(spark, f"{path}/rows", check=False)
    return read.select("sku", "name", "category").withColumn("n", read.agg(F.count(F.lit(1))).scalar())


@query("S6_write_parts", sql("SELECT sku, name, CAST(price AS VARCHAR) AS price, (SELECT count(*) FROM cat) AS total_parts FROM cat", "cat"))
def s6(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "parts")
    exports.write_parts(A.catalog(spark, sf), path)
    rows = spark.read.schema(WRITTEN_PART).json(f"{path}/rows").select("sku", "name", "price")
    return _with_metadata(spark, path, rows, "total_parts")


def _with_metadata(spark: SparkSession, path: str, rows: DataFrame, field: str) -> DataFrame:
    meta = spark.read.schema(sc.METADATA).json(f"{path}/metadata").select(field)
    return rows.withColumn(field, meta.scalar())


@query("S7_write_compat", sql(f"SELECT sku AS part_sku, n, vehicles, (SELECT count(DISTINCT sku) FROM fit1) AS total_mappings FROM ({_VEHICLES})", "fit1"))
def s7(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "compat")
    exports.write_compat(_fits(spark, sf), path)
    rows = spark.read.schema(sc.EXPORT_COMPAT).json(f"{path}/rows").select("part_sku", *vehicles_digest("vehicles"))
    return _with_metadata(spark, path, rows, "total_mappings")


@query(
    "S8_write_hierarchical",
    sql(
        """SELECT f.year, f.make, f.model, c.sku, c.name, CAST(c.price AS VARCHAR) AS price,
        (SELECT count(DISTINCT year) FROM fit1) AS total_years FROM fit1 f JOIN cat c USING (sku)""",
        "fit1", "cat",
    ),
)
def s8(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "hierarchy")
    exports.write_hierarchical(_fits(spark, sf), A.catalog(spark, sf).select("sku", "name", "price"), path)
    schema = "sku string, name string, price string, year int, make string, model string"
    rows = spark.read.schema(schema).json(f"{path}/rows")
    return _with_metadata(spark, path, rows, "total_years")


@query("S9_write_complete", sql(f"SELECT c.sku, CAST(c.price AS VARCHAR) AS price, coalesce(v.n, 0) AS n, v.vehicles FROM cat c LEFT JOIN ({_VEHICLES}) v USING (sku)", "cat", "fit1"))
def s9(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "complete")
    exports.write_complete(A.catalog(spark, sf), _fits(spark, sf), path)
    rows = spark.read.schema(WRITTEN_PART).json(f"{path}/rows")
    return rows.select("sku", "price", *vehicles_digest("compatibility"))


@query("S10_write_delta", sql(f"SELECT sku, name FROM cur WHERE sku IN (SELECT sku FROM ({_CHANGES}))", "cur", "cat", "prev"))
def s10(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "delta")
    changes = dedup.detect_changes(A.occurrences(spark, sf), A.snapshot(spark, sf, "previous"))
    exports.write_delta(A.snapshot(spark, sf, "current"), changes, path)
    return spark.read.schema(WRITTEN_PART).json(f"{path}/rows").select("sku", "name")


@query(
    "S11_append_export",
    sql(
        """SELECT sku, CAST(price AS VARCHAR) AS price, (SELECT count(*) FROM (SELECT sku FROM prev UNION SELECT sku FROM cur)) AS total_parts
        FROM (SELECT sku, price FROM cur UNION ALL SELECT sku, price FROM prev WHERE sku NOT IN (SELECT sku FROM cur))""",
        "prev", "cur",
    ),
)
def s11(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "append")
    exports.write_parts(A.snapshot(spark, sf, "previous"), path)
    path = exports.append_export(exports.export_rows(A.snapshot(spark, sf, "current")), path, WRITTEN_PART)
    rows = spark.read.schema(WRITTEN_PART).json(f"{path}/rows").select("sku", "price")
    return _with_metadata(spark, path, rows, "total_parts")


@query(
    "S11_append_compat",
    sql(
        """SELECT sku AS part_sku, CASE WHEN any_value(o3) % 2 = 0 AND count_if(year >= 1998) > 0 THEN CAST(count_if(year >= 1998) AS BIGINT)
        ELSE count(*) END AS n FROM fit1 GROUP BY sku""",
        "fit1",
    ),
)
def s11c(spark: SparkSession, sf: str) -> DataFrame:
    """A batch replaces a sku's whole vehicle list."""
    path = work_path(spark, "append-compat")
    # Dealt by sku, the sightings are deduplicated and listed where they are. Making them again for the batch deals less than a stored copy would.
    fits = dedup.dedup_fitments(A.fitments(spark, sf, by_sku=True), ORDER)
    exports.write_compat(fits, path)
    batch = exports.compat_rows(fits.where((F.col("o3") % 2 == 0) & (F.col("year") >= 1998)))
    merged = exports.append_export(batch, path, sc.EXPORT_COMPAT, key="part_sku")
    return spark.read.schema(sc.EXPORT_COMPAT).json(f"{merged}/rows").select("part_sku", F.size("vehicles").cast("long").alias("n"))


@query(
    "S12_export_audit",
    """SELECT true AS valid_json, '2025-10-28' AS export_date, '1.0' AS version, max(p_partkey) AS largest, true AS sized FROM part
    UNION ALL SELECT false, NULL, NULL, 0, true""",
)
def s12(spark: SparkSession, sf: str) -> DataFrame:
    """Sound and broken files together; the names are Spark's own, so files are taken together by validity and metadata."""
    path = work_path(spark, "audit")
    parts = A.catalog(spark, sf).select("id", "sku", "name", "category")
    meta = F.struct(F.lit("2025-10-28").alias("export_date"), F.col("id").alias("total_parts"), F.lit("1.0").alias("version"))
    parts.select(meta.alias("metadata"), F.array(F.struct("sku", "name", "category")).alias("parts")).write.json(path)
    broken = work_path(spark, "audit-broken")
    parts.select(F.concat(F.lit('{"parts": [{"sku": "'), F.col("sku")).alias("value")).write.text(broken)
    _as_json(spark, broken, path)
    audit = exports.export_audit(spark, path)
    return audit.groupBy("valid_json", "export_date", "version").agg(F.max("total_parts").alias("largest"), (F.min("size_bytes") > 0).alias("sized"))


def _as_json(spark: SparkSession, texts: str, path: str) -> None:
    """Move text files into a directory of json files."""
    from partloom.operators.upsert import _fs

    fs, folder = _fs(spark, texts)
    made = spark._jvm.org.apache.hadoop.fs.Path
    for k, status in enumerate(fs.listStatus(folder)):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), made(f"{path}/broken-{k}.json"))
