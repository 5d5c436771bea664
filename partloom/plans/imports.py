"""From export files to the stored catalog, as one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom import schemas as sc
from partloom.functions import values as vx
from partloom.operators import aggregates, buckets, dedup, projections, quality
from partloom.session import work_path
from partloom.sources import exports


def import_exports(spark: SparkSession, path: str, table: str, *, multi_line: bool = False) -> DataFrame:
    """Upsert the parts of export files into a table in buckets and return the outcome counts.

    Records without sku are skipped; of several records with one sku the last file's last record counts. A document without parts,
    or one that cannot be read, stops the run before a version is written. A failed run leaves the current version untouched.
    """
    # The records are used for the batch and for the count of skipped ones: parsed once, kept as Parquet.
    staged = work_path(spark, "import-records")
    exports.read_parts_export(spark, path, check=False, multi_line=multi_line).write.parquet(staged)
    read = spark.read.parquet(staged)
    errors, judged = quality.check_import(read, exports.read_structure(spark, path, multi_line=multi_line))
    fault = errors.orderBy("source_file").first()
    if fault is not None:
        raise ValueError(f"{fault.error} {fault.source_file or path}")
    skipped = judged.where(~F.col("importable")).select(F.lit("skipped").alias("status"))
    usable = judged.where("importable").drop("importable")
    batch = projections.cleanup_import(usable).withColumns(
        {"price": vx.price_of(F.col("price")), "in_stock": F.coalesce("in_stock", F.lit(True))}
    )
    latest = dedup.last_per_key(batch, ("sku",), ["source_file", "pos"]).drop("source_file", "pos", "full_description")
    _, written = buckets.upsert_buckets(table, latest, sc.CATALOG)
    return aggregates.import_outcome(written.select("status").unionByName(skipped))
