"""From crawled pages to a published catalog, as one run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom import schemas as sc
from partloom.operators import dedup, joins, quality
from partloom.session import work_path
from partloom.sources import exports, pages

ORDER = ["app_pos", "group_pos", "page_pos"]


@dataclass(frozen=True)
class Build:
    """What a run yields. Everything is lazy; the listing rows behind it were read from html once and stored."""

    parts: DataFrame
    fitments: DataFrame
    changes: DataFrame
    failures: DataFrame

    def publish(self, path: str) -> None:
        """Write every export form; the delta only when something is new or changed. Parts and fitments are evaluated once for all forms."""
        spark = self.parts.sparkSession
        staged = {name: work_path(spark, name) for name in ("parts", "fitments")}
        for name, target in staged.items():
            getattr(self, name).write.parquet(target)
        parts, fitments = (spark.read.parquet(staged[name]) for name in ("parts", "fitments"))
        exports.write_parts(parts, f"{path}/parts")
        exports.write_compat(fitments, f"{path}/compatibility")
        exports.write_complete(parts, fitments, f"{path}/complete")
        exports.write_hierarchical(fitments, parts, f"{path}/hierarchical")
        exports.write_delta(parts, self.changes, f"{path}/delta")


def complete_record(parts: DataFrame) -> DataFrame:
    """Add the export fields a source does not give, as null."""
    have = set(parts.columns)
    lacking = [f for f in sc.EXPORT_PART.fields if f.name not in have and f.name != "compatibility"]
    return parts.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lacking])


def build_catalog(
    crawled: DataFrame, applications: DataFrame, details: DataFrame, previous: DataFrame, *, current_year: int,
    on_invalid: str = "fail_page",
) -> Build:
    """Read listing pages, judge them, deduplicate parts and fitments, detect changes and add details.

    ``crawled`` has application_id and html, ``applications`` application_id, app_pos, make, model and year. Listing
    rows are compared with ``previous``; details are joined afterwards, so enrichment never looks like a change. Parts
    that were not seen again stay. A page or block that cannot be read is a failure too; with ``fail_page`` such a block fails its page.
    ``details`` may be those of ``extract_details_or_errors``: pages that could not be read are then failures and add nothing.
    """
    raw = work_path(crawled.sparkSession, "blocks")
    pages.read_listings_or_errors(crawled, ["application_id"]).write.parquet(raw)
    blocks = crawled.sparkSession.read.parquet(raw)
    unread = blocks.where(F.col("error").isNotNull()).select("application_id", "page_pos", "error")
    read = pages.application_parts(blocks.where(F.col("error").isNull()))
    judged = quality.validate_rows(complete_record(read))
    placed = judged.join(applications.withColumn("year", F.col("year").try_cast("int")), "application_id")
    vehicles = quality.normalize_vehicles(quality.check_vehicles(placed.drop("issues"), current_year=current_year))
    # Four outputs hang on these rows; without a stored copy each would parse the html again.
    staged = work_path(crawled.sparkSession, "listing")
    vehicles.withColumn("sound", F.col("valid") & (F.size("issues") == 0)).drop("issues").write.parquet(staged)
    listing = crawled.sparkSession.read.parquet(staged)

    bad = listing.where(~F.col("sound"))
    if on_invalid == "fail_page":
        failed = bad.select("application_id").union(unread.select("application_id")).distinct()
        kept = listing.join(failed, "application_id", "left_anti")
    else:
        kept = listing.where("sound")
    grouped = dedup.with_group_position(kept, page="application_id", position="page_pos")

    record = [f.name for f in sc.EXPORT_PART.fields if f.name in grouped.columns]
    occurrences = grouped.select(*record, *ORDER)
    fitment_columns = ["sku", "make", "model", "year", "engine", "aspiration", "qualifiers"]
    fitments = dedup.dedup_fitments(grouped.select(*fitment_columns, *ORDER), ORDER)
    parts = dedup.dedup_parts(occurrences, ORDER).drop(*ORDER)
    changes = dedup.detect_changes(occurrences, previous)
    current = dedup.load_baseline(previous, parts)
    failures = bad.groupBy("application_id").agg(F.count(F.lit(1)).alias("bad_rows")).select(
        F.lit("application").alias("phase"), F.col("application_id").cast("string").alias("identifier"),
        F.lit("invalid record").alias("error_type"), F.col("bad_rows").cast("string").alias("error_message"),
        F.lit(True).alias("is_retryable"),
    )
    # The page's own error first, else that of its first block.
    first = unread.groupBy("application_id").agg(F.min_by("error", F.coalesce("page_pos", F.lit(-1))).alias("error"))
    failures = failures.unionByName(first.select(
        F.lit("application").alias("phase"), F.col("application_id").cast("string").alias("identifier"),
        F.lit("unreadable page").alias("error_type"), F.col("error").alias("error_message"), F.lit(True).alias("is_retryable"),
    ))
    if "error" in details.columns:
        failures = failures.unionByName(details.where("error IS NOT NULL").select(
            F.lit("detail").alias("phase"), F.col("sku").cast("string").alias("identifier"), F.lit("unreadable page").alias("error_type"),
            F.col("error").alias("error_message"), F.lit(True).alias("is_retryable"),
        ))
        details = details.where("error IS NULL").drop("error")
    return Build(joins.enrich_parts(current, details, "fill"), fitments.drop(*ORDER), changes, failures)
