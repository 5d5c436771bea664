"""Counts, facets and reports.

Distinct counts are written as two grouped steps: first down to one row per key pair (combined on the map side), then
a count. No step keeps a set of values in memory and no row is expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import constants as K
from partloom.functions import text as tx
from partloom.functions import values as vx


def _count(df: DataFrame, *keys: str, name: str = "parts") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def facet_makes(fitments: DataFrame) -> DataFrame:
    """Makes with the number of distinct parts that fit them."""
    pairs = fitments.where(F.col("make").isNotNull()).select("make", "sku").distinct()
    return _count(pairs, "make").orderBy("make")


def facet_years(fitments: DataFrame) -> DataFrame:
    """Years with the number of distinct parts, newest first."""
    pairs = fitments.where(F.col("year").isNotNull()).select(F.col("year").cast("int").alias("year"), "sku").distinct()
    return _count(pairs, "year").orderBy(F.col("year").desc())


def facet_categories(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("category") != "").select("category").distinct().orderBy("category")


def makes_for_year(fitments: DataFrame, year: int) -> DataFrame:
    return fitments.where(F.col("year") == year).select("make").distinct().orderBy("make")


def models_for(fitments: DataFrame, make: str | None = None, year: int | None = None) -> DataFrame:
    """Distinct models: all, of a make, or of a make in a year."""
    out = fitments
    if make is not None:
        out = out.where(F.col("make") == make)
    if year is not None:
        out = out.where(F.col("year") == year)
    return out.select("model").distinct().orderBy("model")


def _metric(name: str, value: Column, key: Column | None = None) -> list[Column]:
    return [F.lit(name).alias("metric"), (key if key is not None else F.lit("")).alias("key"), value.cast("double").alias("value")]


def _metrics(frame: DataFrame, **values: Column) -> DataFrame:
    """Named values of a one-row frame as (metric, key, value) rows, in one pass."""
    rows = F.array(*[F.struct(*_metric(name, value)) for name, value in values.items()])
    return frame.select(F.inline(rows))


def dataset_stats(parts: DataFrame) -> DataFrame:
    """Statistics of part records as (metric, key, value) rows.

    ``parts`` has sku, category, price and optionally a ``vehicle`` struct. One reduction per sku gives totals,
    distinct skus and repeated skus together.
    """
    per_sku = parts.groupBy("sku").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("price").isNotNull()).alias("priced")
    )
    named = F.coalesce(F.col("sku"), F.lit("")) != ""
    totals = per_sku.agg(
        F.sum("n").alias("total_parts"),
        F.count_if(named).alias("unique_skus"),
        F.count_if(named & (F.col("n") > 1)).alias("duplicate_count"),
        F.max("priced").alias("priced"),
    )
    unique, dup = F.col("unique_skus"), F.col("duplicate_count")
    out = _metrics(
        totals,
        total_parts=F.col("total_parts"),
        unique_skus=unique,
        duplicate_count=dup,
        deduplication_rate=F.when(unique > 0, dup / unique).otherwise(0.0),
        price_data_available=F.coalesce(F.col("priced"), F.lit(False)).cast("int"),
    )
    by_category = _count(parts.select(F.coalesce("category", F.lit(K.DEFAULT_CATEGORY)).alias("category")), "category")
    out = out.unionByName(by_category.select(*_metric("parts_by_category", F.col("parts"), F.col("category"))))
    if "vehicle" not in parts.columns:
        return out
    v = F.col("vehicle")
    complete = (F.coalesce(v.make, F.lit("")) != "") & (F.coalesce(v.model, F.lit("")) != "") & (
        F.coalesce(v.year, F.lit(0)) != 0
    )
    vehicles = (
        parts.where(complete)
        .groupBy(v.make.alias("make"), v.model.alias("model"), v.year.alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_make = vehicles.groupBy("make").agg(F.sum("n").alias("n"))
    return out.unionByName(_metrics(_count(vehicles, name="n"), total_vehicles=F.col("n"))).unionByName(
        by_make.select(*_metric("vehicles_by_make", F.col("n"), F.col("make")))
    )


def summary_stats(summaries: DataFrame) -> DataFrame:
    """The same rows for documents that hold a run's summary instead of parts; see ``sources.exports.read_summaries``.

    ``summaries`` has total_parts, unique_skus and deduplication_rate. Each summary gives its own rows; what it does not tell is 0.
    """
    return _metrics(
        summaries, total_parts=F.col("total_parts"), unique_skus=F.col("unique_skus"), duplicate_count=F.lit(0),
        deduplication_rate=F.col("deduplication_rate"), price_data_available=F.lit(0), total_vehicles=F.lit(0),
    )


def catalog_stats(parts: DataFrame, fitments: DataFrame) -> DataFrame:
    """Size of the catalog and exact counts per category and make, as (metric, key, value) rows."""
    categories = _count(parts, "category")
    named = categories.where(F.coalesce(F.col("category"), F.lit("")) != "")
    summary = _metrics(
        categories.agg(
            F.sum("parts").alias("p"), F.count_if(F.coalesce(F.col("category"), F.lit("")) != "").alias("c")
        ),
        total_parts=F.col("p"),
        categories=F.col("c"),
    )
    makes = _count(fitments.where(F.col("make").isNotNull()).select("make", "sku").distinct(), "make")
    years = fitments.where(F.col("year").isNotNull()).select("year").distinct()
    return (
        summary.unionByName(_metrics(_count(makes, name="n"), makes=F.col("n")))
        .unionByName(_metrics(_count(years, name="n"), years=F.col("n")))
        .unionByName(named.select(*_metric("parts_in_category", F.col("parts"), F.col("category"))))
        .unionByName(makes.select(*_metric("parts_for_make", F.col("parts"), F.col("make"))))
    )


def top_makes(fitments: DataFrame, limit: int = K.TOP_MAKES) -> DataFrame:
    """The makes with the most parts."""
    pairs = fitments.where(F.col("make").isNotNull()).select("make", "sku").distinct()
    return _count(pairs, "make").orderBy(F.col("parts").desc(), F.col("make").asc()).limit(limit)


def failure_summary(failures: DataFrame) -> DataFrame:
    """Failures per phase, split into retryable and permanent; the total is in the row with a null phase.

    Phases are few, so the total is summed from the per-phase rows instead of reading the failures again.
    """
    phases = failures.groupBy("phase").agg(
        F.count(F.lit(1)).alias("failures"),
        F.count_if("is_retryable").alias("retryable"),
        F.count_if(~F.col("is_retryable")).alias("permanent"),
    )
    total = phases.agg(
        F.lit(None).cast("string").alias("phase"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("failures", "retryable", "permanent")],
    )
    return phases.unionByName(total)


def failed_identifiers(failures: DataFrame, phase: str) -> DataFrame:
    return failures.where(F.col("phase") == phase).select("identifier")


def run_report(applications: DataFrame, failures: DataFrame, *, application_phase: str = "application") -> DataFrame:
    """One row: applications, failed applications, all failures, both rates and whether either exceeds the limit."""
    total = _count(applications, name="n").select(F.lit("applications").alias("item"), "n")
    failed = failures.agg(
        F.count_if(F.col("phase") == application_phase).alias("failed"), F.count(F.lit(1)).alias("all")
    )
    rows = total.unionByName(
        failed.select(
            F.inline(
                F.array(
                    F.struct(F.lit("failed").alias("item"), F.col("failed").alias("n")),
                    F.struct(F.lit("all").alias("item"), F.col("all").alias("n")),
                )
            )
        )
    )
    pick = lambda item: F.max(F.when(F.col("item") == item, F.col("n")))
    counts = rows.agg(
        pick("applications").alias("applications"), pick("failed").alias("applications_failed"),
        pick("all").alias("failures"),
    )
    rate = lambda c: F.when(F.col("applications") > 0, F.col(c) / F.col("applications")).otherwise(0.0)
    return counts.select(
        "*",
        rate("applications_failed").alias("application_failure_rate"),
        rate("failures").alias("failure_rate"),
        (rate("applications_failed") > K.FAILURE_RATE_MAX).alias("too_many_failed_applications"),
        (rate("failures") > K.FAILURE_RATE_MAX).alias("too_many_failures"),
    )


def year_range(fitments: DataFrame) -> DataFrame:
    return fitments.groupBy("sku").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def breakdowns(stats: DataFrame, file_bytes: Column | None = None) -> DataFrame:
    """Shares and ratios from ``dataset_stats`` rows: per category, per make, and the derived figures.

    Works on the statistics, one row per category and make, so nothing is read again.
    """
    shares = []
    for metric, share in (("parts_by_category", "category_share"), ("vehicles_by_make", "make_share")):
        rows = stats.where(F.col("metric") == metric)
        total = rows.agg(F.sum("value")).scalar()
        shares.append(rows.select(*_metric(share, F.col("value") / total * 100, F.col("key"))))
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    figures = stats.agg(
        pick("total_parts").alias("total"),
        pick("unique_skus").alias("unique"),
        F.count_if(F.col("metric") == "parts_by_category").alias("categories"),
    )
    derived = {
        "avg_parts_per_category": F.when(F.col("categories") > 0, F.col("total") / F.col("categories")),
        "sku_utilization": F.when(F.col("total") > 0, F.col("unique") / F.col("total")),
    }
    if file_bytes is not None:
        derived["parts_per_kb"] = F.col("total") / (file_bytes / 1024)
    return shares[0].unionByName(shares[1]).unionByName(_metrics(figures, **derived))


def integrity_check(stored: DataFrame, json_columns: tuple[str, ...] = ("specifications", "features", "compatibility", "images")) -> DataFrame:
    """One row: rows without sku, rows with broken JSON in any text column, and skus that occur more than once."""
    broken = F.lit(False)
    for name in json_columns:
        filled = F.coalesce(F.col(name), F.lit("")) != ""
        broken = broken | (filled & ~vx.is_json(F.col(name)))
    per_sku = stored.select("sku", broken.alias("_broken")).groupBy("sku").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_broken").alias("bad")
    )
    no_sku = F.coalesce(F.col("sku"), F.lit("")) == ""
    return per_sku.agg(
        F.coalesce(F.sum(F.when(no_sku, F.col("n"))), F.lit(0)).alias("missing_sku"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_json"),
        F.count_if((F.col("n") > 1) & F.col("sku").isNotNull()).alias("duplicate_skus"),
    )


def drop_missing_sku(stored: DataFrame) -> DataFrame:
    """The automatic repair of ``integrity_check``."""
    return stored.where(F.coalesce(F.col("sku"), F.lit("")) != "")


def url_count(parts: DataFrame, fitments: DataFrame, per_page: int = K.URLS_PER_PAGE) -> DataFrame:
    """Parts plus vehicles, and the pages that many urls fill. Counts every listed vehicle, complete or not."""
    rows = _count(parts, name="n").select(F.lit("parts").alias("kind"), "n").unionByName(
        _count(fitments, name="n").select(F.lit("vehicles").alias("kind"), "n")
    )
    total = rows.agg(
        F.max(F.when(F.col("kind") == "parts", F.col("n"))).alias("p"), F.sum("n").alias("n")
    )
    urls = F.when(F.col("p") > 0, F.col("n")).otherwise(0)
    return total.select(urls.alias("urls"), F.ceil(urls / per_page).alias("pages"))


def merge_coverage(parts: DataFrame, details: DataFrame, fitments: DataFrame) -> DataFrame:
    """How many parts have a detail record and how many have fitments."""
    enriched = details.select("sku").distinct().withColumn("_d", F.lit(1))
    fitted = fitments.select("sku").distinct().withColumn("_f", F.lit(1))
    flags = parts.select("sku").join(enriched, "sku", "left").join(fitted, "sku", "left")
    return flags.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("_d").alias("enriched"),
        F.count("_f").alias("with_fitment"),
        (F.count("_d") / F.count(F.lit(1)) * 100).alias("enriched_pct"),
        (F.count("_f") / F.count(F.lit(1)) * 100).alias("with_fitment_pct"),
    )


def last_modified(parts: DataFrame) -> DataFrame:
    return parts.agg(F.date_format(F.max("updated_at"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("last_modified"))


def import_outcome(statuses: DataFrame) -> DataFrame:
    """Rows per import status. Statuses without rows are listed with zero."""
    known = ["created", "updated", "unchanged", "skipped"]
    counts = statuses.agg(*[F.count_if(F.col("status") == s).alias(s) for s in known])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("parts")) for s in known])))


def manifest_status(manifest: DataFrame) -> DataFrame:
    """Entries per sync state: synced, unsynced or failed."""
    state = (
        F.when(F.col("synced") == "true", "synced").when(F.col("synced") == "failed", "failed").otherwise("unsynced")
    )
    return manifest.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("files"))


def files_in_state(manifest: DataFrame, state: str) -> DataFrame:
    wanted = {"synced": "true", "failed": "failed"}.get(state)
    test = F.col("synced") == wanted if wanted else ~F.coalesce(F.col("synced"), F.lit("false")).isin("true", "failed")
    return manifest.where(test).select("filename")


def upload_totals(results: DataFrame) -> DataFrame:
    """Uploaded, skipped and failed files of a sync run."""
    return results.agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("uploaded", "skipped", "failed")]
    )


def part_makes(fitments: DataFrame, order: list[str]) -> DataFrame:
    """Distinct makes per part in the order in which they were first listed.

    Reduced to one row per part and make first; what remains per part is bounded by the number of makes.
    """
    first = fitments.groupBy("sku", "make").agg(F.min(F.struct(*order)).alias("_first"))
    listed = F.sort_array(F.collect_list(F.struct("_first", "make")))
    return first.groupBy("sku").agg(F.transform(listed, lambda e: e["make"]).alias("makes"))


def engine_variants(fitments: DataFrame, year: int | None, make: str, model: str) -> DataFrame:
    """Distinct engines of the parts that fit a vehicle, names compared ignoring case, sorted per part."""
    same = (F.lower("make") == make.lower()) & (F.lower("model") == model.lower())
    if year is not None:
        same = same & (F.col("year") == year)
    engines = fitments.where(same & (F.col("engine") != "")).select("sku", "engine").distinct()
    return engines.groupBy("sku").agg(F.sort_array(F.collect_list("engine")).alias("engines"))


def recent_log(log: DataFrame, limit: int = K.LOG_ENTRIES, tie_break: str = "event_id") -> DataFrame:
    """The newest import runs, newest first, with their duration."""
    seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    newest = log.orderBy(F.col("started_at").desc(), F.col(tie_break).desc()).limit(limit)
    clock = F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss")
    return newest.withColumn("seconds", seconds).withColumn("duration", clock)


def normalize_makes(df: DataFrame) -> DataFrame:
    return df.withColumn("make", tx.normalize_label(F.col("make")))
