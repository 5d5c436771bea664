"""Joins of parts with fitments, details, page state and snapshots.

The long side is always reduced by its key before it meets the catalog, so each join sees unique keys on at least one
side and a hot key cannot multiply. Whether a side is broadcast is left to the optimizer, which checks its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import schemas as sc
from partloom.functions import values as vx
from partloom.operators.filters import fitting_skus

VEHICLE_FIELDS = [f.name for f in sc.VEHICLE.fields]


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def group_fitments(fitments: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per sku with its vehicles as an array.

    Feed it deduplicated fitments: a sku's array is then bounded by the number of distinct vehicles. Use the long form
    for everything but publishing.
    """
    fields = [f for f in VEHICLE_FIELDS if f in fitments.columns]
    sort = order or [f for f in ("make", "model", "year", "engine") if f in fields]
    # A field that sorts is carried once; what is left decides ties in the order of the fields, as the whole vehicle would.
    entry = F.struct(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(sort)], *[F.col(c) for c in fields if c not in sort])
    vehicle = lambda e: F.struct(*[(e[f"_k{sort.index(c)}"] if c in sort else e[c]).alias(c) for c in fields])
    listed = F.transform(F.sort_array(F.collect_list(entry)), vehicle)
    return fitments.groupBy("sku").agg(listed.alias("vehicles"))


def attach_fitment(parts: DataFrame, grouped: DataFrame, *, absent_as_null: bool = False) -> DataFrame:
    """Parts with their vehicles inline; parts without any get an empty list (or null)."""
    joined = parts.join(grouped, "sku", "left")
    if absent_as_null:
        return joined.withColumnRenamed("vehicles", "compatibility")
    kind = grouped.schema["vehicles"].dataType
    return joined.withColumn("compatibility", F.coalesce("vehicles", F.array().cast(kind))).drop("vehicles")


def _filled_text(new: Column, old: Column) -> Column:
    return F.when(F.coalesce(new, F.lit("")) != "", new).otherwise(old)


def _filled_array(new: Column, old: Column) -> Column:
    return F.when(F.coalesce(F.size(new), F.lit(0)) > 0, new).otherwise(old)


ENRICHED = ("description", "specifications", "tech_notes", "interchange_numbers", "images")


def enrich_parts(parts: DataFrame, details: DataFrame, variant: str = "fill") -> DataFrame:
    """Left join of detail records.

    ``fill``       non-empty detail values replace, specifications are merged with the detail winning
    ``overwrite``  details replace everything; unmatched parts lose the enriched fields
    ``refresh``    description, notes and references are overwritten by a match even when empty; specs merged
    ``stored``     detail value if there is one, else the stored one; specifications merged
    """
    d = details.select(
        "sku",
        F.lit(True).alias("_hit"),
        F.col("full_description").alias("_description"),
        F.col("specifications").alias("_specifications"),
        F.col("tech_notes").alias("_tech_notes"),
        F.col("interchange_data").alias("_interchange_numbers"),
        F.col("additional_images").alias("_images"),
    )
    joined = parts.join(d, "sku", "left")
    hit = F.coalesce("_hit", F.lit(False))
    c = F.col
    merged = vx.merge_maps(c("specifications"), c("_specifications"))
    no_specs = F.create_map().cast("map<string,string>")
    if variant in ("fill", "stored"):
        notes = F.coalesce if variant == "stored" else _filled_text
        new = {
            "description": _filled_text(c("_description"), c("description")),
            "specifications": merged,
            "tech_notes": notes(c("_tech_notes"), c("tech_notes")),
            "interchange_numbers": _filled_array(c("_interchange_numbers"), c("interchange_numbers")),
            "images": _filled_array(c("_images"), c("images")),
        }
    elif variant == "overwrite":
        new = {
            "description": F.when(hit, F.coalesce("_description", F.lit(""))),
            "specifications": F.when(hit, F.coalesce("_specifications", no_specs)).otherwise(no_specs),
            "tech_notes": c("_tech_notes"),
            "interchange_numbers": F.coalesce(
                "_interchange_numbers", _empty("array<struct<reference_number:string,reference_type:string>>")
            ),
            "images": F.coalesce("_images", _empty("array<struct<url:string,alt_text:string,is_primary:boolean>>")),
        }
    elif variant == "refresh":
        new = {
            "description": F.when(hit, c("_description")).otherwise(c("description")),
            "specifications": F.when(hit, merged).otherwise(c("specifications")),
            "tech_notes": F.when(hit, c("_tech_notes")).otherwise(c("tech_notes")),
            "interchange_numbers": F.when(hit, c("_interchange_numbers")).otherwise(c("interchange_numbers")),
            "images": _filled_array(c("_images"), c("images")),
        }
    else:
        raise ValueError(f"unknown enrichment variant: {variant}")
    return joined.select(*[new[n].alias(n) if n in new else c(n) for n in parts.columns])


def fitment_to_parts(fitments: DataFrame, parts: DataFrame) -> DataFrame:
    """Long rows of vehicle and part. Fitments of unknown parts fall out; see ``orphan_fitments``."""
    return fitments.join(parts, "sku", "inner")


def orphan_fitments(fitments: DataFrame, parts: DataFrame) -> DataFrame:
    """Skus with fitments but no part."""
    return fitments.select("sku").distinct().join(parts, "sku", "left_anti")


def explode_fitment(parts: DataFrame, column: str = "compatibility") -> DataFrame:
    """One row per part and vehicle, from the nested array."""
    return parts.select("sku", F.posexplode(column).alias("vehicle_pos", "_v")).select("sku", "vehicle_pos", "_v.*")


def explode_fitment_json(parts: DataFrame, column: str = "compatibility") -> DataFrame:
    """The same from stored JSON text; null, empty and broken text yield no rows."""
    usable = F.col(column).isNotNull() & ~F.trim(column).isin("", "[]")
    vehicles = F.from_json(column, F.lit(f"array<{sc.VEHICLE.simpleString()}>"))
    parsed = parts.where(usable).withColumn(column, F.when(vx.is_json(F.col(column)), vehicles))
    return explode_fitment(parsed, column)


def missing_images(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Skus without a usable image. A failed download does not count as an image."""
    have = manifest.where(~F.col("synced").eqNullSafe("failed")).select(
        F.regexp_replace("filename", "_[^_]*$", "").alias("sku")
    )
    return parts.select("sku").join(have.distinct(), "sku", "left_anti")


def resume_filter(applications: DataFrame, processed: DataFrame) -> DataFrame:
    return applications.join(processed.select("application_id").distinct(), "application_id", "left_anti")


def changed_pages(pages: DataFrame, state: DataFrame, processed: DataFrame) -> DataFrame:
    """Pages with a ``reason``: changed, first_seen, check_failed, unprocessed or unchanged.

    ``pages`` has url and hash (null when the check failed); ``processed`` lists urls handled by an earlier run.
    Everything but ``unchanged`` is to be read again.
    """
    stored = state.select("url", F.col("hash").alias("_stored"), F.lit(True).alias("_known"))
    done = processed.select("url").distinct().withColumn("_done", F.lit(True))
    joined = pages.join(stored, "url", "left").join(done, "url", "left")
    reason = (
        F.when(F.col("hash").isNull(), "check_failed")
        .when(F.col("_known").isNull() | F.col("_stored").isNull(), "first_seen")
        .when(F.col("hash") != F.col("_stored"), "changed")
        .when(F.col("_done").isNull(), "unprocessed")
        .otherwise("unchanged")
    )
    return joined.withColumn("reason", reason).drop("_stored", "_known", "_done")


def pages_to_read(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason") != "unchanged")


def next_page_state(pages: DataFrame, state: DataFrame) -> DataFrame:
    """State after the run: every checked page's hash, failed checks keep what was stored."""
    fresh = pages.select("url", "hash").where(F.col("hash").isNotNull())
    return fresh.unionByName(state.join(fresh, "url", "left_anti").select("url", "hash"))


def page_change_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("pages"))


def split_details(details: DataFrame, state: DataFrame, *, force: bool = False) -> DataFrame:
    """Detail pages with ``unchanged``: true where the stored hash is equal and the run is not forced."""
    stored = state.select("url", F.col("hash").alias("_stored"))
    same = F.lit(False) if force else F.col("hash").eqNullSafe(F.col("_stored")) & F.col("hash").isNotNull()
    return details.join(stored, "url", "left").withColumn("unchanged", same).drop("_stored")


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Skus that only one of two snapshots has."""
    prev = previous.select("sku").distinct().withColumn("_p", F.lit(True))
    cur = current.select("sku").distinct().withColumn("_c", F.lit(True))
    change = F.when(F.col("_c").isNull(), "missing").when(F.col("_p").isNull(), "new")
    return prev.join(cur, "sku", "full_outer").select("sku", change.alias("change")).where(F.col("change").isNotNull())


def completeness_counts(diff: DataFrame, failures: DataFrame) -> DataFrame:
    """Missing and new counts next to the distinct failed identifiers per phase."""
    changes = diff.groupBy(F.col("change").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    failed = (
        failures.select("phase", "identifier").distinct()
        .groupBy(F.concat(F.lit("failed:"), "phase").alias("item"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return changes.unionByName(failed)


def delta_rows(parts: DataFrame, changes: DataFrame) -> DataFrame:
    """Full rows of the new and changed parts."""
    return parts.join(changes.select("sku").distinct(), "sku", "left_semi")


def reuse_hierarchy(responses: DataFrame, state: DataFrame, cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Hierarchy entries of all makes: cached ones where the makes response is unchanged, else freshly read ones.

    ``responses`` has make_id, url and hash; a make with an equal hash but no cached entries counts as a miss.
    """
    stored = state.select("url", F.col("hash").alias("_stored"))
    have = cached.select("make_id").distinct().withColumn("_cached", F.lit(True))
    judged = (
        responses.join(stored, "url", "left")
        .join(have, "make_id", "left")
        .select("make_id", ((F.col("hash") == F.col("_stored")) & F.col("_cached")).alias("hit"))
        .withColumn("hit", F.coalesce("hit", F.lit(False)))
    )
    hits = judged.where("hit").select("make_id")
    misses = judged.where(~F.col("hit")).select("make_id")
    kept = cached.join(hits, "make_id", "left_semi").withColumn("origin", F.lit("cache"))
    read = fresh.join(misses, "make_id", "left_semi").withColumn("origin", F.lit("fresh"))
    return kept.unionByName(read)


def parts_for_vehicle(parts: DataFrame, fitments: DataFrame, make: str, model: str, year: int) -> DataFrame:
    """Parts that fit one vehicle, each once, by category and name."""
    same = (F.col("make") == make) & (F.col("model") == model) & (F.col("year") == year)
    return parts.join(fitting_skus(fitments, same), "sku", "left_semi").orderBy("category", "name", "id")


def is_compatible(fitments: DataFrame, requests: DataFrame, fields: tuple[str, ...] = tuple(VEHICLE_FIELDS)) -> DataFrame:
    """For each request (a sku and a whole vehicle) whether that exact vehicle is listed. All fields must be equal.

    Both sides are reduced to a digest of the vehicle, which turns field-by-field null-safe equality into an equi join.
    """
    key = F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    known = fitments.select("sku", key.alias("_vehicle")).distinct().withColumn("compatible", F.lit(True))
    asked = requests.withColumn("_vehicle", key)
    return asked.join(known, ["sku", "_vehicle"], "left").withColumn(
        "compatible", F.coalesce("compatible", F.lit(False))
    ).drop("_vehicle")
