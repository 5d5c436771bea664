"""Deduplication, change detection and set arithmetic on skus.

Keyed reductions are written as ``groupBy`` with ``max_by``/``min_by`` rather than as windows: Spark then combines on
the map side, so a key that holds a large share of all rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions import values as vx

FITMENT_KEY = ("sku", "make", "model", "year", "engine")


def _pick(df: DataFrame, keys: tuple[str, ...], order: list[str], chooser) -> DataFrame:
    payload = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(chooser(F.struct(*payload), F.struct(*order)).alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def last_per_key(df: DataFrame, keys: tuple[str, ...], order: list[str]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: tuple[str, ...], order: list[str]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def dedup_parts(parts: DataFrame, order: list[str]) -> DataFrame:
    """Last write wins per sku. ``order`` names the columns that carry page, group and in-group position."""
    return last_per_key(parts, ("sku",), order)


def dedup_fitments(fitments: DataFrame, order: list[str]) -> DataFrame:
    """First sighting wins per part, make, model, year and engine; a missing engine equals a missing engine.

    Aspiration and qualifiers are carried along but are not part of the key.
    """
    return first_per_key(fitments, FITMENT_KEY, order)


def qualifier_key(engine: Column, aspiration: Column, qualifiers: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(
        "::", F.coalesce(engine, blank), F.coalesce(aspiration, blank), F.coalesce(F.array_join(qualifiers, "|"), blank)
    )


def qualifier_groups(listing: DataFrame, page: str = "page_id", position: str = "page_pos") -> DataFrame:
    """Per page, the groups of parts that share engine, aspiration and qualifiers, in order of first appearance."""
    key = qualifier_key(F.col("engine"), F.col("aspiration"), F.col("qualifiers"))
    return (
        listing.withColumn("qualifier_key", key)
        .groupBy(page, "qualifier_key")
        .agg(F.min(position).alias("group_pos"), F.count(F.lit(1)).alias("parts"))
    )


def with_group_position(listing: DataFrame, page: str = "page_id", position: str = "page_pos") -> DataFrame:
    """Add each row's group position: the first position of its qualifier group on the page."""
    keyed = listing.withColumn(
        "qualifier_key", qualifier_key(F.col("engine"), F.col("aspiration"), F.col("qualifiers"))
    )
    groups = keyed.groupBy(page, "qualifier_key").agg(F.min(position).alias("group_pos"))
    return keyed.join(groups, [page, "qualifier_key"])


def baseline_hashes(previous: DataFrame) -> DataFrame:
    """One content digest per sku of the previous export."""
    return previous.select("sku", vx.part_hash().alias("previous_hash"))


def load_baseline(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Current parts plus every previous part that was not seen again."""
    unseen = previous.join(current.select("sku").distinct(), "sku", "left_anti")
    return current.unionByName(unseen, allowMissingColumns=True)


def detect_changes(occurrences: DataFrame, previous: DataFrame) -> DataFrame:
    """New and changed skus. A sku counts as changed as soon as any sighting differs from the previous content.

    Sightings are reduced to smallest and largest digest per sku first, so the join sees one row per sku.
    """
    seen = (
        occurrences.select("sku", vx.part_hash().alias("h"))
        .groupBy("sku")
        .agg(F.min("h").alias("low"), F.max("h").alias("high"))
    )
    joined = seen.join(baseline_hashes(previous), "sku", "left")
    differs = (F.col("low") != F.col("previous_hash")) | (F.col("high") != F.col("previous_hash"))
    change = F.when(F.col("previous_hash").isNull(), "new").when(differs, "changed")
    return joined.select("sku", change.alias("change")).where(F.col("change").isNotNull())


def sku_sets(previous: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """Every sku with its fate: missing, new, or preserved (in the baseline and neither new nor changed)."""
    prev, cur = previous.select("sku").distinct(), current.select("sku").distinct()
    missing = prev.join(cur, "sku", "left_anti").withColumn("fate", F.lit("missing"))
    new = cur.join(prev, "sku", "left_anti").withColumn("fate", F.lit("new"))
    preserved = prev.join(changes.select("sku"), "sku", "left_anti").withColumn("fate", F.lit("preserved"))
    return missing.unionByName(new).unionByName(preserved)


def delta_set(changes: DataFrame) -> DataFrame:
    """New and changed skus as one set."""
    new = changes.where(F.col("change") == "new").select("sku")
    return new.union(changes.where(F.col("change") == "changed").select("sku")).distinct()


def concat_exports(*frames: DataFrame) -> DataFrame:
    """Bag union; columns a file lacks come out null."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def sync_success(attempted: DataFrame, failed: DataFrame) -> DataFrame:
    """Attempted files minus the failed ones."""
    return attempted.select("filename").distinct().join(failed.select("filename"), "filename", "left_anti")
