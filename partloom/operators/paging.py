"""Sorted pages of the catalog and global positions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom import constants as K
from partloom.operators import filters
from partloom.session import work_path


@dataclass(frozen=True)
class CatalogQuery:
    """Filters, order and page of a catalog request. Unknown sort keys fall back to the name, sizes are clamped.

    ``after`` is the sort value and id of the last row of the page before: it takes the place of ``page``, so that a deep page
    costs what the first one does.
    """

    search: str = ""
    categories: list[str] = field(default_factory=list)
    makes: list[str] = field(default_factory=list)
    models: list[str] = field(default_factory=list)
    years: list = field(default_factory=list)
    orderby: str = "name"
    order: str = "asc"
    per_page: int = K.PER_PAGE_DEFAULT
    page: int = 1
    after: tuple | None = None

    @property
    def size(self) -> int:
        return max(1, min(K.PER_PAGE_MAX, self.per_page))

    @property
    def offset(self) -> int:
        return 0 if self.after else (max(1, self.page) - 1) * self.size


def matching_parts(parts: DataFrame, fitments: DataFrame, query: CatalogQuery) -> DataFrame:
    """Every part the filters leave, unsorted. The fitment join exists only when a vehicle filter is set."""
    out = filters.keyword_search(parts, query.search, interchange=True)
    out = filters.filter_category(out, query.categories)
    return filters.filter_vehicle(out, fitments, query.makes, query.models, query.years)


def sort_keys(orderby: str, order: str, allowed: tuple[str, ...], default: str) -> list[Column]:
    """Whitelisted sort key plus the id, so that equal keys page the same way every time."""
    column = _sort_column(orderby, allowed, default)
    descending = order.lower() == "desc"
    return [column.desc() if descending else column.asc(), F.col("id").desc() if descending else F.col("id").asc()]


def _sort_column(orderby: str, allowed: tuple[str, ...], default: str) -> Column:
    key = orderby if orderby in allowed else default
    return F.greatest("created_at", "updated_at") if key == "latest" else F.col(key)


def rows_after(df: DataFrame, column: Column, descending: bool, after: tuple) -> DataFrame:
    """The rows that follow the one with this sort value and id; nulls come first in ascending order and last in descending order."""
    value, last = after
    further = F.col("id") < last if descending else F.col("id") > last
    if value is None:
        return df.where(column.isNull() & further if descending else column.isNotNull() | further)
    beyond = (column < F.lit(value)) | column.isNull() if descending else column > F.lit(value)
    return df.where(beyond | ((column == F.lit(value)) & further))


def query_catalog(parts: DataFrame, fitments: DataFrame, query: CatalogQuery) -> DataFrame:
    """One page of matching parts. Sort, offset and limit become a single distributed top-k."""
    found = matching_parts(parts, fitments, query)
    keys = sort_keys(query.orderby, query.order, K.CATALOG_SORT_KEYS, "name")
    if query.after:
        found = rows_after(found, _sort_column(query.orderby, K.CATALOG_SORT_KEYS, "name"), query.order.lower() == "desc", query.after)
    return found.orderBy(*keys).offset(query.offset).limit(query.size)


def count_matches(matches: DataFrame, per_page: int = K.PER_PAGE_DEFAULT, page: int = 1) -> DataFrame:
    """Matches, distinct parts, number of pages and whether another page follows."""
    per_id = matches.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    totals = per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.count(F.lit(1)).alias("total"))
    return totals.select(
        "matches",
        "total",
        F.ceil(F.col("total") / per_page).alias("total_pages"),
        (F.lit(page * per_page) < F.col("total")).alias("has_more"),
    )


def newest_parts(parts: DataFrame, per_page: int = K.PER_PAGE_DEFAULT, page: int = 1, after_id: int | None = None) -> DataFrame:
    """A page of parts, newest first; ``after_id``, the last id of the page before, takes the place of ``page``."""
    if after_id is not None:
        return parts.where(F.col("id") < after_id).orderBy(F.col("id").desc()).limit(per_page)
    return parts.orderBy(F.col("id").desc()).offset((page - 1) * per_page).limit(per_page)


def admin_list(
    parts: DataFrame, *, category: str = "", search: str = "", orderby: str = "created_at", order: str = "desc",
    page: int = 1, after: tuple | None = None,
) -> DataFrame:
    """One page of the maintenance list; ``after`` as in ``CatalogQuery``."""
    keys = sort_keys(orderby, order, K.ADMIN_SORT_KEYS, "created_at")
    found = admin_matches(parts, category=category, search=search)
    if after:
        return rows_after(found, _sort_column(orderby, K.ADMIN_SORT_KEYS, "created_at"), order.lower() == "desc", after).orderBy(*keys).limit(K.ADMIN_PER_PAGE)
    return found.orderBy(*keys).offset((max(1, page) - 1) * K.ADMIN_PER_PAGE).limit(K.ADMIN_PER_PAGE)


def admin_matches(parts: DataFrame, *, category: str = "", search: str = "") -> DataFrame:
    """The maintenance list's filter: one category, and sku or name holding a text."""
    out = filters.filter_category(parts, [category] if category else [])
    if search:
        hit = filters.tx.contains_ignoring_case
        out = out.where(hit(F.col("sku"), search) | F.coalesce(hit(F.col("name"), search), F.lit(False)))
    return out


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Add a gap-free global position from 0 as column ``name``, without pulling the rows into one task.

    The rows are range-sorted over all partitions and written once, as Parquet, with their partition and place in it, so these are
    fixed and later reads take only the columns they need. Then one small row per partition says how many rows came before it. Only those
    rows (as many as there are partitions) pass through a single task.
    """
    in_partition = F.lit((1 << 33) - 1)
    staged = work_path(df.sparkSession, "sorted")
    df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()).write.parquet(staged)
    fixed = df.sparkSession.read.parquet(staged)
    numbered = fixed.withColumn("_part", F.shiftright("_row", 33)).withColumn(
        "_row", F.col("_row").bitwiseAND(in_partition)
    )
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sorted frame: bounded by the partition count, whatever the data size.
    offsets = F.broadcast(
        sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        numbered.join(offsets, "_part")
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_part", "_row", "_before")
    )


def url_pages(urls: DataFrame, *order: Column | str, per_page: int = K.URLS_PER_PAGE) -> DataFrame:
    """Cut an ordered url list into pages of fixed size; ``page`` counts from 1. Write it ``partitionBy('page')``."""
    placed = with_position(urls, *order)
    return placed.withColumn("page", F.floor(F.col("position") / per_page) + 1)
