"""Row filters over the catalog and its fitments."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import constants as K
from partloom.functions import text as tx

SEARCHED = ("sku", "name", "description", "manufacturer")


def filter_hierarchy(applications: DataFrame, make: str | None = None, year: int | None = None) -> DataFrame:
    """Applications of one make (any case) and one year. Both tests are plain predicates that reach the scan."""
    out = applications
    if make:
        out = out.where(F.lower("make") == make.lower())
    if year:
        out = out.where(F.col("year").cast("int") == year)
    return out


def keyword_condition(keyword: str, *, interchange: bool = False) -> Column:
    """True where any searched column holds the keyword as plain text, whatever its case."""
    tests = [tx.contains_ignoring_case(F.col(c), keyword) for c in SEARCHED]
    if interchange:
        tests.append(
            F.exists(
                "interchange_numbers",
                lambda r: tx.contains_ignoring_case(r.reference_number, keyword)
                | tx.contains_ignoring_case(r.reference_type, keyword),
            )
        )
    return reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests])


def keyword_search(parts: DataFrame, keyword: str, *, interchange: bool = False) -> DataFrame:
    return parts.where(keyword_condition(keyword, interchange=interchange)) if keyword else parts


def filter_category(parts: DataFrame, categories: list[str] | str) -> DataFrame:
    """Category equality or membership, ignoring case; an empty list keeps everything."""
    wanted = [categories] if isinstance(categories, str) else list(categories)
    return parts.where(F.lower("category").isin(*[c.lower() for c in wanted])) if wanted else parts


def vehicle_condition(makes: list[str] = (), models: list[str] = (), years: list = ()) -> Column | None:
    """All given tests have to hold on the same vehicle. Years arrive as numbers or as text."""
    tests = []
    if makes:
        tests.append(F.col("make").isin(*makes))
    if models:
        tests.append(F.col("model").isin(*models))
    if years:
        tests.append(F.col("year").isin(*[int(y) for y in years]))
    return reduce(and_, tests) if tests else None


def fitting_skus(fitments: DataFrame, condition: Column) -> DataFrame:
    """Distinct skus with a matching vehicle; map-side dedup keeps a hot sku to one row per task before the shuffle."""
    return fitments.where(condition).select("sku").distinct()


def filter_vehicle(
    parts: DataFrame, fitments: DataFrame, makes: list[str] = (), models: list[str] = (), years: list = ()
) -> DataFrame:
    """Parts that fit a vehicle. A semi join, so a part with many matching variants still comes out once."""
    condition = vehicle_condition(makes, models, years)
    return parts if condition is None else parts.join(fitting_skus(fitments, condition), "sku", "left_semi")


def lookup_by_id(parts: DataFrame, part_id: int) -> DataFrame:
    return parts.where(F.col("id") == part_id)


def lookup_by_sku(parts: DataFrame, sku: str) -> DataFrame:
    return parts.where(F.col("sku") == sku)


def lookup_by_slug(parts: DataFrame, slug: str) -> DataFrame:
    """Find a part from its url slug, e.g. ``csf3680``."""
    return parts.where(F.col("sku") == tx.sku_from_slug(F.lit(slug)))


def lookup_slugs(requests: DataFrame, parts: DataFrame) -> DataFrame:
    """Resolve a table of ``slug`` requests against the catalog; unknown slugs stay with a null sku."""
    keyed = requests.withColumn("wanted", tx.sku_from_slug(F.col("slug")))
    return keyed.join(parts, keyed.wanted == parts.sku, "left")


def needs_enrichment(parts: DataFrame, targets: DataFrame | None = None, *, force: bool = False) -> DataFrame:
    """Parts to fetch details for: the targeted skus, everything when forced, else those with a gap."""
    if targets is not None:
        return parts.join(targets.select("sku").distinct(), "sku", "left_semi")
    if force:
        return parts
    return parts.where(F.col("description").isNull() | (F.coalesce(F.size("images"), F.lit(0)) <= 0))


def unknown_targets(parts: DataFrame, targets: DataFrame) -> DataFrame:
    """Targeted skus that no part has."""
    return targets.select("sku").distinct().join(parts, "sku", "left_anti")


@dataclass(frozen=True)
class ExportFilter:
    """What to export. Empty lists and missing bounds mean no restriction."""

    makes: list[str] = field(default_factory=list)
    years: list[int] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    min_price: float | None = None
    max_price: float | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "makes", [m.strip().title() for m in self.makes if m.strip()])
        object.__setattr__(self, "categories", [c.strip().title() for c in self.categories if c.strip()])
        object.__setattr__(self, "years", sorted(self.years))
        for year in self.years:
            if not K.YEAR_MIN <= year <= K.YEAR_FIELD_MAX:
                raise ValueError(f"year {year} is outside {K.YEAR_MIN}..{K.YEAR_FIELD_MAX}")
        for bound in (self.min_price, self.max_price):
            if bound is not None and bound < 0:
                raise ValueError("price bounds cannot be negative")
        if self.min_price is not None and self.max_price is not None and self.max_price < self.min_price:
            raise ValueError("max_price is below min_price")


def export_filter(parts: DataFrame, fitments: DataFrame, wanted: ExportFilter) -> DataFrame:
    """Apply every given restriction; make and year have to hold on the same vehicle."""
    out = parts
    if wanted.categories:
        out = out.where(tx.normalize_label(F.col("category")).isin(*wanted.categories))
    if wanted.min_price is not None:
        out = out.where(F.col("price") >= wanted.min_price)
    if wanted.max_price is not None:
        out = out.where(F.col("price") <= wanted.max_price)
    if wanted.makes or wanted.years:
        titled = fitments.select("sku", tx.normalize_label(F.col("make")).alias("make"), "year")
        out = filter_vehicle(out, titled, wanted.makes, (), wanted.years)
    return out


def suggest(parts: DataFrame, keyword: str) -> DataFrame:
    """The first hits of a search by name, with a title, a short excerpt, an image and a price."""
    title = F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col("name")).otherwise(
        F.concat("category", F.lit(" - "), "sku")
    )
    excerpt = F.when(F.col("description").isNotNull(), tx.first_words(F.col("description"), K.EXCERPT_WORDS))
    image = F.coalesce(F.try_element_at("images", F.lit(2)), F.try_element_at("images", F.lit(1)))
    return (
        keyword_search(parts, keyword, interchange=True)
        .orderBy(F.col("name").asc(), F.col("id").asc())
        .limit(K.SUGGEST_LIMIT)
        .select(
            "id", title.alias("title"), "sku", "price", F.coalesce(excerpt, F.lit("")).alias("excerpt"),
            image.url.alias("image"),
        )
    )


def relativize_images(parts: DataFrame) -> DataFrame:
    """Absolute image urls of the catalog's own images become relative; ``images_changed`` tells where it mattered."""
    relative = F.transform(
        "images", lambda i: i.withField("url", F.regexp_replace(i.url, K.RELATIVE_IMAGE, "$1"))
    )
    return parts.withColumn("_images", relative).select(
        *[F.col("_images").alias("images") if c == "images" else F.col(c) for c in parts.columns],
        (~F.col("images").eqNullSafe(F.col("_images"))).alias("images_changed"),
    )


def relativize_counts(parts: DataFrame) -> DataFrame:
    """How many rows with images change and how many are left as they are."""
    seen = relativize_images(parts.where(F.size("images") > 0))
    return seen.agg(
        F.count_if("images_changed").alias("changed"), F.count_if(~F.col("images_changed")).alias("skipped")
    )


def resolve_images(parts: DataFrame, base_url: str) -> DataFrame:
    """The other way round: relative urls get the given base; absolute ones stay."""
    prefix = F.lit(base_url.rstrip("/") + "/")
    resolved = F.transform(
        "images",
        lambda i: i.withField(
            "url", F.when(i.url.rlike("^(https?:)?//"), i.url).otherwise(F.concat(prefix, F.ltrim(i.url, F.lit("/"))))
        ),
    )
    return parts.withColumn("images", resolved)
