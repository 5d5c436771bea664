"""Row-wise shapes of the catalog: cards, specifications, feeds, urls and import cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import constants as K
from partloom.functions import text as tx
from partloom.functions import values as vx
from partloom.operators.fitment import display_image

SITE = "https://example.com"
QUOTE_BY = '" × '


def _spec(name: str) -> Column:
    return F.nullif(F.element_at("specifications", F.lit(name)), F.lit(""))


def dimensions(names: tuple[str, str, str] = K.BOX_DIMENSIONS, *, strip_unit: bool = False) -> Column:
    """Three sizes as ``L" × W" × H"``; null unless all three are there."""
    sizes = []
    for name in names:
        size = _spec(name)
        if strip_unit:
            size = F.replace(size, F.lit(" (in)"), F.lit(""))
        sizes.append(tx.pretty_fractions(size))
    return F.concat(sizes[0], F.lit(QUOTE_BY), sizes[1], F.lit(QUOTE_BY), sizes[2], F.lit('"'))


def catalog_cards(parts: DataFrame, makes: DataFrame, *, core: bool = False, site: str = SITE) -> DataFrame:
    """List entry of each part. ``makes`` has the part's makes as an array; ``core`` shows core sizes, not box sizes."""
    size = dimensions(K.CORE_DIMENSIONS, strip_unit=True) if core else dimensions()
    joined = parts.join(makes, "sku", "left")
    shown = F.coalesce("makes", F.array().cast("array<string>"))
    more = F.size(shown) - K.MAX_BADGES
    return joined.select(
        "id",
        "sku",
        F.concat(F.lit(K.DEFAULT_MANUFACTURER), tx.sku_digits(F.col("sku"))).alias("name"),
        "category",
        F.when(F.col("price") != 0, F.col("price").cast("double")).alias("price"),
        "in_stock",
        "manufacturer",
        display_image(F.col("images")).url.alias("image"),
        tx.part_url(F.col("sku"), site).alias("link"),
        shown.alias("makes"),
        F.slice(shown, 1, K.MAX_BADGES).alias("badges"),
        F.when(more > 0, F.concat(F.lit("+"), more.cast("string"))).alias("more_makes"),
        size.alias("dimensions"),
    )


def _part_type() -> Column:
    """Value of the specification whose key looks like a part number."""
    numbered = F.map_entries(F.map_filter("specifications", lambda k, v: k.rlike(K.PART_NUMBER_KEY)))
    return F.try_element_at(numbered, F.lit(1))["value"]


def key_specs(parts: DataFrame) -> DataFrame:
    """Up to eight highlighted specifications per part, sorted by label, plus the part type."""
    found: dict[str, Column] = {}
    for label, names in K.KEY_SPECS.items():
        value = vx.first_filled(F.col("specifications"), names)
        found[label] = tx.capitalize_words(F.lower(value)) if label in K.CAPITALIZED_SPECS else value
    for port in K.PORTS:
        written = vx.first_filled(F.col("specifications"), (f"{port} Size", f"{port} Tube", port))
        length, width = _spec(f"{port} Length (in)"), _spec(f"{port} Width (in)")
        both = F.concat(tx.strip(length), F.lit(QUOTE_BY), tx.strip(width), F.lit('"'))
        found[port] = F.coalesce(tx.capitalize_words(F.lower(written)), both, length, width)
    entries = F.array(
        *[F.struct(F.lit(label).alias("label"), tx.pretty_fractions(found[label]).alias("value")) for label in sorted(found)]
    )
    shown = F.slice(F.filter(entries, lambda e: e["value"].isNotNull()), 1, K.KEY_SPEC_LIMIT)
    return parts.select("sku", _part_type().alias("part_type"), shown.alias("key_specs"))


def spec_rows(parts: DataFrame) -> DataFrame:
    """Every specification as a labelled row."""
    rows = parts.select("sku", F.explode("specifications").alias("key", "raw"))
    label = F.when(F.col("key").rlike(K.PART_NUMBER_KEY), F.lit("Part Type")).otherwise(
        tx.capitalize_words(F.replace("key", F.lit("_"), F.lit(" ")))
    )
    return rows.select("sku", "key", label.alias("label"), tx.pretty_fractions(F.col("raw")).alias("value"))


def product_feed(parts: DataFrame, vehicles: DataFrame | None = None, *, site: str = SITE) -> DataFrame:
    """Title, canonical url, price text, meta description and product markup of each part page.

    With ``vehicles`` (sku, year, make, model) there is one row per part and vehicle and the title names the vehicle.
    """
    display = tx.display_sku(F.col("sku"))
    if vehicles is None:
        rows = parts.withColumn("title", display)
    else:
        worded = lambda c: tx.capitalize_words(F.replace(c, F.lit("-"), F.lit(" ")))
        rows = parts.join(vehicles, "sku").withColumn(
            "title",
            F.concat_ws(" ", F.col("year").cast("string"), worded(F.col("make")), worded(F.col("model")), display),
        )
    url = tx.part_url(F.col("sku"), site)
    price = F.when(F.col("price") > 0, F.concat(F.lit("$"), F.format_number("price", 2))).otherwise(K.NO_PRICE_TEXT)
    plain = F.regexp_replace("description", "<[^>]*>", "")
    excerpt = F.coalesce(tx.first_words(plain, K.EXCERPT_WORDS), F.lit(""))
    meta = F.concat(
        F.coalesce("category", F.lit("")), F.lit(" for "), F.coalesce("manufacturer", F.lit("")), F.lit(". Price: "),
        price, F.lit(". In stock and ready to ship. "), excerpt,
    )
    availability = F.when(F.col("in_stock"), K.IN_STOCK_URL).otherwise(K.OUT_OF_STOCK_URL)
    markup = F.to_json(
        F.struct(
            F.lit("https://schema.org/").alias("@context"),
            F.lit("Product").alias("@type"),
            F.col("title").alias("name"),
            F.col("sku"),
            plain.alias("description"),
            F.struct(F.lit("Brand").alias("@type"), F.col("manufacturer").alias("name")).alias("brand"),
            F.struct(
                F.lit("Offer").alias("@type"),
                vx.price_text(F.col("price")).alias("price"),
                F.lit("USD").alias("priceCurrency"),
                availability.alias("availability"),
                url.alias("url"),
            ).alias("offers"),
            F.try_element_at("images", F.lit(1)).url.alias("image"),
        )
    )
    return rows.select(
        "sku", "title", url.alias("canonical_url"), price.alias("price_text"), meta.alias("meta_description"),
        availability.alias("availability"), markup.alias("markup"),
    )


def catalog_urls(parts: DataFrame, fitments: DataFrame, *, site: str = SITE) -> DataFrame:
    """The canonical url of every part and one url per vehicle with year, make and model all present.

    Trailing letters s are cut from the category. Fitments are the long side; parts are unique by sku.
    """
    item = F.concat_ws("-", tx.slug(F.rtrim("category", F.lit("s"))), tx.slug(F.col("sku")))
    named = parts.select("id", "sku", item.alias("_item"))
    canonical = named.select(
        "id", F.lit("part").alias("kind"), F.concat(F.lit(f"{site}/parts/"), "_item").alias("url"),
        F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("make"),
        F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("engine"),
    )
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    complete = fitments.where((F.coalesce("year", F.lit(0)) != 0) & filled("make") & filled("model"))
    path = F.concat_ws("-", F.col("year").cast("string"), tx.slug(F.col("make")), tx.slug(F.col("model")), F.col("_item"))
    vehicles = complete.join(named, "sku").select(
        "id", F.lit("vehicle").alias("kind"), F.concat(F.lit(f"{site}/parts/"), path).alias("url"),
        "year", "make", "model", "engine",
    )
    return canonical.unionByName(vehicles)


def cleanup_import(parts: DataFrame, image_base: str = f"{SITE}/uploads/") -> DataFrame:
    """Tidy imported records: category aliases, description fallback, name prefixes, image urls and engine suffixes."""
    category = F.col("category")
    for old, new in K.CATEGORY_ALIASES.items():
        category = F.when(F.col("category") == old, new).otherwise(category)
    fallback = F.nullif("full_description", F.lit("")) if "full_description" in parts.columns else F.lit(None)
    description = F.coalesce(F.nullif("description", F.lit("")), fallback, F.col("description"))
    name = F.regexp_replace("name", "^CSFCSF-", K.SKU_PREFIX)
    name = F.replace(F.replace(name, F.lit(K.SKU_PREFIX), F.lit("CSF")), F.lit("-"), F.lit(""))
    out = parts.withColumns({"category": category, "description": description, "name": name})
    if "images" in parts.columns:
        based = F.transform(
            "images",
            lambda i: i.withField(
                "url",
                F.when(F.startswith(i.url, F.lit(K.IMAGE_ROOT)), F.concat(F.lit(image_base), i.url)).otherwise(i.url),
            ),
        )
        out = out.withColumn("images", based)
    if "compatibility" in parts.columns:
        cut = F.transform(
            "compatibility", lambda v: v.withField("engine", F.regexp_replace(v.engine, r" Eng\.$", ""))
        )
        out = out.withColumn("compatibility", cut)
    return out
