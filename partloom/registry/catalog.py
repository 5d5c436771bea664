"""Catalog queries: scans, filters, facets, statistics, sorting and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import aggregates, filters, paging, projections
from partloom.registry import query
from partloom.registry.base import capitalized, fractions, slug, sql, title, words
from partloom.sources import adapters as A


def _price(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.col("price").cast("double"))


@query("S5_scan_catalog", sql("SELECT id, sku, category, manufacturer FROM cat", "cat"))
def s5(spark: SparkSession, sf: str) -> DataFrame:
    return A.catalog(spark, sf).select("id", "sku", "category", "manufacturer")


# --- filters --------------------------------------------------------------------------------------------------------


@query(
    "F1_filter_hierarchy",
    sql("SELECT application_id, make, year, model FROM app WHERE lower(make) = 'nation_15' AND CAST(year AS INT) = 1995", "app"),
)
def f1(spark: SparkSession, sf: str) -> DataFrame:
    found = filters.filter_hierarchy(A.applications(spark, sf), make="Nation_15", year=1995)
    return found.select("application_id", "make", "year", "model")


@query(
    "F2_keyword_search",
    sql(
        """SELECT sku, name FROM cat WHERE contains(lower(sku), 'brand#1') OR contains(lower(name), 'brand#1')
        OR contains(lower(coalesce(description, '')), 'brand#1') OR contains(lower(manufacturer), 'brand#1')""",
        "cat",
    ),
)
def f2(spark: SparkSession, sf: str) -> DataFrame:
    return filters.keyword_search(A.catalog(spark, sf), "Brand#1").select("sku", "name")


@query(
    "F2_keyword_search_interchange",
    sql(
        """SELECT sku, name FROM cat WHERE contains(lower(sku), '07') OR contains(lower(name), '07')
        OR contains(lower(coalesce(description, '')), '07') OR contains(lower(manufacturer), '07')
        OR sku IN (SELECT sku FROM ref WHERE contains(lower(reference_number), '07') OR contains(lower(reference_type), '07'))""",
        "cat", "ref",
    ),
)
def f2i(spark: SparkSession, sf: str) -> DataFrame:
    return filters.keyword_search(A.catalog(spark, sf), "07", interchange=True).select("sku", "name")


@query("F3_filter_category", sql("SELECT sku, category FROM cat WHERE lower(category) IN ('promo', 'small')", "cat"))
def f3(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_category(A.catalog(spark, sf), ["Promo", "SMALL"]).select("sku", "category")


@query(
    "F4_filter_vehicle",
    sql(
        """SELECT sku, name FROM cat WHERE sku IN (SELECT sku FROM fit WHERE make IN ('NATION_15', 'NATION_20')
        AND model IN ('Model 0', 'Model 1') AND year IN (1997, 1998))""",
        "cat", "fit",
    ),
)
def f4(spark: SparkSession, sf: str) -> DataFrame:
    wanted = dict(makes=["NATION_15", "NATION_20"], models=["Model 0", "Model 1"], years=["1997", 1998])
    return filters.filter_vehicle(A.catalog(spark, sf), A.fitments(spark, sf), **wanted).select("sku", "name")


@query(
    "F5_lookup",
    sql(
        """SELECT s.slug, c.id, c.sku, c.name FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'csf' ELSE 'CSF' END || s_suppkey * 7
        AS slug FROM supplier) s LEFT JOIN cat c ON c.sku = 'CSF-' || regexp_replace(s.slug, '^csf', '', 'i')""",
        "cat",
    ),
)
def f5(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    prefix = F.when(key % 2 == 0, "csf").otherwise("CSF")
    requests = A.table(spark, sf, "supplier").select(F.concat(prefix, (key * 7).cast("string")).alias("slug"))
    return filters.lookup_slugs(requests, A.catalog(spark, sf)).select("slug", "id", "sku", "name")


@query("F5_lookup_by_slug", sql("SELECT id, sku, name FROM cat WHERE sku = 'CSF-42'", "cat"))
def f5s(spark: SparkSession, sf: str) -> DataFrame:
    parts = A.catalog(spark, sf)
    by_slug = filters.lookup_by_slug(parts, "csf42").select("id", "sku", "name")
    by_sku = filters.lookup_by_sku(parts, "CSF-42").select("id", "sku", "name")
    by_id = filters.lookup_by_id(parts, 42).select("id", "sku", "name")
    return by_slug.intersect(by_sku).intersect(by_id)


@query(
    "F6_needs_enrichment",
    sql("SELECT sku FROM cat WHERE description IS NULL OR id % 4 = 0", "cat"),
)
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return filters.needs_enrichment(A.catalog(spark, sf)).select("sku")


@query(
    "F6_targeted",
    sql(
        """SELECT t.sku, c.sku IS NOT NULL AS known FROM (SELECT DISTINCT 'CSF-' || s_suppkey * 30 AS sku FROM supplier) t
        LEFT JOIN cat c USING (sku)""",
        "cat",
    ),
)
def f6t(spark: SparkSession, sf: str) -> DataFrame:
    targets = A.table(spark, sf, "supplier").select(F.concat(F.lit("CSF-"), (F.col("s_suppkey") * 30).cast("string")).alias("sku"))
    parts = A.catalog(spark, sf)
    found = filters.needs_enrichment(parts, targets).select("sku", F.lit(True).alias("known"))
    return found.unionByName(filters.unknown_targets(parts, targets).select("sku", F.lit(False).alias("known")))


@query(
    "F7_export_filter",
    sql(
        f"""SELECT sku, category, CAST(price AS DOUBLE) AS price FROM cat WHERE {title("category")} IN ('Economy', 'Promo')
        AND price >= 905 AND price <= 1400
        AND sku IN (SELECT sku FROM fit WHERE {title("make")} IN ('Nation_3', 'Nation_11') AND year IN (1996, 1999))""",
        "cat", "fit",
    ),
)
def f7(spark: SparkSession, sf: str) -> DataFrame:
    wanted = filters.ExportFilter(
        makes=["nation_3 ", "NATION_11"], years=[1999, 1996], categories=["economy", " PROMO"], min_price=905, max_price=1400
    )
    return _price(filters.export_filter(A.catalog(spark, sf), A.fitments(spark, sf), wanted).select("sku", "category", "price"))


_MAKES = """SELECT sku, array_agg(make ORDER BY o1, o2, o3, o4, o5) AS makes FROM (
  SELECT *, row_number() OVER (PARTITION BY sku, make ORDER BY o1, o2, o3, o4, o5) AS rn FROM fit) WHERE rn = 1 GROUP BY sku"""


def _dims(kind: str) -> str:
    a, b, c = {"Box": ("Length", "Width", "Height"), "Core": ("Length", "Width", "Thickness")}[kind]
    one = lambda n: fractions(f"max(CASE WHEN key = '{kind} {n} (in)' THEN replace(value, ' (in)', '') END)")
    return f"SELECT sku, {one(a)} || '\" × ' || {one(b)} || '\" × ' || {one(c)} || '\"' AS dimensions FROM spec GROUP BY sku"


def _cards_sql(kind: str) -> str:
    return sql(
        f"""SELECT c.id, c.sku, 'CSF' || c.id AS name, c.category, CAST(c.price AS DOUBLE) AS price, c.in_stock, c.manufacturer,
        i.url AS image, 'https://example.com/parts/csf' || c.id AS link, coalesce(array_to_string(m.makes, ','), '') AS makes,
        coalesce(array_to_string(m.makes[1:4], ','), '') AS badges,
        CASE WHEN len(m.makes) > 4 THEN '+' || (len(m.makes) - 4) END AS more_makes, d.dimensions
        FROM cat c LEFT JOIN (SELECT id, arg_max(url, pos) AS url FROM img WHERE pos <= 1 GROUP BY id) i ON i.id = c.id
        LEFT JOIN ({_MAKES}) m ON m.sku = c.sku LEFT JOIN ({_dims(kind)}) d ON d.sku = c.sku""",
        "cat", "img", "fit", "spec",
    )


def _cards(spark: SparkSession, sf: str, core: bool) -> DataFrame:
    makes = aggregates.part_makes(A.fitments(spark, sf), list(A.ORDER))
    cards = projections.catalog_cards(A.catalog(spark, sf), makes, core=core)
    return cards.withColumn("makes", F.array_join("makes", ",")).withColumn("badges", F.array_join("badges", ","))


@query("F8_catalog_cards", _cards_sql("Box"))
def f8(spark: SparkSession, sf: str) -> DataFrame:
    return _cards(spark, sf, False)


@query("F8_catalog_cards_core", _cards_sql("Core"))
def f8c(spark: SparkSession, sf: str) -> DataFrame:
    return _cards(spark, sf, True)


_SIZE = "max(CASE WHEN key = '{0}' THEN value END)"


@query(
    "F9_key_specs",
    sql(
        f"""SELECT sku, max(CASE WHEN regexp_matches(key, '^(CSF-?)?[0-9]+$') THEN value END) AS part_type,
        concat_ws('; ',
          'Construction=' || {capitalized("lower(" + _SIZE.format("Construction") + ")")},
          'Core Length=' || {fractions(_SIZE.format("Core Length (in)"))},
          'Core Thickness=' || {fractions(_SIZE.format("Core Thickness (in)"))},
          'Core Width=' || {fractions(_SIZE.format("Core Width (in)"))},
          'Flow=' || {capitalized("lower(" + _SIZE.format("Flow Type") + ")")},
          'Inlet=' || {fractions('coalesce(' + _SIZE.format("Inlet Length (in)") + " || '\" × ' || " + _SIZE.format("Inlet Width (in)") + " || '\"', " + _SIZE.format("Inlet Length (in)") + ", " + _SIZE.format("Inlet Width (in)") + ")")},
          'Outlet=' || {capitalized("lower(" + _SIZE.format("Outlet Size") + ")")}) AS key_specs
        FROM spec GROUP BY sku""",
        "spec",
    ),
)
def f9(spark: SparkSession, sf: str) -> DataFrame:
    found = projections.key_specs(A.catalog(spark, sf))
    joined = F.array_join(F.transform("key_specs", lambda e: F.concat(e["label"], F.lit("="), e["value"])), "; ")
    return found.select("sku", "part_type", joined.alias("key_specs"))


@query(
    "F10_spec_rows",
    sql(
        f"""SELECT sku, key, CASE WHEN regexp_matches(key, '^(CSF-?)?[0-9]+$') THEN 'Part Type'
        ELSE {capitalized("replace(key, '_', ' ')")} END AS label, {fractions("value")} AS value FROM spec""",
        "spec",
    ),
)
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return projections.spec_rows(A.catalog(spark, sf))


@query(
    "F11_admin_list",
    sql(
        """SELECT id, sku, name, category FROM catts WHERE lower(category) = 'economy' AND (contains(lower(sku), '1')
        OR contains(lower(name), '1')) ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20""",
        "catts",
    ),
)
def f11(spark: SparkSession, sf: str) -> DataFrame:
    parts = A.catalog(spark, sf, timestamps=True)
    return paging.admin_list(parts, category="ECONOMY", search="1", page=2).select("id", "sku", "name", "category")


@query(
    "F12_suggest",
    sql(
        f"""SELECT c.id, c.name AS title, c.sku, CAST(c.price AS DOUBLE) AS price,
        coalesce({words("c.description", 20)}, '') AS excerpt, i.url AS image
        FROM cat c LEFT JOIN (SELECT id, arg_max(url, pos) AS url FROM img WHERE pos <= 1 GROUP BY id) i ON i.id = c.id
        WHERE contains(lower(c.sku), 'widget') OR contains(lower(c.name), 'widget')
        OR contains(lower(coalesce(c.description, '')), 'widget') OR contains(lower(c.manufacturer), 'widget')
        ORDER BY c.name, c.id LIMIT 10""",
        "cat", "img",
    ),
)
def f12(spark: SparkSession, sf: str) -> DataFrame:
    return _price(filters.suggest(A.catalog(spark, sf), "widget"))


_PRICE_TEXT = "'$' || format('{:,.2f}', CAST(price AS DOUBLE))"


@query(
    "F13_product_feed",
    sql(
        f"""SELECT sku, 'CSF' || id AS title, 'https://example.com/parts/csf' || id AS canonical_url,
        CASE WHEN price > 0 THEN {_PRICE_TEXT} ELSE 'Contact for pricing' END AS price_text,
        category || ' for ' || manufacturer || '. Price: ' || {_PRICE_TEXT} || '. In stock and ready to ship. '
          || coalesce({words("description", 20)}, '') AS meta_description,
        CASE WHEN in_stock THEN 'https://schema.org/InStock' ELSE 'https://schema.org/OutOfStock' END AS availability,
        'CSF' || id AS markup_name, manufacturer AS markup_brand, CAST(price AS VARCHAR) AS markup_price
        FROM cat""",
        "cat",
    ),
)
def f13(spark: SparkSession, sf: str) -> DataFrame:
    feed = projections.product_feed(A.catalog(spark, sf))
    field = lambda path: F.get_json_object("markup", path)
    return feed.select(
        "sku", "title", "canonical_url", "price_text", "meta_description", "availability",
        field("$.name").alias("markup_name"), field("$.brand.name").alias("markup_brand"),
        field("$.offers.price").alias("markup_price"),
    )


@query(
    "F13_vehicle_feed",
    sql(
        """SELECT c.sku, v.year || ' ' || array_to_string(list_transform(string_split(replace(v.make, '-', ' '), ' '),
        lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || v.model || ' CSF' || c.id AS title
        FROM cat c JOIN (SELECT DISTINCT sku, year, make, model FROM fit) v USING (sku)""",
        "cat", "fit",
    ),
)
def f13v(spark: SparkSession, sf: str) -> DataFrame:
    vehicles = A.fitments(spark, sf).select("sku", "year", "make", "model").distinct()
    return projections.product_feed(A.catalog(spark, sf), vehicles).select("sku", "title")


@query(
    "F14_cleanup_import",
    sql(
        """SELECT c.sku, CASE WHEN c.category = 'Drive Motor Inverter Cooler' THEN 'Inverter Cooler' ELSE c.category END AS category,
        coalesce(nullif(c.description, ''), nullif(c.full_description, ''), c.description) AS description,
        replace(replace(regexp_replace(c.name, '^CSFCSF-', 'CSF-'), 'CSF-', 'CSF'), '-', '') AS name,
        coalesce(i.urls, '') AS urls FROM (
          SELECT id, sku, CASE WHEN id % 6 = 0 THEN 'Drive Motor Inverter Cooler' ELSE category END AS category, description,
          'Full ' || name AS full_description, CASE WHEN id % 2 = 0 THEN 'CSFCSF-' ELSE 'CSF-' END || id || '-' || name AS name FROM cat) c
        LEFT JOIN (SELECT id, string_agg(CASE WHEN url LIKE 'images/%' THEN 'https://example.com/uploads/' || url ELSE url END,
          ' ' ORDER BY pos) AS urls FROM img GROUP BY id) i USING (id)""",
        "cat", "img",
    ),
)
def f14(spark: SparkSession, sf: str) -> DataFrame:
    parts = A.catalog(spark, sf)
    dirty = parts.withColumns(
        {
            "category": F.when(F.col("id") % 6 == 0, "Drive Motor Inverter Cooler").otherwise(F.col("category")),
            "full_description": F.concat(F.lit("Full "), "name"),
            "name": F.concat(
                F.when(F.col("id") % 2 == 0, "CSFCSF-").otherwise("CSF-"), F.col("id").cast("string"), F.lit("-"), F.col("name")
            ),
        }
    )
    urls = F.array_join(F.transform("images", lambda i: i.url), " ")
    return projections.cleanup_import(dirty).select("sku", "category", "description", "name", urls.alias("urls"))


@query(
    "F14_cleanup_engines",
    sql(
        r"""SELECT sku, make, model, year, regexp_replace(engine || CASE WHEN o2 % 2 = 0 THEN ' Eng.' ELSE '' END, ' Eng\.$', '')
        AS engine, o1, o2, o3, o4 FROM fit""",
        "fit",
    ),
)
def f14e(spark: SparkSession, sf: str) -> DataFrame:
    seen = A.fitments(spark, sf)
    suffixed = F.concat("engine", F.when(F.col("o2") % 2 == 0, F.lit(" Eng.")).otherwise(F.lit("")))
    one = seen.select(
        "sku", "o1", "o2", "o3", "o4", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("description"),
        F.array(F.struct("make", "model", "year", suffixed.alias("engine"))).alias("compatibility"),
    )
    return projections.cleanup_import(one).select("sku", "o1", "o2", "o3", "o4", F.inline("compatibility"))


@query(
    "F15_relativize_images",
    sql(
        """SELECT c.sku, coalesce(i.urls, '') AS urls, coalesce(i.changed, false) AS images_changed FROM cat c LEFT JOIN (
          SELECT id, string_agg(regexp_replace(url, '^https?://.*/(images/avif/.+)$', '\\1'), ' ' ORDER BY pos) AS urls,
          bool_or(url LIKE 'https://%') AS changed FROM img GROUP BY id) i USING (id)""".replace("\\\\1", "\\1"),
        "cat", "img",
    ),
)
def f15(spark: SparkSession, sf: str) -> DataFrame:
    urls = F.array_join(F.transform("images", lambda i: i.url), " ")
    return filters.relativize_images(A.catalog(spark, sf)).select("sku", urls.alias("urls"), "images_changed")


@query(
    "F15_relativize_counts",
    sql(
        """SELECT count_if(changed) AS changed, count_if(NOT changed) AS skipped FROM (
        SELECT id, bool_or(url LIKE 'https://%') AS changed FROM img GROUP BY id)""".replace(
            "count_if(changed)", "CAST(count_if(changed) AS BIGINT)"
        ).replace("count_if(NOT changed)", "CAST(count_if(NOT changed) AS BIGINT)"),
        "img",
    ),
)
def f15c(spark: SparkSession, sf: str) -> DataFrame:
    return filters.relativize_counts(A.catalog(spark, sf))


@query(
    "F15_resolve_images",
    sql(
        """SELECT c.sku, coalesce(i.urls, '') AS urls FROM cat c LEFT JOIN (SELECT id, string_agg(
        CASE WHEN url LIKE 'http%' THEN url ELSE 'https://example.com/uploads/' || url END, ' ' ORDER BY pos) AS urls
        FROM img GROUP BY id) i USING (id)""",
        "cat", "img",
    ),
)
def f15r(spark: SparkSession, sf: str) -> DataFrame:
    urls = F.array_join(F.transform("images", lambda i: i.url), " ")
    return filters.resolve_images(A.catalog(spark, sf), "https://example.com/uploads").select("sku", urls.alias("urls"))


# --- aggregates -----------------------------------------------------------------------------------------------------


@query("A1_facet_makes", sql("SELECT make, count(DISTINCT sku) AS parts FROM fit GROUP BY make", "fit"))
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.facet_makes(A.fitments(spark, sf))


@query("A2_facet_years", sql("SELECT year, count(DISTINCT sku) AS parts FROM fit GROUP BY year", "fit"))
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.facet_years(A.fitments(spark, sf))


@query("A3_facet_categories", sql("SELECT DISTINCT category FROM cat WHERE category <> ''", "cat"))
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.facet_categories(A.catalog(spark, sf))


@query("A4_makes_for_year", sql("SELECT DISTINCT make FROM fit WHERE year = 1998", "fit"))
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.makes_for_year(A.fitments(spark, sf), 1998)


@query(
    "A5_models_for",
    sql(
        """SELECT 'all' AS scope, model FROM (SELECT DISTINCT model FROM fit) UNION ALL
        SELECT 'make', model FROM (SELECT DISTINCT model FROM fit WHERE make = 'NATION_3') UNION ALL
        SELECT 'make+year', model FROM (SELECT DISTINCT model FROM fit WHERE make = 'NATION_3' AND year = 1997)""",
        "fit",
    ),
)
def a5(spark: SparkSession, sf: str) -> DataFrame:
    seen = A.fitments(spark, sf)
    scoped = lambda scope, df: df.select(F.lit(scope).alias("scope"), "model")
    return (
        scoped("all", aggregates.models_for(seen))
        .unionByName(scoped("make", aggregates.models_for(seen, "NATION_3")))
        .unionByName(scoped("make+year", aggregates.models_for(seen, "NATION_3", 1997)))
    )


_STATS = """
  SELECT 'total_parts' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM fit
  UNION ALL SELECT 'unique_skus', '', CAST(count(DISTINCT sku) AS DOUBLE) FROM fit
  UNION ALL SELECT 'duplicate_count', '', CAST(count(*) AS DOUBLE) FROM (SELECT sku FROM fit GROUP BY sku HAVING count(*) > 1)
  UNION ALL SELECT 'deduplication_rate', '', (SELECT count(*) FROM (SELECT sku FROM fit GROUP BY sku HAVING count(*) > 1))
    / CAST(count(DISTINCT sku) AS DOUBLE) FROM fit
  UNION ALL SELECT 'price_data_available', '', CAST(bool_or(price IS NOT NULL) AS INT)::DOUBLE FROM fit JOIN cat USING (sku)
  UNION ALL SELECT 'parts_by_category', coalesce(category, 'Unknown'), CAST(count(*) AS DOUBLE) FROM fit JOIN cat USING (sku) GROUP BY 2
  UNION ALL SELECT 'total_vehicles', '', CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT make, model, year FROM fit)
  UNION ALL SELECT 'vehicles_by_make', make, CAST(count(*) AS DOUBLE) FROM fit GROUP BY make"""


def _sightings(spark: SparkSession, sf: str) -> DataFrame:
    """Part records as in a raw export: one per sighting, with its vehicle."""
    parts = A.catalog(spark, sf).select("sku", "category", "price")
    return A.fitments(spark, sf).select("sku", F.struct("make", "model", "year").alias("vehicle")).join(parts, "sku")


@query("A6_dataset_stats", sql(_STATS, "fit", "cat"))
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.dataset_stats(_sightings(spark, sf))


@query(
    "A7_catalog_stats",
    sql(
        """SELECT 'total_parts' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM cat
        UNION ALL SELECT 'categories', '', CAST(count(DISTINCT category) AS DOUBLE) FROM cat
        UNION ALL SELECT 'makes', '', CAST(count(DISTINCT make) AS DOUBLE) FROM fit
        UNION ALL SELECT 'years', '', CAST(count(DISTINCT year) AS DOUBLE) FROM fit
        UNION ALL SELECT 'parts_in_category', category, CAST(count(*) AS DOUBLE) FROM cat GROUP BY category
        UNION ALL SELECT 'parts_for_make', make, CAST(count(DISTINCT sku) AS DOUBLE) FROM fit GROUP BY make""",
        "cat", "fit",
    ),
)
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.catalog_stats(A.catalog(spark, sf), A.fitments(spark, sf))


_FAILURES = """SELECT phase, count(*) AS failures, CAST(count_if(is_retryable) AS BIGINT) AS retryable,
  CAST(count_if(NOT is_retryable) AS BIGINT) AS permanent FROM fail GROUP BY phase
  UNION ALL SELECT NULL, count(*), CAST(count_if(is_retryable) AS BIGINT), CAST(count_if(NOT is_retryable) AS BIGINT) FROM fail"""


@query("A8_failure_summary", sql(_FAILURES, "fail"))
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.failure_summary(A.failures(spark, sf))


@query("A8_failed_identifiers", sql("SELECT identifier FROM fail WHERE phase = 'error'", "fail"))
def a8i(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.failed_identifiers(A.failures(spark, sf), "error")


@query(
    "A9_run_report",
    sql(
        """SELECT applications, applications_failed, failures, applications_failed / applications AS application_failure_rate,
        failures / applications AS failure_rate, applications_failed / applications > 0.05 AS too_many_failed_applications,
        failures / applications > 0.05 AS too_many_failures FROM (
          SELECT (SELECT count(*) FROM orders) AS applications, CAST(count_if(phase = 'error') AS BIGINT) AS applications_failed,
          count(*) AS failures FROM fail)""",
        "fail",
    ),
)
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.run_report(A.table(spark, sf, "orders"), A.failures(spark, sf), application_phase="error")


@query("A10_year_range", sql("SELECT sku, min(year) AS first_year, max(year) AS last_year FROM fit GROUP BY sku", "fit"))
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.year_range(A.fitments(spark, sf))


@query(
    "A11_breakdowns",
    sql(
        f"""SELECT 'category_share' AS metric, key, value / sum(value) OVER () * 100 AS value FROM s WHERE metric = 'parts_by_category'
        UNION ALL SELECT 'make_share', key, value / sum(value) OVER () * 100 FROM s WHERE metric = 'vehicles_by_make'
        UNION ALL SELECT 'avg_parts_per_category', '', (SELECT value FROM s WHERE metric = 'total_parts') / count(*) FROM s
          WHERE metric = 'parts_by_category'
        UNION ALL SELECT 'sku_utilization', '', (SELECT value FROM s WHERE metric = 'unique_skus')
          / (SELECT value FROM s WHERE metric = 'total_parts')
        UNION ALL SELECT 'parts_per_kb', '', (SELECT value FROM s WHERE metric = 'total_parts') / (4096000 / 1024)""".replace(
            "FROM s", f"FROM ({_STATS}) s"
        ),
        "fit", "cat",
    ),
)
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.breakdowns(aggregates.dataset_stats(_sightings(spark, sf)), F.lit(4096000))


@query(
    "A12_integrity_check",
    sql(
        """SELECT CAST(count_if(sku IS NULL OR sku = '') AS BIGINT) AS missing_sku,
        CAST(count_if(NOT json_valid(specifications) OR NOT json_valid(compatibility)) AS BIGINT) AS invalid_json,
        (SELECT count(*) FROM (SELECT CASE WHEN l_partkey % 13 = 0 THEN '' ELSE 'CSF-' || l_partkey END AS sku FROM lineitem
          GROUP BY 1 HAVING count(*) > 1)) AS duplicate_skus
        FROM (SELECT CASE WHEN l_partkey % 13 = 0 THEN '' ELSE 'CSF-' || l_partkey END AS sku,
          CASE WHEN l_linenumber = 7 THEN '{"qty": ' ELSE '{"qty": ' || l_linenumber || '}' END AS specifications,
          CASE WHEN l_suppkey % 11 = 0 THEN '[{"make"' ELSE '[]' END AS compatibility FROM lineitem)"""
    ),
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.integrity_check(_stored_text(spark, sf))


def _stored_text(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a stored table with JSON text columns, some of them broken."""
    number = F.col("l_linenumber")
    return A.table(spark, sf, "lineitem").select(
        F.when(F.col("l_partkey") % 13 == 0, "").otherwise(F.concat(F.lit("CSF-"), F.col("l_partkey").cast("string"))).alias("sku"),
        F.when(number == 7, '{"qty": ').otherwise(F.concat(F.lit('{"qty": '), number.cast("string"), F.lit("}"))).alias(
            "specifications"
        ),
        F.lit(None).cast("string").alias("features"),
        F.when(F.col("l_suppkey") % 11 == 0, '[{"make"').otherwise("[]").alias("compatibility"),
        F.lit("").alias("images"),
    )


@query(
    "A12_integrity_fix",
    "SELECT 'CSF-' || l_partkey AS sku, count(*) AS n FROM lineitem WHERE l_partkey % 13 <> 0 GROUP BY 1",
)
def a12f(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.drop_missing_sku(_stored_text(spark, sf)).groupBy("sku").agg(F.count(F.lit(1)).alias("n"))


@query(
    "A13_count_matches",
    sql(
        """SELECT count(*) AS matches, count(DISTINCT id) AS total, CAST(ceil(count(DISTINCT id) / 12.0) AS BIGINT) AS total_pages,
        24 < count(DISTINCT id) AS has_more FROM cat JOIN (SELECT * FROM fit WHERE make = 'NATION_3') f USING (sku)""",
        "cat", "fit",
    ),
)
def a13(spark: SparkSession, sf: str) -> DataFrame:
    fits = A.fitments(spark, sf).where(F.col("make") == "NATION_3")
    return paging.count_matches(A.catalog(spark, sf).join(fits, "sku"), per_page=12, page=2)


@query(
    "A14_url_count",
    sql(
        """SELECT n AS urls, CAST(ceil(n / 2000.0) AS BIGINT) AS pages FROM (
        SELECT (SELECT count(*) FROM cat) + (SELECT count(*) FROM fit1) AS n)""",
        "cat", "fit1",
    ),
)
def a14(spark: SparkSession, sf: str) -> DataFrame:
    from partloom.operators import dedup

    return aggregates.url_count(A.catalog(spark, sf), dedup.dedup_fitments(A.fitments(spark, sf), list(A.ORDER)))


@query(
    "A15_merge_coverage",
    sql(
        """SELECT count(*) AS total, CAST(count_if(d) AS BIGINT) AS enriched, CAST(count_if(f) AS BIGINT) AS with_fitment,
        count_if(d) / count(*) * 100 AS enriched_pct, count_if(f) / count(*) * 100 AS with_fitment_pct FROM (
          SELECT sku IN (SELECT sku FROM det) AS d, sku IN (SELECT sku FROM fit) AS f FROM cat)""",
        "cat", "det", "fit",
    ),
)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.merge_coverage(A.catalog(spark, sf), A.details(spark, sf), A.fitments(spark, sf))


@query(
    "A16_last_modified",
    sql("SELECT strftime(max(updated_at), '%Y-%m-%dT%H:%M:%SZ') AS last_modified FROM catts", "catts"),
)
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.last_modified(A.catalog(spark, sf, timestamps=True))


@query(
    "A18_manifest_status",
    sql(
        """SELECT CASE synced WHEN 'true' THEN 'synced' WHEN 'failed' THEN 'failed' ELSE 'unsynced' END AS state,
        count(*) AS files FROM man GROUP BY 1""",
        "man",
    ),
)
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.manifest_status(A.manifest(spark, sf))


@query(
    "A18_files_by_state",
    sql(
        """SELECT CASE synced WHEN 'true' THEN 'synced' WHEN 'failed' THEN 'failed' ELSE 'unsynced' END AS state, filename
        FROM man""",
        "man",
    ),
)
def a18f(spark: SparkSession, sf: str) -> DataFrame:
    manifest = A.manifest(spark, sf)
    listed = [aggregates.files_in_state(manifest, s).select(F.lit(s).alias("state"), "filename") for s in ("synced", "unsynced", "failed")]
    return listed[0].unionByName(listed[1]).unionByName(listed[2])


@query(
    "A18_upload_totals",
    sql(
        """SELECT CAST(count_if(synced = 'false') AS BIGINT) AS uploaded, CAST(count_if(synced = 'true') AS BIGINT) AS skipped,
        CAST(count_if(synced = 'failed') AS BIGINT) AS failed FROM man""",
        "man",
    ),
)
def a18u(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("synced") == "true", "skipped").when(F.col("synced") == "failed", "failed").otherwise("uploaded")
    return aggregates.upload_totals(A.manifest(spark, sf).select(outcome.alias("outcome")))


@query("A19_part_makes", sql(f"SELECT sku, array_to_string(makes, ',') AS makes FROM ({_MAKES})", "fit"))
def a19(spark: SparkSession, sf: str) -> DataFrame:
    found = aggregates.part_makes(A.fitments(spark, sf), list(A.ORDER))
    return found.select("sku", F.array_join("makes", ",").alias("makes"))


@query(
    "A20_engine_variants",
    sql(
        """SELECT sku, string_agg(engine, ',' ORDER BY engine) AS engines FROM (SELECT DISTINCT sku, engine FROM fit
        WHERE year = 1997 AND lower(make) = 'nation_15' AND lower(model) = 'model 0' AND engine <> '') GROUP BY sku""",
        "fit",
    ),
)
def a20(spark: SparkSession, sf: str) -> DataFrame:
    found = aggregates.engine_variants(A.fitments(spark, sf), 1997, "Nation_15", "MODEL 0")
    return found.select("sku", F.array_join("engines", ",").alias("engines"))


# --- sorting and paging ---------------------------------------------------------------------------------------------

_REQUEST = dict(categories=["ECONOMY", "PROMO"], makes=["NATION_3", "NATION_8", "NATION_15"], years=[1996, 1997, 1998])
_REQUEST_SQL = """lower(category) IN ('economy', 'promo') AND sku IN (SELECT sku FROM fit
  WHERE make IN ('NATION_3', 'NATION_8', 'NATION_15') AND year IN (1996, 1997, 1998))"""


@query(
    "O1_query_catalog",
    sql(
        f"""SELECT id, sku, name, category, CAST(price AS DOUBLE) AS price FROM cat WHERE {_REQUEST_SQL}
        ORDER BY name, id LIMIT 20""",
        "cat", "fit",
    ),
)
def o1(spark: SparkSession, sf: str) -> DataFrame:
    found = paging.query_catalog(A.catalog(spark, sf), A.fitments(spark, sf), paging.CatalogQuery(**_REQUEST))
    return _price(found.select("id", "sku", "name", "category", "price"))


@query(
    "O1_query_catalog_latest",
    sql(
        """SELECT id, sku, name FROM catts WHERE contains(lower(name), 'ring') OR contains(lower(coalesce(description, '')), 'ring')
        OR contains(lower(sku), 'ring') OR contains(lower(manufacturer), 'ring') ORDER BY greatest(created_at, updated_at) DESC, id DESC
        LIMIT 12 OFFSET 12""",
        "catts",
    ),
)
def o1l(spark: SparkSession, sf: str) -> DataFrame:
    request = paging.CatalogQuery(search="RING", orderby="latest", order="desc", per_page=12, page=2)
    parts = A.catalog(spark, sf, timestamps=True)
    return paging.query_catalog(parts, A.fitments(spark, sf), request).select("id", "sku", "name")


@query(
    "O1_query_catalog_after",
    sql(
        """SELECT id, sku, name FROM cat WHERE name > (SELECT name FROM cat WHERE id = 100) OR (name = (SELECT name FROM cat WHERE id = 100) AND id > 100)
        ORDER BY name, id LIMIT 20""",
        "cat",
    ),
)
def o1a(spark: SparkSession, sf: str) -> DataFrame:
    """The page after a given row: no row before it is sorted."""
    parts = A.catalog(spark, sf)
    last = parts.where("id = 100").select("name", "id").first()
    return paging.query_catalog(parts, A.fitments(spark, sf), paging.CatalogQuery(after=tuple(last))).select("id", "sku", "name")


@query("O1_count", sql(f"""SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, 20 < count(*) AS has_more
  FROM cat WHERE {_REQUEST_SQL}""", "cat", "fit"))
def o1c(spark: SparkSession, sf: str) -> DataFrame:
    request = paging.CatalogQuery(**_REQUEST)
    found = paging.matching_parts(A.catalog(spark, sf), A.fitments(spark, sf), request)
    return paging.count_matches(found, request.size, request.page).select("total", "total_pages", "has_more")


@query("O2_newest_parts", sql("SELECT id, sku, name FROM cat ORDER BY id DESC LIMIT 20 OFFSET 20", "cat"))
def o2(spark: SparkSession, sf: str) -> DataFrame:
    return paging.newest_parts(A.catalog(spark, sf), page=2).select("id", "sku", "name")


@query(
    "O3_top_makes",
    sql("SELECT make, count(DISTINCT sku) AS parts FROM fit GROUP BY make ORDER BY parts DESC, make LIMIT 10", "fit"),
)
def o3(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.top_makes(A.fitments(spark, sf))


_URLS = f"""
  SELECT id, 'part' AS kind, 'https://example.com/parts/' || {slug("rtrim(category, 's')")} || '-' || {slug("sku")} AS url,
    CAST(NULL AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS make, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS engine FROM cat
  UNION ALL SELECT c.id, 'vehicle', 'https://example.com/parts/' || f.year || '-' || {slug("f.make")} || '-' || {slug("f.model")}
    || '-' || {slug("rtrim(c.category, 's')")} || '-' || {slug("c.sku")}, f.year, f.make, f.model, f.engine
    FROM cat c JOIN fit1 f USING (sku)"""


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    from partloom.operators import dedup

    return projections.catalog_urls(A.catalog(spark, sf), dedup.dedup_fitments(A.fitments(spark, sf), list(A.ORDER)))


@query("U4_catalog_urls", sql(f"SELECT id, kind, url FROM ({_URLS})", "cat", "fit1"))
def u4(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("id", "kind", "url")


@query(
    "O4_url_page",
    sql(
        f"""SELECT url, position, CAST(floor(position / 2000) AS BIGINT) + 1 AS page FROM (SELECT url, row_number() OVER
        (ORDER BY id, kind, year, make, model, engine NULLS FIRST) - 1 AS position FROM ({_URLS}))""",
        "cat", "fit1",
    ),
)
def o4(spark: SparkSession, sf: str) -> DataFrame:
    return paging.url_pages(_urls(spark, sf), "id", "kind", "year", "make", "model", "engine").select("url", "position", "page")


@query(
    "U4_url_difference",
    sql("SELECT count(*) AS listed, (SELECT count(*) FROM cat) + (SELECT count(*) FROM fit1) AS counted FROM ({0})".format(_URLS), "cat", "fit1"),
)
def u4d(spark: SparkSession, sf: str) -> DataFrame:
    """Urls that are listed next to urls that are counted; they part ways when a vehicle lacks a field."""
    from partloom.operators import dedup

    fits = dedup.dedup_fitments(A.fitments(spark, sf), list(A.ORDER))
    counted = aggregates.url_count(A.catalog(spark, sf), fits).select(F.lit("counted").alias("item"), F.col("urls").alias("n"))
    listed = _urls(spark, sf).agg(F.count(F.lit(1)).alias("n")).select(F.lit("listed").alias("item"), "n")
    both = counted.unionByName(listed)
    return both.agg(*[F.max(F.when(F.col("item") == i, F.col("n"))).alias(i) for i in ("listed", "counted")])

