"""Whole runs, each composed from the single jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import dedup
from partloom.operators.paging import CatalogQuery
from partloom.plans import browse, build, imports
from partloom.registry import query
from partloom.registry.base import sql, title
from partloom.registry.catalog import _MAKES, _REQUEST, _REQUEST_SQL
from partloom.registry.pages import _listing_pages
from partloom.session import work_path
from partloom.sources import adapters as A
from partloom.sources import exports

_BUILT = f"""SELECT 'CSF-' || p_partkey AS sku, CASE WHEN p_partkey % 2 = 0 THEN 'extra' ELSE p_partkey || '- ' || p_name END AS name,
  CASE WHEN p_partkey % 2 = 0 THEN 'Unknown' ELSE {title("p_type")} END AS category, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT)
  AS fitments, CASE WHEN p_partkey % 10 = 0 THEN 'new' ELSE 'changed' END AS change FROM part WHERE p_size % 30 <> 7
  UNION ALL SELECT 'CSF-' || p_partkey, p_name, p_type, CAST(0 AS BIGINT), NULL FROM part WHERE p_size % 30 = 7 AND p_partkey % 10 <> 0"""


@query(
    "R1_build_catalog",
    f"""SELECT b.*, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 'Full text for ' || p_name WHEN change IS NULL AND k % 3 <> 0 THEN
    concat_ws(' ', 'OE style', p_name, 'by', p_brand || ';', 'size', p_size, 'from the', lower(p_type), 'line') END AS description
    FROM (SELECT *, CAST(sku[5:] AS BIGINT) AS k FROM ({_BUILT})) b JOIN part ON p_partkey = k""".replace("b.*", "b.* EXCLUDE (k)"),
)
def r1(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to parts, fitments and changes. Pages whose vehicle has an impossible year fail as a whole."""
    pages = _listing_pages(spark, sf).withColumnRenamed("page_id", "application_id")
    size = F.col("p_size") % 30
    applications = A.table(spark, sf, "part").select(
        F.col("p_partkey").alias("application_id"), F.col("p_partkey").alias("app_pos"), F.col("p_brand").alias("make"),
        F.col("p_name").alias("model"), F.when(size == 7, 1900).otherwise(1990 + size).cast("string").alias("year"),
    )
    previous = exports.export_rows(A.snapshot(spark, sf, "previous").drop("id")).withColumn("price", F.col("price").cast("decimal(10,2)"))
    built = build.build_catalog(pages, applications, A.details(spark, sf), previous, current_year=2026)
    counted = built.fitments.groupBy("sku").agg(F.count(F.lit(1)).alias("fitments"))
    joined = built.parts.join(counted, "sku", "left").join(built.changes, "sku", "left")
    return joined.select("sku", "name", "category", F.coalesce("fitments", F.lit(0)).alias("fitments"), "change", "description")


@query(
    "R1_failures",
    "SELECT 'application' AS phase, CAST(p_partkey AS VARCHAR) AS identifier FROM part WHERE p_size % 30 = 7",
)
def r1f(spark: SparkSession, sf: str) -> DataFrame:
    pages = _listing_pages(spark, sf).withColumnRenamed("page_id", "application_id")
    size = F.col("p_size") % 30
    applications = A.table(spark, sf, "part").select(
        F.col("p_partkey").alias("application_id"), F.col("p_partkey").alias("app_pos"), F.col("p_brand").alias("make"),
        F.col("p_name").alias("model"), F.when(size == 7, 1900).otherwise(1990 + size).cast("string").alias("year"),
    )
    previous = A.snapshot(spark, sf, "previous").drop("id")
    return build.build_catalog(pages, applications, A.details(spark, sf), previous, current_year=2026).failures.select("phase", "identifier")


@query(
    "R2_import_exports",
    sql(
        """SELECT run, status, parts FROM (
          SELECT 1 AS run, 'created' AS status, (SELECT count(*) FROM prev) AS parts UNION ALL SELECT 1, 'updated', 0 UNION ALL
          SELECT 1, 'unchanged', 0 UNION ALL SELECT 1, 'skipped', 0 UNION ALL
          SELECT 2, 'created', (SELECT count(*) FROM cur WHERE sku NOT IN (SELECT sku FROM prev)) UNION ALL
          SELECT 2, 'updated', (SELECT count(*) FROM cur c JOIN prev p USING (sku) WHERE c.price <> p.price) UNION ALL
          SELECT 2, 'unchanged', (SELECT count(*) FROM cur c JOIN prev p USING (sku) WHERE c.price = p.price) UNION ALL SELECT 2, 'skipped', 0)""",
        "prev", "cur",
    ),
)
def r2(spark: SparkSession, sf: str) -> DataFrame:
    """Two exports imported one after the other."""
    root = work_path(spark, "import-run")
    outcomes = []
    for run, which in ((1, "previous"), (2, "current")):
        rows = exports.export_rows(A.snapshot(spark, sf, which)).select("sku", "name", "category", "description", "price", "images", "specifications")
        rows.write.json(f"{root}/drop-{run}")
        outcome = imports.import_exports(spark, f"{root}/drop-{run}", f"{root}/catalog")
        outcomes.append(outcome.select(F.lit(run).alias("run"), "status", "parts"))
    return dedup.concat_exports(*outcomes)


@query(
    "R3_browse",
    sql(
        f"""SELECT c.sku, 'CSF' || c.id AS name, array_to_string(m.makes, ',') AS makes FROM (SELECT * FROM cat WHERE {_REQUEST_SQL}
        ORDER BY name, id LIMIT 20) c LEFT JOIN ({_MAKES}) m USING (sku)""",
        "cat", "fit",
    ),
)
def r3(spark: SparkSession, sf: str) -> DataFrame:
    shown = browse.browse(A.catalog(spark, sf), A.fitments(spark, sf), CatalogQuery(**_REQUEST), list(A.ORDER))
    return shown.cards.select("sku", "name", F.array_join("makes", ",").alias("makes"))
