"""How fitment is presented: spans, cards, ranks, badges, images and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import aggregates, fitment
from partloom.registry import query
from partloom.registry.base import sql
from partloom.sources import adapters as A

_RUNS = """SELECT sku, make, model, min(year) AS first_year, max(year) AS last_year FROM (
  SELECT *, year - row_number() OVER (PARTITION BY sku, make, model ORDER BY year) AS island
  FROM (SELECT DISTINCT sku, make, model, year FROM fit)) GROUP BY sku, make, model, island"""


@query(
    "W3_year_spans",
    sql(
        f"""SELECT sku, make, model, first_year, last_year, CASE WHEN last_year - first_year < 3
        THEN array_to_string(range(first_year, last_year + 1), ', ') ELSE first_year || '–' || last_year END AS label FROM ({_RUNS})""",
        "fit",
    ),
)
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return fitment.year_spans(A.fitments(spark, sf))


_CARDS = """SELECT sku, make, model, years, string_agg(engine || '/' || aspiration || '/' || qualifiers, ',' ORDER BY engine, aspiration,
  qualifiers) AS variants, count(*) AS n, count(*) FILTER (engine <> '') AS engines, bool_or(lower(engine) = 'a-f') AS has_af FROM (
  SELECT sku, make, model, engine, aspiration, qualifiers, string_agg(year, ',' ORDER BY year) AS years FROM (
    SELECT DISTINCT sku, make, model, year, coalesce(engine, '') AS engine,
    CASE WHEN coalesce(aspiration, 'None') = 'None' THEN '' ELSE aspiration END AS aspiration, qualifiers FROM fit) GROUP BY ALL)
  GROUP BY sku, make, model, years"""


def _years() -> Column:
    return F.array_join(F.transform("years", lambda y: y.cast("string")), ",")


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    return fitment.fitment_cards(A.fitments(spark, sf))


@query("W4_fitment_cards", sql(f"SELECT sku, make, model, years, variants FROM ({_CARDS})", "fit"))
def w4(spark: SparkSession, sf: str) -> DataFrame:
    text = F.array_join(F.transform("variants", lambda v: F.concat_ws("/", v["engine"], v["aspiration"], v["qualifiers"])), ",")
    return _cards(spark, sf).select("sku", "make", "model", _years().alias("years"), text.alias("variants"))


_SAME = "(lower(make) = 'nation_15' AND lower(model) = 'model 0' AND contains(years, '1997'))"


@query(
    "W5_rank_cards",
    sql(
        f"""SELECT sku, make, model, years, CAST(row_number() OVER (PARTITION BY sku ORDER BY {_SAME} DESC, lower(make), lower(model),
        CAST(years[1:4] AS INT), years, make, model) AS INTEGER) AS rank FROM ({_CARDS})""",
        "fit",
    ),
)
def w5(spark: SparkSession, sf: str) -> DataFrame:
    ranked = fitment.rank_cards(_cards(spark, sf), "Nation_15", "MODEL 0", 1997)
    return ranked.select("sku", "make", "model", _years().alias("years"), "rank")


@query(
    "W6_primary_image",
    sql(
        """SELECT c.sku, f.url AS flagged_url, d.url AS display_url FROM cat c
        LEFT JOIN (SELECT id, arg_max(url, CASE WHEN is_primary THEN 1000 ELSE -pos END) AS url FROM img GROUP BY id) f USING (id)
        LEFT JOIN (SELECT id, arg_max(url, pos) AS url FROM img WHERE pos <= 1 GROUP BY id) d USING (id)""",
        "cat", "img",
    ),
)
def w6(spark: SparkSession, sf: str) -> DataFrame:
    return fitment.primary_images(A.catalog(spark, sf))


@query(
    "W7_image_names",
    sql("SELECT sku, pos AS position, sku || '_' || pos || '.avif' AS filename FROM img WHERE NOT (id % 3 = 0 AND pos = 0)", "img"),
)
def w7(spark: SparkSession, sf: str) -> DataFrame:
    gap = lambda i, n: i.withField("url", F.when((F.col("id") % 3 == 0) & (n == 0), "").otherwise(i.url))
    parts = A.catalog(spark, sf).withColumn("images", F.transform("images", gap))
    return fitment.image_names(parts).select("sku", "position", "filename")


@query(
    "W9_recent_log",
    sql(
        """SELECT filename, parts_count, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started, seconds,
        strftime(make_timestamp(seconds * 1000000), '%H:%M:%S') AS duration FROM log ORDER BY started_at DESC, event_id DESC LIMIT 50""",
        "log",
    ),
)
def w9(spark: SparkSession, sf: str) -> DataFrame:
    newest = aggregates.recent_log(A.import_log(spark, sf))
    started = F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started")
    return newest.select("filename", "parts_count", started, "seconds", "duration")


def _badges(spark: SparkSession, sf: str, year: int | None, engine: str | None, mode: str) -> DataFrame:
    found = fitment.match_badges(_cards(spark, sf), "Nation_15", "Model 0", year, engine, mode=mode)
    return found.select("sku", "make", "model", _years().alias("years"), "badge", "hidden")


_BADGE = "SELECT sku, make, model, years, CASE WHEN {0} THEN {1} END AS badge, {2} AS hidden FROM ({3})"
_NAME = "(lower(make) = 'nation_15' AND lower(model) = 'model 0')"


@query("W10_match_badge", sql(_BADGE.format(_SAME, "CASE WHEN engines <= 1 THEN 'Your Vehicle' ELSE 'Possible Match' END", "false", _CARDS), "fit"))
def w10(spark: SparkSession, sf: str) -> DataFrame:
    return _badges(spark, sf, 1997, None, "page")


@query("W10_match_badge_no_engine", sql(_BADGE.format(_SAME, "CASE WHEN engines = 0 THEN 'Your Vehicle' ELSE 'Possible Match' END", "false", _CARDS), "fit"))
def w10n(spark: SparkSession, sf: str) -> DataFrame:
    return _badges(spark, sf, 1997, None, "interactive")


@query("W10_match_badge_engine", sql(_BADGE.format(_SAME, "CASE WHEN has_af THEN 'Your Vehicle' END", "false", _CARDS), "fit"))
def w10e(spark: SparkSession, sf: str) -> DataFrame:
    return _badges(spark, sf, 1997, "a-f", "interactive")


@query(
    "W10_match_badge_inline",
    sql(_BADGE.format(_NAME, "CASE WHEN has_af THEN 'Your Vehicle' END", f"({_NAME} AND NOT has_af)", _CARDS), "fit"),
)
def w10i(spark: SparkSession, sf: str) -> DataFrame:
    return _badges(spark, sf, None, "A-F", "inline")


@query(
    "O5_sort_interchange",
    sql(
        """SELECT c.sku, coalesce(r.refs, '') AS refs FROM cat c LEFT JOIN (SELECT id, string_agg(reference_type || '/' || reference_number,
        ',' ORDER BY encode(reference_type), encode(reference_number)) AS refs FROM ref GROUP BY id) r USING (id)""",
        "cat", "ref",
    ),
)
def o5(spark: SparkSession, sf: str) -> DataFrame:
    text = F.array_join(F.transform("interchange_numbers", lambda r: F.concat_ws("/", r.reference_type, r.reference_number)), ",")
    return fitment.sort_interchange(A.catalog(spark, sf)).select("sku", text.alias("refs"))
