"""Dropdown responses: script text that carries a list of links, read with native regex columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom import constants as K
from partloom.functions import text as tx

LINK = r"(?is)<a\b[^>]*>.*?</a>"
HREF = r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\xa0", "&amp;": "&"}


def response_html(script: Column) -> Column:
    """Markup inside the script's first ``.html("...")`` call, unescaped; null when there is none."""
    inner = F.nullif(F.regexp_extract(script, f"(?d){K.HTML_CALL}", 1), F.lit(""))
    return F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\/"), F.lit("/"))


def _plain(markup: Column) -> Column:
    text = F.regexp_replace(markup, "<[^>]*>", "")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return tx.strip(text)


def options(responses: DataFrame, key: str, marker: str, script: str = "js") -> DataFrame:
    """(key, option_id, label) rows of the links whose target holds a marker.

    The id is the target's last path segment; others than whole numbers are skipped. The last of equal ids wins.
    """
    links = responses.select(key, F.posexplode(F.regexp_extract_all(response_html(F.col(script)), F.lit(LINK), F.lit(0))).alias("pos", "a"))
    read = links.select(key, "pos", F.regexp_extract("a", HREF, 1).alias("href"), _plain(F.col("a")).alias("label"))
    wanted = read.where(F.contains("href", F.lit(marker))).withColumn(
        "option_id", F.element_at(F.split("href", "/"), -1).try_cast("long")
    )
    return (
        wanted.where(F.col("option_id").isNotNull())
        .groupBy(key, "option_id")
        .agg(F.max_by("label", "pos").alias("label"))
    )


def discovered_makes(homepage: DataFrame) -> DataFrame:
    """Makes linked from the home page; the fixed make list when there is no such link.

    ``homepage`` has one row with the page's html.
    """
    spark = homepage.sparkSession
    link = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(0))).alias("a")
    read = homepage.select(link).where(F.col("a").rlike(r"(?i)^<a\b[^>]*\bdata-remote\b"))
    found = read.select(
        F.regexp_extract(F.regexp_extract("a", HREF, 1), rf"/{K.MAKE_LINK}/(\d+)", 1).try_cast("int").alias("make_id"),
        _plain(F.col("a")).alias("make"),
    ).where(F.col("make_id").isNotNull() & (F.col("make") != ""))
    found = found.groupBy("make_id").agg(F.max("make").alias("make"))
    return found.unionByName(fixed_makes(spark).where(~found.exists()))


def fixed_makes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.MAKES.items()), "make_id int, make string")


def build_hierarchy(makes: DataFrame, year_responses: DataFrame, model_responses: DataFrame) -> DataFrame:
    """One row per application: make, year and model, from the years and models responses.

    ``year_responses`` is keyed by make_id, ``model_responses`` by year_id.
    """
    years = options(year_responses, "make_id", K.YEAR_LINK).select(
        "make_id", F.col("option_id").alias("year_id"), F.col("label").alias("year")
    )
    models = options(model_responses, "year_id", K.MODEL_LINK).select(
        "year_id", F.col("option_id").alias("application_id"), F.col("label").alias("model")
    )
    return (
        makes.join(years, "make_id")
        .join(models, "year_id")
        .select("make_id", "make", "year_id", "year", "application_id", "model")
    )
