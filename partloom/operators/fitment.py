"""How fitment is shown: year spans, cards, badges, image choice and reference order.

Years of one group are at most as many as there are model years, so they are handled as small sorted arrays. The rows
are reduced to distinct (group, year) pairs before any array is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom import constants as K


def spans(years: Column) -> Column:
    """Consecutive runs of a sorted, distinct year array as structs of first and last."""
    starts = F.filter(years, lambda y: ~F.array_contains(years, y - 1))
    ends = F.filter(years, lambda y: ~F.array_contains(years, y + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def format_spans(years: Column) -> Column:
    """Runs of up to three years are listed, longer ones shown as first–last."""

    def one(span: Column) -> Column:
        listed = F.array_join(F.transform(F.sequence(span["first"], span["last"]), lambda y: y.cast("string")), ", ")
        ranged = F.concat(span["first"].cast("string"), F.lit("–"), span["last"].cast("string"))
        return F.when(span["last"] - span["first"] < 3, listed).otherwise(ranged)

    return F.array_join(F.transform(spans(years), one), ", ")


def year_spans(fitments: DataFrame) -> DataFrame:
    """Runs of consecutive years per part, make and model, one row per run."""
    keys = ("sku", "make", "model")
    # As many values as there are model years, and combined before the shuffle.
    years = fitments.groupBy(*keys).agg(F.sort_array(F.collect_set("year")).alias("y"))
    runs = years.select(*keys, F.explode(spans(F.col("y"))).alias("s"))
    label = format_spans(F.sequence("s.first", "s.last"))
    return runs.select(*keys, F.col("s.first").alias("first_year"), F.col("s.last").alias("last_year"), label.alias("label"))


def fitment_cards(fitments: DataFrame) -> DataFrame:
    """One card per part, make, model and set of years; its variants are the configurations sold in just those years.

    A variant is engine, aspiration and qualifiers. The aspiration text ``None`` counts as no aspiration.
    """
    blank = F.lit("")
    aspiration = F.coalesce("aspiration", blank)
    variant = fitments.select(
        "sku", "make", "model", "year",
        F.coalesce("engine", blank).alias("engine"),
        F.when(aspiration == "None", blank).otherwise(aspiration).alias("aspiration"),
        F.array_join(F.coalesce("qualifiers", F.array().cast("array<string>")), "|").alias("qualifiers"),
    )
    per_variant = variant.groupBy("sku", "make", "model", "engine", "aspiration", "qualifiers").agg(
        F.sort_array(F.collect_set("year")).alias("years")
    )
    return per_variant.groupBy("sku", "make", "model", "years").agg(
        F.sort_array(F.collect_list(F.struct("engine", "aspiration", "qualifiers"))).alias("variants")
    )


def _same_vehicle(make: str, model: str, year: int | None) -> Column:
    same = (F.lower("make") == make.lower()) & (F.lower("model") == model.lower())
    return same if year is None else same & F.array_contains("years", year)


def rank_cards(cards: DataFrame, make: str = "", model: str = "", year: int | None = None) -> DataFrame:
    """Cards of each part with their place: the searched vehicle first, then make, model and earliest year.

    Cards are one row per part, make, model and year set, so a part's window is bounded by the vehicles there are.
    """
    searched = _same_vehicle(make, model, year) if make and model else F.lit(False)
    order = [
        searched.desc(), F.lower("make"), F.lower("model"), F.try_element_at("years", F.lit(1)),
        F.array_join(F.transform("years", lambda y: y.cast("string")), ","), F.col("make"), F.col("model"),
    ]
    return cards.withColumn("rank", F.row_number().over(Window.partitionBy("sku").orderBy(*order)))


def match_badges(
    cards: DataFrame, make: str, model: str, year: int | None = None, engine: str | None = None, *, mode: str = "page"
) -> DataFrame:
    """Badge of each card for a searched vehicle.

    ``page``         up to one engine confirms the card, more make it possible
    ``interactive``  without a chosen engine a card without engines is confirmed and others are possible; a chosen
                     engine confirms by case-insensitive equality, other cards lose their badge
    ``inline``       exact engine equality and make/model only; ``hidden`` marks same-model cards that miss
    """
    engines = F.filter(F.transform("variants", lambda v: v["engine"]), lambda e: e != "")
    confirmed, possible, none = F.lit(K.CONFIRMED_BADGE), F.lit(K.POSSIBLE_BADGE), F.lit(None).cast("string")
    hidden = F.lit(False)
    if mode == "page":
        badge = F.when(F.size(engines) <= 1, confirmed).otherwise(possible)
        same = _same_vehicle(make, model, year)
    elif mode == "interactive":
        same = _same_vehicle(make, model, year)
        if engine:
            badge = F.when(F.exists(engines, lambda e: F.lower(e) == engine.lower()), confirmed).otherwise(none)
        else:
            badge = F.when(F.size(engines) == 0, confirmed).otherwise(possible)
    elif mode == "inline":
        same = _same_vehicle(make, model, None)
        if engine:
            hit = F.array_contains(engines, engine)
            badge, hidden = F.when(hit, confirmed).otherwise(none), same & ~hit
        else:
            badge = possible
    else:
        raise ValueError(f"unknown badge mode: {mode}")
    return cards.withColumn("badge", F.when(same, badge)).withColumn("hidden", hidden)


def flagged_image(images: Column) -> Column:
    """The image flagged as primary, else the first."""
    flagged = F.filter(images, lambda i: F.coalesce(i.is_primary, F.lit(False)))
    return F.coalesce(F.try_element_at(flagged, F.lit(1)), F.try_element_at(images, F.lit(1)))


def display_image(images: Column) -> Column:
    """The second image when there is one (the first tends to be a drawing), else the first."""
    return F.coalesce(F.try_element_at(images, F.lit(2)), F.try_element_at(images, F.lit(1)))


def primary_images(parts: DataFrame) -> DataFrame:
    return parts.select(
        "sku", flagged_image(F.col("images")).url.alias("flagged_url"), display_image(F.col("images")).url.alias("display_url")
    )


def image_names(parts: DataFrame) -> DataFrame:
    """File name of each image by list position. Entries without a url are left out but keep their number."""
    rows = parts.select("sku", F.posexplode("images").alias("position", "image"))
    return rows.where(F.coalesce(F.col("image.url"), F.lit("")) != "").select(
        "sku", "position",
        F.concat("sku", F.lit("_"), F.col("position").cast("string"), F.lit(".avif")).alias("filename"),
        F.col("image.url").alias("url"),
    )


def sort_interchange(parts: DataFrame) -> DataFrame:
    """References by type, then number, in byte order."""
    keyed = F.transform("interchange_numbers", lambda r: F.struct(
        F.coalesce(r.reference_type, F.lit("")).alias("t"), F.coalesce(r.reference_number, F.lit("")).alias("n"), r.alias("r")
    ))
    return parts.withColumn("interchange_numbers", F.transform(F.sort_array(keyed), lambda e: e["r"]))
