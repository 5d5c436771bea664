"""Prices, maps and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom import constants as K
from partloom.functions.text import strip

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def clean_price_text(col: Column) -> Column:
    """Drop currency sign, thousands separators and blanks."""
    return F.regexp_replace(strip(col), "[$, ]", "")


def is_number(col: Column) -> Column:
    return F.coalesce(col.rlike(NUMBER), F.lit(False))


def exact_number(col: Column) -> Column:
    """The text as a wide decimal, so that digits past the second place are still visible to the checks."""
    return col.try_cast("decimal(38,12)")


def price_of(col: Column) -> Column:
    """Price text as stored: two places, or null when it is no number."""
    return exact_number(clean_price_text(col)).cast("decimal(10,2)")


def price_text(col: Column) -> Column:
    """Prices are written as text so that readers do not round them."""
    return col.cast("string")


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps where the right one wins (``map_concat`` refuses duplicate keys)."""
    left = F.coalesce(left, F.create_map().cast("map<string,string>"))
    right = F.coalesce(right, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def sorted_entries(col: Column) -> Column:
    """A map as an ordered array, so that equal maps compare and hash alike."""
    return F.sort_array(F.map_entries(col))


def first_filled(specs: Column, names: tuple[str, ...]) -> Column:
    """The first of several specification fields that holds a value."""
    return F.coalesce(*[F.nullif(F.element_at(specs, F.lit(n)), F.lit("")) for n in names])


def content_hash(columns: dict[str, Column]) -> Column:
    """One digest over named values; two rows have equal digests exactly when all of the values are equal."""
    ordered = [columns[name].alias(name) for name in sorted(columns)]
    return F.md5(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}))


def part_hash() -> Column:
    """Digest of the fields a listing can change. Timestamps and detail-page fields stay out of it."""
    values = {name: F.col(name) for name in K.HASH_FIELDS}
    values["price"] = price_text(F.col("price"))
    values["specifications"] = sorted_entries(F.col("specifications"))
    return content_hash(values)


def page_hash(html: Column, *, detail: bool = False) -> Column:
    """Digest of a page with per-request tokens blanked; the detail form also drops signed-url queries."""
    stable = reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), K.VOLATILE_TOKENS, html)
    if detail:
        stable = F.regexp_replace(stable, K.SIGNED_URL_QUERY, "")
    return F.md5(stable)


def is_json(text: Column) -> Column:
    """True where a text is one whole JSON value.

    The parser stops after the first value and would accept trailing text, so the value is put inside an object whose
    last field has to be reached.
    """
    wrapped = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(',"end":1}')))
    return F.coalesce(F.try_variant_get(wrapped, "$.end", "int") == 1, F.lit(False))
