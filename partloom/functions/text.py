"""String expressions: trimming, title case, slugs, sku forms, excerpts and fractions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom import constants as K

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def strip(col: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` alone only knows the space)."""
    return F.btrim(col, F.lit(WHITESPACE))


def squeeze(col: Column) -> Column:
    """Collapse every run of whitespace to one space and strip."""
    return strip(F.regexp_replace(col, r"(?U)\s+", " "))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def py_title(col: Column) -> Column:
    """Title case in which any letter after a non-letter is a capital: ``mercedes-benz 3rd`` -> ``Mercedes-Benz 3Rd``.

    ``initcap`` only looks at spaces, so the text is cut into letter and non-letter runs first.
    """
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def normalize_label(col: Column) -> Column:
    """Stripped and title-cased, as makes, models and categories are stored."""
    return py_title(strip(col))


def normalize_sku(col: Column) -> Column:
    return strip(F.upper(col))


def slug(col: Column) -> Column:
    """Lower case with every run of other characters turned into one dash."""
    dashed = F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def display_sku(col: Column) -> Column:
    """``CSF-3680`` -> ``CSF3680``."""
    return F.replace(F.upper(col), F.lit("-"), F.lit(""))


def sku_digits(col: Column) -> Column:
    return F.regexp_replace(col, "^CSF-?", "")


def url_sku(col: Column) -> Column:
    """``CSF-3680`` -> ``3680``: prefix and dashes dropped, lower case."""
    bare = F.replace(F.replace(col, F.lit(K.SKU_PREFIX), F.lit("")), F.lit("-"), F.lit(""))
    return F.lower(bare)


def part_url(sku: Column, site: str) -> Column:
    return F.concat(F.lit(f"{site}/parts/csf"), url_sku(sku))


def sku_from_slug(col: Column) -> Column:
    """``csf3680`` -> ``CSF-3680``."""
    return F.concat(F.lit(K.SKU_PREFIX), F.regexp_replace(col, "(?i)^csf", ""))


def first_words(col: Column, count: int) -> Column:
    """The first words of a text; an ellipsis marks a cut."""
    words = F.split(squeeze(col), " ")
    short = F.array_join(F.slice(words, 1, count), " ")
    return F.when(F.size(words) > count, F.concat(short, F.lit("…"))).otherwise(short)


def capitalize_words(col: Column) -> Column:
    """Upper-case the first letter of each blank-separated word and leave the rest alone."""
    words = F.split(col, " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def pretty_fractions(col: Column) -> Column:
    """Common fractions as single characters, any other as superscript over subscript."""
    spaced = F.concat(F.lit(" "), col)
    common = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), K.FRACTIONS.items(), spaced)
    return strip(F.regexp_replace(common, r"\s(\d+)/(\d+)", " <sup>$1</sup>⁄<sub>$2</sub>"))


def contains_ignoring_case(col: Column, needle: str) -> Column:
    """Plain substring test; wildcards in the needle have no meaning."""
    return F.contains(F.lower(col), F.lit(needle.lower()))
