"""Engine text: cleaning, and the vehicle qualifiers a listing mentions.

All of it is a chain of native regex expressions over whole columns. The flags make the JVM's regex engine treat
classes, case and line ends the way the feed's rules expect: Unicode classes (U), only ``\\n`` ends a line (d).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import constants as K
from partloom.functions.text import squeeze, strip

ANY_CASE = "(?iUd)"
EXACT_CASE = "(?Ud)"


def _drop(col: Column, patterns: tuple[str, ...], replacement: str = "") -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, ANY_CASE + p, replacement), patterns, col)


def _guarded(col: Column, patterns: tuple[str, ...], change: Column) -> Column:
    """``change``, a chain of replacements of ``patterns`` in ``col``, where one of them occurs; else every step of the chain finds nothing
    and the text stays as it is. ``col`` is to be a column of its own, as it is read three times. Blanks that may stand in front decide nothing.
    """
    return F.when(F.rlike(col, F.lit(ANY_CASE + "(?:" + "|".join(f"(?:{p.removeprefix(_BLANKS)})" for p in patterns) + ")")), change).otherwise(col)


_BLANKS = r"\s*"
_LABELS = (*K.ENGINE_LABELS, *(rf"[/,\s]+{maker}(?:/[A-Z]+)?" for maker in K.ENGINE_MAKERS))
_CUTS = tuple(rf"\s*{cut}.*$" for cut in K.ENGINE_CUTOFFS)
_TRAIL = r"\s*w/o?\s*$"
_WORDS = (*K.ASPIRATION_WORDS, K.FUEL_TEXT, K.RADIATOR_POSITION_TEXT, K.DUTY_TEXT, K.MULTIFIT_TEXT, K.PACKAGE_TEXT, *K.ENGINE_PACKAGES, *K.PRODUCT_SPECS, _TRAIL)


def _one_displacement(text: Column) -> Column:
    return F.regexp_replace(text, ANY_CASE + r"(\d+cc)\s+\d+ci", "$1")


def _units(text: Column) -> Column:
    text = F.regexp_replace(text, ANY_CASE + r"\b(\d+)CC\b", "$1cc")
    text = F.regexp_replace(text, ANY_CASE + r"\b(\d+)CI\b", "$1ci")
    return squeeze(text)


def clean_engine(col: Column) -> Column:
    """Strip labels, maker names, the smaller displacement unit and everything after a known cut-off point."""
    return _units(_drop(_one_displacement(_drop(col, _LABELS)), _CUTS))


def _apart(col: Column) -> Column:
    return F.regexp_replace(col, EXACT_CASE + "(cc|ci)([A-Z])", "$1 $2")


def _without_words(text: Column) -> Column:
    text = _drop(text, K.ASPIRATION_WORDS)
    text = _drop(text, (K.FUEL_TEXT, K.RADIATOR_POSITION_TEXT, K.DUTY_TEXT, K.MULTIFIT_TEXT))
    text = _drop(text, (K.PACKAGE_TEXT,), " ")
    text = _drop(text, K.ENGINE_PACKAGES)
    text = _drop(text, K.PRODUCT_SPECS)
    return F.regexp_replace(text, EXACT_CASE + _TRAIL, "")


def engine_spec(col: Column) -> Column:
    """Displacement and layout only: aspiration, fuel, duty, package and product wording is removed."""
    return squeeze(_without_words(_apart(col)))


def _field(text: Column, pattern: str) -> Column:
    """Raw text of a labelled field, null when the label is absent."""
    return strip(F.nullif(F.regexp_extract(text, EXACT_CASE + pattern, 1), F.lit("")))


def _packages(text: Column) -> Column:
    """All qualifiers in a text, in the order of the patterns. Each pattern begins with ``w/``; texts without it are not searched."""
    none = F.array().cast("array<string>")
    found = [F.coalesce(F.regexp_extract_all(text, F.lit(ANY_CASE + p), F.lit(1)), none) for p in K.QUALIFIER_PATTERNS]
    return F.when(F.contains(text, F.lit("w/")) | F.contains(text, F.lit("W/")), F.concat(*found)).otherwise(none)


def _optional(value: Column, condition: Column) -> Column:
    """A one-element array when the condition holds, else an empty one."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(value)).otherwise(F.array().cast("array<string>"))


def with_vehicle_qualifiers(df: DataFrame, text: str = "text", *, keep_plain_aspiration: bool = False) -> DataFrame:
    """Add engine, aspiration and qualifiers read from a listing block's text (one text node per line).

    A plain aspiration word is removed by the engine rules, so it ends as null; ``keep_plain_aspiration`` keeps it.
    Each long regex chain is its own projection: every intermediate is used more than once, so the optimizer keeps the
    projections apart and each stays small enough to be compiled. A chain runs only on texts in which one search finds any of its patterns.
    """
    cleaned = {"_engine_clean": "_engine", "_asp_clean": "_asp_clean", "_shift": "_shift"}
    fields = {"_engine": K.ENGINE_FIELD, "_asp_clean": K.ASPIRATION_FIELD, "_shift": K.TRANSMISSION_FIELD}
    spec = {"_engine_spec": "_engine_clean", "_asp": "_asp_clean"}
    steps = (
        df.withColumns({name: _field(F.col(text), pattern) for name, pattern in fields.items()})
        .withColumns({name: _one_displacement(_guarded(F.col(c), _LABELS, _drop(F.col(c), _LABELS))) for name, c in cleaned.items()})
        .withColumns({name: _units(_guarded(F.col(name), _CUTS, _drop(F.col(name), _CUTS))) for name in cleaned})
        .withColumns({name: _apart(F.col(c)) for name, c in spec.items()})
        .withColumns({name: squeeze(_guarded(F.col(name), _WORDS, _without_words(F.col(name)))) for name in spec})
        .withColumn("engine", F.when(F.col("_engine_clean") != "", F.col("_engine_spec")))
    )
    if keep_plain_aspiration:
        steps = steps.withColumn("_asp", F.col("_asp_clean"))
    asp, shift = F.col("_asp"), F.col("_shift")
    usable = (asp != "") & ~F.lower(asp).isin(*K.NOT_APPLICABLE) & (F.char_length(asp) <= K.ASPIRATION_MAX)
    shifts = (
        (shift != "")
        & ~F.lower(shift).isin(*K.NOT_APPLICABLE)
        & (F.char_length(shift) < K.TRANSMISSION_BELOW)
    )
    found = F.concat(
        _optional(F.lit(K.ECOBOOST), F.contains(F.lower("_asp_clean"), F.lit(K.ECOBOOST.lower()))),
        _optional(shift, shifts),
        _packages(F.col(text)),
        _packages(F.col("_engine")),
    )
    return (
        steps.withColumn("aspiration", F.when(usable, asp))
        .withColumn("qualifiers", F.array_distinct(found))
        .drop("_engine", "_engine_clean", "_engine_spec", "_asp_clean", "_asp", "_shift")
    )
