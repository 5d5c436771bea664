"""Data-quality jobs.

Each check adds an ``issues`` array of (severity, field, message) to the row it judges; ``issue_rows`` turns that into
one row per issue and ``summary`` into the verdict. All of it is row-wise, so no check shuffles; only the one-row
summaries aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import constants as K
from partloom import schemas as sc
from partloom.functions import text as tx
from partloom.functions import values as vx

ERROR, WARNING = "error", "warning"
Rule = tuple[Column, str, str, str]


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def mask(rules: list[Rule]) -> Column:
    """The rules that fire, as bits of one number. This is where the conditions are evaluated, in compiled code."""
    total = F.lit(0).cast("long")
    for bit, (condition, *_) in enumerate(rules):
        total = total + F.when(_yes(condition), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def unmask(bits: Column, rules: list[Rule]) -> Column:
    """The fired rules as an array of (severity, field, message), looked up in a constant table."""
    known = F.array(
        *[
            F.struct(
                F.lit(severity).alias("severity"), F.lit(name).alias("field"), F.lit(message).alias("message"),
                F.lit(1 << bit).cast("long").alias("bit"),
            )
            for bit, (_, severity, name, message) in enumerate(rules)
        ]
    )
    # The bits go in as an argument: inside a lambda they would be evaluated again for every rule.
    fired = F.zip_with(
        known,
        F.array_repeat(bits, len(rules)),
        lambda r, b: F.when(
            b.bitwiseAND(r["bit"]) != 0,
            F.struct(r["severity"].alias("severity"), r["field"].alias("field"), r["message"].alias("message")),
        ),
    )
    return F.filter(fired, lambda i: i.isNotNull())


def error_bits(rules: list[Rule]) -> int:
    return sum(1 << bit for bit, rule in enumerate(rules) if rule[1] == ERROR)


def with_issues(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return df.withColumn("_bits", mask(rules)).withColumn("issues", unmask(F.col("_bits"), rules)).drop("_bits")


def _empty(col: Column) -> Column:
    return F.coalesce(tx.strip(col), F.lit("")) == ""


def _has_errors() -> Column:
    return F.exists("issues", lambda i: i["severity"] == ERROR)


def issue_rows(judged: DataFrame, key: str) -> DataFrame:
    """One row per issue."""
    rows = judged.select(F.col(key).alias("key"), F.inline_outer("issues"))
    return rows.where(F.col("severity").isNotNull())


def summary(judged: DataFrame, *, strict: bool = False, extra: DataFrame | None = None) -> DataFrame:
    """The verdict over all rows. ``extra`` holds further issues about the file itself; strict makes warnings count."""
    count = lambda level: F.size(F.filter("issues", lambda i: i["severity"] == level))
    rows = judged.select(
        F.lit(1).alias("item"), (~_has_errors()).cast("int").alias("good"), count(ERROR).alias("e"), count(WARNING).alias("w")
    )
    if extra is not None:
        rows = rows.unionByName(
            extra.select(
                F.lit(0).alias("item"), F.lit(0).alias("good"),
                (F.col("severity") == ERROR).cast("int").alias("e"), (F.col("severity") == WARNING).cast("int").alias("w"),
            )
        )
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("item", "good", "e", "w")])
    good = (F.col("e") == 0) & (F.lit(not strict) | (F.col("w") == 0))
    return total.select(
        F.col("item").alias("total"), F.col("good").alias("valid"), F.col("e").alias("errors"), F.col("w").alias("warnings"),
        good.alias("is_valid"),
    )


# --- single records -------------------------------------------------------------------------------------------------


def _sku_rules(col: Column, name: str, *, limit: int | None) -> list[Rule]:
    sku = tx.normalize_sku(col)
    blank = F.coalesce(sku, F.lit("")) == ""
    rules = [
        (blank, ERROR, name, "is required"),
        (~blank & ~F.startswith(sku, F.lit(K.SKU_PREFIX)), ERROR, name, f"must start with '{K.SKU_PREFIX}'"),
    ]
    if limit:
        rules.append((F.char_length(sku) > limit, ERROR, name, f"is longer than {limit}"))
    return rules


def _too_precise(price: Column) -> Column:
    """More than two decimal places; trailing zeros do not count. Only exponent notation needs exact arithmetic."""
    exact = vx.exact_number(price)
    return F.when(F.contains(F.lower(price), F.lit("e")), exact != F.round(exact, K.PRICE_DECIMALS)).otherwise(
        price.rlike(r"\.\d\d\d*[1-9]")
    )


def _price_rules(price: Column) -> list[Rule]:
    """Price text: a number within the ceiling, at most two places, above zero. The first fault found is the one told."""
    value = price.try_cast("double")
    faults = ["is not a number", "is unreasonably high", "has more than 2 decimal places", "must be greater than 0"]
    code = (
        F.when(price.isNull() | (price == "None"), 0)
        .when(~vx.is_number(price), 1)
        .when(value > K.PRICE_MAX, 2)
        .when(_too_precise(price), 3)
        .when(value <= 0, 4)
        .otherwise(0)
    )
    return [(code == n, ERROR, "price", fault) for n, fault in enumerate(faults, 1)]


def part_rules() -> list[Rule]:
    name, category = F.col("name"), F.col("category")
    return [
        *_sku_rules(F.col("sku"), "sku", limit=K.SKU_MAX),
        (_empty(name), ERROR, "name", "is required"),
        (F.char_length(tx.strip(name)) > K.NAME_MAX, ERROR, "name", f"is longer than {K.NAME_MAX}"),
        *_price_rules(F.col("price")),
        (_empty(category), ERROR, "category", "is required"),
        (F.exists("images", lambda i: _empty(i.url)), ERROR, "images.url", "is required"),
        (
            F.exists("interchange_numbers", lambda r: _empty(r.reference_number)),
            ERROR, "interchange_numbers.reference_number", "is required",
        ),
        (
            F.exists("interchange_numbers", lambda r: _empty(r.reference_type)),
            ERROR, "interchange_numbers.reference_type", "is required",
        ),
    ]


def completeness_rules() -> list[Rule]:
    """What a sound part may still lack."""
    missing = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return [
        (missing("images"), WARNING, "images", "has no images"),
        (F.coalesce(F.col("description"), F.lit("")) == "", WARNING, "description", "has no description"),
        (missing("specifications"), WARNING, "specifications", "has no specifications"),
    ]


def check_parts(parts: DataFrame, *, warnings: bool = False, more: list[Rule] = ()) -> DataFrame:
    """Judge part records. Prices are text here. Completeness warnings are given only for rows without errors."""
    rules = [*part_rules(), *more]
    if warnings:
        rules = [*rules, *completeness_rules()]
    errors = F.lit(error_bits(rules)).cast("long")
    kept = F.when(F.col("_bits").bitwiseAND(errors) != 0, F.col("_bits").bitwiseAND(errors)).otherwise(F.col("_bits"))
    staged = parts.withColumn("_bits", mask(rules)).withColumn("_bits", kept)
    return staged.withColumn("issues", unmask(F.col("_bits"), rules)).drop("_bits")


def sound_parts(parts: DataFrame) -> DataFrame:
    """Part records without errors."""
    rules = part_rules()
    good = mask(rules).bitwiseAND(F.lit(error_bits(rules)).cast("long")) == 0
    return _fence(parts.withColumn("_good", good), "_good").where("_good").drop("_good")


def stored_form(parts: DataFrame) -> dict[str, Column]:
    """Stored form of sound records: upper-case sku, title-cased category, stripped texts, typed price."""
    stripped = F.transform("images", lambda i: i.withField("url", tx.strip(i.url)).withField("alt_text", tx.strip(i.alt_text)))
    return {
        "sku": tx.normalize_sku(F.col("sku")),
        "name": tx.strip(F.col("name")),
        "category": tx.normalize_label(F.col("category")),
        "price": F.when(F.col("price") != "None", vx.price_of(F.col("price"))),
        "images": F.coalesce(stripped, F.array().cast(parts.schema["images"].dataType)),
    }


def normalize_parts(parts: DataFrame) -> DataFrame:
    return parts.withColumns(stored_form(parts))


def vehicle_rules(current_year: int) -> list[Rule]:
    def text(name: str, limit: int, *, required: bool = False) -> list[Rule]:
        col = F.col(name)
        rules = [(F.char_length(tx.strip(col)) > limit, ERROR, name, f"is longer than {limit}")]
        return [(_empty(col), ERROR, name, "is required"), *rules] if required else rules

    year = F.col("year")
    return [
        *text("make", K.MAKE_MODEL_MAX, required=True),
        *text("model", K.MAKE_MODEL_MAX, required=True),
        (year.isNull(), ERROR, "year", "is required"),
        ((year < K.YEAR_FIELD_MIN) | (year > K.YEAR_FIELD_MAX), ERROR, "year", f"is outside {K.YEAR_FIELD_MIN}..{K.YEAR_FIELD_MAX}"),
        ((year >= K.YEAR_FIELD_MIN) & (year < K.YEAR_MIN), ERROR, "year", f"must be {K.YEAR_MIN} or later"),
        (
            (year <= K.YEAR_FIELD_MAX) & (year > current_year + K.YEARS_AHEAD),
            ERROR, "year", f"is more than {K.YEARS_AHEAD} years ahead",
        ),
        *text("submodel", K.SUBMODEL_MAX),
        *text("engine", K.ENGINE_MAX),
        *text("fuel_type", K.FUEL_MAX),
        *text("aspiration", K.ASPIRATION_MAX),
    ]


def check_vehicles(vehicles: DataFrame, *, current_year: int) -> DataFrame:
    """Judge vehicles. The current year is an argument so that a run can be repeated."""
    have = set(vehicles.columns)
    lacking = [f for f in sc.VEHICLE.fields if f.name not in have]
    full = vehicles.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lacking])
    return with_issues(full, vehicle_rules(current_year)).select(*vehicles.columns, "issues")


def normalize_vehicles(vehicles: DataFrame) -> DataFrame:
    return vehicles.withColumns({c: tx.normalize_label(F.col(c)) for c in ("make", "model")})


def check_compat(entries: DataFrame) -> DataFrame:
    """Judge fitment entries: a proper sku and at least one vehicle."""
    rules = [
        *_sku_rules(F.col("part_sku"), "part_sku", limit=None),
        (F.coalesce(F.size("vehicles"), F.lit(0)) <= 0, ERROR, "vehicles", "needs at least one vehicle"),
    ]
    return with_issues(entries, rules)


def check_compat_long(fitments: DataFrame, key: str = "part_sku", vehicle_year: str = "year") -> DataFrame:
    """The same from long rows: one judged row per sku, without ever building its vehicle list."""
    counted = fitments.groupBy(key).agg(F.count(vehicle_year).alias("vehicle_count"))
    rules = [
        *_sku_rules(F.col(key), key, limit=None),
        (F.col("vehicle_count") == 0, ERROR, "vehicles", "needs at least one vehicle"),
    ]
    return with_issues(counted, rules)


def preprocess_parts(parts: DataFrame) -> DataFrame:
    """Clean raw records before they are judged. ``price_bad`` marks a price that could not be read."""
    cleaned = vx.clean_price_text(F.col("price"))
    features = F.filter("features", lambda f: F.coalesce(f, F.lit("")) != "")
    return parts.withColumns(
        {
            "price_bad": F.col("price").isNotNull() & ~vx.is_number(cleaned),
            "price": F.when(vx.is_number(cleaned), cleaned),
            "specifications": F.coalesce("specifications", F.create_map().cast(sc.SPECS)),
            "features": F.coalesce(features, F.array().cast("array<string>")),
            "tech_notes": tx.blank_to_null(F.col("tech_notes")),
            "position": tx.blank_to_null(F.col("position")),
            "manufacturer": F.coalesce("manufacturer", F.lit(K.DEFAULT_MANUFACTURER)),
            "in_stock": F.coalesce("in_stock", F.lit(True)),
        }
    )


def batch_rules() -> list[Rule]:
    """Rules for preprocessed records. A price that cannot be read rejects its row, not the batch."""
    return [*part_rules(), (F.col("price_bad"), ERROR, "price", "cannot be read")]


def judge_batch(raw: DataFrame) -> DataFrame:
    """Preprocess and judge raw records."""
    return with_issues(preprocess_parts(raw), batch_rules())


def _fence(df: DataFrame, name: str) -> DataFrame:
    """Keep filters on a costly column above the projection that computes it.

    A filter moves below a projection by repeating its expressions, and filters do not share common parts. It does not
    move below a one-element ``explode``.
    """
    return df.withColumn(name, F.explode(F.array(name)))


def validate_rows(raw: DataFrame) -> DataFrame:
    """Preprocess and judge every record in one pass: ``valid``, ``issues``, and stored form where valid.

    Rejected rows keep their texts as they came and have no price. ``price_text`` is every row's price as it was read.
    """
    rules = batch_rules()
    ready = preprocess_parts(raw).withColumn("_bits", mask(rules))
    ready = ready.withColumn("valid", F.col("_bits").bitwiseAND(F.lit(error_bits(rules)).cast("long")) == 0)
    stored = stored_form(ready)
    price = F.when(F.col("valid"), stored.pop("price"))
    kept = {name: F.when(F.col("valid"), new).otherwise(F.col(name)) for name, new in stored.items()}
    return _fence(ready, "valid").withColumns({**kept, "price": price, "price_text": F.col("price"), "issues": unmask(F.col("_bits"), rules)}).drop("_bits")


def validate_batch(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows in stored form, and rejected rows with their issues."""
    rows = validate_rows(raw)
    return rows.where("valid").drop("issues", "price_bad", "valid", "price_text"), rows.where(~F.col("valid")).drop("valid")


def drop_invalid_pages(judged: DataFrame, page: str = "page_id", *, on_invalid: str = "fail_page") -> DataFrame:
    """Rows that go on from judged listings.

    ``fail_page`` lets one bad row stop its whole page; ``drop_row`` only loses the row.
    """
    if on_invalid == "drop_row":
        return judged.where(~_has_errors())
    if on_invalid != "fail_page":
        raise ValueError(f"unknown policy: {on_invalid}")
    bad = judged.where(_has_errors()).select(page).distinct()
    return judged.join(bad, page, "left_anti")


# --- export files ---------------------------------------------------------------------------------------------------


def _file_issue(condition: Column, severity: str, name: str, message: Column) -> Column:
    return F.when(
        _yes(condition),
        F.struct(F.lit("file").alias("key"), F.lit(severity).alias("severity"), F.lit(name).alias("field"), message.alias("message")),
    )


def metadata_issues(metadata: DataFrame, required: tuple[str, ...], count_field: str, counted: DataFrame) -> DataFrame:
    """Issues about metadata, one verdict per metadata row, compared with the actual counts.

    Without a column ``source_file`` on both sides, every metadata row is compared with the one-row frame ``counted`` (column ``n``); with
    it, each file's metadata is compared with its own count, and a file without metadata is an issue of its own.
    """
    per_file = "source_file" in metadata.columns and "source_file" in counted.columns
    known = metadata.select(*(["source_file"] if per_file else []), F.struct(*dict.fromkeys([*required, count_field])).alias("m"))
    if per_file:
        both = counted.join(known, "source_file", "full_outer").select(F.coalesce("n", F.lit(0)).alias("n"), "m")
    else:
        # The count is one row, so this join keeps the metadata rows, and one empty row if there are none.
        both = counted.select("n", F.lit(1).alias("_one")).join(known.withColumn("_one", F.lit(1)), "_one", "left").select("n", "m")
    present = F.col("m").isNotNull()
    checks = [_file_issue(~present, ERROR, "structure", F.lit("Missing required key: 'metadata'"))]
    for name in required:
        checks.append(
            _file_issue(
                present & F.col(f"m.{name}").isNull(), ERROR, f"metadata.{name}", F.lit(f"Missing required metadata field: '{name}'")
            )
        )
    declared = F.coalesce(f"m.{count_field}", F.lit(0))
    checks.append(
        _file_issue(
            present & (declared != F.col("n")), WARNING, f"metadata.{count_field}",
            F.concat(F.lit("Metadata declares "), declared.cast("string"), F.lit(" but found "), F.col("n").cast("string")),
        )
    )
    fired = F.filter(F.array(*checks), lambda i: i.isNotNull())
    return both.select(F.inline(fired))


def _counted(df: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """The number of rows, per source file where both frames tell it."""
    keys = ["source_file"] if metadata is not None and "source_file" in metadata.columns and "source_file" in df.columns else []
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def check_parts_export(parts: DataFrame, metadata: DataFrame, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Judge an export of parts: (issue rows, summary)."""
    judged = check_parts(parts, warnings=True)
    about_file = metadata_issues(metadata, ("export_date", "total_parts"), "total_parts", _counted(parts, metadata))
    rows = issue_rows(judged, "sku").unionByName(about_file)
    return rows, summary(judged, strict=strict, extra=about_file)


def check_compat_export(entries: DataFrame, metadata: DataFrame, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Judge an export of fitments: (issue rows, summary). ``entries`` is nested or, without ``vehicles``, long."""
    judged = check_compat(entries) if "vehicles" in entries.columns else check_compat_long(entries)
    about_file = metadata_issues(metadata, ("export_date", "total_mappings"), "total_mappings", _counted(judged, metadata))
    rows = issue_rows(judged, "part_sku").unionByName(about_file)
    return rows, summary(judged, strict=strict, extra=about_file)


def check_hierarchical(leaves: DataFrame, metadata: DataFrame, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Judge a year/make/model export given as leaf rows (year text, make, model, leaf_pos, part columns).

    Each issue's key is the leaf's place, ``year.make.model[leaf_pos]``. With ``source_file`` on both sides every file's years are
    compared with its own metadata.
    """
    place = F.concat("year", F.lit("."), "make", F.lit("."), "model", F.lit("["), F.col("leaf_pos").cast("string"), F.lit("]"))
    judged = check_parts(leaves.withColumn("location", place), warnings=True)
    by_file = ["source_file"] if "source_file" in leaves.columns and "source_file" in metadata.columns else []
    years = leaves.select(*by_file, "year").distinct()
    odd = years.where(~F.col("year").rlike(r"^\d+$")).select(
        F.lit("file").alias("key"), F.lit(WARNING).alias("severity"), F.concat(F.lit("data."), "year").alias("field"),
        F.concat(F.lit("Year '"), "year", F.lit("' is not numeric")).alias("message"),
    )
    about_file = metadata_issues(
        metadata, ("export_date", "structure", "total_years"), "total_years", _counted(years, metadata)
    ).unionByName(odd)
    return issue_rows(judged, "location").unionByName(about_file), summary(judged, strict=strict, extra=about_file)


def check_files(documents: DataFrame) -> DataFrame:
    """One verdict per JSON file of a directory.

    ``documents`` has filename, kind (parts, compatibility, hierarchical, unknown, unreadable) and the file's counts: total, valid, errors and
    warnings, null without items; see ``sources.exports.judge_directory``. A file of unknown kind is an error of its own.
    """
    bad = F.col("kind").isin("unknown", "unreadable").cast("int")
    none = F.lit(0).cast("long")
    return documents.select(
        "filename", "kind", F.coalesce("total", none).alias("total"), F.coalesce("valid", none).alias("valid"),
        (F.coalesce("errors", none) + bad).alias("errors"), F.coalesce("warnings", none).alias("warnings"),
    ).withColumn("is_valid", F.col("errors") == 0)


# --- imports --------------------------------------------------------------------------------------------------------


def check_import(parts: DataFrame, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Structure errors of an import (rows of source_file, error and how many documents have it) and the parts, marked ``importable`` if a sku is given.

    ``documents`` tells per document its source_file and container, see ``sources.exports.read_structure``: a document without parts and one that
    cannot be read, metadata that is no object included, are errors.
    """
    empty = _counted(parts).where("n = 0").select(F.lit(None).cast("string").alias("source_file"), F.lit(K.IMPORT_EMPTY).alias("error"), F.lit(1).cast("long").alias("documents"))
    usable = parts.withColumn("importable", F.coalesce("sku", F.lit("")) != "")
    if documents is None:
        return empty, usable
    error = F.when(F.col("container").isin("metadata", "none"), K.IMPORT_NO_PARTS).when(F.col("container") == "broken", K.IMPORT_BROKEN)
    faults = documents.withColumn("error", error).where("error IS NOT NULL").groupBy("source_file", "error").agg(F.count(F.lit(1)).alias("documents"))
    return faults.unionByName(empty), usable


def import_sample_rules() -> list[Rule]:
    price, sku = F.col("price"), F.col("sku")
    required = [(F.col(c).isNull(), ERROR, c, f"Missing required field '{c}'") for c in K.IMPORT_SAMPLE_FIELDS]
    url = lambda i: ~_yes(i.url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/]+"))
    return [
        *required,
        (sku.isNotNull() & ~sku.rlike(K.SKU_FORMAT), WARNING, "sku", "does not match the expected format"),
        (
            price.isNotNull() & (~vx.is_number(price) | (price.try_cast("double") < 0)),
            ERROR, "price", "is not a valid price",
        ),
        (F.exists("images", url), ERROR, "images", "holds an invalid url"),
    ]


def check_import_sample(parts: DataFrame, vehicles: DataFrame | None = None) -> DataFrame:
    """The stricter check for sample files, as issue rows; vehicles are long rows with the part's sku."""
    rows = issue_rows(with_issues(parts, import_sample_rules()), "sku")
    if vehicles is None:
        return rows
    year = F.col("year")
    rules = [
        *[(F.col(c).isNull(), ERROR, f"vehicles.{c}", f"Missing required field '{c}'") for c in ("make", "model", "year")],
        ((year < K.IMPORT_YEAR_MIN) | (year > K.IMPORT_YEAR_MAX), ERROR, "vehicles.year", "is not a valid year"),
    ]
    return rows.unionByName(issue_rows(with_issues(vehicles, rules), "sku"))


def health_thresholds(
    previous: DataFrame, current: DataFrame, *, export_age_seconds: int, min_parts: int = K.HEALTH_MIN_PARTS,
    max_new: int = K.HEALTH_MAX_NEW, max_age: int = K.HEALTH_MAX_AGE_SECONDS,
) -> DataFrame:
    """One row per alarm: fewer parts than before, stale export, many new parts, too few parts."""
    prev = previous.select("sku").distinct().withColumn("_p", F.lit(1))
    cur = current.select("sku").distinct().withColumn("_c", F.lit(1))
    counts = prev.join(cur, "sku", "full_outer").agg(
        F.count("_p").alias("before"),
        F.count("_c").alias("now"),
        F.count_if(F.col("_p").isNull()).alias("new"),
    )
    alarm = lambda name, severity, raised: F.struct(
        F.lit(name).alias("alarm"), F.lit(severity).alias("severity"), raised.alias("raised")
    )
    return counts.select(
        F.inline(
            F.array(
                alarm("parts_decreased", "critical", F.col("now") < F.col("before")),
                alarm("export_stale", "warning", F.lit(export_age_seconds > max_age)),
                alarm("many_new_parts", "info", F.col("new") > max_new),
                alarm("too_few_parts", "error", F.col("now") < min_parts),
            )
        )
    )
