"""Page extraction.

One Arrow-batched pass per page kind reads the structure of a page (blocks, tables, images) and nothing else; the
rules that turn structure into fields are native columns. The html itself never leaves the Python worker again.

A page or block that cannot be read never fails the job: it gives no fields, and ``page_failures`` (listing pages) or
``detail_failures`` lists it with the reason; the ``…_or_errors`` readers give fields and reasons from one reading.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from partloom import constants as K
from partloom.functions import text as tx
from partloom.functions.engine import with_vehicle_qualifiers
from partloom.sources.markup import Element, parse
from partloom.sources.structure import detail_reader, listing_reader, match_reader

_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BLOCK = _struct(sku=_TEXT, name=_TEXT, category=_TEXT, block_text=_TEXT, cells=_TEXTS, error=_TEXT)
TABLE = _struct(headers=_TEXTS, rows=T.ArrayType(_struct(cells=_TEXTS, tds=_TEXTS)))
ABOUT = _struct(title=_TEXT, subtitle=_TEXT, chunks=_TEXTS, items=_TEXTS)
PICTURE = _struct(src=_TEXT, alt=_TEXT)
MATCH = _struct(text=_TEXT, value=_TEXT)
#: Html that is read before its structure is handed on, in characters.
SLICE_CHARS = 4_000_000


def _read(pages: DataFrame, keys: list[str], found: T.StructType, reader: Callable[[Element], dict]) -> DataFrame:
    """Apply a structure reader to every page's html. Keys pass through; a page without html yields nulls.

    A page that cannot be read yields nulls too, and the reason as ``read_error``. Pages are taken one by one and handed on in slices
    of bounded size, so a batch of large pages is never held as Python text.
    """
    schema = T.StructType([pages.schema[k] for k in keys] + [*found.fields, T.StructField("read_error", _TEXT)])
    arrow = to_arrow_schema(schema)
    names = [*[f.name for f in found.fields], "read_error"]

    def one(html: str | None) -> dict:
        try:
            return reader(parse(html)) if html is not None else {}
        except Exception as e:  # noqa: BLE001
            return {"read_error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, chars = [], 0, 0
            for i, html in enumerate(batch.column("html")):
                text = html.as_py()
                rows.append(one(text))
                chars += len(text or "")
                if chars >= SLICE_CHARS or i + 1 == batch.num_rows:
                    made = [pa.array([r.get(n) for r in rows], type=arrow.field(n).type) for n in names]
                    kept = [batch.column(k).slice(start, len(rows)).cast(arrow.field(k).type) for k in keys]
                    yield pa.RecordBatch.from_arrays(kept + made, schema=arrow)
                    rows, start, chars = [], i + 1, 0

    return pages.select(*keys, "html").mapInArrow(run, schema)


# --- listing pages --------------------------------------------------------------------------------------------------


def read_listings(pages: DataFrame, keys: list[str], *, join_with_space: bool = False) -> DataFrame:
    """Raw part blocks of listing pages, one row each, with ``page_pos`` counting from 0.

    Text nodes are joined without a space, as the feed's own names are; ``join_with_space`` puts one in.
    """
    read = _read(pages, keys, _struct(blocks=T.ArrayType(BLOCK)), listing_reader(" " if join_with_space else ""))
    return read.select(*keys, F.posexplode("blocks").alias("page_pos", "b")).select(*keys, "page_pos", "b.*")


def read_listings_or_errors(pages: DataFrame, keys: list[str], *, join_with_space: bool = False) -> DataFrame:
    """The rows of ``read_listings`` and, from the same reading, one for each page that cannot be read, with its error and no page_pos."""
    read = _read(pages, keys, _struct(blocks=T.ArrayType(BLOCK)), listing_reader(" " if join_with_space else ""))
    # A page that is not read has null blocks, which give one row of nulls; so has a page without html, and one without blocks.
    rows = read.select(*keys, "read_error", F.posexplode_outer("blocks").alias("page_pos", "b"))
    shown = rows.where(F.col("page_pos").isNotNull() | F.col("read_error").isNotNull())
    fields = [F.col(f"b.{f}").alias(f) for f in BLOCK.names if f != "error"]
    return shown.select(*keys, "page_pos", *fields, F.coalesce("read_error", "b.error").alias("error"))


def page_failures(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Listing pages, and blocks of them, that cannot be read: keys, page_pos (null for a whole page) and error."""
    read = _read(pages, keys, _struct(blocks=T.ArrayType(BLOCK)), listing_reader(""))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("page_pos"), F.col("read_error").alias("error")))
    blocks = F.transform(F.coalesce("blocks", F.array().cast(T.ArrayType(BLOCK))), lambda b, i: F.struct(i.cast("int").alias("page_pos"), b["error"].alias("error")))
    found = read.select(*keys, F.explode(F.concat(whole, blocks)).alias("f"))
    return found.where("f.error IS NOT NULL").select(*keys, "f.page_pos", "f.error")


def _after_dash(heading: Column) -> Column:
    """What follows the first `` - ``; the whole heading when there is none."""
    return F.when(F.contains(heading, F.lit(" - ")), F.substr(heading, F.locate(" - ", heading) + 3)).otherwise(heading)


def application_parts(listings: DataFrame) -> DataFrame:
    """Typed parts of listing blocks. Blocks without sku or name are left out; the page's other blocks stay."""
    sku = F.col("sku")
    name = _after_dash(F.col("name"))
    usable = (F.coalesce(sku, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "")
    shaped = listings.where(usable).select(
        *[c for c in listings.columns if c not in BLOCK.names],
        F.when(F.startswith(sku, F.lit(K.SKU_PREFIX)), sku).otherwise(F.concat(F.lit(K.SKU_PREFIX), sku)).alias("sku"),
        name.alias("name"),
        F.lit(None).cast("string").alias("price"),
        F.lit(None).cast("string").alias("description"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit(K.DEFAULT_CATEGORY)).alias("category"),
        listing_specs(F.col("cells")).alias("specifications"),
        F.array().cast("array<struct<url:string,alt_text:string,is_primary:boolean>>").alias("images"),
        F.lit(K.DEFAULT_MANUFACTURER).alias("manufacturer"),
        F.lit(True).alias("in_stock"),
        "block_text",
    )
    return with_vehicle_qualifiers(shaped, "block_text").drop("block_text")


def extract_application_parts(pages: DataFrame, keys: list[str], *, join_with_space: bool = False) -> DataFrame:
    return application_parts(read_listings(pages, keys, join_with_space=join_with_space))


def _put(entries: Column, *, last_wins: bool) -> Column:
    """A map from key/value structs; a repeated key keeps its last or its first value."""
    empty = F.create_map().cast("map<string,string>")

    def step(acc: Column, e: Column) -> Column:
        single = F.create_map(e["key"], e["value"])
        if last_wins:
            return F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), single)
        return F.when(F.map_contains_key(acc, e["key"]), acc).otherwise(F.map_concat(acc, single))

    return F.aggregate(entries, empty, step)


def listing_specs(cells: Column) -> Column:
    """``Key: Value`` cells as a map; the last of several equal keys wins."""
    keyed = F.filter(cells, lambda c: F.contains(c, F.lit(": ")))
    entries = F.transform(
        keyed,
        lambda c: F.struct(
            F.substring_index(c, ": ", 1).alias("key"), tx.strip(F.substr(c, F.locate(": ", c) + 2)).alias("value")
        ),
    )
    return _put(entries, last_wins=True)


# --- detail pages ---------------------------------------------------------------------------------------------------


def read_details(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Tables, description box and pictures of detail pages; ``read_error`` says why a page has none of them."""
    found = _struct(tables=T.ArrayType(TABLE), about=ABOUT, pictures=T.ArrayType(PICTURE))
    return _read(pages, keys, found, detail_reader)


def _pair(key: Column, value: Column) -> Column:
    return F.struct(F.rtrim(key, F.lit(":")).alias("key"), value.alias("value"))


def _row_pairs(cells: Column) -> Column:
    """Label and value of a table row: (shown, label, value) triplets, label and value, or one ``label: value`` cell."""
    n = F.size(cells)
    at = lambda i: F.get(cells, i)
    triplets = F.transform(F.sequence(F.lit(0), n - 3, F.lit(3)), lambda i: _pair(at(i + 1), at(i + 2)))
    text = at(F.lit(0))
    single = F.struct(
        tx.strip(F.substring_index(text, ":", 1)).alias("key"),
        tx.strip(F.substr(text, F.locate(":", text) + 1)).alias("value"),
    )
    none = F.array().cast("array<struct<key:string,value:string>>")
    return (
        F.when((n >= 3) & (n % 3 == 0), triplets)
        .when(n == 2, F.array(_pair(at(F.lit(0)), at(F.lit(1)))))
        .when((n == 1) & F.contains(text, F.lit(":")) & (F.char_length(text) > 3), F.array(single))
        .otherwise(none)
    )


def _has(headers: Column, name: str) -> Column:
    return F.array_contains(headers, name)


def detail_specs(tables: Column) -> Column:
    """Specifications of all tables but the interchange and vehicle ones; the first of several equal keys wins."""
    number, name = K.INTERCHANGE_HEADERS
    make, model = K.VEHICLE_HEADERS
    wanted = F.filter(
        tables,
        lambda t: ~(
            _has(t.headers, number) | _has(t.headers, name) | (_has(t.headers, make) & _has(t.headers, model))
        ),
    )
    rows = F.flatten(F.transform(wanted, lambda t: t.rows))
    pairs = F.flatten(F.transform(rows, lambda r: _row_pairs(r.cells)))
    filled = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    return _put(filled, last_wins=False)


def interchange_rows(tables: Column) -> Column:
    """References of the first table with both reference headers; its first row is the heading."""
    number, name = K.INTERCHANGE_HEADERS
    table = F.try_element_at(F.filter(tables, lambda t: _has(t.headers, number) & _has(t.headers, name)), F.lit(1))
    body = F.slice(table.rows, 2, F.greatest(F.size(table.rows), F.lit(1)))
    pairs = F.transform(
        F.filter(body, lambda r: F.size(r.tds) >= 2),
        lambda r: F.struct(F.get(r.tds, 0).alias("reference_number"), F.get(r.tds, 1).alias("reference_type")),
    )
    filled = F.filter(pairs, lambda p: (p.reference_number != "") & (p.reference_type != ""))
    return F.coalesce(filled, F.array().cast("array<struct<reference_number:string,reference_type:string>>"))


def full_description(about: Column) -> Column:
    """The description box as html: heading, subtitle, marketing sentences and feature list, one per line."""
    chunks = F.filter(about.chunks, lambda c: F.char_length(c) > K.MARKETING_MIN_CHARS)
    sentences = F.filter(F.transform(F.split(F.array_join(chunks, " "), ";"), tx.strip), lambda s: s != "")
    ended = F.transform(sentences, lambda s: F.when(s.rlike("[.!?]$"), s).otherwise(F.concat(s, F.lit("."))))
    items = F.filter(about["items"], lambda i: i != "")
    listed = F.array_join(F.transform(items, lambda i: F.concat(F.lit("<li>"), i, F.lit("</li>"))), "")
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    parts = F.array(
        F.when(filled(about.title), F.concat(F.lit("<h5>"), about.title, F.lit("</h5>"))),
        F.when(filled(about.subtitle), F.concat(F.lit("<p><strong>"), about.subtitle, F.lit("</strong></p>"))),
        F.when(F.size(ended) > 0, F.concat(F.lit("<p>"), F.array_join(ended, " "), F.lit("</p>"))),
        F.when(F.size(items) > 0, F.concat(F.lit("<ul>"), listed, F.lit("</ul>"))),
    )
    return F.nullif(F.array_join(parts, "\n"), F.lit(""))


def gallery(pictures: Column, *, host: str = "", catalog_only: bool = True) -> Column:
    """Large product pictures, of one image host if it is named; the first one is primary. ``catalog_only`` also asks for the catalog's folder."""
    marks = [*([host] if host else []), K.GALLERY_SIZE, *([K.GALLERY_CATALOG] if catalog_only else [])]

    def wanted(p: Column) -> Column:
        test = F.lit(True)
        for mark in marks:
            test = test & F.contains(p.src, F.lit(mark))
        return test

    return F.transform(
        F.filter(pictures, wanted),
        lambda p, i: F.struct(p.src.alias("url"), p.alt.alias("alt_text"), (i == 0).alias("is_primary")),
    )


def extract_details(pages: DataFrame, keys: list[str], *, host: str = "", catalog_only: bool = True) -> DataFrame:
    """One detail record per page: description, specifications, notes, references and gallery."""
    return extract_details_or_errors(pages, keys, host=host, catalog_only=catalog_only).drop("error")


def detail_failures(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Detail pages that cannot be read: keys and error."""
    return read_details(pages, keys).where(F.col("read_error").isNotNull()).select(*keys, F.col("read_error").alias("error"))


def extract_details_or_errors(pages: DataFrame, keys: list[str], *, host: str = "", catalog_only: bool = True) -> DataFrame:
    """The records of ``extract_details`` and, from the same reading, ``error``: why a page gives an empty record; null if it was read."""
    read = read_details(pages, keys).withColumn("specifications", detail_specs(F.col("tables")))
    return read.select(
        *keys,
        full_description(F.col("about")).alias("full_description"),
        "specifications",
        tech_notes(F.col("specifications")).alias("tech_notes"),
        interchange_rows(F.col("tables")).alias("interchange_data"),
        gallery(F.col("pictures"), host=host, catalog_only=catalog_only).alias("additional_images"),
        F.col("read_error").alias("error"),
    )


def tech_notes(specs: Column) -> Column:
    return F.element_at(specs, F.lit(K.TECH_NOTE_KEY))


# --- any page -------------------------------------------------------------------------------------------------------


def _matches(pages: DataFrame, css: str, keys: list[str], attribute: str | None, *, first: bool) -> DataFrame:
    found = _struct(m=T.ArrayType(MATCH))
    return _read(pages, keys, found, match_reader(css, attribute, first=first))


def select_text(pages: DataFrame, css: str, keys: list[str]) -> DataFrame:
    """Text of each page's first match; null when there is none."""
    return _matches(pages, css, keys, None, first=True).select(*keys, F.try_element_at("m", F.lit(1)).text.alias("text"))


def select_attr(pages: DataFrame, css: str, attribute: str, keys: list[str]) -> DataFrame:
    """Attribute of each page's first match; null when there is none or it is empty."""
    value = F.nullif(F.try_element_at("m", F.lit(1)).value, F.lit(""))
    return _matches(pages, css, keys, attribute, first=True).select(*keys, value.alias("value"))


def select_all(pages: DataFrame, css: str, keys: list[str], attribute: str | None = None) -> DataFrame:
    """Every match as a row, in document order."""
    rows = _matches(pages, css, keys, attribute, first=False).select(*keys, F.posexplode("m").alias("pos", "m"))
    return rows.select(*keys, "pos", "m.text", "m.value")


def split_renderable(pages: DataFrame, *, detail: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pages that already hold parts, and pages that first have to be rendered."""
    marks = (K.SELLING_MARKER,) if detail else K.PART_MARKERS
    ready = F.lit(False)
    for mark in marks:
        ready = ready | F.contains("html", F.lit(mark))
    ready = F.coalesce(ready, F.lit(False))
    return pages.where(ready), pages.where(~ready)
