"""Page extraction. Pages are rendered from ``part`` in the feed's layout and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom import constants as K
from partloom.functions import engine
from partloom.registry import query
from partloom.registry.base import sql
from partloom.sources import adapters as A
from partloom.sources import pages, responses


def _key() -> Column:
    """Built on use: columns cannot be made before there is a session."""
    return F.col("p_partkey")


#: A marked section of no known kind: what follows it cannot be told from it.
BROKEN = "<![part["
ENGINE_TEXTS = (
    "2.4L L4 2351CC 143CI",
    "1.7L L4 1679cc 102ci DENSO/TOYO",
    "3.8L V6 3792ccBody Type: Sedan, 21 psi",
    "TRANSMISSION CONTROL TYPE: Automatic CVT",
    "Eng. Base: 6.2L V8 376CI w/ Max Duty Towing Package",
    "2998ccMax Duty w/o Tow Package",
    "2.7L L5 2694cc Eng. Version: EcoBoost Turbocharged",
    "7.3L V8 7292cc, BEHR w/ SUB COOL Design w/o Towing",
    "4.3L V6 4293cc Primary Radiator Fuel Type: Gas w/ Air Conditioning",
    "2.2L L4 2189cc Pkg 5% Thicker High-Efficiency",
    "ENGINE: 1.4L L4  1398cc w/ 3 Plate cooler w/",
    "Multi-fit Model Std Duty OE 42mm core Includes cap",
)
ASPIRATION_TEXTS = ("Turbocharged", "EcoBoost w/ Twin Turbo", "N/A", "Naturally Aspirated Intercooled")


def _pick(values: tuple[str, ...]) -> Column:
    """One of the given texts, by part key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_key() % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...]) -> str:
    return f"[{', '.join(chr(39) + v + chr(39) for v in values)}][p_partkey % {len(values)} + 1]"


def _html(*pieces: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return A.dealt_table(spark, sf, "part", "p_partkey")


def _listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One listing page per part: a full block, for a fifth of the parts a block without link, and for half of them a
    block outside any panel."""
    blocks = _html(
        '<!DOCTYPE html><html><body><div class="panel" id="panel-top"><div class="panel-header">Fitment For</div></div>'
        '<div class="applications"><div class="panel result"><div class="panel-header"><div class="row"><div class="col">'
        '<h4 class="font-weight-bold"> ', F.col("p_type"), ' </h4></div></div></div><div class="panel-body">'
        '<div class="row app" id="a', _key(), '"><div class="col-8 p-0"><h4>\n  <a href="/items/', _key(), '">', _key(), "</a> - ",
        F.col("p_name"), "\n</h4>Position: <b>Not Applicable</b><br><table class='table table-borderless table-ssm'><tbody><tr>"
        '<td width="50%">Eng. Base: <b>', _pick(ENGINE_TEXTS), "</b></td><td>Aspiration: <b>", _pick(ASPIRATION_TEXTS),
        "</b></td></tr><tr><td>Transmission Control Type: <b>Automatic</b><td>Size: ", F.col("p_size"), "</td><td>Size: ",
        F.col("p_size") + 1, "</td></tr><tr><td>Brand: ", F.col("p_brand"), " &amp; Co: Ltd</td></tr></tbody></table>"
        '<ul class="no-padding"><li>Upgraded core<li>Fits well</ul></div></div>',
        F.when(_key() % 5 == 0, '<div class="row app"><h4>No link here</h4></div>').otherwise(""),
        "</div></div></div>",
        F.when(_key() % 2 == 0, _html('<div class="app row"><h4><a>CSF-', _key(), "</a> - ", F.col("p_name"), " - extra</h4></div>")).otherwise(""),
        "</body></html>",
    )
    return _parts(spark, sf).select(_key().alias("page_id"), blocks.alias("html"))


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract_application_parts(_listing_pages(spark, sf), ["page_id"])


_BLOCKS = """SELECT p_partkey AS page_id, 0 AS page_pos, 'CSF-' || p_partkey AS sku, p_partkey || '- ' || p_name AS name,
  p_type AS category, true AS in_stock FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END,
  'CSF-' || p_partkey, 'extra', 'Unknown', true FROM part WHERE p_partkey % 2 = 0"""


@query("X1_extract_application_parts", _BLOCKS)
def x1(spark: SparkSession, sf: str) -> DataFrame:
    return _listing(spark, sf).select("page_id", "page_pos", "sku", "name", "category", "in_stock")


@query(
    "X2_extract_listing_specs",
    f"""SELECT 'CSF-' || p_partkey AS sku, 'Size' AS key, CAST(p_size + 1 AS VARCHAR) AS value FROM part
    UNION ALL SELECT 'CSF-' || p_partkey, 'Brand', p_brand || ' & Co: Ltd' FROM part
    UNION ALL SELECT 'CSF-' || p_partkey, 'Eng. Base:' || split_part(t, ': ', 1), t[strpos(t, ': ') + 2:] FROM (
      SELECT p_partkey, {_pick_sql(ENGINE_TEXTS)} AS t FROM part) WHERE contains(t, ': ')""",
)
def x2(spark: SparkSession, sf: str) -> DataFrame:
    return _listing(spark, sf).select("sku", F.explode("specifications"))


# --- engine text in SQL ---------------------------------------------------------------------------------------------


def _drop_sql(expr: str, patterns: tuple[str, ...], replacement: str = "", flags: str = "gi") -> str:
    for p in patterns:
        expr = f"regexp_replace({expr}, '{p}', '{replacement}', '{flags}')"
    return expr


def _squeeze_sql(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '\s+', ' ', 'g'))"


def clean_sql(expr: str) -> str:
    expr = _drop_sql(expr, K.ENGINE_LABELS)
    expr = _drop_sql(expr, tuple(rf"[/,\s]+{m}(?:/[A-Z]+)?" for m in K.ENGINE_MAKERS))
    expr = _drop_sql(expr, (r"(\d+cc)\s+\d+ci",), r"\1")
    expr = _drop_sql(expr, tuple(rf"\s*{c}.*$" for c in K.ENGINE_CUTOFFS))
    expr = _drop_sql(_drop_sql(expr, (r"\b(\d+)CC\b",), r"\1cc"), (r"\b(\d+)CI\b",), r"\1ci")
    return _squeeze_sql(expr)


def spec_sql(expr: str) -> str:
    expr = _drop_sql(expr, ("(cc|ci)([A-Z])",), r"\1 \2", "g")
    expr = _drop_sql(expr, K.ASPIRATION_WORDS)
    expr = _drop_sql(expr, (K.FUEL_TEXT, K.RADIATOR_POSITION_TEXT, K.DUTY_TEXT, K.MULTIFIT_TEXT))
    expr = _drop_sql(expr, (K.PACKAGE_TEXT,), " ")
    expr = _drop_sql(_drop_sql(expr, K.ENGINE_PACKAGES), K.PRODUCT_SPECS)
    return _squeeze_sql(_drop_sql(expr, (r"\s*w/o?\s*$",), "", "g"))


_ENGINES = f"SELECT p_partkey, {_pick_sql(ENGINE_TEXTS)} || ' ' || p_brand AS t FROM part"
_CLEANED = f"SELECT p_partkey, t, {clean_sql('t')} AS cleaned FROM ({_ENGINES})"


@query("X3_clean_engine", f"SELECT p_partkey, cleaned, {spec_sql('cleaned')} AS spec FROM ({_CLEANED})")
def x3(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(_pick(ENGINE_TEXTS), F.lit(" "), F.col("p_brand"))
    cleaned = _parts(spark, sf).select("p_partkey", text.alias("t")).withColumn("cleaned", engine.clean_engine(F.col("t")))
    return cleaned.select("p_partkey", "cleaned", engine.engine_spec(F.col("cleaned")).alias("spec"))


_FIELDS = f"""SELECT p_partkey, txt, nullif(trim(regexp_extract(txt, '{K.ENGINE_FIELD}', 1)), '') AS e,
  nullif(trim(regexp_extract(txt, '{K.ASPIRATION_FIELD}', 1)), '') AS a, nullif(trim(regexp_extract(txt, '{K.TRANSMISSION_FIELD}', 1)), '') AS t
  FROM (SELECT p_partkey, 'Eng. Base: ' || chr(10) || {_pick_sql(ENGINE_TEXTS)} || chr(10) || 'Aspiration: ' || chr(10)
    || {_pick_sql(ASPIRATION_TEXTS)} || chr(10) || 'Transmission Control Type: ' || chr(10) || 'Automatic' || chr(10) AS txt FROM part)"""
_STEPS = f"""SELECT *, {clean_sql("e")} AS ec, {clean_sql("a")} AS ac, {clean_sql("t")} AS tc FROM ({_FIELDS})"""
_SPECS = f"SELECT *, {spec_sql('ec')} AS es, {spec_sql('ac')} AS asp FROM ({_STEPS})"


def _found_sql(expr: str) -> str:
    lists = [f"coalesce(regexp_extract_all({expr}, '{p}', 1, 'i'), [])" for p in K.QUALIFIER_PATTERNS]
    return " || ".join(lists)


@query(
    "X4_vehicle_qualifiers",
    f"""SELECT page_id, engine, aspiration, string_agg(q, '|' ORDER BY first_pos) AS qualifiers FROM (
      SELECT page_id, engine, aspiration, q, min(pos) AS first_pos FROM (
        SELECT p_partkey AS page_id, CASE WHEN ec <> '' THEN es END AS engine,
        CASE WHEN asp <> '' AND lower(asp) NOT IN ('not applicable', 'n/a') AND length(asp) <= 50 THEN asp END AS aspiration,
        unnest(all_q) AS q, unnest(range(len(all_q))) AS pos FROM (SELECT *, CASE WHEN contains(lower(ac), 'ecoboost')
          THEN ['EcoBoost'] ELSE [] END || [tc] || {_found_sql("txt")} || {_found_sql("e")} AS all_q FROM ({_SPECS})))
      GROUP BY ALL) GROUP BY ALL""".replace("SELECT page_id, engine, aspiration, string_agg", "SELECT page_id, 0 AS page_pos, engine, aspiration, string_agg", 1)
    + " UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END, NULL, NULL, '' FROM part WHERE p_partkey % 2 = 0",
)
def x4(spark: SparkSession, sf: str) -> DataFrame:
    """All blocks: those outside a panel name no vehicle fields and have no qualifiers."""
    return _listing(spark, sf).select("page_id", "page_pos", "engine", "aspiration", F.array_join("qualifiers", "|").alias("qualifiers"))


# --- detail pages ---------------------------------------------------------------------------------------------------


IMAGE_HOST = "images.example.com"


def _detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One detail page per part with every table form, a description box and pictures."""
    size = F.col("p_size")
    host = f"https://{IMAGE_HOST}/"
    image = lambda folder, kind, tail: _html('<img alt="', F.col("p_name"), f'" src="{host}{folder}/{kind}/', _key(), f'{tail}.jpg">')
    html = _html(
        "<html><body><h5></h5><div class='col-6'><h5>", F.col("p_size"), " Row Core</h5><p>", F.col("p_type"),
        "</p>Built to last; made by ", F.col("p_brand"), "; fits!<br>short<ul><li> Strong tank </li><li></li><li>Light</li></ul></div>",
        F.when(_key() % 4 != 0, image("catalog196", "small", "")).otherwise(""),
        image("catalog196", "large", "_1"), image("other", "large", "_2"),
        F.when(_key() % 3 == 0, image("catalog196", "large", "_3")).otherwise(""),
        "<table><tr><td>Core Thickness (in):</td><th class='text-left'>", size, "/8 (in)</th></tr>"
        "<tr><td>Box Length (in):", size, " 1/4</td></tr><tr><td>Bottom:x</td><td>Bottom:</td><th>13/16 Left</th>"
        "<td>again</td><td>Core Thickness (in):</td><th>ignored</th></tr><tr><td>a:b</td><td></td></tr>",
        F.when(_key() % 2 == 0, _html("<tr><td>Tech Note:</td><td>Style ", F.col("p_brand"), "</td></tr>")).otherwise(""),
        "</table><table><tr><th>Make</th><th>Model</th></tr><tr><td>Honda</td><td>Civic</td></tr></table>"
        "<table><tr><th>Reference Number</th><th>Reference Name</th></tr><tr><td>R", _key(), "</td><td>OEM</td></tr><tr><td></td><td>DPI</td></tr>",
        F.when(_key() % 3 == 0, _html("<tr><td> P", _key(), " </td><td>Partslink</td></tr>")).otherwise(""),
        "</table></body></html>",
    )
    return _parts(spark, sf).select(_html("CSF-", _key()).alias("sku"), html.alias("html"))


def _details(spark: SparkSession, sf: str, **options: bool) -> DataFrame:
    return pages.extract_details(_detail_pages(spark, sf), ["sku"], host=IMAGE_HOST, **options)


@query(
    "X5_extract_detail_specs",
    """SELECT 'CSF-' || p_partkey AS sku, 'Core Thickness (in)' AS key, p_size || '/8 (in)' AS value FROM part
    UNION ALL SELECT 'CSF-' || p_partkey, 'Box Length (in)', p_size || ' 1/4' FROM part
    UNION ALL SELECT 'CSF-' || p_partkey, 'Bottom', '13/16 Left' FROM part
    UNION ALL SELECT 'CSF-' || p_partkey, 'Tech Note', 'Style ' || p_brand FROM part WHERE p_partkey % 2 = 0""",
)
def x5(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf).select("sku", F.explode("specifications"))


@query(
    "X5_detail_failures",
    """SELECT 'CSF-' || p_partkey AS sku, p_partkey % 7 = 0 AS failed, p_partkey % 7 <> 0 AS has_specifications FROM part""",
)
def x5f(spark: SparkSession, sf: str) -> DataFrame:
    """A seventh of the detail pages is broken, another nested 3,000 deep. Records and failures come from one reading."""
    broken, deep = _key() % 7 == 0, _key() % 7 == 1
    before = F.when(broken, F.lit(BROKEN)).otherwise(F.repeat(F.lit("<i>"), F.when(deep, 3000).otherwise(0)))
    key = F.regexp_extract("sku", "[0-9]+", 0).cast("long").alias("p_partkey")
    marked = _detail_pages(spark, sf).select("sku", "html", key).select("sku", F.concat(before, "html").alias("html"))
    read = pages.extract_details_or_errors(marked, ["sku"], host=IMAGE_HOST)
    return read.select("sku", F.col("error").isNotNull().alias("failed"), F.coalesce(F.size("specifications") > 0, F.lit(False)).alias("has_specifications"))


@query("X6_tech_notes", "SELECT 'CSF-' || p_partkey AS sku, CASE WHEN p_partkey % 2 = 0 THEN 'Style ' || p_brand END AS tech_notes FROM part")
def x6(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf).select("sku", "tech_notes")


@query(
    "X7_extract_interchange",
    """SELECT 'CSF-' || p_partkey AS sku, 0 AS pos, 'R' || p_partkey AS reference_number, 'OEM' AS reference_type FROM part
    UNION ALL SELECT 'CSF-' || p_partkey, 1, 'P' || p_partkey, 'Partslink' FROM part WHERE p_partkey % 3 = 0""",
)
def x7(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf).select("sku", F.posexplode("interchange_data").alias("pos", "r")).select("sku", "pos", "r.*")


@query(
    "X8_extract_description",
    """SELECT 'CSF-' || p_partkey AS sku, '<h5>' || p_size || ' Row Core</h5>' || chr(10) || '<p><strong>' || p_type || '</strong></p>'
    || chr(10) || '<p>Built to last. made by ' || p_brand || '. fits!</p>' || chr(10)
    || '<ul><li>Strong tank</li><li>Light</li></ul>' AS full_description FROM part""",
)
def x8(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf).select("sku", "full_description")


_GALLERY = """SELECT 'CSF-' || p_partkey AS sku, 'https://images.example.com/' || f || '/large/' || p_partkey || t || '.jpg'
  AS url, p_name AS alt_text, n = 1 AS is_primary FROM part, (VALUES ('catalog196', '_1', 1), ('other', '_2', 2), ('catalog196', '_3', 3))
  v(f, t, n) WHERE (n < 3 OR p_partkey % 3 = 0)"""


@query("X9_extract_gallery", _GALLERY + " AND f = 'catalog196'")
def x9(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf).select("sku", F.inline("additional_images"))


@query("X9_extract_gallery_any_folder", _GALLERY)
def x9a(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf, catalog_only=False).select("sku", F.inline("additional_images"))


# --- dropdown responses ---------------------------------------------------------------------------------------------


def _link(target: str | Column, label: Column) -> Column:
    """A link as it stands inside a script string."""
    head = _html('<li><a data-remote=\\"true\\" href=\\"', target) if isinstance(target, str) else F.concat(
        F.lit('<li><a data-remote=\\"true\\" href=\\"'), target
    )
    return F.concat(head, F.lit('\\"> '), label, F.lit(" <\\/a><\\/li>"))


def _script(links: Column) -> Column:
    return F.concat(
        F.lit('$("#btnMake").text("x")\n$("#btnYear").next().html("<ul>'), links,
        F.lit('<li><a href=\\"\\/help\\">Help<\\/a><\\/li><li><a href=\\"remote:\\/get_model_by_make_year\\/applications\\/all\\">All<\\/a><\\/li><\\/ul>")\n$("#btnYear").show()'),
    )


@query(
    "X10_build_hierarchy",
    sql("SELECT make_id, make, CAST(year_id AS BIGINT) AS year_id, year, application_id, model || ' & Co' AS model FROM app", "app"),
)
def x10(spark: SparkSession, sf: str) -> DataFrame:
    """Responses for every make's years and every year's models, read back into one row per application."""
    rows = A.applications(spark, sf)
    makes = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("make_id"), F.col("n_name").alias("make"))
    year_target = F.concat(F.lit("remote:\\/get_model_by_make_year\\/"), F.col("year_id").cast("string"))
    years = rows.select("make_id", "year_id", "year").distinct().select(
        "make_id", _script(_link(year_target, F.col("year"))).alias("js")
    )
    model_target = F.concat(F.lit("\\/applications\\/"), F.col("application_id").cast("string"))
    models = rows.select(
        F.col("year_id").cast("long").alias("year_id"),
        _script(_link(model_target, F.concat("model", F.lit(" &amp; Co")))).alias("js"),
    )
    return responses.build_hierarchy(makes, years, models)


@query("X10_discovered_makes", "SELECT n_nationkey AS make_id, n_name AS make FROM nation WHERE n_nationkey % 2 = 0")
def x10m(spark: SparkSession, sf: str) -> DataFrame:
    """A home page fragment per make; odd makes are linked without the marker."""
    key = F.col("n_nationkey")
    path = F.when(key % 2 == 0, "/get_year_by_make/").otherwise("/about/")
    link = F.concat(F.lit('<li><a data-remote="true" href="'), path, key.cast("string"), F.lit('">'), F.col("n_name"), F.lit("</a></li>"))
    return responses.discovered_makes(A.table(spark, sf, "nation").select(link.alias("html")))


# --- any page -------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return A.dealt_table(spark, sf, "pages", "page_id")


_UNESCAPE = "replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&amp;', '&')"


@query("X11_select_text", f"""SELECT page_id, trim({_UNESCAPE.format("regexp_extract(html, '<h1[^>]*>([^<]*)', 1)")}) AS text FROM pages""")
def x11(spark: SparkSession, sf: str) -> DataFrame:
    return pages.select_text(_pages(spark, sf), "h1", ["page_id"])


@query("X11_select_attr", """SELECT page_id, regexp_extract(html, '<a href="([^"]*)"', 1) AS value FROM pages""")
def x11a(spark: SparkSession, sf: str) -> DataFrame:
    return pages.select_attr(_pages(spark, sf), "a[href]", "href", ["page_id"])


@query(
    "X11_select_contained",
    f"""SELECT page_id, page_id % 5 = 0 AS failed, CASE WHEN page_id % 5 <> 0 THEN
    trim({_UNESCAPE.format("regexp_extract(html, '<h1[^>]*>([^<]*)', 1)")}) END AS text FROM pages""",
)
def x11c(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of the pages is broken, another fifth nested 6,000 deep, some 100,000: the first are listed, all others read."""
    page = F.col("page_id")
    before = F.when(page % 5 == 0, F.lit(BROKEN)).otherwise(F.repeat(F.lit("<b>"), F.when(page % 200 == 1, 100_000).when(page % 5 == 1, 6000).otherwise(0)))
    nested = _pages(spark, sf).withColumn("html", F.concat(before, "html"))
    found = pages.select_text(nested, "h1", ["page_id"]).join(pages.page_failures(nested, ["page_id"]).select("page_id", F.lit(True).alias("failed")), "page_id", "left")
    return found.select("page_id", F.coalesce("failed", F.lit(False)).alias("failed"), "text")


@query(
    "X11_select_all",
    f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, trim({_UNESCAPE.format("label")}) AS text, value FROM (SELECT page_id,
    unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)', 1)) AS label, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS value,
    unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)))) AS pos FROM pages)""",
)
def x11l(spark: SparkSession, sf: str) -> DataFrame:
    return pages.select_all(_pages(spark, sf), "nav ul li a[href]", ["page_id"], "href")


@query(
    "X12_split_renderable",
    """SELECT page_id, page_id % 3 = 0 OR contains(html, '.row.app') OR contains(html, 'row app') AS ready FROM pages""",
)
def x12(spark: SparkSession, sf: str) -> DataFrame:
    marked = A.table(spark, sf, "pages").withColumn(
        "html", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit('<div class="row app"></div>'))).otherwise(F.col("html"))
    )
    ready, waiting = pages.split_renderable(marked)
    return ready.select("page_id", F.lit(True).alias("ready")).unionByName(waiting.select("page_id", F.lit(False).alias("ready")))
