"""SQL twins of the adapters, as named common table expressions."""

from __future__ import annotations

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "cat": (
        (),
        """
        SELECT p_partkey AS id, 'CSF-' || p_partkey AS sku, p_name AS name,
          CASE WHEN p_partkey % 3 <> 0 THEN concat_ws(' ', 'OE style', p_name, 'by', p_brand || ';', 'size', p_size,
            'from the', lower(p_type), 'line') END AS description,
          p_type AS category, CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_brand AS manufacturer,
          p_size % 4 <> 0 AS in_stock, CASE WHEN p_size % 3 = 0 THEN 'Front' END AS position, p_size,
          CASE WHEN p_partkey % 2 = 0 THEN 'Check fitting' END AS tech_notes
        FROM part""",
    ),
    "catts": (
        ("cat",),
        """
        SELECT cat.*, t.created_at, t.updated_at FROM cat LEFT JOIN
          (SELECT l_partkey, min(l_shipdate) AS created_at, max(l_shipdate) AS updated_at FROM lineitem GROUP BY 1) t
          ON cat.id = t.l_partkey""",
    ),
    "fit": (
        (),
        """
        SELECT 'CSF-' || l_partkey AS sku, n_name AS make, 'Model ' || (l_suppkey % 7) AS model,
          CAST(year(l_shipdate) AS INTEGER) AS year,
          CASE WHEN l_quantity >= 5 THEN l_returnflag || '-' || l_linestatus END AS engine,
          CASE l_linenumber % 3 WHEN 0 THEN 'Turbocharged' WHEN 1 THEN 'None' END AS aspiration,
          CASE WHEN l_tax > 0.06 THEN 'w/ Towing' ELSE '' END AS qualifiers,
          l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_suppkey AS o4, l_shipdate AS o5
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    ),
    "fit1": (
        ("fit",),
        """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sku, make, model, year, engine
          ORDER BY o1, o2, o3, o4, o5) AS rn FROM fit) WHERE rn = 1""",
    ),
    "spec": (
        (),
        """
        SELECT 'CSF-' || p_partkey AS sku, p_partkey AS id, k AS key, v AS value FROM part, LATERAL (
          SELECT unnest(['Size', 'Construction', 'Core Length (in)', 'Core Width (in)', 'Core Thickness (in)',
            'Box Length (in)', 'Box Width (in)', 'Box Height (in)', 'Flow Type', 'Inlet Length (in)',
            'Inlet Width (in)', 'Outlet Size', 'tank_material', CAST(p_partkey AS VARCHAR)]) AS k,
          unnest([CAST(p_size AS VARCHAR), 'PLASTIC TANK aluminum core', p_size || ' 1/2', (p_size + 3) || ' 9/16',
            CASE WHEN p_partkey % 4 <> 0 THEN '1 1/4 (in)' END, (p_size + 5) || ' 3/8', CAST(p_size + 2 AS VARCHAR),
            CASE WHEN p_partkey % 5 <> 0 THEN '7 5/8' END, CASE WHEN p_partkey % 2 = 0 THEN 'CROSS flow' END,
            CASE WHEN p_partkey % 3 = 0 THEN '2 1/4' END, CASE WHEN p_partkey % 6 = 0 THEN '1 1/16' END,
            CASE WHEN p_partkey % 7 = 0 THEN '1 IN barb' END, CASE WHEN p_partkey % 8 = 0 THEN 'Plastic' END,
            CASE WHEN p_partkey % 9 = 0 THEN p_type END]) AS v) WHERE v IS NOT NULL""",
    ),
    "img": (
        (),
        """
        SELECT p_partkey AS id, 'CSF-' || p_partkey AS sku, CAST(i AS INTEGER) AS pos,
          CASE WHEN (p_partkey + i) % 2 = 0 THEN 'https://cdn.example.com/media/' ELSE '' END
            || 'images/avif/CSF-' || p_partkey || '_' || i || '.avif' AS url,
          p_name || ' ' || i AS alt_text, (i = 1 AND p_partkey % 2 = 0) AS is_primary
        FROM part, LATERAL (SELECT unnest(range(p_partkey % 4)) AS i)""",
    ),
    "ref": (
        (),
        """
        SELECT p_partkey AS id, 'CSF-' || p_partkey AS sku, CAST(i AS INTEGER) AS pos,
          'R' || ((p_partkey * 7 + i * 400) % 1000) || '-' || i AS reference_number,
          ['OEM', 'Partslink', 'DPI'][(p_partkey + i) % 3 + 1] AS reference_type
        FROM part, LATERAL (SELECT unnest(range(p_partkey % 3)) AS i)""",
    ),
    "raw": (
        (),
        """
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
            || strftime(l_shipdate, '%Y%m%d') AS row_key,
          CASE WHEN n = 1 THEN 'csf-' || k WHEN n = 2 THEN '  CSF-' || k || ' ' WHEN n = 7 AND k % 5 = 0 THEN 'XX-' || k
            WHEN k % 97 = 0 THEN '' ELSE 'CSF-' || k END AS sku,
          CASE WHEN s % 31 = 0 THEN '   ' ELSE 'radiator ' || s END AS name,
          CASE k % 9 WHEN 0 THEN '$' || n || ',299.99 ' WHEN 1 THEN NULL WHEN 2 THEN 'None' WHEN 3 THEN 'call us'
            WHEN 4 THEN k || '.125' WHEN 5 THEN '75000.00' WHEN 6 THEN '-5.00'
            ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END AS price,
          CASE WHEN s % 29 = 0 THEN ' ' WHEN l_linestatus = 'F' THEN ' RADIATORS ' ELSE 'a/c condenser' END AS category,
          CASE WHEN k % 2 = 0 THEN 'From supplier ' || s END AS description,
          n % 2 = 0 AS has_features,
          CASE n WHEN 3 THEN '   ' WHEN 4 THEN ' fits tight ' END AS tech_notes,
          CASE WHEN n = 5 THEN ' Front ' END AS position,
          CASE WHEN n = 6 THEN 'Other' END AS manufacturer,
          CASE WHEN n = 2 THEN false END AS in_stock,
          k % 5 = 0 AS has_specs, k % 3 <> 0 AS has_image, s % 17 = 0 AS bad_image,
          k % 4 = 0 AS has_ref, s % 19 = 0 AS bad_ref, k, n, s
        FROM (SELECT *, l_partkey AS k, l_linenumber AS n, l_suppkey AS s FROM lineitem)""",
    ),
    "prev": (
        ("cat",),
        """
        SELECT * EXCLUDE (price), CAST(CASE WHEN id % 7 = 0 THEN price + 1 ELSE price END AS DECIMAL(10,2)) AS price
        FROM cat WHERE id % 10 <> 0""",
    ),
    "cur": (("cat",), "SELECT * FROM cat WHERE id % 11 <> 0"),
    "det": (
        (),
        """
        SELECT 'CSF-' || p_partkey AS sku, CASE WHEN p_partkey % 5 <> 0 THEN 'Full text for ' || p_name END AS full_description,
          'detail' AS size, CAST(p_partkey % 4 AS VARCHAR) AS rows_,
          CASE WHEN p_partkey % 4 = 0 THEN 'Detail note' END AS tech_notes,
          CASE WHEN p_partkey % 2 = 0 THEN 'D' || p_partkey || '/OEM' ELSE '' END AS refs,
          CASE WHEN p_partkey % 7 = 0 THEN 'https://cdn.example.com/large/' || p_partkey || '.jpg' ELSE '' END AS imgs
        FROM part WHERE p_partkey % 3 <> 0""",
    ),
    "fail": (
        (),
        """
        SELECT event_type AS phase, CAST(user_id AS VARCHAR) AS identifier, value < 50 AS is_retryable, event_id, ts
        FROM events""",
    ),
    "log": (
        (),
        """
        SELECT 'parts_' || event_id || '.json' AS filename, date_trunc('second', ts) AS started_at,
          date_trunc('second', ts) + to_seconds(CAST(floor(abs(value)) AS INTEGER)) AS completed_at,
          CAST(floor(abs(value)) AS BIGINT) AS seconds, user_id AS parts_count, event_id FROM events""",
    ),
    "ph": (
        (),
        """
        SELECT page_id, url, html, md5(regexp_replace(regexp_replace(html, 'content="[A-Za-z0-9+/=]+"', 'content=""', 'g'),
          'value="[A-Za-z0-9+/=]+"', 'value=""', 'g')) AS hash FROM pages""",
    ),
    "pstate": (
        ("ph",),
        "SELECT url, CASE WHEN page_id % 4 = 0 THEN reverse(hash) ELSE hash END AS hash FROM ph WHERE page_id % 5 <> 0",
    ),
    "man": (
        ("img",),
        """
        SELECT sku || '_' || pos || '.avif' AS filename,
          CASE WHEN id % 5 <> 0 THEN md5(url) END AS source_hash, CASE WHEN id % 2 = 0 THEN 'etag' END AS etag,
          CASE WHEN id % 5 = 0 THEN 'failed' WHEN id % 3 = 0 THEN 'true' ELSE 'false' END AS synced,
          CASE WHEN id % 5 = 0 THEN 'timed out' END AS error, id, sku, pos FROM img""",
    ),
    "app": (
        (),
        """
        SELECT n_nationkey AS make_id, n_name AS make,
          CAST(n_nationkey * 100 + 1995 + s_suppkey % 7 AS INTEGER) AS year_id,
          CAST(1995 + s_suppkey % 7 AS VARCHAR) AS year, s_suppkey AS application_id, s_name AS model
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    ),
}


def sql(body: str, *tables: str) -> str:
    """A statement over the named derived tables, with their own inputs included."""
    needed: list[str] = []

    def add(name: str) -> None:
        for dependency in TABLES[name][0]:
            add(dependency)
        if name not in needed:
            needed.append(name)

    for name in tables:
        add(name)
    clauses = ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in needed)
    return f"WITH {clauses}\n{body}" if needed else body


SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
TITLE = r"array_to_string(list_transform(regexp_extract_all({0}, '(\p{{L}}+|\P{{L}}+)'), lambda x: upper(x[1]) || lower(x[2:])), '')"


def slug(expr: str) -> str:
    return SLUG.format(expr)


def title(expr: str) -> str:
    return TITLE.format(expr)


def fractions(expr: str) -> str:
    """The fraction rule as SQL."""
    from partloom.constants import FRACTIONS

    out = f"(' ' || {expr})"
    for plain, pretty in FRACTIONS.items():
        out = f"replace({out}, '{plain}', '{pretty}')"
    return rf"trim(regexp_replace({out}, '\s(\d+)/(\d+)', ' <sup>\1</sup>⁄<sub>\2</sub>', 'g'))"


def words(expr: str, count: int) -> str:
    """The excerpt rule as SQL."""
    parts = rf"string_split(trim(regexp_replace({expr}, '\s+', ' ', 'g')), ' ')"
    return (
        f"CASE WHEN len({parts}) > {count} THEN array_to_string(list_slice({parts}, 1, {count}), ' ') || '…' "
        f"ELSE array_to_string({parts}, ' ') END"
    )


def capitalized(expr: str) -> str:
    return f"array_to_string(list_transform(string_split({expr}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
