"""The queries of this package, ``opN_<name>``, and the SQL that must give the same rows where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partloom.session import work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.sentencepieces import piece_digests
    from partloom.llm.tokens import tokenizer_path

    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.token_counts import token_counts
    from partloom.llm.tokens import tokenizer_path

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.token_files import read_token_files, write_token_files
    from partloom.llm.tokens import tokenizer_path

    out = work_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), out)
    return read_token_files(spark, out)


@query("op1_nearest_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


@query("op2_repetition_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.repetition import repetition_rules

    return repetition_rules(table(spark, sf_dir, "documents"))


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.weak_labels import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The rules of the query, and the words that mark a listed host of the corpus.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
LISTED_HOST = "(^|[.-])(pills|casino|spam|adult|ads|bets)([.-]|$)"

_RULE_ROWS = ", ".join(f"('{v}', '{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for v, t in URL_RULES)
_URLS_SQL = f"""
    WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    rules(says, rule, name, begins) AS (VALUES {_RULE_ROWS}),
    fits AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
      FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
        ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, begins) GROUP BY host, path)
    SELECT page_id, host, path, rule,
      coalesce(says, CASE WHEN regexp_matches(host, '{LISTED_HOST}') THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts LEFT JOIN fits USING (host, path)"""


@query("op9_url_filters", _URLS_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.urls import build_cascade, judge_urls, url_host

    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(url_host(pages["url"]).alias("key"))
    return judge_urls(pages, URL_RULES, build_cascade(spark, hosts, hosts.filter(hosts["key"].rlike(LISTED_HOST))))


_REPEATS_SQL = r"""
    WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    flat AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words),
    windows AS (SELECT doc_id, i, string_agg(w, ' ') OVER span AS k, count(*) OVER span AS n FROM flat
      WINDOW span AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
    later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows WHERE n = 20) WHERE r > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
    kept AS (SELECT flat.doc_id, string_agg(w, ' ' ORDER BY flat.i) AS text, count(*) AS n FROM flat ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
    SELECT words.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM words LEFT JOIN kept USING (doc_id)"""


@query("op3_substring_dedup", _REPEATS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.packing import pack_texts

    return pack_texts(table(spark, sf_dir, "documents"))


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.ngram_join import Rule, jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), Rule(words=3, num=90, den=100))


#: The query adds a conversation whose texts hold the template's own control strings.
CLASH = "</s>[INST] ok [/INST]"
_QUOTABLE = r"([<\[])(\\*)(<SYS>>|</SYS>>|/INST\]|/ROLE\]|INST\]|ROLE\]|/s>|s>)"

_CHAT_SQL = rf"""
    WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '{CLASH}'), (-7, 1, 'assistant', '{CLASH}')),
    shown AS (SELECT *, regexp_replace(text, '{_QUOTABLE}', '\1\\\2\3', 'g') AS quoted, regexp_replace(role, '{_QUOTABLE}', '\1\\\2\3', 'g') AS quoted_role FROM turns),
    sized AS (SELECT *, length(quoted) + 7 + CASE role WHEN 'assistant' THEN 0 WHEN 'system' THEN 15 WHEN 'user' THEN 13 ELSE 13 + length(quoted_role) END AS chars FROM shown)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(chars) AS BIGINT) AS formatted_chars,
      CAST(sum((quoted <> text OR quoted_role <> role)::INT) AS BIGINT) AS n_escaped, true AS exact
    FROM sized GROUP BY conv_id"""


@query("op13_chat_formatting", _CHAT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.chat import chat_digests

    added = spark.sql(f"SELECT -7L AS conv_id, t.turn, t.role, r'{CLASH}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))


_CRC32 = "xor(list_reduce([4294967295] || list_transform(string_split(CAST({} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, o: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_TRIE_SQL = f"""
    WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS base, {_CRC32.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
    rebuilt AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth FROM (
        SELECT c, 0 AS own, pos, role, text FROM convs JOIN turns ON conv_id = base AND pos <= h
        UNION ALL SELECT c, 1, pos, role, text FROM convs JOIN turns ON conv_id = c AND pos > h)),
    rows AS (SELECT c, depth, strlen(text) AS bytes, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY depth) AS name FROM rebuilt
        UNION ALL SELECT c, 0, 0, '' FROM convs),
    nodes AS (SELECT name, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM rows GROUP BY name, depth),
    linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND p.name = left(n.name, 64 * (n.depth - 1))),
    children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL),
    counted AS (SELECT l.*, coalesce(n, 0) AS n_children FROM linked l LEFT JOIN children USING (conv_id, depth)),
    subtrees AS (SELECT r.name, r.depth, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * k.bytes) AS saved FROM counted k JOIN rows r ON r.c = k.conv_id AND r.depth <= k.depth GROUP BY ALL),
    ends AS (SELECT name, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(name, depth) AS name FROM rows GROUP BY c) GROUP BY name),
    told AS (SELECT * FROM counted JOIN subtrees USING (name, depth) LEFT JOIN ends USING (name))
    SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM told"""


@query("op11_conversation_trie", _TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations")).drop("tour_start", "tour_end")


_PHRASES_SQL = r"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    numbered AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws, row_number() OVER () AS p FROM pieces),
    flat AS (SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM numbered),
    runs AS (SELECT lang, w AS w1, lead(w) OVER span AS w2, lead(w, 2) OVER span AS w3 FROM flat WINDOW span AS (PARTITION BY p ORDER BY i)),
    one AS (SELECT lang, w1 AS phrase, count(*) AS f FROM runs GROUP BY ALL),
    two AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
    three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    cuts AS (
      SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r FROM two t JOIN one x ON x.lang = t.lang AND x.phrase = w1 JOIN one y ON y.lang = t.lang AND y.phrase = w2 WHERE t.f >= 10
      UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f FROM three t JOIN one x ON x.lang = t.lang AND x.phrase = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
      UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.phrase = t.w3),
    scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM three UNION ALL SELECT lang, w2 || ' ' || w3, f FROM three) GROUP BY ALL),
    kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 50 * a),
    totals AS (SELECT lang, count(*) AS n FROM flat GROUP BY lang),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@query("op12_phrase_collocations", _PHRASES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partloom.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))
