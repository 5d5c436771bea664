"""Url filters: path rules, and a cascade of Bloom filters for exact membership in a listed set of keys.

All of it is DataFrame functions. Level 1 encodes the listed keys; level 2 the other keys of the universe that level 1 takes for listed; level 3
the listed keys that level 2 takes for others; and so on until a level has no false positive. For every key of the universe
the first level that misses it tells exactly whether it is listed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.session import work_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 7
BITS_PER_KEY = 10
#: A filter row holds at most so many bits (8 KB); more keys make more rows, never larger ones.
SEGMENT_BITS = 1 << 16
_MASK = (1 << 40) - 1


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; ``rules`` are (verdict, host and path), and fit a host with its subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    rows: DataFrame
    segments: int
    number: int


@dataclass
class Cascade:
    levels: list[Level]

    def listed(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """Add a boolean column: whether ``key`` is one of the listed keys. Right for every key of the universe; false for null."""
        hits = []
        for level in self.levels:
            df, hit = _hit(df, key, level)
            hits.append(hit)
        answer = F.lit(len(hits) % 2 == 1)
        for i in range(len(hits), 0, -1):
            answer = F.when(~hits[i - 1], F.lit(i % 2 == 0)).otherwise(answer)
        answer = F.when(F.col(key).isNull(), F.lit(False)).otherwise(answer) if hits else F.lit(False)
        return df.withColumn(name, answer).drop(*[c for c in df.columns if c.startswith("_cascade_")])


def _positions(key: Column, number: int, bits: int) -> list[Column]:
    """Bit positions of a key: sums of two hashes of 40 bits, so nothing overflows."""
    a = F.xxhash64(key, F.lit(number)).bitwiseAND(F.lit(_MASK))
    b = F.xxhash64(F.lit(number), key).bitwiseAND(F.lit(_MASK))
    return [(a + b * F.lit(j)) % F.lit(bits) for j in range(HASHES)]


def _segment(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("segment"), key), F.lit(segments))


def _sizes(keys: int) -> tuple[int, int]:
    """How many segments, and the bits of each."""
    wanted = max(64, keys * BITS_PER_KEY)
    segments = -(-wanted // SEGMENT_BITS)
    return segments, SEGMENT_BITS if segments > 1 else -(-wanted // 64) * 64


def _build(keys: DataFrame, key: str, number: int, count: int, path: str) -> Level:
    segments, bits = _sizes(count)
    words = bits // 64
    positions = keys.select(_segment(F.col(key), segments).alias("segment"), F.explode(F.array(*_positions(F.col(key), number, bits))).alias("at"))
    # shiftleft(1, 63) is the sign bit; bit_or keeps all 64 as they are.
    set_words = positions.selectExpr("segment", "CAST(floor(at / 64) AS BIGINT) AS word", "shiftleft(1L, CAST(at % 64 AS INT)) AS bits")
    empty = keys.sparkSession.range(segments * words).selectExpr(f"id % {segments} AS segment", f"CAST(floor(id / {segments}) AS BIGINT) AS word", "0L AS bits")
    merged = set_words.unionByName(empty).groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))
    rows = merged.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all"))
    rows.selectExpr("segment", "transform(all, x -> x.bits) AS filter").write.parquet(path)
    return Level(keys.sparkSession.read.parquet(path), segments, number)


def _hit(df: DataFrame, key: str, level: Level) -> tuple[DataFrame, Column]:
    name = f"_cascade_{level.number}"
    if level.segments == 1:
        # One row of at most SEGMENT_BITS: a scalar subquery hands it to every task.
        held = level.rows.select("filter").scalar()
        df = df.withColumn(name, held)
    else:
        rows = level.rows.select(F.col("segment").alias(f"_cascade_s{level.number}"), F.col("filter").alias(name))
        df = df.withColumn(f"_cascade_k{level.number}", _segment(F.col(key), level.segments))
        df = df.join(rows, F.col(f"_cascade_k{level.number}") == F.col(f"_cascade_s{level.number}"), "left")
    bits = F.size(name).cast("long") * F.lit(64)
    a = F.xxhash64(F.col(key), F.lit(level.number)).bitwiseAND(F.lit(_MASK))
    b = F.xxhash64(F.lit(level.number), F.col(key)).bitwiseAND(F.lit(_MASK))
    tests = []
    for j in range(HASHES):
        at = (a + b * F.lit(j)) % bits
        word = F.get(F.col(name), F.floor(at / F.lit(64)).cast("int"))
        tests.append(F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", word, (at % F.lit(64)).cast("int"))) == F.lit(1))
    return df, reduce(lambda x, y: x & y, tests)


def build_cascade(spark: SparkSession, universe: DataFrame, listed: DataFrame, key: str = "key") -> Cascade:
    """A cascade that tells the keys of ``listed`` from all other keys of ``universe``; both have a column ``key``.

    Nulls, repeated keys and listed keys outside the universe are left out. An empty list makes no level, and nothing is listed.
    Each level is about a hundredth of the one two before it, so a few levels end it.
    """
    all_keys = work_path(spark, "url-keys")
    marked = listed.select(F.col(key)).dropna().distinct().withColumn("listed", F.lit(True))
    universe.select(F.col(key)).dropna().distinct().join(marked, key, "left").select(key, F.coalesce("listed", F.lit(False)).alias("listed")).write.parquet(all_keys)
    keys = spark.read.parquet(all_keys)
    inside, outside = keys.filter("listed").select(key), keys.filter("NOT listed").select(key)
    levels: list[Level] = []
    while count := inside.count():
        level = _build(inside, key, len(levels) + 1, count, work_path(spark, "url-filter"))
        levels.append(level)
        tested, hit = _hit(outside, key, level)
        wrong = work_path(spark, "url-wrong")
        tested.filter(hit).select(key).write.parquet(wrong)
        inside, outside = spark.read.parquet(wrong), inside
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], cascade: Cascade) -> DataFrame:
    """page_id, host, path, rule and verdict: the longest fitting rule's, else block for a listed host, else allow.

    Rows with a null url have an empty host and path. Repeated rows stay, other columns are ignored.
    """
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    judged = cascade.listed(parts.withColumns({"rule": rule, "says": says}), "host", "blocked")
    verdict = F.coalesce("says", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
