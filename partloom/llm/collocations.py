"""Phrase collocations by prefix-free parsing.

Texts become streams of words with a mark between pieces. A stream is cut where two words in a row have a hash that is 0 modulo ``MEAN``; a chunk
runs on over the two words that trigger the next one, so equal passages give equal chunks wherever they stand, and every phrase of up to three words
lies in the chunk that its first word belongs to. The parse is the frequency of each distinct chunk; phrases are counted in distinct chunks
only, weighted, and a phrase that starts in the overlap is left to the next chunk.

A phrase of three words can only be found ten times if both of its pairs are. So:

1. ``parse_chunks``: distinct chunks with their frequencies, dealt to slices by hash.
2. ``frequent_pairs``: 40-bit hashes of the pairs of each slice, with counts; after one exchange by hash those with ``least`` or more in all go back to their slices.
   Equal hashes of unlike pairs can only let a pair through, which the exact counts then drop. Both ways a slice's hashes travel sorted, as differences in
   compressed byte planes (3 bytes a pair instead of 12), and its chunks go to the last step in one compressed block.
3. ``phrase_counts``: each slice meets its frequent pairs and gives the words, the pairs left and the phrases whose pairs are all left, spelled out, with counts.
   Spark sums them by language and phrase.
4. ``collocations``: cuts, scores, parts of longer phrases, ranks; in SQL functions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.words import factorized, hashes, mixed, owners, slices, starts
from partloom.session import work_path

#: Mean number of words between two cuts.
MEAN = 32
#: Words that a chunk shares with the next one: one less than the longest phrase.
OVERLAP = 2
MOST_WORDS = 3
#: Text of distinct chunks in a slice.
SLICE_BYTES = 8 << 20
#: Of a pair's hash: what sorted differences cost, and how rarely unlike pairs meet.
PAIR_BITS = 40
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Stands between pieces; no text in UTF-8 has this byte.
MARK = b"\xff"
_TO_MARKS = bytes.maketrans(ENDS, MARK * len(ENDS))
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def _stage(df: DataFrame, purpose: str) -> DataFrame:
    spark, path = df.sparkSession, work_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def symbols(text: bytes) -> list[bytes]:
    """Words of a text in lower case (A to Z only), with ``MARK`` for every character that ends a piece."""
    return text.lower().translate(_TO_MARKS).replace(MARK, b" \xff ").split()


def cut_places(codes: np.ndarray, counts: np.ndarray, hashed: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Where chunks begin: at each text's start and at every pair of words whose hash is 0 modulo ``mean``."""
    begin = np.zeros(len(codes), bool)
    if len(codes) > 1:
        begin[:-1] = mixed(hashed[codes[:-1]] * _ROLL + hashed[codes[1:]]) % np.uint64(mean) == 0
    at = starts(counts)
    # A pair over two texts is none; the last word of a text has no pair.
    begin[at[1:][counts > 0] - 1] = False
    begin[at[:-1][counts > 0]] = True
    return np.flatnonzero(begin)


_PARSED = pa.schema([("lang", pa.string()), ("over", pa.int32()), ("chunk", pa.binary()), ("n", pa.int64())])


def _parse(batches: Iterable[pa.RecordBatch], mean: int) -> Iterator[pa.RecordBatch]:
    """Distinct chunks of a slice of texts; ``over``: how many of the last words belong to the next chunk."""
    for batch in slices(batches):
        parts = [symbols(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        codes, counts, vocabulary = factorized(parts)
        if not len(codes):
            continue
        begin = cut_places(codes, counts, hashes(vocabulary), mean)
        at = starts(counts)
        owner = np.searchsorted(at, begin, side="right") - 1
        end = np.minimum(np.append(begin[1:], len(codes)), at[owner + 1])
        over = np.minimum(at[owner + 1] - end, OVERLAP)
        langs = batch.column("lang").to_pylist()
        first = at[owner]
        found: Counter = Counter(
            (langs[o], v, b" ".join(parts[o][b - f : e - f + v]))
            for o, b, e, v, f in zip(owner.tolist(), begin.tolist(), end.tolist(), over.tolist(), first.tolist())
        )
        lang, overs, chunk = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(overs, pa.int32()), pa.array(chunk, pa.binary()), pa.array(found.values(), pa.int64())], schema=_PARSED)


def parse_chunks(docs: DataFrame, mean: int = MEAN, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """slice, lang, over, chunk (words joined by a space) and n (frequency in the parse) of every distinct chunk, written slice by slice."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # As many slices as the text asks for, however small the corpus is: a slice's arrays fit a task.
    n_slices = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // slice_bytes + 1)
    parsed = texts.mapInArrow(lambda b: _parse(b, mean), "lang string, over int, chunk binary, n long")
    parsed = parsed.withColumn("slice", F.pmod(F.xxhash64("chunk"), F.lit(n_slices)))
    # Dealt by slice, which also brings equal chunks together; each task sends a chunk once per slice of texts.
    whole = parsed.repartition("slice").groupBy("slice", "lang", "over", "chunk").agg(F.sum("n").alias("n"))
    return _stage(whole.sortWithinPartitions("slice"), "chunks")


class Slice:
    """The distinct chunks of one slice as arrays: a code per word, with its chunk's language and weight."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        parts = [c.split(b" ") for c in table.column("chunk").to_pylist()]
        self.codes, counts, self.vocabulary = factorized(parts)
        owner = owners(counts)
        at = np.arange(len(self.codes)) - starts(counts)[:-1][owner]
        over = table.column("over").to_numpy().astype(np.int64)
        lang, self.langs = pd.factorize(np.array(table.column("lang").to_pylist(), object))
        self.lang = lang.astype(np.int64)[owner]
        self.weight = table.column("n").to_numpy().astype(np.int64)[owner]
        self.word = self.codes != (np.flatnonzero(self.vocabulary == MARK)[:1].tolist() or [-1])[0]
        # Phrases that start in the overlap are the next chunk's.
        self.own = self.word & (at < (counts - over)[owner])
        self.left = counts[owner] - at
        self.hashed = hashes(self.vocabulary)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash (``PAIR_BITS``) of the pair from each position on, and whether there is one."""
        n = len(self.codes)
        out, there = np.zeros(n, np.int64), np.zeros(n, bool)
        if n > 1:
            salt = hashes([x.encode() for x in self.langs])[self.lang[:-1]]
            whole = mixed((self.hashed[self.codes[:-1]] * _ROLL + self.hashed[self.codes[1:]]) * _ROLL + salt)
            out[:-1] = (whole >> np.uint64(64 - PAIR_BITS)).view(np.int64)
            there[:-1] = self.word[:-1] & self.word[1:] & (self.left[:-1] > 1)
        return out, there


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of each one's weights, and one place where it stands."""
    if not len(keys):
        return keys, weights, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(weights[order], first), order[first]


def _runs(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows in the order of slices, as one batch per slice; one with over ``limit`` bytes of chunks is cut."""
    held: list[pa.RecordBatch] = []
    key, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column("slice").to_numpy()
        border = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
        for a, b in zip(border, border[1:]):
            if held and (key != of[a] or size > limit):
                yield key, pa.concat_batches(held)
                held, size = [], 0
            key = int(of[a])
            held.append(batch.slice(a, b - a))
            size += held[-1].column("chunk").nbytes
    if held:
        yield key, pa.concat_batches(held)


_ZSTD = pa.Codec("zstd")


def _planes(values: np.ndarray) -> list[bytes]:
    """Numbers from 0 on as compressed byte planes, lowest first, up to the highest byte that is in use."""
    used = (int(values.max()).bit_length() + 7) // 8
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:used])
    return [_ZSTD.compress(p.tobytes(), asbytes=True) for p in planes]


def _numbers(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((8, n), np.uint8)
    for k, plane in enumerate(planes):
        out[k] = np.frombuffer(_ZSTD.decompress(plane, n, asbytes=True), np.uint8)
    return np.ascontiguousarray(out.T).view("<u8")[:, 0].astype(np.int64)


_PAIRS = pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("m", pa.int64()), ("pairs", pa.list_(pa.binary())), ("ns", pa.list_(pa.binary()))])


def _slice_pairs(batches: Iterable[pa.RecordBatch], n_parts: int, least: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Hashed pairs of each run of rows of one slice, with counts up to ``least``: a row for each of ``n_parts`` ranges of hashes."""
    edges = np.array([(k << PAIR_BITS) // n_parts for k in range(1, n_parts)], np.int64)
    for key, rows in _runs(batches, limit):
        part = Slice(rows)
        pair, there = part.pairs()
        # Pairs of the overlap are counted by the next chunk, but asked for here too: longer phrases reach into it.
        found, n, _ = _sums(pair[there], np.where(part.own, part.weight, 0)[there])
        n = np.minimum(n, least)
        border = np.r_[0, np.searchsorted(found, edges), len(found)]
        filled = np.flatnonzero(np.diff(border))
        for few in np.array_split(filled, len(filled) // 256 + 1):
            cut = [slice(border[k], border[k + 1]) for k in few]
            out = [pa.array(few), pa.array(np.full(len(few), key)), pa.array([c.stop - c.start for c in cut], pa.int64())]
            out += [pa.array([_planes(np.diff(found[c], prepend=0)) for c in cut], _PAIRS.field("pairs").type), pa.array([_planes(n[c]) for c in cut], _PAIRS.field("ns").type)]
            yield pa.RecordBatch.from_arrays(out, schema=_PAIRS)


_KEPT = pa.schema([("slice", pa.int64()), ("pair", pa.int64())])


def _frequent(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rows of pairs whose counts come to ``least``; rows come in the order of pairs, and one pair has a few rows per slice at most."""
    kept: list[np.ndarray] = []

    def judged(rows: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        total = np.add.reduceat(rows[:, 2], first)
        many = np.repeat(total >= least, np.diff(np.append(first, len(rows))))
        return pa.RecordBatch.from_arrays([pa.array(rows[many, 1]), pa.array(rows[many, 0])], schema=_KEPT)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns], 1)
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if kept and (last or kept[0][0, 0] != rows[0, 0]):
            # The last pair of the batch may go on in the next one.
            last_old = rows[:last] if last else rows[:0]
            yield judged(np.concatenate([*kept, last_old]))
            kept = [rows[last:]]
        elif last:
            yield judged(rows[:last])
            kept = [rows[last:]]
        else:
            kept.append(rows)
    if kept:
        yield judged(np.concatenate(kept))


_ASKED = pa.schema([("pair", pa.int64()), ("slice", pa.int64()), ("n", pa.int64())])
_FREQUENT = pa.schema([("slice", pa.int64()), ("m", pa.int64()), ("pairs", pa.list_(pa.binary()))])


def _part_frequent(rows: pa.Table, least: int) -> pa.Table:
    """For each slice the pairs of one range of hashes that all slices together have ``least`` times."""
    m = rows.column("m").to_numpy()
    pair = np.concatenate([np.cumsum(_numbers(p, k)) for p, k in zip(rows.column("pairs").to_pylist(), m.tolist())])
    n = np.concatenate([_numbers(p, k) for p, k in zip(rows.column("ns").to_pylist(), m.tolist())])
    order = np.argsort(pair, kind="stable")
    asked = pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (pair, np.repeat(rows.column("slice").to_numpy(), m), n)], schema=_ASKED)
    kept = pa.Table.from_batches(_frequent([asked], least), schema=_KEPT)
    of, pair = kept.column("slice").to_numpy(), kept.column("pair").to_numpy()
    order = np.argsort(of, kind="stable")
    of, pair = of[order], pair[order]
    border = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)] if len(of) else np.zeros(1, np.int64)
    packed = [_planes(np.diff(pair[a:b], prepend=0)) for a, b in zip(border, border[1:])]
    return pa.Table.from_arrays([pa.array(of[border[:-1]]), pa.array(np.diff(border)), pa.array(packed, _FREQUENT.field("pairs").type)], schema=_FREQUENT)


def frequent_pairs(chunks: DataFrame, least: int) -> DataFrame:
    """slice, m and pairs (the differences of m sorted hashes, in planes) of the pairs of each slice that the whole corpus has ``least`` times; several rows a slice."""
    # As many ranges of hashes as there are slices: a range holds about as many pairs as a slice.
    n_parts = (chunks.agg(F.max("slice").alias("n")).first()["n"] or 0) + 1
    rows = chunks.select("slice", "lang", "over", "chunk", "n").mapInArrow(lambda b: _slice_pairs(b, n_parts, least), "part long, slice long, m long, pairs array<binary>, ns array<binary>")
    return rows.groupBy("part").applyInArrow(lambda t: _part_frequent(t, least), "slice long, m long, pairs array<binary>")


_BLOCKS = pa.schema([("slice", pa.int64()), ("block", pa.binary())])


def _blocks(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The chunks of each run of rows of one slice as one compressed block."""
    for key, rows in _runs(batches, limit):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(rows)
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=_BLOCKS)


_COUNTED = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def _spelled(part: Slice, size: int, key: np.ndarray, at: np.ndarray) -> pa.Table:
    """Counts of the phrases of ``size`` words at the positions ``at``, equal ones having equal keys."""
    _, n, one = _sums(key, part.weight[at])
    place = at[one]
    spelled = pa.array(part.vocabulary, pa.binary())
    words = [spelled.take(pa.array(part.codes[place + j])) for j in range(size)]
    phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary())) if size > 1 else words[0]
    lang = pa.array(part.langs, pa.string()).take(pa.array(part.lang[place]))
    return pa.Table.from_arrays([lang, pa.array(np.full(len(place), size, np.int32)), phrase.cast(pa.string()), pa.array(n)], schema=_COUNTED)


def _slice_phrases(blocks: pa.Table, frequent: pa.Table, most: int) -> pa.Table:
    if not blocks.num_rows:
        return _COUNTED.empty_table()
    part = Slice(pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blocks.column("block").to_pylist()]))
    width = len(part.vocabulary)
    key = part.lang * width + part.codes
    out = [_spelled(part, 1, key[part.own], np.flatnonzero(part.own))]
    pair, there = part.pairs()
    lots = [np.cumsum(_numbers(p, m)) for p, m in zip(frequent.column("pairs").to_pylist(), frequent.column("m").to_pylist())]
    known = np.unique(np.concatenate(lots)) if lots else np.zeros(0, np.int64)
    if len(known):
        spot = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        there &= known[spot] == pair
    else:
        there[:] = False
    fits = there.copy()
    for size in range(2, most + 1):
        # A longer phrase is one word more: its key is made from the shorter one's code and that word.
        code = pd.factorize(key)[0].astype(np.int64)
        follow = np.roll(part.codes, 1 - size)
        key = code * width + follow
        if size > 2:
            fits = fits & np.r_[there[size - 2 :], np.zeros(size - 2, bool)]
        at = np.flatnonzero(fits & part.own)
        out.append(_spelled(part, size, key[at], at))
    return pa.concat_tables(out)


def phrase_counts(chunks: DataFrame, least: int, most: int = MOST_WORDS) -> DataFrame:
    """lang, size, phrase and n: all words, and every phrase of two to ``most`` words that is found ``least`` times."""
    if most - 1 > OVERLAP:
        raise ValueError("a phrase has to fit a chunk's own words and the overlap")
    frequent = frequent_pairs(chunks, least)
    blocks = chunks.select("slice", "lang", "over", "chunk", "n").mapInArrow(_blocks, "slice long, block binary")
    rows = blocks.groupBy("slice").cogroup(frequent.groupBy("slice")).applyInArrow(lambda a, b: _slice_phrases(a, b, most), "lang string, size int, phrase string, n long")
    counted = rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return _stage(counted.filter((F.col("size") == 1) | (F.col("n") >= least)), "phrases")


#: floor(1,000,000 * a * a / (l * r)) without rounding: 38 digits hold counts up to 10^16; never over 1,000,000, as a <= l and a <= r.
_WIDE = "CAST({} AS DECIMAL(16,0))".format
SCORE = f"({_WIDE('a')} * {_WIDE('a')} * CAST(1000000 AS DECIMAL(7,0))) div ({_WIDE('l')} * {_WIDE('r')})"


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, mean: int = MEAN) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of two or three words of each language.

    A phrase counts if it is found ``least`` times; it goes if a longer one that holds it has ``share`` percent of its count. Of its cuts the one of lowest score counts,
    ties to the shorter first part. A null language is ``und``; null, empty and all-blank texts have no words; texts are taken whole, a very long one is a
    slice of its own. Repeated rows count each time; ids play no part. An empty table gives no rows; other columns are not read, whatever their names.
    """
    counts = phrase_counts(parse_chunks(docs, mean), least)
    words = F.split("phrase", " ")
    found = counts.filter("size > 1")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = found.select("lang", "phrase", "size", F.col("n").alias("a"), cut.alias("k"))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    firsts = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"])
    scored = scored.withColumn("score", F.expr(SCORE))
    lowest = scored.groupBy("lang", "phrase").agg(F.max("size").alias("size"), F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Every run of words inside a longer phrase, with the count of the most frequent phrase around it.
    inner = found.filter("size > 2").select("lang", "n", words.alias("w"), F.explode(F.expr("filter(flatten(transform(sequence(1, size), i -> transform(sequence(2, size - 1), s -> struct(i AS i, s AS s)))), x -> x.i + x.s - 1 <= size)")).alias("x"))
    around = inner.groupBy("lang", F.array_join(F.slice("w", F.col("x.i"), F.col("x.s")), " ").alias("phrase")).agg(F.max("n").alias("longer"))
    left = lowest.join(around, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {share} * a")
    totals = counts.filter("size = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
