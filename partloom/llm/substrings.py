"""Substring dedup: repeated windows of words, found in suffix trees that are built group by group.

1. Sampled suffixes. Every window of ``WINDOW`` words names one of its positions, the one whose next ``PREFIX`` words hash lowest, so equal windows
   name the same place. The suffixes from these places on are the ones to compare; a window is such a suffix with some words before it.
2. Prefix counts. A suffix whose first ``PREFIX`` words come once in the corpus can be in no repeat and goes.
3. Groups. The rest is dealt by prefix. A prefix with more than ``GROUP_ROWS`` suffixes is made longer, to the whole window, until
   its suffixes spread over many groups; so a group fits in memory whatever the texts share.
4. Subtrees. In a group the tree grows by one word a level, to the right of the place and to the left of it; nodes at depth ``WINDOW``, counted
   over both sides, with more than one leaf are the repeats. The first leaf stays, the windows of all others are marked.

Copies within one slice of the input are marked at once, by comparing words, and only the first goes on: a passage
that is everywhere reaches the shuffle once per slice. Words are compared as they are at the end; hashes only bring candidates together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from partloom.llm.carry import carried, restored
from partloom.llm.words import flat_words, hashes, owners, raw_texts, slices, starts, window_hashes
from partloom.session import work_path

WINDOW = 20
PREFIX = 5
GROUP_ROWS = 20_000
_PLACES = WINDOW - PREFIX + 1
_POSITION = np.uint64((1 << 28) - 1)
_NO_ID = -(1 << 63)


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each position's next ``width`` values."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        shifted = np.full(len(out), np.iinfo(np.uint64).max, np.uint64)
        shifted[: len(out) - step] = out[step:]
        out, reach = np.minimum(out, shifted), reach + step
    return out


def _slice_suffixes(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Marks of windows that come earlier in the slice, and the sampled suffixes of all others: text, place, offsets (as bits), prefix hash."""
    codes, counts, vocabulary = flat_words(texts)
    total = len(codes)
    symbols = hashes(vocabulary)[codes] if total else np.zeros(0, np.uint64)
    prefix, _ = window_hashes(symbols, counts, PREFIX)
    whole, inside = window_hashes(symbols, counts, WINDOW)
    at = np.flatnonzero(inside)
    named = (_lowest((prefix & ~_POSITION) | np.arange(total, dtype=np.uint64), _PLACES)[at] & _POSITION).astype(np.int64)
    owner = owners(counts)
    begin = starts(counts)
    place_in_text = at - begin[owner[at]]
    # The first window of the slice with the same hash, then the words themselves.
    code, distinct = pd.factorize(whole[at])
    first = np.empty(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(at))[::-1]
    first = first[code]
    copy = np.flatnonzero(first != np.arange(len(at)))
    a, b = at[first[copy]], at[copy]
    same = np.ones(len(copy), bool)
    for j in range(WINDOW):
        same &= codes[a + j] == codes[b + j]
    copy = copy[same]
    left = np.ones(len(at), bool)
    left[copy] = False
    place, offset = named[left], named[left] - at[left]
    heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    bits = np.bitwise_or.reduceat(1 << offset, heads) if len(heads) else np.zeros(0, np.int64)
    place = place[heads]
    return owner[at[copy]], place_in_text[copy], owner[place], place - begin[owner[place]], bits, prefix[place]


def _masks(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as (doc, base, bits of 32 starts from base on)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    base = start // 32 * 32
    heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (base[1:] != base[:-1])]) if len(doc) else np.zeros(0, np.int64)
    bits = np.bitwise_or.reduceat(1 << (start - base), heads) if len(heads) else np.zeros(0, np.int64)
    return doc[heads], base[heads], bits


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        doc, text = batch.column("_doc").to_numpy(), batch.column("_text").to_numpy()
        order = np.lexsort((text, doc))
        # A row that is there twice is not its own copy.
        order = order[np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(text[order]) != 0)]] if len(order) else order
        doc, text, texts = doc[order], text[order], raw_texts(batch.column("text"))
        own, start, at, place, bits, prefix = _slice_suffixes([texts[i] for i in order])
        own, base, mask = _masks(own, start)
        for rows, first, packed in ((own, pa.nulls(len(own), pa.int64()), base << 32 | mask), (at, pa.array(prefix.view(np.int64)), place << 16 | bits)):
            yield pa.RecordBatch.from_pydict({"prefix": first, "_doc": pa.array(doc[rows]), "_text": pa.array(text[rows]), "packed": pa.array(packed)})


def _contexts(batches: Iterable[pa.RecordBatch], group_rows: int) -> Iterator[pa.RecordBatch]:
    """Every counted suffix with the words of its windows: group, doc and text, first window, offsets, place of the suffix in the words, words."""
    seen = set()
    for batch in slices(batches):
        out: dict[str, list] = {k: [] for k in _CONTEXTS.names}
        columns = [batch.column(c).to_pylist() for c in ("_doc", "_text", "suffixes")]
        for doc, key, found, text in zip(*columns, raw_texts(batch.column("text"))):
            # Rows that are there twice have the same suffixes.
            if (doc, key) in seen:
                continue
            seen.add((doc, key))
            words = text.split()
            for suffix in found:
                place, bits, prefix = suffix["packed"] >> 16, suffix["packed"] & 0xFFFF, suffix["prefix"]
                if suffix["n"] <= group_rows:
                    parts = [bits]
                else:
                    parts = [1 << o for o in range(_PLACES) if bits >> o & 1]
                for part in parts:
                    low, high = (part & -part).bit_length() - 1, part.bit_length() - 1
                    joined = b" ".join(words[place - high : place - low + WINDOW])
                    branch = prefix if suffix["n"] <= group_rows else xxhash.xxh3_64_intdigest(joined, seed=low) - (1 << 63)
                    for name, value in zip(out, (branch, doc, key, place - high, part, high, joined)):
                        out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=_CONTEXTS)


_CONTEXTS = pa.schema(
    [("branch", pa.int64()), ("_doc", pa.int64()), ("_text", pa.int64()), ("base", pa.int64()), ("bits", pa.int64()), ("place", pa.int64()), ("words", pa.binary())]
)


def _levels(node: np.ndarray, codes: np.ndarray, at: np.ndarray, stop: np.ndarray, step: int, depth: int) -> list[np.ndarray]:
    """Tree nodes of all leaves by depth: a level's node is its parent and one more word; -1 past a leaf's words."""
    out, width = [node], int(codes.max(initial=0)) + 1
    for d in range(depth):
        spot = at + step * d
        on = (out[-1] >= 0) & ((spot < stop) if step > 0 else (spot >= stop))
        node = np.full(len(at), -1, np.int64)
        node[on] = pd.factorize(out[-1][on] * width + codes[spot[on]])[0]
        out.append(node)
    return out


def _repeats(table: dict[str, np.ndarray], words: list[bytes]) -> pa.RecordBatch:
    """All subtrees of whole groups at once: the windows that are not the first leaf of their node."""
    codes, counts, _ = flat_words(words)
    begin, end = starts(counts)[:-1], starts(counts)[1:]
    anchor = begin + table["place"]
    root = pd.factorize(table["branch"])[0].astype(np.int64)
    right = _levels(root, codes, anchor, end, 1, WINDOW)
    left = _levels(root, codes, anchor - 1, begin, -1, _PLACES - 1)
    gone = np.zeros(len(words), np.int64)
    for offset in range(_PLACES):
        rows = np.flatnonzero(table["bits"] >> offset & 1)
        before, after = left[offset][rows], right[WINDOW - offset][rows]
        node = pd.factorize(before * (int(after.max(initial=0)) + 1) + after)[0]
        doc, text, start = table["_doc"][rows], table["_text"][rows], table["base"][rows] + table["place"][rows] - offset
        order = np.lexsort((start, text, doc, node))
        lead = np.r_[True, node[order][1:] != node[order][:-1]] if len(order) else np.zeros(0, bool)
        first = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))] if len(order) else order
        later = (doc[order] != doc[first]) | (text[order] != text[first]) | (start[order] != start[first])
        chosen = rows[order[later]]
        gone[chosen] |= 1 << (table["place"][chosen] - offset)
    hit = np.flatnonzero(gone)
    return pa.RecordBatch.from_pydict({"_doc": pa.array(table["_doc"][hit]), "_text": pa.array(table["_text"][hit]), "base": pa.array(table["base"][hit]), "mask": pa.array(gone[hit])})


def _subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of the sorted rows; the last group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table):
        table = {k: rows[k].to_numpy() for k in ("branch", "_doc", "_text", "base", "bits", "place")}
        return _repeats(table, rows["words"].to_pylist())

    for batch in batches:
        if not batch.num_rows:
            continue
        branch = batch.column("branch").to_numpy()
        cut = int(np.searchsorted(branch, branch[-1], side="left"))
        if cut or (held and held[0].column("branch")[0].as_py() != branch[0]):
            yield done(pa.Table.from_batches([*held, batch.slice(0, cut)], batch.schema))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield done(pa.Table.from_batches(held))


def _removed(n_words: int, marks: list[dict]) -> np.ndarray:
    gone = np.zeros(n_words + 1, np.int64)
    for mark in marks:
        bits, start = mark["mask"], mark["base"]
        while bits:
            low = (bits & -bits).bit_length() - 1
            if start + low + WINDOW <= n_words:
                gone[start + low] += 1
                gone[start + low + WINDOW] -= 1
            bits &= bits - 1
    return np.cumsum(gone)[:n_words] > 0


def _cut(batches: Iterable[pa.RecordBatch], names: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, removed, digest, kept = [], [], [], []
        for text, marks in zip(raw_texts(batch.column("text")), batch.column("marks").to_pylist()):
            words = text.split()
            gone = _removed(len(words), marks) if marks else None
            left = [w for w, g in zip(words, gone.tolist()) if not g] if gone is not None else words
            n.append(len(words))
            removed.append(len(words) - len(left))
            joined = b" ".join(left)
            if with_text:
                # A text of which nothing is removed keeps its spacing.
                kept.append((joined if gone is not None and gone.any() else text).decode())
            else:
                digest.append(hashlib.sha256(joined).hexdigest())
        last = {"kept_text": pa.array(kept, pa.string())} if with_text else {"kept_sha256": pa.array(digest, pa.string())}
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64())} | last)


def _without_repeats(chosen: DataFrame, out: list[str], with_text: bool, group_rows: int) -> DataFrame:
    """The columns ``out`` of rows of doc_id, text and perhaps a struct, n_words, n_removed, and the kept text or its digest."""
    spark = chosen.sparkSession
    key = ["_doc", "_text"]
    keyed = chosen.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "_text": F.xxhash64("text")})
    path = work_path(spark, "suffixes")
    keyed.select(*key, "text").mapInArrow(_sampled, "prefix long, _doc long, _text long, packed long").write.parquet(path)
    sampled = spark.read.parquet(path)
    at_once = sampled.filter("prefix IS NULL").selectExpr(*key, "shiftright(packed, 32) AS base", f"packed & {(1 << 32) - 1}L AS mask")
    counted = sampled.filter("prefix IS NOT NULL").withColumn("n", F.count("*").over(Window.partitionBy("prefix"))).filter("n > 1")
    by_doc = counted.groupBy(*key).agg(F.collect_set(F.struct("prefix", "packed", "n")).alias("suffixes"))
    # Both joins read the same columns of the documents, so that their exchange is made once.
    contexts = keyed.join(by_doc, key).select(*key, *chosen.columns, "suffixes").mapInArrow(
        lambda b: _contexts(b, group_rows), "branch long, _doc long, _text long, base long, bits long, place long, words binary"
    )
    found = contexts.repartition("branch").sortWithinPartitions("branch").mapInArrow(_subtrees, "_doc long, _text long, base long, mask long")
    marks = at_once.unionByName(found).groupBy(*key).agg(F.collect_set(F.struct("base", "mask")).alias("marks"))
    last = "kept_text string" if with_text else "kept_sha256 string"
    schema = StructType([f for f in chosen.schema.fields if f.name in out] + StructType.fromDDL(f"n_words long, n_removed long, {last}").fields)
    return keyed.join(marks, key, "left").drop(*key).mapInArrow(lambda b: _cut(b, out, with_text), schema)


def remove_repeats(docs: DataFrame, keep_columns: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256; with ``keep_columns`` all columns of ``docs`` and kept_text in place of the digest.

    A word goes if it is in a window of ``WINDOW`` words that also starts earlier: in a smaller doc_id, or in the same document before. Windows are
    judged on the input. A null text has no words, a null doc_id counts as the smallest. Different texts under one doc_id, or under none, are
    documents of their own, the one with the smaller xxhash64 first. A row that is there twice, with the same doc_id or none and the same text, is not
    its own copy: both rows give what one would give. Columns of ``docs`` named n_words, n_removed or kept_text are replaced. An empty table gives no rows.
    """
    if not keep_columns:
        return _without_repeats(docs.select("doc_id", "text"), ["doc_id"], False, group_rows)
    chosen = carried(docs)
    return restored(_without_repeats(chosen, chosen.columns, True, group_rows), docs, more=["n_words", "n_removed", "kept_text"])


def cut_repeats(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The documents with what is left of their texts; n_chars, if there, follows it. All other columns are as they were, whatever their names and types."""
    chosen = carried(docs)
    cut = _without_repeats(chosen, chosen.columns, True, group_rows)
    return restored(cut, docs, {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")})
