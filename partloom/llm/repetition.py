"""Quality rules on repetition inside a text: suffix arrays with longest common prefixes over its words.

Texts of which no run of ``MIN_WORDS`` words comes twice are set aside first. The suffixes of all others in a batch are sorted together
by prefix doubling, where only suffixes that are still tied are sorted again. Words of different texts never compare equal, so no
repeat goes over two texts. The common prefix of neighbours in the order comes from the ranks of each doubling, longest first.
A suffix's longest repeat is the larger of its two common prefixes, the depth of its deepest prefix interval; the union of these
spans is the union of all maximal repeats of at least ``MIN_WORDS`` words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from partloom.llm.carry import carried, restored
from partloom.llm.words import factorized, flat_words, owners, raw_texts, slices, sums

#: A repeat has at least so many words.
MIN_WORDS = 8
#: Words in repeats of ``MIN_WORDS`` words are a part of the words in repeats of three, of which the base rules allow half. The limit is the one
#: that goes with repeated runs of 8 words in the rules of Gopher (Rae et al. 2021, table A1).
MAX_COVERED = 0.12
MAX_REPEAT = 100
#: A longer repeat may still be so much of its text: with its copy, half of what all repeats may cover.
REPEAT_SHARE = MAX_COVERED / 4
LEAST_WORDS = 50
SYMBOLS = b"#*$%&|<>"

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, "
    "longest_repeat long, base_failed boolean, kept boolean"
)


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions in the order of their suffixes, and for 1, 2, 4, … words an array that is equal where that many words are."""
    total = len(codes)
    _, inverse, count = np.unique(codes, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[inverse]
    active = np.flatnonzero(count[inverse] > 1)
    levels, length = [(1, rank.astype(np.int32))], 1
    while len(active):
        after = active + length
        follow = np.where(after < total, rank[np.minimum(after, total - 1)] + 1, 0)
        order = np.lexsort((follow, rank[active]))
        active, follow = active[order], follow[order]
        own = rank[active]
        at = np.arange(len(active))
        old = np.r_[True, own[1:] != own[:-1]]
        new = old | np.r_[True, follow[1:] != follow[:-1]]
        old_start, new_start = np.maximum.accumulate(np.where(old, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank[active] = own + new_start - old_start
        active = active[~(new & np.r_[new[1:], True])]
        length *= 2
        levels.append((length, rank.astype(np.int32)))
    order = np.empty(total, np.int64)
    order[rank] = np.arange(total)
    return order, levels


def longest_repeats(codes: np.ndarray, least: int = MIN_WORDS) -> np.ndarray:
    """For each position, the most words from it on that are also found elsewhere; 0 if fewer than ``least``."""
    total = len(codes)
    out = np.zeros(total, np.int64)
    if total < 2:
        return out
    order, levels = suffix_array(codes)
    a, b = order[:-1], order[1:]
    common = np.zeros(total - 1, np.int64)
    for length, rank in reversed(levels):
        x, y = a + common, b + common
        inside = (x < total) & (y < total)
        hit = inside & (rank[np.minimum(x, total - 1)] == rank[np.minimum(y, total - 1)])
        common += np.where(hit, length, 0)
    common[common < least] = 0
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return pd.factorize(left * (int(right.max(initial=0)) + 1) + right)[0].astype(np.int64)


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """A code for the ``size`` words from each position on, as far as the end allows."""
    codes, length = words, 1
    while length < size:
        step = min(length, size - length)
        codes = _pairs(codes[: len(words) - length - step + 1], codes[step : len(words) - length + 1]) if len(words) > length + step - 1 else codes[:0]
        length += step
    return codes


def _windows_twice(words: np.ndarray, size: int, total: int) -> np.ndarray:
    """Whether the run of ``size`` words from each position on comes twice or more."""
    out = np.zeros(total, bool)
    runs = _runs(words, size)
    if len(runs):
        out[: len(runs)] = np.bincount(runs)[runs] > 1
    return out


def _covered(reach: np.ndarray) -> np.ndarray:
    """Which positions lie in a span; ``reach`` is the length of the span that begins at each position, or 0."""
    at = np.arange(len(reach))
    return np.maximum.accumulate(np.where(reach > 0, at + reach, 0)) > at if len(reach) else np.zeros(0, bool)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    codes, counts, vocabulary = flat_words(texts)
    total, owner = len(codes), owners(counts)
    letters = np.fromiter((len(w.decode()) for w in vocabulary), np.int64, len(vocabulary))
    # Words of different texts are different symbols; a window over two texts is then found once only.
    words = pd.factorize(owner * (len(vocabulary) + 1) + codes)[0].astype(np.int64)
    repeat = _covered(np.where(_windows_twice(words, 3, total), 3, 0))
    busy = sums(_windows_twice(words, MIN_WORDS, total), counts) > 0
    chosen = busy[owner]
    longest = np.zeros(total, np.int64)
    longest[chosen] = longest_repeats(words[chosen])
    lines, line_counts, distinct = _lines(texts)
    return {
        "n_words": counts, "word_chars": sums(letters[codes], counts), "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": line_counts - _distinct_per_owner(lines, line_counts, distinct), "n_repeat_words": sums(repeat, counts),
        "covered_words": sums(_covered(longest), counts), "longest_repeat": np.array([x.max(initial=0) for x in np.split(longest, np.cumsum(counts)[:-1])], np.int64),
    }


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    codes, counts, distinct = factorized([[x for x in t.split(b"\n") if x and not x.isspace()] for t in texts])
    return codes, counts, len(distinct)


def _distinct_per_owner(codes: np.ndarray, counts: np.ndarray, distinct: int) -> np.ndarray:
    pairs = pd.unique(owners(counts) * (distinct + 1) + codes)
    return np.bincount(pairs // (distinct + 1), minlength=len(counts)).astype(np.int64)


def _rules(batches: Iterable[pa.RecordBatch], names: list[str], max_covered: float, max_repeat: int, repeat_share: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        m = measure(raw_texts(batch.column("text")))
        failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        longest = np.maximum(max_repeat, repeat_share * m["n_words"])
        kept = ~failed & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= longest)
        own = {c: batch.column(c) for c in names}
        yield pa.RecordBatch.from_pydict(own | {k: pa.array(v) for k, v in m.items()} | {"base_failed": pa.array(failed), "kept": pa.array(kept)})


def _judged(chosen: DataFrame, out: list[str], max_covered: float, max_repeat: int, repeat_share: float) -> DataFrame:
    schema = StructType([f for f in chosen.schema.fields if f.name in out] + StructType.fromDDL(MEASURES).fields)
    return chosen.mapInArrow(lambda b: _rules(b, out, max_covered, max_repeat, repeat_share), schema)


def repetition_rules(
    docs: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, keep_columns: bool = False, repeat_share: float = REPEAT_SHARE
) -> DataFrame:
    """Measures of every whole text, whether the base rules fail, and whether the document is kept.

    A document is kept if the base rules hold, repeats of at least ``MIN_WORDS`` words cover at most ``max_covered`` of its words, and the longest
    has at most ``max_repeat`` words or ``repeat_share`` of the text's words. A null or empty text has no words and fails. Repeated rows give repeated rows, an empty table an empty one.
    With ``keep_columns`` all columns of ``docs`` come first, but for those named like a measure, which are replaced; else only doc_id.
    A text is judged in one piece; a task holds a few megabytes of text, or one text.
    """
    if not keep_columns:
        return _judged(docs.select("doc_id", "text"), ["doc_id"], max_covered, max_repeat, repeat_share)
    chosen = carried(docs)
    return restored(_judged(chosen, chosen.columns, max_covered, max_repeat, repeat_share), docs, more=StructType.fromDDL(MEASURES).names)


def keep_good(docs: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, repeat_share: float = REPEAT_SHARE) -> DataFrame:
    """The documents that ``repetition_rules`` keeps, with all their columns as they were, whatever their names and types."""
    chosen = carried(docs)
    return restored(_judged(chosen, chosen.columns, max_covered, max_repeat, repeat_share).filter("kept"), docs)
