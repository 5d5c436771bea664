"""Words and texts of an Arrow batch as flat numpy arrays, the form that all text operators of this package work on."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BATCH_BYTES = 6 << 20
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts in UTF-8; a null counts as an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def factorized(parts: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all elements in a row, how many each list has, and the distinct elements that the codes stand for."""
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.empty(int(counts.sum()), object)
    flat[:] = list(chain.from_iterable(parts))
    codes, vocabulary = pd.factorize(flat)
    return codes.astype(np.int64), counts, vocabulary


def flat_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``factorized`` words ``[^\\x20\\x09-\\x0D]+``; bytes.split() cuts at exactly these six characters."""
    return factorized([t.split() for t in texts])


def hashes(vocabulary: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_hashes(symbols: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the ``size`` symbols from each position on, and whether they all lie in one text."""
    total = len(symbols)
    out = np.zeros(total, np.uint64)
    if total >= size:
        h = np.zeros(total - size + 1, np.uint64)
        for j in range(size):
            h = h * _ROLL + symbols[j : total - size + 1 + j]
        out[: total - size + 1] = mixed(h)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return out, left >= size


def owners(counts: np.ndarray) -> np.ndarray:
    """The list that each element belongs to."""
    return np.repeat(np.arange(len(counts)), counts)


def starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, …, then the next range: positions for gathering many slices at once."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - length, length) + np.repeat(begin, length)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each list's values; 0 for an empty list."""
    total = np.concatenate([[0], np.cumsum(values)])
    at = starts(counts)
    return total[at[1:]] - total[at[:-1]]
