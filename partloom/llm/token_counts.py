"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from partloom.llm.tokens import encode_all, kind_of, worker_table, worker_tokenizer
from partloom.llm.words import factorized, slices, starts, sums

LIMIT = 1024


def _pieces(fields: list[str]) -> list[str]:
    """The text cut before every space that stands between two characters which are no white space.

    A byte-level pre-token holds at most one leading space before letters, digits or signs, so such a space always begins a
    new one: encoding the pieces one by one gives the ids of the whole text. Runs of white space stay within a piece.
    """
    out = [fields[0]]
    for before, field in zip(fields, fields[1:]):
        if before and field and not before[-1].isspace() and not field[0].isspace():
            out.append(" " + field)
        else:
            out[-1] += " " + field
    return out


def _count(batches: Iterable[pa.RecordBatch], path: str, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=batch_bytes):
        texts = [x or "" for x in batch.column("text").to_pylist()]
        n = _word_counts(texts, path) if kind_of(path) == "bytes" else _whole_counts(texts, path)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))),
                "n_tokens": pa.array(n),
            }
        )


def _whole_counts(texts: list[str], path: str) -> np.ndarray:
    """By batch encoding of whole texts: the file's own rules say nothing on where a text may be cut."""
    return np.fromiter(map(len, encode_all(worker_tokenizer(path), texts, per_call=100)), np.int64, len(texts))


def _word_counts(texts: list[str], path: str) -> np.ndarray:
    """By words, each encoded once per worker."""
    table = worker_table(path)
    codes, counts, vocabulary = factorized([t.split(" ") for t in texts])
    # Most fields are plain words; only texts that hold another one are cut piece by piece.
    plain = np.fromiter((bool(w) and not w[0].isspace() and not w[-1].isspace() for w in vocabulary), bool, len(vocabulary))
    odd = sums(~plain[codes], counts) > 0
    first = codes[starts(counts)[:-1]]
    lengths = table.lengths(np.array([" " + w for w in vocabulary], object))
    n = sums(lengths[codes], counts)
    heads = np.unique(first)
    bare = np.zeros(len(vocabulary), np.int64)
    bare[heads] = table.lengths(vocabulary[heads])
    n += bare[first] - lengths[first]
    where = np.flatnonzero(odd)
    if len(where):
        codes, counts, vocabulary = factorized([_pieces(texts[i].split(" ")) for i in where])
        n[where] = sums(table.lengths(vocabulary)[codes], counts)
    return n


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, batch_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text, as the tokenizer file at ``path`` gives them.

    Special strings in a text are read as the library does by default. Work goes in slices of ``batch_bytes`` of text; a
    longer text is its own slice. Where the file describes itself as plain byte-level pairs, texts are cut into words at boundaries no
    token crosses; any other file is given whole texts. Null and empty texts count 0 tokens.
    Repeated rows give repeated rows, an empty table an empty one; other columns are ignored.
    """
    rows = docs.select("doc_id", "text").mapInArrow(
        lambda batches: _count(batches, path, batch_bytes), "doc_id long, n_bytes long, n_tokens long"
    )
    return rows.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {int(limit)} AS over_limit")
