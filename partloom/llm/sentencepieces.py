"""SentencePiece BPE in numpy: vectorised merge rounds over the flat symbols of many words at once, and decoding.

The vocabulary file is read with the sentencepiece library; encoding and decoding are done here. Every text gets one leading
word mark and every space is a word mark. No piece holds a mark after another character, so words (a run of marks and what
follows it) are independent of each other, and each distinct word is encoded once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from partloom.llm.tokens import WordTable
from partloom.llm.words import factorized, ranges, slices, starts

MARK = "▁"
_NONE = np.iinfo(np.int64).max


class Pieces:
    """Pieces, their scores as ranks, and every pair of symbols that joins into a piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = len(model)
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        normal = {names[i]: i for i in range(size) if not special[i]}
        if any(MARK in n.lstrip(MARK) for n in normal):
            raise ValueError("a piece goes over a word mark; words are not independent")
        # Symbols: the pieces, and after them characters that are only parts of pieces.
        symbols = dict(normal)
        for name in normal:
            for c in name:
                symbols.setdefault(c, size + len(symbols))
        self.width = max(symbols.values()) + 1
        self.characters = {ord(n): i for n, i in symbols.items() if len(n) == 1}
        scores = sorted({model.get_score(i) for i in normal.values()}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        pairs = [
            (symbols[n[:k]] * self.width + symbols[n[k:]], order[model.get_score(i)], i)
            for n, i in normal.items() for k in range(1, len(n)) if n[:k] in symbols and n[k:] in symbols
        ]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int64)
        self.joined = np.array([p[2] for p in pairs], np.int64)
        self.size = size
        self.text = {i: n.replace(MARK, " ").encode() for n, i in normal.items()}
        self.text |= {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.fallback = {i: c for c, i in self.characters.items() if i >= size}

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; a pair that makes no piece has the largest rank."""
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.joined[at]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and the number of each word's. A word is given without its first mark."""
        marked = [MARK + w.replace(" ", MARK) for w in words]
        counts = np.fromiter(map(len, marked), np.int64, len(marked))
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
        distinct, back = np.unique(codes, return_inverse=True)
        # A character without a symbol keeps its code point below -1 and never joins.
        table = np.array([self.characters.get(int(c), -2 - int(c)) for c in distinct], np.int64)
        symbols = table[back]
        owner = np.repeat(np.arange(len(words)), counts)
        done_symbols, done_owner = [], []
        rank, piece = self._pairs(symbols, owner)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[first, len(owner)])
            least = np.minimum.reduceat(rank, first)
            if (least == _NONE).any():
                # Compaction: words without a pair are complete and leave.
                ended = np.repeat(least == _NONE, length)
                done_symbols.append(symbols[ended])
                done_owner.append(owner[ended])
                symbols, owner, rank, piece = symbols[~ended], owner[~ended], rank[~ended], piece[~ended]
                if not len(symbols):
                    break
                open_ = least < _NONE
                least, length = least[open_], length[open_]
                first = np.cumsum(length) - length
            symbols, owner, rank, piece = self._round(symbols, owner, rank, piece, first, length, least)
        if not done_symbols:
            return np.zeros(0, np.int64), counts
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        by_word = np.argsort(owner, kind="stable")
        return self._ids(symbols[by_word], owner[by_word], len(words))

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, piece = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside], piece[inside] = self.pair(symbols[inside], symbols[inside + 1])
        return rank, piece

    def _round(self, symbols, owner, rank, piece, first, length, least):
        """Join the pairs of least rank in every word: all that do not overlap, taken from the left, where no join makes a pair that
        would have to go first; else the leftmost alone. This is the order of the queue that joins one pair at a time."""
        at = np.flatnonzero(rank == np.repeat(least, length))
        # In a run of overlapping pairs every second one is taken.
        run = np.cumsum(np.r_[True, (at[1:] != at[:-1] + 1)]) - 1
        run_start = at[np.r_[True, run[1:] != run[:-1]]] if len(at) else at
        at = at[(at - run_start[run]) % 2 == 0]
        word = owner[at]
        many = np.r_[False, word[1:] == word[:-1]] | np.r_[word[1:] == word[:-1], False]
        if many.any():
            x = at[many]
            made, limit = piece[x], rank[x]
            after = np.full(len(x), _NONE)
            ok = (x + 2 < len(symbols))
            ok[ok] = owner[x[ok] + 2] == owner[x[ok]]
            after[ok] = self.pair(made[ok], symbols[x[ok] + 2])[0]
            before = np.full(len(x), _NONE)
            ok = x > 0
            ok[ok] = owner[x[ok] - 1] == owner[x[ok]]
            left = symbols[x - 1].copy()
            # The neighbour on the left may itself have been joined a moment ago.
            joined = np.r_[False, x[1:] - 2 == x[:-1]]
            left[joined] = made[:-1][joined[1:]]
            before[ok] = self.pair(left[ok], made[ok])[0]
            bad = np.unique(owner[x[np.minimum(after, before) <= limit]])
            if len(bad):
                later = np.r_[False, word[1:] == word[:-1]]
                at = at[~(later & np.isin(word, bad))]
        symbols = symbols.copy()
        symbols[at] = piece[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, owner, rank, piece = symbols[keep], owner[keep], rank[keep], piece[keep]
        now = moved[at]
        touched = np.unique(np.r_[now, now[now > 0] - 1])
        rank[touched] = _NONE
        inner = touched[touched + 1 < len(symbols)]
        inner = inner[owner[inner] == owner[inner + 1]]
        rank[inner], piece[inner] = self.pair(symbols[inner], symbols[inner + 1])
        return symbols, owner, rank, piece

    def _ids(self, symbols: np.ndarray, owner: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the pieces of their bytes."""
        plain = (symbols >= 0) & (symbols < self.size)
        size = np.ones(len(symbols), np.int64)
        odd = np.flatnonzero(~plain)
        spelled = [chr(self.fallback[s] if s >= 0 else -2 - s).encode() for s in symbols[odd].tolist()]
        size[odd] = np.fromiter(map(len, spelled), np.int64, len(spelled))
        out = np.repeat(np.where(plain, symbols, 0), size)
        at = starts(size)[:-1]
        out[ranges(at[odd], size[odd])] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.bincount(owner, weights=size, minlength=words).astype(np.int64)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: marks are spaces, the first one goes, bytes that are no UTF-8 are replaced."""
        raw = b"".join(self.text.get(int(i), b"") for i in ids)
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def words_of(text: str) -> list[str]:
    """The words of a text, each without its first mark; a space stands for every further mark."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    fields = text.split(" ")
    if "  " not in text and text[0] != " ":
        return fields
    out, extra = [], 0
    for i, field in enumerate(fields):
        if not field and i < len(fields) - 1:
            extra += 1
        else:
            out.append(" " * extra + field)
            extra = 0
    return out


def _encoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, WordTable, np.ndarray, np.ndarray]]:
    """Each slice with the table's row of every word and the number of words of each text."""
    pieces = Pieces(path)
    table = WordTable(pieces.encode)
    table.pieces = pieces
    for batch in slices(batches):
        codes, counts, vocabulary = factorized([words_of(t or "") for t in batch.column("text").to_pylist()])
        yield batch, table, table.rows(vocabulary)[codes], counts


def _digest(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch, table, rows, counts in _encoded(batches, path):
        # The ids of each distinct word as text, and decoded; a document joins those of its words.
        distinct, back = np.unique(rows, return_inverse=True)
        spelled, decoded = [], []
        for a, n in zip(table.start[distinct].tolist(), table.length[distinct].tolist()):
            ids = table.flat[a : a + n].tolist()
            spelled.append(",".join(map(str, ids)).encode())
            decoded.append(b"".join([table.pieces.text[i] for i in ids]))
        spelled, decoded, back = np.array(spelled, object), np.array(decoded, object), back
        at = starts(counts)
        total = np.r_[0, np.cumsum(table.length[rows])]
        ids_hex, text_hex = [], []
        for a, b in zip(at, at[1:]):
            own = back[a:b]
            ids_hex.append(hashlib.sha256(b",".join(spelled[own].tolist())).hexdigest())
            raw = b"".join(decoded[own].tolist())[1:]
            text_hex.append(hashlib.sha256(raw).hexdigest())
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(total[at[1:]] - total[at[:-1]]),
                "ids_sha256": pa.array(ids_hex, pa.string()), "decoded_sha256": pa.array(text_hex, pa.string()),
            }
        )


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the ids decoded again).

    Null and empty texts have no ids and decode to an empty text. Repeated rows give repeated rows; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(
        lambda b: _digest(b, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def piece_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, table, rows, counts in _encoded(batches, path):
            flat = table.flat[ranges(table.start[rows], table.length[rows])]
            total = np.r_[0, np.cumsum(table.length[rows])][starts(counts)]
            ids = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": ids})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<long>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of ``ids``; null ids give a null text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
