"""Word tables for tokenizers: a word that comes again is encoded once, and texts are assembled from the words' ids."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from partloom.llm.words import ranges, starts

#: Words remembered by one task; beyond it the table starts anew, so a task's memory is bounded.
REMEMBERED = 500_000


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file of this name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """A tokenizer of the tokenizers library that stays on its task's thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: How a text becomes pre-tokens, as the two kinds of file that have a short way say it themselves. Fixed values.
_BYTE_LEVEL = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
_LOWER_WORDS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


@lru_cache(maxsize=8)
def kind_of(path: str) -> str:
    """``bytes`` or ``words`` for files whose own description allows texts to be cut into words; ``other`` has to be given whole texts."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    # Added tokens that look at their surroundings, and models that guess, could join what is cut.
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told.get("added_tokens") or []) or told["model"].get("dropout") or told["model"]["type"] != "BPE":
        return "other"
    rules = {k: told.get(k) for k in ("normalizer", "pre_tokenizer")}
    return "bytes" if rules == _BYTE_LEVEL else "words" if rules == _LOWER_WORDS else "other"


def encode_all(tokenizer, texts: list[str], per_call: int = 20_000) -> list[list[int]]:
    out: list[list[int]] = []
    for i in range(0, len(texts), per_call):
        out += [e.ids for e in tokenizer.encode_batch_fast(texts[i : i + per_call], add_special_tokens=False)]
    return out


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()
#: Signs after a word that are a pre-token of their own.
_TAILS = frozenset(".,;:!?")
#: Letters up to here are unchanged by NFC.
_LATIN_END = "\u024f"


class WordEncoder:
    """Ids of words as the library gives them for whole texts, with a short way for plain ones.

    A word of Latin letters, perhaps with a space before and one sign after it, is one pre-token and the sign another; these go
    straight to the library's model. All else goes through the whole tokenizer.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.plain = tokenizer, tokenizer.model, {}

    def _model_ids(self, text: str) -> list[int]:
        found = self.plain.get(text)
        if found is None:
            spelled = text if text.isascii() and " " not in text else text.encode().decode("latin-1").translate(_LETTERS)
            found = self.plain[text] = [t.id for t in self.model.tokenize(spelled)]
        return found

    def __call__(self, words: list[str]) -> list[list[int]]:
        if len(self.plain) > REMEMBERED:
            self.plain = {}
        out: list = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            tail = word[-1:] if word[-1:] in _TAILS else ""
            core = word[:-1] if tail else word
            body = core[1:] if core[:1] == " " else core
            if body.isalpha() and max(body) <= _LATIN_END:
                out[i] = self._model_ids(core) + self._model_ids(tail) if tail else self._model_ids(core)
            else:
                rest.append(i)
        for i, ids in zip(rest, encode_all(self.tokenizer, [words[i] for i in rest])):
            out[i] = ids
        return out


class WordTable:
    """Ids of every word seen by this task: ``flat`` ids, with the start and number of each word's own."""

    def __init__(self, encode):
        self._encode = encode
        self._clear()

    def _clear(self) -> None:
        self.known: dict = {}
        self.flat = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def rows(self, vocabulary: np.ndarray) -> np.ndarray:
        """The row of each word, after new ones are encoded together."""
        if len(self.known) + len(vocabulary) > REMEMBERED and self.known:
            self._clear()
        known = self.known
        fresh = [w for w in vocabulary if w not in known]
        if fresh:
            ids = self._encode(fresh)
            _extend(self, ids)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
        return np.fromiter((known[w] for w in vocabulary), np.int64, len(vocabulary))

    def lengths(self, vocabulary: np.ndarray) -> np.ndarray:
        rows = self.rows(vocabulary)
        return self.length[rows]


class LowerWords:
    """Ids of words as a ``words`` file gives them, for all distinct words of a slice at once.

    Words of Latin letters, perhaps with one sign after them, are told apart by one pattern, lower-cased and cut from their signs as columns; each distinct core goes to the
    model once as long as it is remembered. All other words go through the whole tokenizer, and are remembered too.
    """

    #: Letters up to U+024F but for the one whose lower case is two characters, then at most one sign. Fixed values.
    PLAIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+[.,;:!?]?$"
    SIGNS = ".,;:!?"

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        self.cores = WordTable(lambda cores: [[t.id for t in self.model.tokenize(self._spelled(c))] for c in cores])
        self.others = WordTable(lambda words: encode_all(tokenizer, words))

    @staticmethod
    def _spelled(core: str) -> str:
        return core if core.isascii() else core.encode().decode("latin-1").translate(_LETTERS)

    def ids(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words (in UTF-8), and how many each one has."""
        text = pa.array(vocabulary, pa.binary()).cast(pa.string())
        plain = pc.match_substring_regex(text, self.PLAIN).to_numpy(zero_copy_only=False)
        length = np.zeros(len(vocabulary), np.int64)
        lower = pc.utf8_lower(text.filter(pa.array(plain)))
        core = pc.utf8_rtrim(lower, characters=self.SIGNS)
        signed = pc.less(pc.utf8_length(core), pc.utf8_length(lower)).to_numpy(zero_copy_only=False)
        coded = core.dictionary_encode()
        rows = self.cores.rows([*self.SIGNS, *coded.dictionary.to_pylist()])
        at = rows[len(self.SIGNS) + coded.indices.to_numpy()]
        sign = pc.index_in(pc.utf8_slice_codeunits(lower.filter(pa.array(signed)), -1), pa.array(list(self.SIGNS))).to_numpy()
        last = rows[sign]
        where = np.flatnonzero(plain)
        length[where] = self.cores.length[at]
        length[where[signed]] += self.cores.length[last]
        rest = np.flatnonzero(~plain)
        other = self.others.rows(text.filter(pa.array(~plain)).to_pylist())
        length[rest] = self.others.length[other]
        begin = starts(length)[:-1]
        flat = np.zeros(int(length.sum()), np.int64)
        for table, words, own, offset in ((self.cores, where, at, 0), (self.cores, where[signed], last, self.cores.length[at][signed]), (self.others, rest, other, 0)):
            flat[ranges(begin[words] + offset, table.length[own])] = table.flat[ranges(table.start[own], table.length[own])]
        return flat, length


@lru_cache(maxsize=2)
def worker_table(path: str) -> WordTable:
    """The word table of this Python worker for a ``bytes`` file: workers are used again, so that only their first task loads the tokenizer and meets all words anew."""
    return WordTable(WordEncoder(load_tokenizer(path)))


@lru_cache(maxsize=2)
def worker_words(path: str) -> LowerWords:
    """The same for a ``words`` file."""
    return LowerWords(load_tokenizer(path))


@lru_cache(maxsize=2)
def worker_tokenizer(path: str):
    """The tokenizer of this Python worker, for files without a short way."""
    return load_tokenizer(path)


def _extend(table: WordTable, ids) -> None:
    """``ids``: a list of lists, or flat ids with the number of each word's."""
    if isinstance(ids, tuple):
        flat, length = ids
    else:
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(length.sum()))
    table.start = np.concatenate([table.start, len(table.flat) + np.cumsum(length) - length])
    table.length = np.concatenate([table.length, length])
    table.flat = np.concatenate([table.flat, flat])
