"""Token-ID files: blocks of ids as byte planes, each plane compressed with zstandard, with an index of chunks.

A file is one Parquet row group sequence of chunks. A chunk holds whole documents and is cut into blocks of ``BLOCK`` ids;
each block is transposed into planes (byte or bit), and each plane is compressed on its own. High planes of token ids
are nearly constant, so they almost vanish.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.llm.tokens import encode_all, kind_of, worker_tokenizer, worker_words
from partloom.llm.words import flat_words, ranges, raw_texts, slices, starts, sums

BLOCK = 1 << 14
CHUNK = 1 << 18
LEVEL = 3
CHUNKS = "file long, chunk long, first long, n_ids long, first_doc long, last_doc long, doc_ids array<long>, lengths array<long>, planes array<binary>"
#: Stands for a null id in the index, where ids are compared: it is the smallest of all.
NO_ID = -(1 << 63)


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of one block of unsigned 32-bit ids, least significant first: 4 byte planes or 32 bit planes."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    table = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(table[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of one block again."""
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").ravel()[:n]
    table = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
    return np.packbits(table, axis=1, bitorder="little").copy().view("<u4").ravel()


def pack(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """All compressed planes of all blocks of a chunk, block by block."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    return [squeeze.compress(p) for i in range(0, len(ids), BLOCK) for p in to_planes(ids[i : i + BLOCK], bits)]


def unpack(planes: list[bytes], n: int) -> np.ndarray:
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, "<u4")
    per = len(planes) // blocks
    expand = zstandard.ZstdDecompressor()
    raw = [expand.decompress(p) for p in planes]
    return np.concatenate([from_planes(raw[i * per : (i + 1) * per], min(BLOCK, n - i * BLOCK)) for i in range(blocks)])


def _document_ids(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """doc_ids, number of ids and flat ids of each slice, with the end id after every document."""
    for batch in slices(batches):
        texts = raw_texts(batch.column("text"))
        if kind_of(path) == "words":
            codes, counts, vocabulary = flat_words(texts)
            of_word, size = worker_words(path).ids(vocabulary)
            length = size[codes]
            n, ids = sums(length, counts) + 1, of_word[ranges(starts(size)[codes], length)]
        else:
            found = encode_all(worker_tokenizer(path), [t.decode() for t in texts], per_call=100)
            n = np.fromiter(map(len, found), np.int64, len(found)) + 1
            ids = np.fromiter((i for x in found for i in x), np.int64, int(n.sum()) - len(n))
        flat = np.full(int(n.sum()), end_id, np.int64)
        keep = np.ones(len(flat), bool)
        keep[np.cumsum(n) - 1] = False
        flat[keep] = ids
        yield batch.column("doc_id").to_pylist(), n, flat


def _write(batches: Iterable[pa.RecordBatch], path: str, end_id: int, bits: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    file, chunk, first = TaskContext.get().partitionId(), 0, 0
    kept: list[tuple[list[int], np.ndarray, np.ndarray]] = []
    held = 0

    def row():
        nonlocal chunk, first, held
        ids = np.concatenate([k[2] for k in kept]).astype("<u4")
        docs = [d for k in kept for d in k[0]]
        ends = [NO_ID if d is None else d for d in (docs[0], docs[-1])]
        out = {
            "file": [file], "chunk": [chunk], "first": [first], "n_ids": [len(ids)], "first_doc": [ends[0]], "last_doc": [ends[1]],
            "doc_ids": [docs], "lengths": [np.concatenate([k[1] for k in kept]).tolist()], "planes": [pack(ids, bits)],
        }
        chunk, first, held = chunk + 1, first + len(ids), 0
        kept.clear()
        return pa.RecordBatch.from_pydict(out, schema=_ARROW)

    for docs, n, flat in _document_ids(batches, path, end_id):
        at, ends = starts(n), np.cumsum(n)
        i = 0
        while i < len(docs):
            # The documents that fill the chunk; one that is larger than a chunk is a chunk of its own.
            j = max(i + 1, int(np.searchsorted(ends, at[i] + CHUNK - held, side="right")))
            kept.append((docs[i:j], n[i:j], flat[at[i] : at[j]]))
            held += int(at[j] - at[i])
            i = j
            if held >= CHUNK or i < len(docs):
                yield row()
    if kept:
        yield row()


_ARROW = pa.schema(
    [
        ("file", pa.int64()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
    ]
)


def write_token_files(docs: DataFrame, tokenizer: str, out: str, end_id: int = 2, bits: bool = False) -> None:
    """Encode every whole text and write its ids, with ``end_id`` after each, to ``out`` in ascending doc_id order.

    Documents are range-partitioned by doc_id, so file k holds smaller ids than file k+1; nulls in doc_id come first. Equal doc_ids, nulls too, are ordered by a hash of
    their texts and may lie in several files, so that an id with a third of all rows is no single task. A null or empty text is written as its end id; a text longer than
    a chunk is a chunk of its own; repeated rows are written each time; an empty table gives no chunks. Other columns are not written, whatever their names. Spark's
    writer commits the files, so a task that is run again leaves no second copy.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("mix"))
    # A number of files that is asked for stays, however small they are.
    n_files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n_files, "doc_id", "mix").sortWithinPartitions("doc_id", "mix", "text").select("doc_id", "text")
    ordered.mapInArrow(lambda b: _write(b, tokenizer, end_id, bits), CHUNKS).write.mode("overwrite").option("compression", "uncompressed").parquet(out)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, n = unpack(row["planes"], row["n_ids"]), np.array(row["lengths"], np.int64)
            at = starts(n)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_pydict(
                {
                    "file": pa.array(np.full(len(n), row["file"])), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "within": pa.array(row["first"] + at[:-1]), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64()),
                }
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    # One row per file: the window without a key sees as many rows as there are files.
    totals = chunks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = chunks.mapInArrow(_read, "file long, doc_id long, within long, n_tokens long, ids_crc32 long")
    # How to join is left to the optimizer: there is one row per file, and files grow with the input.
    return rows.join(offsets, "file").select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """doc_id and the ids themselves; of one document, only the chunks whose index says that it may be there are read."""

    def ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, flat = starts(np.array(row["lengths"], np.int64)), unpack(row["planes"], row["n_ids"]).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": pa.array([flat[a:b] for a, b in zip(at, at[1:])], pa.list_(pa.int64()))}
                )

    chunks = spark.read.schema(CHUNKS).parquet(path)
    if doc_id is None:
        return chunks.mapInArrow(ids, "doc_id long, ids array<long>")
    near = chunks.filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    return near.mapInArrow(ids, "doc_id long, ids array<long>").filter(F.col("doc_id") == doc_id)
