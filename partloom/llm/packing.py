"""Best-fit packing: documents into bins of a fixed number of words, where some may not share a bin.

Documents longer than a bin are cut. The pieces are dealt to groups of a bounded size by hash, so a source or a duplicate cluster with
a third of all rows is spread over all groups, and each group is packed by itself. In a group, pieces come longest first. Bins are ordered by residual; a
bin carries the bitmap of its duplicate clusters and, for each further document of a source that a bin may hold, a bitmap of sources.
The search starts at the smallest residual that fits and goes on to the next larger one until no bit is in conflict.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.session import work_path

CAPACITY = 2048
MAX_PER_SOURCE = 2
GROUP_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = "doc_id long, piece int, start long, n_words long, bin_id long, bin_slot int, bin_start long"


def copy_cluster(text: Column) -> Column:
    """The duplicate cluster of texts that are equal but for case and white space; null for a text without words."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.md5(plain.cast("binary")))


class Bins:
    """Open bins as (residual, bin), in that order."""

    def __init__(self, capacity: int, max_per_source: int):
        self.capacity, self.open, self.clusters = capacity, [], []
        self.sources: list[list[int]] = [[] for _ in range(max_per_source)]
        self.slots: list[int] = []

    def place(self, size: int, source: int | None, cluster: int | None) -> tuple[int, int, int]:
        """Put a piece into the tightest bin without a conflict, else into a new one; returns bin, slot and start."""
        source_bit, cluster_bit = 0 if source is None else 1 << source, 0 if cluster is None else 1 << cluster
        full = self.sources[-1]
        i = bisect_left(self.open, (size, -1))
        while i < len(self.open) and (full[self.open[i][1]] & source_bit or self.clusters[self.open[i][1]] & cluster_bit):
            i += 1
        if i < len(self.open):
            residual, chosen = self.open.pop(i)
        else:
            residual, chosen = self.capacity, len(self.slots)
            self.clusters.append(0)
            self.slots.append(0)
            for plane in self.sources:
                plane.append(0)
        self.clusters[chosen] |= cluster_bit
        for plane in self.sources:
            # The first plane that lacks the bit counts this document.
            if not plane[chosen] & source_bit:
                plane[chosen] |= source_bit
                break
        slot = self.slots[chosen]
        self.slots[chosen] += 1
        if residual > size:
            insort(self.open, (residual - size, chosen))
        return chosen, slot, self.capacity - residual


def _codes(values: list) -> list[int | None]:
    """A number for each value that comes twice or more; others can be in no conflict."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    number = {v: i for i, v in enumerate(v for v, n in seen.items() if n > 1 and v is not None)}
    return [number.get(v) for v in values]


def pack_documents(
    docs: DataFrame, size: Column, source: Column, cluster: Column, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """doc_id, piece, start, n_words, bin_id, bin_slot and bin_start of every piece of every document.

    No bin holds more than ``capacity`` words, two pieces of one cluster, or more than ``max_per_source`` of one source. A null source or cluster is
    in no conflict. Documents of size 0 or null are in no bin: one row with piece 0 and null bin columns. Ties are broken by doc_id and
    piece; repeated rows are packed each. bin_id is the group times 2^32 plus the bin's number in it. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = work_path(spark, "packing")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"), source.cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    sized.write.parquet(path)
    sized = spark.read.parquet(path)
    cut = sized.filter("size > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {capacity}"))))
    pieces = cut.selectExpr("doc_id", "CAST(piece AS INT) AS piece", f"piece * {capacity} AS start", f"least(size - piece * {capacity}, {capacity}L) AS n_words", "source", "cluster")
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", "n_words"), F.lit(groups)))

    def fill(table: pa.Table) -> pa.Table:
        size, doc, piece = table["n_words"].to_numpy(), pc.fill_null(table["doc_id"], -(1 << 63)).to_numpy(), table["piece"].to_numpy()
        order = np.lexsort((piece, doc, -size))
        sources, clusters = _codes(table["source"].to_pylist()), _codes(table["cluster"].to_pylist())
        bins = Bins(capacity, max_per_source)
        placed = np.zeros((len(size), 3), np.int64)
        for i in order.tolist():
            placed[i] = bins.place(int(size[i]), sources[i], clusters[i])
        group = table["bin_group"][0].as_py()
        return table.select(["doc_id", "piece", "start", "n_words"]).append_column("bin_id", pa.array((group << 32) + placed[:, 0])).append_column(
            "bin_slot", pa.array(placed[:, 1].astype(np.int32))
        ).append_column("bin_start", pa.array(placed[:, 2]))

    packed = dealt.groupBy("bin_group").applyInArrow(fill, COLUMNS)
    empty = sized.filter("size <= 0").selectExpr("doc_id", "0 AS piece", "0L AS start", "0L AS n_words", "CAST(NULL AS BIGINT) AS bin_id", "CAST(NULL AS INT) AS bin_slot", "CAST(NULL AS BIGINT) AS bin_start")
    return packed.unionByName(empty)


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pack_documents`` by the words of ``text``, the column ``source``, and clusters of equal texts."""
    size = F.when(F.col("text").isNotNull(), F.call_function("regexp_count", F.col("text"), F.lit(WORD)))
    return pack_documents(docs, size, F.col("source"), copy_cluster(F.col("text")), capacity, max_per_source, group_rows)
