"""The trie of conversation prefixes by the Euler-tour technique.

Every node of the trie has an enter and an exit arc; arcs are linked into one tour of the whole trie, the tour is list-ranked, and what a
subtree holds is the difference of two sums at the positions of its arcs.

How it stays distributed:

* A prefix is named by two 64-bit hashes: the exclusive or of the hashes of its turns, each taken with its depth. Such names are sums, so a very long
  conversation is hashed in blocks of ``BLOCK`` turns side by side.
* A node is (conv_id, depth), conv_id being its smallest member. The child with its parent's conv_id follows the enter arc; the other children come
  after it by conv_id. Links between siblings are made inside range partitions, and between partitions from one row per parent and partition.
* Ranking starts in the range partitions of (conv_id, depth): each task contracts the stretches of the tour that lie inside its partition,
  by pointer jumping on arrays. What is left is a list of stretches. While that has more than ``one_task`` elements, rounds of coin tosses splice
  out a quarter each (an element that shows heads absorbs a follower that shows tails), as joins. The rest, bounded by ``one_task``, is walked by one
  task, and the rounds are undone in reverse.
* The ids that end at a node are sorted by range; a node's digest is made from chunks, of which only nodes cut by a partition border have more than one task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.session import work_path

BLOCK = 4096
#: The tour's stretches that one task may walk; 24 bytes of weights and 32 of links each.
ONE_TASK = 1 << 16
#: Nodes of one range partition in the ranking: about 150 bytes each while its stretches are contracted.
PART_ROWS = 1 << 20
#: Ids of a digest that travel as one chunk.
CHUNK_IDS = 1 << 16
#: Characters of a text that take part in cutting the ranges; the order itself is by the whole text.
CUT = 32
EMPTY = hashlib.sha256(b"").hexdigest()


def _stage(df: DataFrame, purpose: str) -> DataFrame:
    """Written and read again: lineage ends here, and a retried task meets the same rows."""
    spark, path = df.sparkSession, work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t1 and t2 (hashes of role and text) and bytes (of the text in UTF-8) of every turn, ordered by turn, role and text.

    Rows are numbered by a range sort, so a conversation that holds a third of all rows is numbered by many tasks.
    """
    given = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = given.withColumn("cut", F.left("text", F.lit(CUT))).repartitionByRange("conv_id", "turn", "role", "cut").sortWithinPartitions("conv_id", "turn", "role", "text")
    hashed = in_order.select(
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "conv_id", F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64(F.lit(2), "text", "role").alias("t2"), F.octet_length("text").cast("long").alias("bytes"),
    )
    rows = _stage(hashed, "turns")
    pieces = rows.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row per conversation and partition that it lies in.
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(pieces, ["conv_id", "part"]).select("conv_id", (F.col("row") - F.col("first") + F.col("before") + 1).alias("pos"), "t1", "t2", "bytes")


def shared_heads(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations rebuilt so that families share their first turns: conv_id, depth, t1, t2 and bytes, with depth 0 for the conversation itself.

    Conversation c becomes the first h turns of conversation c - c % family and its own turns after its first h, h being crc32(c) % most. A base
    that is not there or has fewer than h turns gives what it has. Remainders have the sign of c.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % most
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), head.alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = _stage(convs.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("k")), "rebuilt")
    own = turns.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "t1", "t2", "bytes")
    # Of a base, fewer than ``most`` turns meet fewer than 2 * ``family`` conversations.
    heads = turns.filter((F.col("pos") < most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").filter("pos <= k").select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "bytes")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("bytes"))
    return own.unionByName(taken).unionByName(roots)


def prefix_names(turns: DataFrame) -> DataFrame:
    """Adds p1 and p2, the name of the prefix that ends with each row, and q1 and q2, that of its parent; the root's name is 0, 0."""
    # The row of depth 0 adds nothing, so that the root is the same for all.
    own = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", f"t{k}")).otherwise(F.lit(0).cast("long")).alias(f"x{k}") for k in (1, 2)]
    rows = _stage(turns.select("conv_id", "depth", F.expr(f"depth div {BLOCK}").alias("block"), *own, "bytes"), "names")
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of more than a block have blocks to add.
    before = blocks.select("conv_id", "block", F.bit_xor("b1").over(earlier).alias("b1"), F.bit_xor("b2").over(earlier).alias("b2")).filter("block > 0")
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({f"s{k}": F.bit_xor(f"x{k}").over(within) for k in (1, 2)}).join(before, ["conv_id", "block"], "left")
    name = {k: F.col(f"s{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0).cast("long"))) for k in (1, 2)}
    return summed.select("conv_id", "depth", "bytes", *[name[k].alias(f"p{k}") for k in (1, 2)], *[name[k].bitwiseXOR(F.col(f"x{k}")).alias(f"q{k}") for k in (1, 2)])


def trie_nodes(named: DataFrame) -> DataFrame:
    """One row per distinct prefix: p1, p2, depth, conv_id (smallest member), parent_conv_id, n_convs and saved, what the node itself saves."""
    nodes = named.groupBy("p1", "p2", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
    )
    nodes = _stage(nodes, "nodes")
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    # All conversations that differ in their first turn have the root for a parent: it is one number and needs no join.
    top = nodes.filter("depth = 0").agg(F.max("conv_id")).scalar()
    deep = nodes.filter("depth > 1").join(parents.filter("depth > 1"), ["q1", "q2", "depth"])
    low = nodes.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, top))
    keep = ["p1", "p2", "depth", "conv_id", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")]
    return deep.select(*keep).unionByName(low.select(*keep))


def _code(depth: Column, leaving: int) -> Column:
    """An arc's place on its path: enter and exit of each depth."""
    return depth * 2 + leaving


def tour(nodes: DataFrame) -> DataFrame:
    """The nodes with the arcs that follow their enter arc (e_conv, e_code) and their exit arc (x_conv, x_code; null after the root's), n_children and leaf.

    Adds ``part``, the range partition of (conv_id, depth).
    """
    placed = _stage(nodes.repartitionByRange("conv_id", "depth").withColumn("part", F.spark_partition_id()), "placed")
    lower = placed.filter("depth > 0").select("conv_id", "depth", "part", "parent_conv_id", (F.col("depth") - 1).alias("above"), (F.col("conv_id") == F.col("parent_conv_id")).alias("same"))
    per_part = lower.groupBy("parent_conv_id", "above", "part").agg(
        F.count(F.lit(1)).alias("n"), F.max("same").alias("same"), F.min(F.when(~F.col("same"), F.col("conv_id"))).alias("first"), F.max(F.when(~F.col("same"), F.col("conv_id"))).alias("last"),
    )
    per_part = _stage(per_part, "siblings")
    per_parent = per_part.groupBy("parent_conv_id", "above").agg(F.sum("n").alias("n_children"), F.max("same").alias("same"), F.min("first").alias("first"))
    # Siblings of one partition by a window, the last of them from the next partition's first: no window holds more than a partition, or a row per partition.
    inside = Window.partitionBy("parent_conv_id", "above", "part").orderBy("conv_id")
    across = Window.partitionBy("parent_conv_id", "above").orderBy("part")
    borders = per_part.filter("first IS NOT NULL").select("parent_conv_id", "above", "part", F.lead("first").over(across).alias("beyond"))
    light = lower.filter("NOT same").withColumn("next", F.lead("conv_id").over(inside)).join(borders, ["parent_conv_id", "above", "part"])
    following = light.select("conv_id", "depth", F.coalesce("next", "beyond").alias("sibling"))
    # A child on its parent's own path is followed by the parent's first other child.
    on_path = per_parent.filter("same").select(F.col("parent_conv_id").alias("conv_id"), (F.col("above") + 1).alias("depth"), F.col("first").alias("sibling"))
    own = per_parent.select(F.col("parent_conv_id").alias("conv_id"), F.col("above").alias("depth"), "n_children", "same", "first")
    rows = placed.join(following.unionByName(on_path), ["conv_id", "depth"], "left").join(own, ["conv_id", "depth"], "left")
    down = F.when(F.col("same"), F.col("conv_id")).otherwise(F.col("first"))
    below, beside = F.col("depth") + 1, F.col("sibling").isNotNull()
    return rows.select(
        "p1", "p2", "part", "conv_id", "depth", "parent_conv_id", "n_convs", "saved", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("leaf"),
        F.coalesce(down, "conv_id").alias("e_conv"), F.when(F.col("n_children").isNull(), _code(F.col("depth"), 1)).otherwise(_code(below, 0)).alias("e_code"),
        F.coalesce("sibling", "parent_conv_id").alias("x_conv"), F.when(beside, _code(F.col("depth"), 0)).when(F.col("depth") > 0, _code(F.col("depth") - 1, 1)).alias("x_code"),
    )


WEIGHTS = ("arcs", "leaves", "saving")
_LONGS = lambda *names: pa.schema([(n, pa.int64()) for n in names])
_HEADS = _LONGS("conv", "code", "to_conv", "to_code", *WEIGHTS)
_STRETCHED = _LONGS("conv_id", "depth", *[f"{a}_{w}" for a in "ex" for w in (*WEIGHTS, "head_conv", "head_code")], "is_head", "conv", "code", "to_conv", "to_code", *WEIGHTS)


def suffix_sums(follow: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists given by the index that follows (-1 at an end): weights summed from each element to its list's end, and that end. By pointer jumping."""
    total, ahead, end = weights.copy(), follow.copy(), np.arange(len(follow))
    while True:
        go = np.flatnonzero(ahead >= 0)
        if not len(go):
            return total, end
        at = ahead[go]
        total[go] += total[at]
        end[go] = end[at]
        ahead[go] = ahead[at]


def _columns(batches: Iterable[pa.RecordBatch], names: list[str], missing: int = -1) -> list[np.ndarray]:
    """Whole columns of longs; ``missing`` in place of a null."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return [np.zeros(0, np.int64) for _ in names]
    table = pa.Table.from_batches(held)
    return [table.column(n).fill_null(missing).to_numpy().astype(np.int64) for n in names]


def _stretch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract the parts of the tour that lie inside one range partition; rows come in the order of (conv_id, depth)."""
    conv, depth, e_conv, e_code, x_conv, x_code, leaf, saved = _columns(batches, ["conv_id", "depth", "e_conv", "e_code", "x_conv", "x_code", "leaf", "saved"])
    if not len(conv):
        return
    # Depths of one conversation follow each other without a gap, so an arc is found from its conversation's first row.
    names, first, count = np.unique(conv, return_index=True, return_counts=True)

    def index(c: np.ndarray, code: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(names, c), len(names) - 1)
        step = code // 2 - depth[first[at]]
        here = (names[at] == c) & (step >= 0) & (step < count[at]) & (code >= 0)
        return np.where(here, 2 * (first[at] + step) + code % 2, -1)

    n = len(conv)
    to_conv, to_code = np.stack([e_conv, x_conv], 1).ravel(), np.stack([e_code, x_code], 1).ravel()
    weights = np.zeros((2 * n, 3), np.int64)
    weights[:, 0] = 1
    weights[::2, 1], weights[::2, 2] = leaf, saved
    follow = index(to_conv, to_code)
    total, end = suffix_sums(follow, weights)
    is_head = np.ones(2 * n, bool)
    is_head[follow[follow >= 0]] = False
    heads = np.flatnonzero(is_head)
    head_of_end = np.full(2 * n, -1, np.int64)
    head_of_end[end[heads]] = heads
    head = head_of_end[end]
    arc_conv, arc_code = np.repeat(conv, 2), np.stack([2 * depth, 2 * depth + 1], 1).ravel()
    out = {"conv_id": conv, "depth": depth}
    # From an arc back to its stretch's head: what lies before the arc.
    for k, a in enumerate("ex"):
        before = (total[head] - total)[k::2]
        out |= {f"{a}_{w}": before[:, i] for i, w in enumerate(WEIGHTS)} | {f"{a}_head_conv": arc_conv[head[k::2]], f"{a}_head_code": arc_code[head[k::2]]}
    size = 1 << 16
    blank = lambda n: pa.nulls(n, pa.int64())
    for i in range(0, n, size):
        rows = {c: pa.array(v[i : i + size]) for c, v in out.items()}
        m = len(rows["conv_id"])
        yield pa.RecordBatch.from_arrays([rows[f.name] if f.name in rows else pa.array(np.zeros(m, np.int64)) if f.name == "is_head" else blank(m) for f in _STRETCHED], schema=_STRETCHED)
    last = end[heads]
    ends = to_code[last] < 0
    lists = {"is_head": np.ones(len(heads), np.int64), "conv": arc_conv[heads], "code": arc_code[heads]} | {w: total[heads, i] for i, w in enumerate(WEIGHTS)}
    arrays = {c: pa.array(v) for c, v in lists.items()} | {"to_conv": pa.array(to_conv[last], mask=ends), "to_code": pa.array(to_code[last], mask=ends)}
    yield pa.RecordBatch.from_arrays([arrays.get(f.name, blank(len(heads))) for f in _STRETCHED], schema=_STRETCHED)


_RANKED = _LONGS("conv", "code", *WEIGHTS)


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix sums of the list that is left."""
    conv, code, to_conv, to_code, *weights = _columns(batches, _HEADS.names)
    if not len(conv):
        return
    order = np.lexsort((code, conv))
    key = np.empty(len(conv), [("conv", np.int64), ("code", np.int64)])
    key["conv"], key["code"] = conv[order], code[order]
    want = np.empty(len(conv), key.dtype)
    want["conv"], want["code"] = to_conv, to_code
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    follow = np.where((key[at] == want) & (to_code >= 0), order[at], -1)
    total, _ = suffix_sums(follow, np.stack(weights, 1))
    yield pa.RecordBatch.from_arrays([pa.array(conv), pa.array(code), *[pa.array(total[:, i]) for i in range(3)]], schema=_RANKED)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} long" for f in schema)


def rank_list(heads: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """conv, code and the weights summed from each element to the end of the list.

    Rounds of coin tosses, each a join on the link, until ``one_task`` elements are left. An element that shows heads takes over a follower that shows
    tails; the follower's own follower cannot go in the same round, so a spliced element finds its sum from its follower's.
    """
    gone: list[DataFrame] = []
    while heads.count() > one_task:
        seed = len(gone)
        coin = lambda conv, code: F.xxhash64(F.lit(seed), conv, code) % 2 == 0  # noqa: B023, E731
        mates = heads.filter(~coin("conv", "code")).select(F.col("conv").alias("to_conv"), F.col("code").alias("to_code"), F.col("to_conv").alias("n_conv"), F.col("to_code").alias("n_code"), *[F.col(w).alias(f"n_{w}") for w in WEIGHTS])
        # Only links from heads to tails are joined; the list's end has no link.
        joins = F.col("to_code").isNotNull() & coin("conv", "code") & ~coin("to_conv", "to_code")
        spliced = _stage(heads.filter(joins).join(mates, ["to_conv", "to_code"]), "spliced")
        taken = spliced.select(F.col("to_conv").alias("conv"), F.col("to_code").alias("code"), F.col("n_conv").alias("to_conv"), F.col("n_code").alias("to_code"), *[F.col(f"n_{w}").alias(w) for w in WEIGHTS])
        longer = spliced.select("conv", "code", F.col("n_conv").alias("to_conv"), F.col("n_code").alias("to_code"), *[(F.col(w) + F.col(f"n_{w}")).alias(w) for w in WEIGHTS])
        rest = heads.filter(~joins).join(taken.select("conv", "code"), ["conv", "code"], "left_anti")
        heads = _stage(rest.unionByName(longer), "list")
        gone.append(taken)
    ranked = heads.repartition(1).mapInArrow(_walk, _ddl(_RANKED))
    for taken in reversed(gone):
        ranked = _stage(ranked, "ranked")
        ahead = ranked.select(F.col("conv").alias("to_conv"), F.col("code").alias("to_code"), *[F.col(w).alias(f"n_{w}") for w in WEIGHTS])
        back = taken.join(ahead, ["to_conv", "to_code"], "left").select("conv", "code", *[(F.col(w) + F.coalesce(f"n_{w}", F.lit(0))).alias(w) for w in WEIGHTS])
        ranked = ranked.unionByName(back)
    return ranked


def arc_sums(arcs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """conv_id, depth, and for the enter arc (e_) and the exit arc (x_) how many arcs, leaves and savings the tour has from there to its end."""
    parts = max(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), arcs.count() // PART_ROWS + 1)
    stretched = _stage(arcs.select("conv_id", "depth", "e_conv", "e_code", "x_conv", "x_code", "leaf", "saved").repartitionByRange(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth").mapInArrow(_stretch, _ddl(_STRETCHED)), "stretches")
    heads = _stage(stretched.filter("is_head = 1").select(*_HEADS.names), "heads")
    ranked = _stage(rank_list(heads, one_task), "ranks")
    rows = stretched.filter("is_head = 0").select("conv_id", "depth", *[f"{a}_{w}" for a in "ex" for w in (*WEIGHTS, "head_conv", "head_code")])
    for a in "ex":
        head = ranked.select(F.col("conv").alias(f"{a}_head_conv"), F.col("code").alias(f"{a}_head_code"), *[F.col(w).alias(f"_{w}") for w in WEIGHTS])
        rows = rows.join(head, [f"{a}_head_conv", f"{a}_head_code"]).withColumns({f"{a}_{w}": F.col(f"_{w}") - F.col(f"{a}_{w}") for w in WEIGHTS}).drop(*[f"_{w}" for w in WEIGHTS])
    return rows


_CHUNKS = "p1 long, p2 long, depth long, first long, digest string, ids binary"


def _chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the nodes whose ids lie wholly in this partition; the first and the last node of a partition go on as chunks."""
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("digest", pa.string()), ("ids", pa.binary())])
    kept: list[tuple] = []
    key, border, ids = None, True, []

    def close(last: bool) -> None:
        """End a node. At a border its ids go on; inside, its digest is final."""
        if border or last:
            kept.extend((*key, part[0], None, ",".join(map(str, part)).encode()) for part in ids)
        else:
            kept.append((*key, ids[0][0], _digest(ids), None))

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for p1, p2, depth, conv in zip(*columns):
            if key != (p1, p2, depth):
                if key is not None:
                    close(False)
                    border = False
                key, ids = (p1, p2, depth), [[]]
            if len(ids[-1]) >= CHUNK_IDS:
                ids.append([])
                if border:
                    # A node from before this partition may be longer than memory: its full chunks leave at once.
                    full = ids.pop(0)
                    kept.append((*key, full[0], None, ",".join(map(str, full)).encode()))
            ids[-1].append(conv)
        if kept:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in kept], schema=schema)
            kept.clear()
    if key is not None:
        close(True)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in kept], schema=schema)


def _digest(parts: list[list[int]]) -> str:
    state = hashlib.sha256()
    for k, part in enumerate(parts):
        state.update((("," if k else "") + ",".join(map(str, part))).encode())
    return state.hexdigest()


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its chunks in order; only the hash's state is held."""
    key, state = None, None
    out: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["p1"], row["p2"], row["depth"]):
                if key is not None:
                    out.append(dict(zip(("p1", "p2", "depth"), key)) | {"digest": state.hexdigest()})
                key, state = (row["p1"], row["p2"], row["depth"]), hashlib.sha256()
            else:
                state.update(b",")
            state.update(row["ids"])
    if key is not None:
        out.append(dict(zip(("p1", "p2", "depth"), key)) | {"digest": state.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()), ("digest", pa.string())]))


def end_digests(ends: DataFrame) -> DataFrame:
    """p1, p2, depth and the SHA-256 of the conv_ids that end there, ascending, joined by commas."""
    key = ["p1", "p2", "depth"]
    parts = _stage(ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(_chunked, _CHUNKS), "ends")
    cut = parts.filter("ids IS NOT NULL").repartition(*key).sortWithinPartitions(*key, "first").select(*key, "ids").mapInArrow(_joined, "p1 long, p2 long, depth long, digest string")
    return parts.filter("digest IS NOT NULL").select(*key, "digest").unionByName(cut)


def prefix_trie(turns: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """The trie of rebuilt conversations (conv_id, depth, t1, t2, bytes; a row of depth 0 for each conversation).

    One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and tour_start and tour_end, the places of
    its two arcs in the tour, from 0.
    """
    named = _stage(prefix_names(turns), "prefixes")
    arcs = _stage(tour(trie_nodes(named)), "arcs")
    sums = arc_sums(arcs, one_task)
    lengths = named.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2")).alias("end")).select("conv_id", "end.*")
    digests = end_digests(lengths)
    rows = arcs.join(sums, ["conv_id", "depth"]).join(digests, ["p1", "p2", "depth"], "left")
    all_arcs = arcs.agg((2 * F.count(F.lit(1))).alias("n")).scalar()
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("e_leaves") - F.col("x_leaves")).alias("n_leaves"), (F.col("e_saving") - F.col("x_saving")).alias("saved_tokens"),
        F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"), (all_arcs - F.col("e_arcs")).alias("tour_start"), (all_arcs - F.col("x_arcs")).alias("tour_end"),
    )


def conversation_trie(conversations: DataFrame, family: int = 5, most: int = 9, one_task: int = ONE_TASK) -> DataFrame:
    """``prefix_trie`` of ``conversations`` (conv_id, turn, role, text) after ``shared_heads``.

    Turns are ordered by ``turn``, null first, ties by role and text; a null role or text is an empty one; repeated rows are turns of their own. Rows with a null conv_id
    take no part, as no rule says how to rebuild them. A conversation may end up without turns and then ends at the root. An empty table gives no rows,
    not even a root. Other columns are not read, whatever their names. Long texts count by hash and length only.
    """
    turns = _stage(ordered_turns(conversations), "ordered")
    return prefix_trie(_stage(shared_heads(turns, family, most), "heads-shared"), one_task)
