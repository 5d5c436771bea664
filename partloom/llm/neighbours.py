"""Approximate nearest neighbours: robust-pruned directed graphs, one per shard of the vectors.

Vectors are dealt to shards of a fixed size by hash. In a shard, a greedy search proposes neighbours for each vector, and relaxed distance
pruning keeps those that are not much closer to a kept neighbour than to the vector itself. A query's beam search walks
the graph of every shard; the best of all shards are its neighbours. Equal vectors are one node, so copies cannot crowd out others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.session import work_path

SHARD_ROWS = 4096
QUERY_BLOCK = 512
#: Queries that share one copy of a shard; fewer copies of vectors than of queries, and a bound on the work of a task.
QUERY_LOT = 16_384
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 128
ALPHA = 1.2
#: Distances within a shard are compared in single precision, so far points are drawn in to this many times the usual distance.
FAR = 1e15
_INDEX = "dim int, shard long, node int, ids array<long>, vector array<double>, links array<int>, entry boolean"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part: no null id, vector or component, all finite, not all zero."""
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & sound).select(F.col(id_col).alias("id"), v.cast("array<double>").alias("vector")).distinct()


class Graph:
    """Neighbour lists of one shard: ``links`` is (nodes, degree), padded with -1; without ``entry``, the most central node is it.

    Vectors are compared in single precision, relative to the shard: its median is subtracted and its median distance is the unit, so
    neither an offset nor a scale costs digits, and a few far vectors do not either.
    """

    def __init__(self, points: np.ndarray, links: np.ndarray, entry: int | None = None):
        self.links = links
        # A power of two beforehand, exact, so that differences of the largest doubles are finite.
        self.centre = np.median(points * 0.25, axis=0)
        away = np.abs(points * 0.25 - self.centre).max(1)
        usual = away[away > 0]
        self.unit = max(float(np.median(usual)), np.finfo(float).tiny) if len(usual) else 1.0
        relative, far = self._relative(points)
        self.points = (relative * np.minimum(far, FAR)[:, None]).astype(np.float32)
        self.squares = (self.points**2).sum(1)
        self.entry = int(self.squares.argmin()) if entry is None else entry

    def _relative(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direction from the centre, with a largest component of at most one, and the factor that it lacks, at least one."""
        moved = vectors * 0.25 - self.centre
        with np.errstate(over="ignore"):
            far = np.minimum(np.maximum(np.abs(moved).max(1) / self.unit, 1.0), np.finfo(float).max)
        return moved / far[:, None] / self.unit, far

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """The nodes that a beam search of each query ends with, nearest first; -1 where there are fewer.

        A far query is divided by its distance, and so are its distances to all nodes: their order is the same.
        """
        relative, far = self._relative(queries)
        q, near_by = relative.astype(np.float32), (1 / far).astype(np.float32)
        rows, n = len(q), len(self.points)
        beam = min(beam, n)
        ids = np.full((rows, beam), -1, np.int64)
        dist = np.full((rows, beam), np.inf, np.float32)
        done = np.ones((rows, beam), bool)
        seen = np.zeros((rows, n), bool)
        ids[:, 0], done[:, 0] = self.entry, False
        dist[:, 0] = near_by * self.squares[self.entry] - 2 * q @ self.points[self.entry]
        seen[:, self.entry] = True
        while True:
            open_ = np.where(done, np.inf, dist)
            best = open_.argmin(1)
            active = np.flatnonzero(np.isfinite(open_[np.arange(rows), best]))
            if not len(active):
                return ids
            done[active, best[active]] = True
            near = self.links[ids[active, best[active]]]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            seen[active[:, None], np.where(near >= 0, near, self.entry)] = True
            d = near_by[active, None] * self.squares[near] - 2 * np.einsum("qd,qrd->qr", q[active], self.points[near])
            all_d = np.concatenate([dist[active], np.where(fresh, d, np.inf)], 1)
            all_i = np.concatenate([ids[active], np.where(fresh, near, -1)], 1)
            all_f = np.concatenate([done[active], ~fresh], 1)
            order = np.argsort(all_d, 1, kind="stable")[:, :beam]
            dist[active], ids[active] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
            done[active] = np.take_along_axis(all_f, order, 1)


def _prune(graph: Graph, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: take the nearest proposal, drop those that are closer to it than to the node by the factor alpha, and repeat."""
    own = graph.points[nodes]
    proposed = np.sort(proposed, 1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
    proposed[proposed == nodes[:, None]] = -1
    at = graph.points[proposed]
    d = np.where(proposed >= 0, ((at - own[:, None]) ** 2).sum(2), np.inf)
    order = np.argsort(d, 1, kind="stable")
    proposed, d = np.take_along_axis(proposed, order, 1), np.take_along_axis(d, order, 1)
    at = graph.points[proposed]
    sq = (at**2).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * at @ at.transpose(0, 2, 1)
    alive = np.isfinite(d)
    kept = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[:, k] = np.where(some, proposed[rows, first], -1)
        alive &= ~((alpha**2 * between[rows, first] <= d) & some[:, None])
        alive[rows, first] = False
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 256) -> Graph:
    """A navigable graph over distinct points; vectors enter in a fixed shuffled order, a batch at a time."""
    n = len(points)
    rng = np.random.default_rng(7)
    links = np.full((n, degree), -1, np.int64)
    if n > 1:
        links[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
        links[links == np.arange(n)[:, None]] = -1
    graph = Graph(points, links)
    for relax in (1.0, alpha):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            nodes = order[i : i + batch]
            found = graph.search(points[nodes], beam)
            links[nodes] = _prune(graph, nodes, np.concatenate([found, links[nodes]], 1), degree, relax)
            _link_back(graph, nodes, degree, relax)
    return graph


def _link_back(graph: Graph, nodes: np.ndarray, degree: int, alpha: float) -> None:
    """Every new link is proposed to its target as well; a target with too many is pruned again."""
    links = graph.links
    target = links[nodes].ravel()
    source = np.repeat(nodes, degree)[target >= 0]
    target = target[target >= 0]
    new = ~(links[target] == source[:, None]).any(1)
    target, source = target[new], source[new]
    if not len(target):
        return
    near = ((graph.points[target] - graph.points[source]) ** 2).sum(1)
    order = np.lexsort((near, target))
    target, source = target[order], source[order]
    heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
    place = np.arange(len(target)) - np.repeat(heads, np.diff(np.r_[heads, len(target)]))
    # The nearest of many proposals are enough: the rest would be pruned by them.
    target, source, place = (x[place < 2 * degree] for x in (target, source, place))
    hubs, row = np.unique(target, return_inverse=True)
    offered = np.full((len(hubs), int(place.max()) + 1), -1, np.int64)
    offered[row, place] = source
    together = np.concatenate([links[hubs], offered], 1)
    count = (together >= 0).sum(1)
    small = count <= degree
    packed = np.sort(np.where(together < 0, np.iinfo(np.int64).max, together), 1)[:, :degree]
    links[hubs[small]] = np.where(packed[small] == np.iinfo(np.int64).max, -1, packed[small])
    for part in np.array_split(np.flatnonzero(~small), max(1, -(-int((~small).sum()) // 256))):
        if len(part):
            links[hubs[part]] = _prune(graph, hubs[part], together[part], degree, alpha)


def build_index(vectors: DataFrame, copies: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per distinct vector: its shard and place there, its ``copies`` smallest ids, its links, and whether searches of the shard start at it.

    ``vectors`` come from ``usable``.
    """
    nearest = Window.partitionBy("vector").orderBy("id")
    nodes = vectors.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= copies).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    path = work_path(vectors.sparkSession, "vector-nodes")
    nodes.write.parquet(path)
    nodes = vectors.sparkSession.read.parquet(path)
    shards = max(1, -(-nodes.count() // shard_rows))
    placed = nodes.withColumns({"dim": F.size("vector"), "shard": F.pmod(F.xxhash64("vector"), F.lit(shards))})

    def build(group: pa.Table) -> pa.Table:
        points = _matrix(group["vector"], group["dim"][0].as_py())
        graph = build_graph(points)
        rows = len(points)
        links = pa.ListArray.from_arrays(np.arange(0, graph.links.size + 1, graph.links.shape[1], dtype=np.int32), graph.links.astype(np.int32).ravel())
        return pa.table(
            {
                "dim": group["dim"], "shard": group["shard"], "node": pa.array(np.arange(rows, dtype=np.int32)), "ids": group["ids"],
                "vector": group["vector"], "links": links, "entry": pa.array(np.arange(rows) == graph.entry),
            }
        )

    return placed.groupBy("dim", "shard").applyInArrow(build, _INDEX)


def _matrix(column, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _answers(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Answers for rows sorted by shard and lot, nodes before queries: a shard is loaded once, and its lot's queries stream past it."""
    key, nodes, loaded = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[c].cast(pa.int64()).to_numpy() for c in ("dim", "shard", "lot", "asks")])
        cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            part, (*mine, asks) = batch.slice(start, end - start), keys[:, start].tolist()
            if mine != key:
                key, nodes, loaded = mine, [], None
            if not asks:
                nodes.append(part)
                continue
            if loaded is None and nodes:
                loaded, nodes = _loaded(pa.Table.from_batches(nodes), mine[0]), []
            for i in range(0, part.num_rows if loaded else 0, QUERY_BLOCK):
                block = part.slice(i, QUERY_BLOCK)
                yield from _best(*loaded, block["ids"].flatten().to_numpy(), _matrix(block["vector"], mine[0]), k)


def _loaded(nodes: pa.Table, dim: int) -> tuple[Graph, np.ndarray, list[list[int]]]:
    points = _matrix(nodes["vector"], dim)
    links = _matrix(nodes["links"], -1 if not len(points) else len(nodes["links"][0])).astype(np.int64)
    entry = int(nodes["entry"].to_numpy().argmax())
    return Graph(points, links, entry), points, nodes["ids"].to_pylist()


def _best(graph: Graph, points: np.ndarray, ids: list[list[int]], asked: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    found = graph.search(vectors, max(SEARCH_BEAM, k + 1))
    q, f, s = [], [], []
    for query, vector, nodes in zip(asked.tolist(), vectors, found):
        nodes = nodes[nodes >= 0]
        score = np.sqrt(((points[nodes] - vector) ** 2).sum(1))
        best = sorted((d, v) for d, node in zip(score.tolist(), nodes.tolist()) for v in ids[node] if v != query)[:k]
        q += [query] * len(best)
        f += [v for _, v in best]
        s += [d for d, _ in best]
    yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(f, pa.int64()), "score": pa.array(s, pa.float64())})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest vectors found for each query, by Euclidean distance, ties to the smaller id.

    The query's own id is no candidate. Vectors that are null, zero, or hold null or non-finite components take no part on either side;
    repeated rows count once, and vectors of another length than the query's are no candidates. Queries go to all shards, in lots; a shard
    is of bounded size and the queries of a lot stream past it, so memory does not grow with the table. Other columns are not looked at. Offsets, scales and a few huge
    finite components cost no recall, as the search is relative to each shard. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    path = work_path(spark, "vector-index")
    build_index(usable(vectors, id_col, vector_col), k + 1, shard_rows).write.parquet(path)
    index = spark.read.parquet(path)
    asked = usable(queries, id_col, vector_col)
    lots = max(1, -(-asked.count() // QUERY_LOT))
    last = max(0, (index.agg(F.max("shard")).first()[0] or 0))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    nodes = index.withColumns({"lot": every(lots - 1), "asks": F.lit(False)})
    asking = asked.select(
        F.size("vector").alias("dim"), every(last).alias("shard"), F.lit(None).cast("int").alias("node"), F.array("id").alias("ids"), "vector",
        F.lit(None).cast("array<int>").alias("links"), F.lit(None).cast("boolean").alias("entry"),
        F.pmod(F.xxhash64("id", "vector"), F.lit(lots)).alias("lot"), F.lit(True).alias("asks"),
    )
    keys = ("dim", "shard", "lot")
    met = nodes.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys, "asks", "node")
    found = met.mapInArrow(lambda b: _answers(b, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
