"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers (floor of SCALE times each component). A cover tree is built over each block of data
vectors and over each block of queries: a node is a centre with the radius that covers all vectors below it.
For a pair of nodes no inner product exceeds <q, x> + |q| r_x + |x| r_q + r_q r_x; a pair falls away when that
is below the worst kth score that the query node's vectors have so far. Pairs are taken best bound first, so
the kth scores rise early; leaves are scored by one matrix product. Each task keeps k rows a query; the rows
of all tasks meet by query in a window of k rows a task.

Of a cover tree's invariants these are kept: nesting (a node's centre is its first child's), separation (centres of one node's children
are more than half its radius apart, as each is the point farthest from those before) and covering (all vectors below a node
lie within its radius, which is measured, so the bounds hold whatever the tree's shape). Given up are fixed levels (radii shrink as the
data say) and, where more than BRANCHES children would be needed, as in many dimensions, the cover by half the radius: the last
children are then wider. That costs pruning, never a result.

Queries are read in blocks of at most BLOCK_QUERIES and about BLOCK_BYTES; each block makes one pass over the data and leaves its k
rows a query in the shared folder before the next is read, so neither the driver nor an executor holds more than one block,
and no join pairs queries with rows.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows without vec_id,
take no part; a query is compared with vectors of its own length; rows that repeat a vec_id and a vector are
one row; ties go to the smaller vec_id; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, new_path, stash, table

SCALE = 256
#: Rows whose vec_id this divides are queries.
QUERY_EVERY = 50
K = 5
#: Most queries, and bytes of their components, that are sent to the executors at once (one longer vector aside).
BLOCK_QUERIES, BLOCK_BYTES = 8192, 64 << 20
#: Data vectors under one tree.
BLOCK_ROWS = 4096
#: Of places that no row has taken.
NO_SCORE, NO_ID = -(1 << 62), (1 << 63) - 1
#: A node of no more vectors than this is a leaf.
LEAF = 256
#: Most children of a node.
BRANCHES = 16


class Node:
    __slots__ = ("centre", "norm", "radius", "rows", "children")

    def __init__(self, points: np.ndarray, squares: np.ndarray, rows: np.ndarray, centre: np.ndarray, distance: np.ndarray):
        """rows: numbers of points, squares: of their norms; distance: theirs from the centre."""
        self.centre, self.norm = centre, float(np.sqrt(centre @ centre))
        self.radius = float(distance.max()) * (1 + 1e-9)
        self.rows, self.children = rows, []
        if len(rows) <= LEAF or self.radius == 0:
            return
        # Children's centres: points farther than half the radius from each other (a cover); each point goes to the nearest.
        own, own_squares = points[rows], squares[rows]
        nearest, owner, centres = distance, np.zeros(len(rows), np.int64), [centre]
        while nearest.max() > self.radius / 2 and len(centres) < BRANCHES:
            new = own[int(np.argmax(nearest))]
            d = _distances(own, own_squares, new)
            owner[d < nearest] = len(centres)
            nearest = np.minimum(d, nearest)
            centres.append(new)
        if len(centres) > 1:
            groups = [np.flatnonzero(owner == k) for k in range(len(centres))]
            self.children = [Node(points, squares, rows[g], c, nearest[g]) for g, c in zip(groups, centres, strict=True) if len(g)]


def _distances(points: np.ndarray, squares: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares - 2 * (points @ centre) + centre @ centre, 0))


def cover_tree(points: np.ndarray) -> Node:
    squares = (points * points).sum(axis=1)
    return Node(points, squares, np.arange(len(points)), points[0], _distances(points, squares, points[0]))


class Best:
    """The k best (score, smaller vec_id first) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NO_SCORE, np.int64)
        self.ids = np.full((n, k), NO_ID, np.int64)
        self.worst = np.full(n, NO_SCORE, np.int64)  # the kth score

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        """scores[i, j]: of query rows[i] and data ids[j]; own: the queries' ids."""
        scores[own[:, None] == ids[None, :]] = NO_SCORE
        reach = (scores >= self.worst[rows][:, None]) & (scores > NO_SCORE)
        for i in np.flatnonzero(reach.any(axis=1)):
            r, may = rows[i], np.flatnonzero(reach[i])
            score, idx = np.concatenate((self.score[r], scores[i, may])), np.concatenate((self.ids[r], ids[may]))
            order = np.lexsort((idx, -score))[: self.k]
            self.score[r], self.ids[r] = score[order], idx[order]
            self.worst[r] = self.score[r, -1]


def dual_search(queries: np.ndarray, query_ids: np.ndarray, tree_q: Node, data: np.ndarray, data_ids: np.ndarray, tree_x: Node, best: Best) -> None:
    """Offer every data vector that can be among a query's best."""
    fq, fx = queries.astype(np.float64), data.astype(np.float64)
    # Products of integers are exact in doubles below 2^53; beyond, they are formed as integers.
    exact = float(np.abs(fq).max(initial=0)) * float(np.abs(fx).max(initial=0)) * max(1, fq.shape[1]) < 2.0**53

    def bound(q: Node, x: Node) -> float:
        """No less than any inner product of the two nodes' vectors, rounding included."""
        return float(q.centre @ x.centre) + q.norm * x.radius + x.norm * q.radius + q.radius * x.radius + 1e-9 * (1 + q.norm + q.radius) * (1 + x.norm + x.radius)

    heap, n = [(-bound(tree_q, tree_x), 0, tree_q, tree_x)], 1
    while heap:
        top, _, q, x = heapq.heappop(heap)
        if -top < best.worst[q.rows].min():
            continue
        if not q.children and not x.children:
            if exact:  # most products are below what is there already, so they are compared before they are offered
                scores = fq[q.rows] @ fx[x.rows].T
                rows = np.flatnonzero(scores.max(axis=1) >= best.worst[q.rows])
                best.offer(q.rows[rows], data_ids[x.rows], scores[rows].astype(np.int64), query_ids[q.rows[rows]])
                continue
            scores = queries[q.rows] @ data[x.rows].T
            best.offer(q.rows, data_ids[x.rows], scores, query_ids[q.rows])
            continue
        for a in q.children or [q]:
            for b in x.children or [x]:
                value = bound(a, b)
                if value >= best.worst[a.rows].min():
                    heapq.heappush(heap, (-value, n, a, b))
                    n += 1


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of long) of the rows that take part, each once."""
    whole = embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = whole.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & fine)
    return kept.select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(SCALE))).cast("long")).alias("v")).distinct()


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each length in a batch of vec_id, v."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield ids[own], flat[offsets[own][:, None] + np.arange(size)].astype(np.int64)


def search_block(data: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int = K) -> DataFrame:
    """query_id, vec_id, score: the k best of each task for a block of queries of one length."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, tree = Best(len(ids), k), cover_tree(vectors.astype(np.float64))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                for own_ids, own in _grouped(batch.slice(start, BLOCK_ROWS)):
                    if own.shape[1] == vectors.shape[1]:
                        dual_search(vectors, ids, tree, own, own_ids, cover_tree(own.astype(np.float64)), best)
        at = np.flatnonzero(best.ids.ravel() != NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[at]), pa.array(best.ids.ravel()[at]), pa.array(best.score.ravel()[at])], ["query_id", "vec_id", "score"])

    return data.mapInArrow(search, "query_id long, vec_id long, score long")


def query_blocks(data: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stated queries in blocks of bounded size, by length of vector."""
    queries = data.where(F.col("vec_id") % QUERY_EVERY == 0)
    n, size = queries.agg(F.count(F.lit(1)), F.sum(F.size("v").cast("long") * 8)).first()
    parts = max(1, -(-n // block), -(-(size or 0) // BLOCK_BYTES))
    for k in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k).toArrow().combine_chunks()
        for batch in rows.to_batches():
            yield from _grouped(batch)


def top_k(embeddings: DataFrame, k: int = K, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query."""
    spark = embeddings.sparkSession
    data = stash(integer_vectors(embeddings), "vectors")
    path, kind = new_path(spark, "scores"), "query_id long, vec_id long, score long"
    spark.createDataFrame([], kind).write.parquet(path)
    for ids, vectors in query_blocks(data, block):
        search_block(data, ids, vectors, k).write.mode("append").parquet(path)
    discard(data)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(kind).parquet(path).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
