"""Approximate nearest neighbours by vantage-point trees.

Rows are dealt to shards by a hash of their id.  Each shard builds one tree
over the directions of its vectors (chord distance on the unit sphere, a
metric that orders like the cosine): a node holds a vantage point and splits
its vectors at the median distance; leaves hold about ``leaf`` vectors.

A query reaches a shard's leaves in the order of their lower bounds, which
follow from the triangle inequality at every vantage point on the way down: no
vector of a leaf is nearer than ``max |d(query, vantage) - shell|``.  It stops
at the first leaf with ``bound > factor * (distance of its k-th best)``.
``factor`` 1 never stops too early, so the search is exact; smaller factors
stop sooner.  Where more vectors tie with the k-th best than the search has
slots (vectors of one direction and different lengths), all that tie are
scored and the smaller ids win.  The lists of all shards are merged by (score, id).

All queries of a shard go down its tree together as matrix products, in blocks
of ``block`` queries.  Scores are cosines of the original vectors in double
precision, computed pair by pair, so equal vectors get equal scores.

Defined cases: vectors that are NULL, empty, zero, or hold NULL or non-finite
components take no part as query or candidate; vectors of different sizes are
never compared; equal vectors are kept once per tree with the ids that can
still win; ids that repeat are separate candidates, except that a query never
finds its own id; fewer candidates than k give fewer rows; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import shard_count

SHARD_BYTES = 4 << 20
LEAF = 256
#: Pruning factor of the registered query.
FACTOR = 1.0
BLOCK = 20_000
#: Rounding of the products may move a distance by 2e-7 near 0, so two by twice that.
ROUNDING = 4e-7
#: Queries with ties beyond the slots that are looked up at a time.
TIED = 64
FOUND = "query_id bigint, vec_id bigint, score double"


class Tree:
    """Vantage points of a binary tree, and of each leaf its members and the
    shells [low, high] of distances at every vantage point above it."""

    def __init__(self, x: np.ndarray, leaf: int, seed: int = 5) -> None:
        self.x = x
        self.points: list[int] = []
        self.leaves: list[np.ndarray] = []
        self.paths: list[list[tuple[int, float, float]]] = []
        rng = np.random.Generator(np.random.PCG64(seed))
        todo = [(np.arange(len(x)), [])]
        while todo:
            members, path = todo.pop()
            if len(members) <= leaf:
                self.leaves.append(members)
                self.paths.append(path)
                continue
            vantage = int(members[rng.integers(len(members))])
            d = chord(x[members] @ x[vantage])
            order = np.argpartition(d, len(d) // 2)
            self.points.append(vantage)
            for half in (order[: len(d) // 2], order[len(d) // 2 :]):
                todo.append((members[half], [*path, (len(self.points) - 1, float(d[half].min()), float(d[half].max()))]))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Lower bound of the distance of each query to each leaf."""
        at = chord(queries @ self.x[self.points].T) if self.points else np.zeros((len(queries), 0))
        out = np.zeros((len(queries), len(self.leaves)))
        for k, path in enumerate(self.paths):
            for point, low, high in path:
                d = at[:, point]
                np.maximum(out[:, k], np.maximum(d - high, low - d), out=out[:, k])
        return out

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(members, distances) of the k nearest, as far as the factor lets
        the search look; places that stay open hold member -1."""
        n = len(queries)
        best, dist = np.full((n, k), -1), np.full((n, k), np.inf)
        bound = self.bounds(queries)
        order = np.argsort(bound, axis=1, kind="stable")
        open_ = np.arange(n)
        for step in range(len(self.leaves)):
            leaf = order[open_, step]
            # rounding of the products may move a distance by 1e-7 near 0
            go = bound[open_, leaf] <= factor * dist[open_, -1] + 2e-7
            open_, leaf = open_[go], leaf[go]
            if not len(open_):
                break
            by = np.argsort(leaf, kind="stable")
            edges = np.flatnonzero(np.diff(leaf[by], prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:], strict=False):
                rows, members = open_[by[a:b]], self.leaves[leaf[by[a]]]
                d = np.concatenate([dist[rows], chord(queries[rows] @ self.x[members].T)], axis=1)
                who = np.concatenate([best[rows], np.broadcast_to(members, (len(rows), len(members)))], axis=1)
                top = np.argsort(d, axis=1, kind="stable")[:, :k]
                best[rows], dist[rows] = np.take_along_axis(who, top, 1), np.take_along_axis(d, top, 1)
        return best, dist


    def ties(self, queries: np.ndarray, dist: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all members whose distance is not above ``dist``
        by more than rounding, in the leaves that the factor lets the search look at."""
        bound, rows, members = self.bounds(queries), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, leaf in enumerate(self.leaves):
            look = np.flatnonzero(bound[:, k] <= factor * dist + ROUNDING)
            a, b = np.nonzero(chord(queries[look] @ self.x[leaf].T) <= dist[look, None] + ROUNDING)
            rows.append(look[a])
            members.append(leaf[b])
        return np.concatenate(rows), np.concatenate(members)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat, np.float64).reshape(-1, width)


def search_shard(vectors: pa.Table, queries: pa.Table, k: int, factor: float, leaf: int) -> pa.Table:
    """The k nearest of one shard's vectors for each query."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not vectors.num_rows or not queries.num_rows:
        return schema.empty_table()
    width = len(vectors.column("v")[0])
    x, q = matrix(vectors.column("v"), width), matrix(queries.column("v"), width)
    ids, q_ids = np.asarray(vectors.column("id"), np.int64), np.asarray(queries.column("id"), np.int64)
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    rows = x.view(np.dtype((np.void, x.dtype.itemsize * width))).ravel()
    _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
    by = np.argsort(inverse, kind="stable")  # ids of each distinct vector, ascending
    start = np.searchsorted(inverse[by], np.arange(len(first)))
    size = np.minimum(np.diff(np.append(start, len(by))), k + 1)  # one may be the query's own
    distinct = x[first]
    norm, q_norm = np.sqrt((distinct * distinct).sum(1)), np.sqrt((q * q).sum(1))
    tree = Tree(distinct / norm[:, None], leaf)
    # k + 1: the query's own vector may be among them; as many again for equal cosines of different vectors.
    unit = q / q_norm[:, None]
    found, dist = tree.search(unit, min(2 * (k + 1), len(distinct)), factor)
    last = np.minimum(k, found.shape[1] - 1)
    tied = (dist[:, -1] <= dist[:, last] + ROUNDING) & (found[:, -1] >= 0) & (found.shape[1] < len(distinct))
    parts = [_best(q, q_ids, distinct, q_norm, norm, np.repeat(np.flatnonzero(~tied), found.shape[1]), found[~tied].ravel(), ids, by, start, size, k)]
    for some in np.array_split(np.flatnonzero(tied), max(1, -(-int(tied.sum()) // TIED))):
        row, member = tree.ties(unit[some], dist[some, last], factor)  # all of them: the ids decide
        parts.append(_best(q, q_ids, distinct, q_norm, norm, some[row], member, ids, by, start, size, k))
    return pa.table([np.concatenate(x) for x in zip(*parts, strict=True)], schema=schema)


def _best(q, q_ids, distinct, q_norm, norm, row, member, ids, by, start, size, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """(query id, id, score) of the k best of each query's members."""
    row, member = row[member >= 0], member[member >= 0]
    score = np.empty(len(row))
    for a in range(0, len(row), 65536):  # bounds the memory of many ties
        i, j = row[a : a + 65536], member[a : a + 65536]
        score[a : a + 65536] = (q[i] * distinct[j]).sum(1) / (q_norm[i] * norm[j])
    many = size[member]
    row, score = np.repeat(row, many), np.repeat(score, many)
    place = np.repeat(start[member] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    who = ids[by[place]]
    other = who != q_ids[row]
    row, who, score = row[other], who[other], score[other]
    order = np.lexsort((who, -score, row))
    row, who, score = row[order], who[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
    top = rank < k
    return q_ids[row[top]], who[top], score[top]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, leaf: int = LEAF, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The k nearest of ``vectors`` (vec_id, embedding) for each of
    ``queries`` (vec_id, embedding): query_id, rank, vec_id, score."""

    def usable(df: DataFrame) -> DataFrame:
        v = F.transform("embedding", lambda e: e.cast("double"))
        finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        some = F.exists("v", lambda e: e != 0)
        return df.select(F.col("vec_id").cast("bigint").alias("id"), v.alias("v")).filter(finite & some & F.col("id").isNotNull())

    shards = shard_count(vectors, shard_bytes)
    asked = usable(queries)
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = usable(vectors).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = [F.size("v").alias("width"), F.col("shard"), F.col("block")]
    found = (
        held.select(*keys, "id", "v")
        .groupBy("width", "shard", "block")
        .cogroup(asked.select(*keys, "id", "v").groupBy("width", "shard", "block"))
        .applyInArrow(lambda a, b: search_shard(a, b, k, factor, leaf), FOUND)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(vectors: DataFrame, every: int = 50) -> DataFrame:
    return nearest(vectors, vectors.filter(F.col("vec_id") % every == 0))
