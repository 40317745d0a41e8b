"""Approximate nearest neighbours: vantage-point trees per shard.

A node of a tree keeps a vantage point and the least and greatest distance to it of the
nearer and the farther half of its vectors.  By the triangle inequality no vector of a half
with distances [low, high] is nearer to a query at distance d than low - d or d - high.  A
half is left out if ``factor`` times that bound exceeds the k-th distance found so far:
factor 1 is exact, a greater one visits less and may miss some.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carbonsplit.llm.common import cut

#: How much the triangle bounds are stretched; see the README for the recall measured.
FACTOR = 2.0
#: A shard's vectors in memory at most, its rows at least if more tasks could run, and the rows of a leaf.
SHARD_BYTES = 1 << 26
SHARD_ROWS = 4096
LEAF_ROWS = 128
#: Queries that are searched together.
QUERY_ROWS = 1024
#: Vantage points tried for a node, and vectors on which they are compared.
_TRIED, _SEEN = 5, 256


class Node(NamedTuple):
    """A leaf's rows ``first`` to ``last``, or a vantage point with the distance ranges of two children."""

    first: int
    last: int
    vantage: np.ndarray | None = None
    near: tuple[float, float] = (0.0, 0.0)
    far: tuple[float, float] = (0.0, 0.0)
    children: tuple[Node, Node] | tuple[()] = ()


def distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distance of rows that belong together, components added one after another."""
    return np.sqrt(np.cumsum((rows - others) ** 2, axis=-1)[..., -1])


class Tree:
    """A vantage-point tree over the vectors of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.leaf = leaf
        choose = np.random.default_rng(len(ids))
        # places of the rows in the order of the leaves
        self.order = np.argsort(ids, kind="stable")
        rows = rows[self.order]
        self.root = self._built(rows, 0, len(rows), choose)
        self.ids, self.rows = ids[self.order], rows
        self.squares = (rows**2).sum(1)

    def _built(self, rows: np.ndarray, first: int, last: int, choose: np.random.Generator) -> Node:
        if last - first <= self.leaf:
            return Node(first, last)
        own = rows[first:last]
        tried, seen = own[choose.integers(0, len(own), _TRIED)], own[choose.integers(0, len(own), _SEEN)]
        # the point to which distances differ most
        vantage = tried[np.argmax([distances(seen, t).std() for t in tried])]
        d = distances(own, vantage)
        half = len(own) // 2
        # halves by place, so equal distances do not unbalance the tree
        by_distance = np.argsort(d, kind="stable")
        d = d[by_distance]
        rows[first:last] = own[by_distance]
        self.order[first:last] = self.order[first:last][by_distance]
        middle = first + half
        children = (self._built(rows, first, middle, choose), self._built(rows, middle, last, choose))
        return Node(first, last, vantage, (d[0], d[half - 1]), (d[half], d[-1]), children)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``query number, id, distance`` of the k nearest found of each query."""
        return _Search(self, query_ids, queries, k, factor).found()


class _Search:
    """All queries go down to their own leaf, which bounds the k-th distance, and then through the whole tree together."""

    def __init__(self, tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.tree, self.own, self.queries, self.k, self.factor = tree, query_ids, queries, k, factor
        self.squares = (queries**2).sum(1)
        self.best = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.home = np.full(len(queries), -1)
        self.scored = 0

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        everyone = np.arange(len(self.queries))
        self._descend(self.tree.root, everyone)
        self._visit(self.tree.root, everyone)
        number, place = np.nonzero(np.isfinite(self.best))
        return number, self.ids[number, place], self.best[number, place]

    def _bounds(self, node: Node, active: np.ndarray) -> list[np.ndarray]:
        d = distances(self.queries[active], node.vantage)
        return [np.maximum(np.maximum(low - d, d - high), 0) for low, high in (node.near, node.far)]

    def _descend(self, node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if not node.children:
            self.home[active] = node.first
            self._score(node, active)
            return
        near, far = self._bounds(node, active)
        self._descend(node.children[0], active[near <= far])
        self._descend(node.children[1], active[near > far])

    def _visit(self, node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if not node.children:
            self._score(node, active[self.home[active] != node.first])
            return
        for child, bound in zip(node.children, self._bounds(node, active), strict=True):
            # a little is taken off for rounding, so ties are never cut
            self._visit(child, active[self.factor * bound * (1 - 1e-9) <= self.best[active, -1]])

    def _score(self, node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        rows, queries = self.tree.rows[node.first : node.last], self.queries[active]
        self.scored += len(rows) * len(queries)
        sums = self.squares[active][:, None] + self.tree.squares[None, node.first : node.last]
        # products tell which pairs can matter; those are measured exactly
        rough = sums - 2 * (queries @ rows.T)
        q, r = np.nonzero(rough <= (self.best[active, -1] ** 2)[:, None] + 1e-9 * sums)
        number, ids = active[q], self.tree.ids[node.first + r]
        other = ids != self.own[number]
        number, ids, q, r = number[other], ids[other], q[other], r[other]
        measured = distances(queries[q], rows[r])
        touched = np.unique(number)
        number = np.concatenate([number, np.repeat(touched, self.k)])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        measured = np.concatenate([measured, self.best[touched].ravel()])
        order = np.lexsort((ids, measured, number))
        number = number[order]
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        place = np.arange(len(number)) - np.repeat(starts, np.diff(starts, append=len(number)))
        kept = place < self.k
        self.best[number[kept], place[kept]] = measured[order][kept]
        self.ids[number[kept], place[kept]] = ids[order][kept]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector that is not all zero and has only finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & some, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))


def shard_count(rows: int, width: int, tasks: int) -> int:
    """As many shards as memory needs, or as tasks can use."""
    return max(1, math.ceil(rows * width * 8 / SHARD_BYTES), min(tasks, rows // SHARD_ROWS))


def _searched(k: int, factor: float, leaf: int):
    """Builds the tree of each shard that streams by, and answers the queries that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, asked, ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(asked.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)], strict=True):
                vectors = batch.column(4).slice(a, b - a)
                rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)
                if shard[a] != at:
                    at, parts, tree = shard[a], [], None
                if not asked[a]:
                    parts.append((ids[a:b], rows))
                    continue
                if not parts and tree is None:
                    continue
                if tree is None:
                    tree = Tree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), leaf)
                    parts = []
                for c in range(0, b - a, QUERY_ROWS):
                    part = slice(a + c, min(b, a + c + QUERY_ROWS))
                    number, found, score = tree.search(ids[part], rows[c : c + QUERY_ROWS], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[part][number], keys[part][number], found, score)], names=_FOUND)

    return run


_FOUND = ["query_id", "key", "vec_id", "score"]


def nearest(vectors: DataFrame, queries: Column, k: int = 10, factor: float = FACTOR, leaf: int = LEAF_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query row by Euclidean distance, ties to the smaller id.

    ``queries`` tells which rows of ``vectors`` (``vec_id, embedding``) are queries; all
    rows with another id are candidates, and only vectors of equal length are compared.
    Rows without an id, and vectors that are null, all zero or hold null or non-finite
    components, take no part; repeated candidates each count; a repeated query row counts
    once; fewer than k candidates give all of them; empty tables give no rows; other
    columns do not matter.

    Every vector is in a tree.  Shards are drawn by a hash of the row, so equal vectors and
    ids spread over all; each answers every query, block by block as queries stream by, and
    keeps its k best.  ``factor`` 1 gives the exact result.
    """
    rows = cut(usable(vectors), "vectors").withColumn("width", F.size("v"))
    asked = rows.filter(queries).distinct().withColumn("key", F.xxhash64("v"))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one row per length of vectors
    sizes = rows.groupBy("width").count().collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    counts = {r.width: shard_count(r["count"], r.width, tasks) for r in sizes}
    shards = F.coalesce(*[F.when(F.col("width") == w, n) for w, n in counts.items()])
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), shards)
    index = rows.select("width", place.alias("shard"), F.lit(False).alias("asked"), "vec_id", F.lit(0).cast("long").alias("key"), "v")
    sent = asked.select("width", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)).alias("shard"), F.lit(True).alias("asked"), "vec_id", "key", "v")
    named = index.unionByName(sent).withColumn("shard", F.struct("width", "shard")).withColumn("number", F.xxhash64("shard"))
    total = sum(counts.values())
    order = ["number", "asked"]
    sorted_rows = named.repartition(total, "number").sortWithinPartitions(*order).select("number", "asked", "vec_id", "key", "v")
    found = sorted_rows.mapInArrow(_searched(k, factor, leaf), "query_id long, key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
