"""Exact top-k search by inner product over a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, and stored in that
order, so that a run of rows is an annulus around a pivot.  For a query at distance d
from the pivot, no vector of an annulus [lo, hi] is nearer than max(lo - d, d - hi), and
inner product = (|q|^2 + |v|^2 - |q - v|^2) / 2 turns that into an upper bound of the
score.  Annuli are visited from the best bound outwards until the bound falls below the
k-th score found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carbonsplit.llm.common import cut

#: Vectors from which the pivots are chosen, and on which each query's first bound is taken.
SAMPLE_ROWS = 4096
PIVOTS = 64
#: Rows of an index partition (a task's memory), of an annulus, and queries that are sent to the tasks at a time.
PARTITION_ROWS = 1 << 16
ANNULUS_ROWS = 512
QUERY_ROWS = 4096


def scaled(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, v``: components as floor(scale * x); rows without an id or with null or non-finite components take no part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(values, width: int) -> np.ndarray:
    return np.array([np.asarray(v) for v in values], dtype=np.int64).reshape(len(values), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; by floating point where that is exact."""
    largest = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if largest * largest * max(1, a.shape[1]) < 2**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, b = rows.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T), 0))


def choose_pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Means of the sample's clusters, from the sample's first rows on."""
    pivots = sample[:n].astype(np.float64)
    for _ in range(rounds):
        nearest = distances(sample, pivots).argmin(1)
        pivots = np.stack([sample[nearest == i].mean(0) if (nearest == i).any() else pivots[i] for i in range(len(pivots))])
    return pivots


class Best:
    """The k best scores so far of each query; a score below the bound of a query cannot be among its k best."""

    def __init__(self, queries: int, k: int, bound: np.ndarray):
        self.k, self.bound = k, bound.astype(np.float64)
        self.scores = [np.zeros(0, np.int64) for _ in range(queries)]
        self.ids = [np.zeros(0, np.int64) for _ in range(queries)]

    def add(self, query: int, own: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.bound[query]) & (ids != own)
        if not good.any():
            return
        s, i = np.concatenate([self.scores[query], scores[good]]), np.concatenate([self.ids[query], ids[good]])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[query], self.ids[query] = s[order], i[order]
        if len(order) == self.k:
            self.bound[query] = max(self.bound[query], float(s[order[-1]]))


def search(query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, pivots: np.ndarray, part: pd.DataFrame, k: int) -> Best:
    """The k best of one index partition, annuli in the order of their bounds."""
    best = Best(len(queries), k, bound)
    rows, ids = _matrix(part["v"], queries.shape[1]), part["vec_id"].to_numpy()
    pivot, distance = part["pivot"].to_numpy(), part["distance"].to_numpy()
    turns = np.nonzero(np.diff(pivot))[0] + 1
    edges = sorted({0, len(part), *turns.tolist(), *(s for a, b in zip([0, *turns], [*turns, len(part)], strict=True) for s in range(a, b, ANNULUS_ROWS))})
    to_pivot = distances(queries, pivots)
    norms = (rows.astype(np.float64) ** 2).sum(1)
    query_norms = (queries.astype(np.float64) ** 2).sum(1)
    annuli = list(zip(edges[:-1], edges[1:], strict=True))
    d = to_pivot[:, [pivot[a] for a, _ in annuli]]
    low, high = np.array([distance[a] for a, _ in annuli]), np.array([distance[b - 1] for _, b in annuli])
    gap = np.maximum(0, np.maximum(low - d, d - high) - 1e-6)
    largest = np.array([norms[a:b].max() for a, b in annuli])
    # a little is added for rounding: a bound that is too high costs time, never a result
    upper = (query_norms[:, None] + largest - gap**2) / 2 * (1 + 1e-12) + 1
    for at in np.argsort(-upper.max(0), kind="stable"):
        active = np.nonzero(upper[:, at] >= best.bound)[0]
        if len(active):
            a, b = annuli[at]
            for query, scores in zip(active, products(queries[active], rows[a:b]), strict=True):
                best.add(query, query_ids[query], scores, ids[a:b])
    return best


def _nearest_pivot(pivots: np.ndarray) -> Column:
    @F.pandas_udf("pivot int, distance double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        d = distances(_matrix(vectors, pivots.shape[1]), pivots)
        at = d.argmin(1)
        return pd.DataFrame({"pivot": at.astype(np.int32), "distance": d[np.arange(len(d)), at]})

    return nearest("v")


def _found(index: DataFrame, chunk: list, sample: list, pivots: np.ndarray, k: int) -> DataFrame:
    """``number, query_id, vec_id, score``: each partition's k best for the queries of one chunk."""
    width = pivots.shape[1]
    query_ids, queries = np.array([r.vec_id for r in chunk], np.int64), _matrix([r.v for r in chunk], width)
    known_ids, known = np.array([r.vec_id for r in sample], np.int64), _matrix([r.v for r in sample], width)
    scores = products(queries, known).astype(np.float64)
    scores[query_ids[:, None] == known_ids[None, :]] = -np.inf
    # the k-th best of the sample: no worse than the k-th best of all
    bound = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(queries), -np.inf)
    shared = index.sparkSession.sparkContext.broadcast((query_ids, queries, bound, pivots))

    def searched(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        ids, rows, least, own_pivots = shared.value
        best = search(ids, rows, least, own_pivots, pd.concat(parts, ignore_index=True), k)
        for n, (s, i) in enumerate(zip(best.scores, best.ids, strict=True)):
            if len(s):
                yield pd.DataFrame({"number": n, "query_id": ids[n], "vec_id": i, "score": s})

    return index.mapInPandas(searched, "number long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query row, ties to the smaller id.

    ``queries`` tells which rows of ``vectors`` (``vec_id, embedding``) are queries; all
    rows with another id are candidates, and only vectors of equal length are compared.
    Rows without an id, and vectors that are null or hold null or non-finite components,
    take no part; repeated candidates each count; a repeated query row counts once;
    fewer than k candidates give all of them; empty tables give no rows; other columns
    do not matter.

    Pivots and first bounds come from at most ``SAMPLE_ROWS`` vectors; every vector is
    indexed.  Queries are sent to the index partitions ``QUERY_ROWS`` at a time.
    """
    spark = vectors.sparkSession
    asked_rows = scaled(vectors.filter(queries), scale).distinct().withColumn("is_query", F.lit(True))
    usable = cut(scaled(vectors, scale).withColumn("is_query", F.lit(False)).unionByName(asked_rows), "vectors")
    results = []
    for width, n in usable.filter(~F.col("is_query")).groupBy(F.size("v").alias("width")).count().orderBy("width").collect():
        own = usable.filter(F.size("v") == width)
        candidates, asked = own.filter(~F.col("is_query")).select("vec_id", "v"), own.filter("is_query").select("vec_id", "v")
        sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
        pivots = choose_pivots(_matrix([r.v for r in sample], width), min(PIVOTS, len(sample)))
        keyed = candidates.withColumn("_p", _nearest_pivot(pivots)).select("vec_id", "v", "_p.*")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / PARTITION_ROWS)) if n > ANNULUS_ROWS else 1
        # equal vectors are told apart by id, so that no partition holds more than its share
        order = ("pivot", "distance", "vec_id")
        index = cut(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order), "index")
        chunks = math.ceil(asked.count() / QUERY_ROWS)
        numbered = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, chunks))))
        for chunk in range(chunks):
            rows = numbered.filter(F.col("chunk") == chunk).collect()
            if rows:
                found = _found(index, rows, sample, pivots, k)
                place = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id"))
                results.append(cut(found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for part in results:
        out = out.unionByName(part)
    return out
