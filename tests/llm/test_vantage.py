"""Vantage-point trees against all distances."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from carbonsplit.llm import vantage
from carbonsplit.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<double>, v int, shard string, score int, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], SCHEMA)


def by_hand(rows, asked, k=10):
    """``(query_id, rank, vec_id, score)`` over all usable rows."""
    good = [(i, tuple(map(float, v))) for i, v in rows if i is not None and v is not None and any(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for query, q in sorted({r for r in good if asked(r[0])}):
        others = [(float(vantage.distances(np.array(q), np.array(v))), i) for i, v in good if i != query and len(v) == len(q)]
        out += [(query, n, i, d) for n, (d, i) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


def clusters(n, width, seed):
    choose = np.random.default_rng(seed)
    centres = choose.normal(size=(12, width))
    return [(i, [float(np.float32(x)) for x in centres[choose.integers(12)] + 0.2 * choose.normal(size=width)]) for i in range(n)]


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD_ROWS", 100)
    monkeypatch.setattr(vantage, "QUERY_ROWS", 7)
    rows = clusters(600, 5, 1)
    # equal vectors, among them a query's own, in every shard
    rows += [(1000 + i, rows[40][1]) for i in range(150)]
    got = vantage.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, factor=1.0, leaf=4).collect()
    assert sorted(map(tuple, got)) == by_hand(rows, lambda i: i % 20 == 0)


def test_a_greater_factor_visits_less_and_misses_little():
    rows = clusters(4000, 16, 2)
    ids, points = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    found, work = {}, {}
    for factor in (1.0, vantage.FACTOR, 6.0):
        search = vantage._Search(vantage.Tree(ids, points), ids[::50], points[::50], 10, factor)
        number, near, _ = search.found()
        found[factor], work[factor] = set(zip(number.tolist(), near.tolist(), strict=True)), search.scored
    assert work[1.0] > work[vantage.FACTOR] > work[6.0] and work[vantage.FACTOR] < 0.5 * len(rows) * 80
    assert len(found[vantage.FACTOR] & found[1.0]) >= 0.97 * len(found[1.0])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 3.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0])]
    rows += [(4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (10, [1.0, 2.0, 4.0]), (20, [5.0])]
    got = vantage.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == by_hand(rows, lambda i: i % 10 == 0)
    none = vantage.nearest(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0)
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.collect() == []


def test_a_long_vector_takes_more_shards():
    assert vantage.shard_count(1000, 64, 200) == 1 and vantage.shard_count(50_000, 64, 200) == 12
    assert vantage.shard_count(10**6, 1024, 8) * vantage.SHARD_BYTES >= 10**6 * 1024 * 8


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_recall_of_the_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = {r[::2] for r in by_hand(rows, lambda i: i % 100 == 0)}
    got = {(r.query_id, r.vec_id) for r in QUERIES["op13_vantage_neighbours"](spark, FOLDER).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
