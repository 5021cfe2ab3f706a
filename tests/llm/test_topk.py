"""Top-k search against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchlake.llm import topk


def brute_force(rows, k, every=3):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(64 * x) for x in v]
            vectors[i] = min(vectors.get(i, q), q)
    out = []
    for q in vectors:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def sample_rows():
    draw = np.random.default_rng(4)
    rows = []
    for i in range(400):
        v = draw.normal(size=16) * draw.choice([0.05, 0.5, 3.0])
        if i % 5 == 0:
            v = np.round(v)  # ties
        rows.append((i, v.tolist()))
    # A tight cluster: high cosines take coordinate pruning.
    base = draw.normal(size=16) * 2
    rows += [(1000 + i, (base + draw.normal(size=16) * 0.05).tolist()) for i in range(60)]
    rows += [(2000 + i, [1.0] * 16) for i in range(20)] + [(i, rows[i][1]) for i in range(3)]
    rows += [(3000, None), (3003, [float("nan")] * 16), (3006, [math.inf] + [0.0] * 15), (3009, [None] * 16), (None, [1.0] * 16)]
    return rows + [(4002, []), (4005, [5.0]), (4008, [0.0] * 16), (4011, [2.0] * 20)]


@pytest.mark.parametrize("bucket_rows, query_rows", [(4096, 1024), (50, 40)])
def test_exact(spark, bucket_rows, query_rows):
    rows = sample_rows()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(frame, F.col("vec_id") % 3 == 0, 7, bucket_rows=bucket_rows, query_rows=query_rows)
    assert sorted(map(tuple, got.collect())) == brute_force(rows, 7)


def test_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (3, [-1.0]), (5, [0.5])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 3 == 0).collect()))
    assert got == [(0, 1, 5, 2048), (0, 2, 3, -4096), (3, 1, 5, -2048), (3, 2, 0, -4096)]
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(frame.limit(1), F.lit(True)).count() == 0


def test_pruning_prunes_and_loses_nothing():
    draw = np.random.default_rng(5)
    vectors = np.floor(64 * draw.normal(size=(500, 32)) * draw.uniform(0.2, 1, (500, 1)))
    vectors[:40] = np.floor(64 * (np.linspace(0.5, 2, 32) + draw.normal(size=(40, 32)) * 0.05))
    vectors = vectors[np.argsort(-np.sqrt((vectors**2).sum(axis=1)))]
    ids, counts = np.arange(500), {}
    queries = vectors[:60]
    true = queries @ vectors.T
    np.fill_diagonal(true[:, :60], -np.inf)
    thresholds = np.sort(true, axis=1)[:, -10]
    found = {q: (i.tolist(), s.tolist()) for q, i, s in topk.search_bucket(ids[:60], queries, thresholds, np.full(60, 500), ids, vectors, 10, counts)}
    for q in range(60):
        order = sorted((-true[q, i], i) for i in range(500) if true[q, i] >= thresholds[q])[:10]
        assert found[q] == ([i for _, i in order], [-s for s, _ in order])
    assert counts["left"] < 0.7 * counts["pairs"]


def test_ties_with_the_known_threshold_go_to_smaller_ids():
    one = np.ones((6, 2))
    found = list(topk.search_bucket(np.array([9]), one[:1], np.array([2.0]), np.array([4]), np.array([1, 2, 3, 4, 5, 9]), one, 5))
    assert [(q, i.tolist()) for q, i, _ in found] == [(0, [1, 2, 3])]


def test_products_beyond_doubles():
    a = np.array([[2.0**40, 1.0]])
    assert topk._products(a, np.array([[2.0**20, 3.0], [2.0**40, 0.0]])).tolist() == [[2**60 + 3, 2**63 - 1]]
