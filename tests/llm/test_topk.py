"""Exact top-k search against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import topk

VECTORS = "vec_id long, embedding array<double>, label int, block long, ids string, score double"


def plain(rows, every, k):
    codes = {}
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            codes.setdefault(key, []).append([math.floor(64 * x) for x in v])
    out = []
    for key, own in codes.items():
        if key % every:
            continue
        best = {}
        for other, some in codes.items():
            values = [sum(a * b for a, b in zip(x, y, strict=True)) for x in own for y in some if len(x) == len(y)]
            if other != key and values:
                best[other] = min(max(*values, -(2**63)), 2**63 - 1)
        first = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
        out += [(key, i, other, v) for i, (other, v) in enumerate(first, 1)]
    return sorted(out)


def found(spark, rows, every=3, k=4):
    df = spark.createDataFrame([(a, b, 1, 2, "x", 0.5) for a, b in rows], VECTORS)
    got = topk.top_inner_products(df, F.col("vec_id") % every == 0, k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(n, dim, seed=0, copies=0):
    x = np.random.Generator(np.random.PCG64(seed)).normal(size=(n, dim)) / math.sqrt(dim)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(n + i, x[0].tolist()) for i in range(copies)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, monkeypatch, small):
    """A third of the rows are one vector; small blocks make many tiles and cutoffs that prune."""
    if small:
        for name, value in (("CANDIDATES", 16), ("QUERIES", 8), ("ROWS", 4)):
            monkeypatch.setattr(topk, name, value)
    rows = vectors(120, 24, copies=60)
    assert found(spark, rows) == plain(rows, 3, 4)


def test_odd_rows(spark):
    rows = [(0, [0.5, -0.25]), (3, None), (6, [None, 1.0]), (9, [float("nan"), 1.0]), (12, [float("inf"), 0.0]), (15, []), (18, []), (16, []),
            (None, [1.0, 1.0]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (4, [-3.0, 2.0]), (5, [0.0, 0.0]), (21, [0.0, 0.0]), (24, [1.0]), (25, [2.0, 2.0, 2.0]),
            (0, [4.0, 4.0]), (4, [9.0, 9.0]), (1, [0.5, -0.25])]
    assert found(spark, rows) == plain(rows, 3, 4)


def test_fewer_candidates_than_k_and_empty_table(spark):
    rows = vectors(4, 5)
    assert found(spark, rows, k=20) == plain(rows, 3, 20) and len(plain(rows, 3, 20)) == 6
    assert found(spark, []) == [] and found(spark, [(0, [1.0])]) == []


@pytest.mark.parametrize("scale", [1e3, 1e6, 1e9, 1e30])
def test_large_components_are_exact(spark, scale):
    """Beyond what float32, doubles and 64 bits hold."""
    rows = [(i, [x * scale for x in v]) for i, v in vectors(30, 6, seed=3)]
    assert found(spark, rows, k=3) == plain(rows, 3, 3)


def test_the_threshold_drops_candidates_and_loses_none():
    rng = np.random.Generator(np.random.PCG64(5))
    q, c = rng.integers(-30, 30, (20, 32)), rng.integers(-30, 30, (500, 32))
    lists = topk.local_scores(q, c, 900.0)
    totals = q @ c.T
    assert (sum(lists) == totals).all()
    cutoffs = np.sort(totals, axis=1)[:, -10].astype(float)
    got = list(topk.collected(lists, np.arange(20), cutoffs, np.arange(1000, 1500), 10))
    for i, (key, ids, scores) in enumerate(got):
        order = np.lexsort((np.arange(500), -totals[i]))[:10]
        assert key == i and ids.tolist() == (order + 1000).tolist() and scores.tolist() == totals[i][order].tolist()
    few = [sum(2 * x[i] >= cutoffs[i] for x in lists) > 0 for i in range(20)]
    assert np.mean(few) < 0.2
