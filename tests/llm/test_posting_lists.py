"""Posting lists against all pairs: recall, scores, ties, copies, odd vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from codeloom.llm import posting_lists

SCHEMA = "vec_id long, embedding array<float>, a string, b int, lists string, shard string"


def brute(rows, every=20, k=20):
    kept = [(i, tuple(v)) for i, v, *_ in rows if i is not None and v
            and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in kept]
    length = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    kept = sorted({(i, v) for i, v in kept if len(v) == length})
    found = []
    for q, v in kept:
        if q % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q)
            found += [(q, rank, i, -s) for rank, (s, i) in enumerate(hits[:k], 1)]
    return sorted(found)


def found(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "a", 1, "l", "s") for r in rows], SCHEMA).repartition(3)
    result = posting_lists.nearest(frame, **how)
    assert result.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in result.collect())


def _whole(rng, n, length=8):
    """Vectors of small whole numbers: many ties, exact sums."""
    return [(i, [float(x) for x in rng.integers(-2, 3, length)]) for i in range(n)]


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = _whole(rng, 25)
    rows += [(100 + i, rows[3][1]) for i in range(60)]  # copies, among them queries
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = _whole(np.random.default_rng(2), 12) + [
        (20, None), (40, [0.0] * 8), (60, [None] + [1.0] * 7), (80, [nan] * 8),
        (100, [inf] * 8), (120, [1.0] * 4), (140, []), (None, [1.0] * 8), (160, [9.0] * 8),
        (160, [9.0] * 8), (160, [-9.0] * 8), (-20, [2.0] * 8), (180, [-0.0] * 7 + [1.0])]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [
    [], [(0, None)], [(0, [1.0])], [(0, [1.0]), (1, [2.0])], [(1, [1.0]), (2, [2.0])],
    [(20 * i, [1.0, 2.0]) for i in range(30)],
])
def test_few_vectors(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_recall_of_many_lists_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    points = centres[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    points *= rng.uniform(0.5, 2.0, (3000, 1))  # lengths matter for inner products
    points[1000:2000] = points[7] + 1e-3 * rng.normal(size=(1000, 24))  # a third nearly alike
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(points)]
    monkeypatch.setattr(posting_lists, "SHARD_BYTES", 8 * 24 * 90)
    want, got = brute(rows), found(spark, rows)
    assert len(got) == len(want)
    pairs = {(q, i): s for q, _, i, s in want}
    hits = [(q, i, s) for q, _, i, s in got if (q, i) in pairs]
    assert len(hits) >= 0.93 * len(want)
    assert all(math.isclose(s, pairs[q, i], rel_tol=1e-12) for q, i, s in hits)
    ranks = [(q, r) for q, r, *_ in got]
    assert ranks == [(q, r) for q in sorted({q for q, _ in ranks}) for r in range(1, 21)]


def test_graph_finds_nearest_centroids():
    rng = np.random.default_rng(4)
    centroids = rng.normal(size=(400, 16)).astype(np.float32)
    points = rng.normal(size=(300, 16)).astype(np.float32)
    lists, gaps = posting_lists.CentroidGraph(centroids).search(points, 24)
    true = ((points[:, None] - centroids[None]) ** 2).sum(-1)
    assert (np.diff(gaps, axis=1) >= 0).all()
    assert np.allclose(np.take_along_axis(true, lists, 1), gaps, atol=1e-3)
    assert (lists[:, 0] == true.argmin(axis=1)).mean() > 0.97


def test_groups_of_the_sample_are_balanced():
    points = np.random.default_rng(5).normal(size=(2000, 8)) ** 3
    centroids = posting_lists.balanced_centroids(points, 40)
    sizes = np.bincount(((points[:, None] - centroids) ** 2).sum(-1).argmin(1), minlength=40)
    assert len(centroids) == 40 and sizes.max() <= 6 * sizes.mean()
