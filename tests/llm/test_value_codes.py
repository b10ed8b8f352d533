"""Vector codes against the same rounds in plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from codeloom.llm import value_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, entry int, error string"


def brute(rows):
    kept = [r for r in rows if r[1] is not None
            and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return Counter()
    sizes = Counter(len(r[1]) for r in kept)
    n = max(sizes, key=lambda s: (sizes[s], s))
    kept = sorted((r for r in kept if len(r[1]) == n),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    most = 1 << 27
    whole = [[max(-most, min(most, math.floor(4096 * x))) for x in r[1]] for r in kept]
    parts = [[v[p * n // 8:(p + 1) * n // 8] for p in range(8)] for v in whole]
    books = [[parts[i][p] for i in range(min(16, len(kept)))] for p in range(8)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), k)
                   for k, entry in enumerate(books[p]))

    for _ in range(6):
        groups = defaultdict(list)
        for v in parts:
            for p in range(8):
                groups[p, nearest(p, v[p])[1]].append(v[p])
        for (p, k), members in groups.items():
            books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    digest = hashlib.sha256(
        ",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    best = [[nearest(p, v[p]) for p in range(8)] for v in parts]
    errors = [sum(d for d, _ in b) for b in best]
    per_label = Counter()
    for r, e in zip(kept, errors):
        per_label[r[2]] += e
    return Counter((r[0], "".join(f"{k:02x}" for _, k in b), e, per_label[r[2]], digest)
                   for r, b, e in zip(kept, best, errors))


def found(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "c", 1, "e") for r in rows], SCHEMA).repartition(3)
    result = value_codes.compressed(frame, **how)
    assert result.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return Counter(tuple(r) for r in result.collect())


def _rows(n, length, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.randint(-40, 40) / 32 for _ in range(length)], rng.choice([None, 0, 1]))
            for i in range(n)]


@pytest.mark.parametrize("block_rows", [7, 1 << 15])
def test_rounds(spark, block_rows):
    rows = _rows(300, 16)
    rows += [(1000 + i, rows[5][1], 7) for i in range(150)]  # a third of the rows is one vector
    assert found(spark, rows, block_rows=block_rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = _rows(60, 16) + [
        (200, None, 1), (201, [None] + [0.0] * 15, 1), (202, [nan] * 16, 1),
        (203, [inf] + [0.0] * 15, None), (204, [-inf] + [0.0] * 15, 2), (205, [], 1),
        (206, [0.5] * 8, 1), (None, [0.25] * 16, None), (None, [-0.0] * 16, None),
        (3, [9.0] * 16, 1), (3, [9.0] * 16, 1), (207, [3e38, -3e38] + [1e-40] * 14, 1)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [
    [], [(1, None, 1)], [(1, [1.0] * 8, None)], _rows(5, 24), _rows(40, 11), _rows(20, 3),
    [(1, [], 1), (2, [], None)],
])
def test_few_vectors_and_other_lengths(spark, rows):
    assert found(spark, rows) == brute(rows)
