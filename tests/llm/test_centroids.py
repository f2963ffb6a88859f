"""Clustering against a plain loop over all centroids with Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from postsieve.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, d int, cluster string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "i", 2, 3, "c", 4) for k, v in rows], SCHEMA).repartition(3)


def plain(rows, count=40, rounds=5, width=64):
    kept = []
    for k, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((k, [math.floor(256 * float(np.float32(x))) for x in v]))
    packed = lambda x: np.array(x, np.int64).tobytes()
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", packed(r[1])))
    centres = [x for _, x in first[:count]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for i, xs in groups.items():
            centres[i] = [sum(column) // len(xs) for column in zip(*xs, strict=True)]
    found = [(k, *nearest(x)[::-1]) for k, x in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((k, c, d, inertia[c], sum(inertia.values()), name[c]) for k, c, d in found), key=repr)


def some_rows(n=300, spread=0.3):
    dice = random.Random(3)
    centres = [[dice.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    rows = [(k, [c + dice.gauss(0, spread) for c in dice.choice(centres)]) for k in range(n)]
    rows += [(5, rows[5][1]), (6, rows[7][1]), (None, rows[8][1]), (None, [0.0] * 64), (1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 65)]
    rows += [(1004, [None] + [1.0] * 63), (1005, [float("nan")] * 64), (1006, [float("inf")] + [0.0] * 63), (-7, [-1 / 256, 1 / 256] * 32), (-8, [-0.0] * 64)]
    return rows


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_like_a_plain_loop(spark, spread):
    rows = some_rows(spread=spread)
    assert sorted(map(tuple, centroids.clustering(frame(spark, rows)).collect()), key=repr) == plain(rows)


def test_ties_and_few_vectors(spark):
    rows = [(k, [float(k % 2)] * 64) for k in range(30)] + [(k, [0.5] * 64) for k in range(30, 35)]
    assert sorted(map(tuple, centroids.clustering(frame(spark, rows)).collect()), key=repr) == plain(rows)
    assert centroids.clustering(frame(spark, [])).count() == 0
    assert centroids.clustering(frame(spark, [(1, None), (2, [1.0])])).count() == 0


def test_large_components(spark):
    rows = [(k, [3e6 * (k % 5), -2e6] * 32) for k in range(50)]
    assert sorted(map(tuple, centroids.clustering(frame(spark, rows)).collect()), key=repr) == plain(rows)


def test_bounds_save_distances(spark):
    rows = some_rows(n=600, spread=0.01)
    found, _, worked = centroids.clusters(frame(spark, rows))
    assert len(worked) == 5 and max(worked) < 0.5 * 40 * found.count()


def test_integer_distances_of_any_size():
    x, y = np.array([[1 << 40, 5]]), np.array([[-(1 << 40), 7]])
    assert centroids.squared(x, y)[0] == (1 << 82) + 4
