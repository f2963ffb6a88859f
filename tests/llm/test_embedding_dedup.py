"""Links between vectors against all pairs."""

import numpy as np
import pytest
from postsieve.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, cell int, links string"


def rows_of(vectors):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], None, 1, 2, "x") for i, v in vectors]


def plain(vectors):
    good = [(k, np.array(v, np.float32).astype(float)) for k, (i, v) in enumerate(vectors) if i is not None and v and None not in v]
    good = [(k, v / np.linalg.norm(v)) for k, v in good if np.isfinite(v).all() and v.any()]
    links, parent = [0] * len(vectors), list(range(len(vectors)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, v) in enumerate(good):
        for j, w in good[:a]:
            if len(v) == len(w) and v @ w >= 0.95:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(vectors):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, links[k], least.get(root(k)), i is not None and least[root(k)] == i) for k, (i, _) in enumerate(vectors)), key=repr)


@pytest.mark.parametrize("cell, slots", [(4096, 4_000_000), (7, 300)])
def test_links_and_components(spark, monkeypatch, cell, slots):
    monkeypatch.setattr(e, "SLOTS", slots)
    rng = np.random.default_rng(1)
    vectors = [(k, rng.standard_normal(32)) for k in range(300)]
    for g in range(5):
        centre = rng.standard_normal(32)
        for _ in range(20):
            vectors.append((1000 + len(vectors), centre + rng.standard_normal(32) * rng.uniform(0, 0.2)))
    vectors += [(5000 + k, vectors[310][1]) for k in range(15)]  # copies
    vectors += [(6000, vectors[310][1] * 4), (6001, None), (6002, []), (6003, [0.0] * 32), (6004, [-0.0] * 32), (6005, [float("nan")] * 32)]
    vectors += [(6006, [float("inf")] + [1.0] * 31), (6007, [None] + [1.0] * 31), (6008, [1.0]), (6009, [2.0]), (6010, [-2.0]), (None, [1.0])]
    vectors += [(6011, vectors[0][1]), (6011, vectors[1][1]), (6012, [1e30] * 3), (6013, [1e-30] * 3)]
    vectors = [(i, None if v is None else list(v)) for i, v in vectors]
    frame = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in e.dedup(frame, cell=cell).collect()), key=repr)
    want = plain(vectors)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got if g[0] != 6011] == [w[1] for w in want if w[0] != 6011]
    assert [g[2:] for g in got] == [w[2:] for w in want]
    assert sum(w[1] > 0 for w in want) > 80


def test_no_vectors(spark):
    assert e.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_at_the_threshold_itself():
    plan = e.Plan(20_000, 0.95, 0.995, e.LINES, e.COLLIDES)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = rng.standard_normal((3000, 64))
    other -= (other * x).sum(1)[:, None] * x
    other /= np.linalg.norm(other, axis=1)[:, None]
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * other
    meet = (plan.cells(x) == plan.cells(y)).any(axis=1)
    lines = plan.lines_of(64)
    count = (np.abs(x @ lines - y @ lines) <= plan.half).sum(axis=1)
    assert (meet & (count >= plan.count)).mean() > 0.985
    away = (np.abs(x[:-1] @ lines - x[1:] @ lines) <= plan.half).sum(axis=1)
    assert (away >= plan.count).mean() < 0.01
