import random

import numpy as np
from postsieve.llm import common


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    links += [(5000, k) for k in range(5001, 5100)] + [(None, 3), (4, None), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_has_every_key(spark):
    keys = [k * 7919 - 10**9 for k in range(1000)] + [-(2**63), 2**63 - 1]
    bitmap = common.key_bitmap(spark.createDataFrame([(k,) for k in [*keys, None]], "k long"), "k", bits=1 << 17)
    assert len(bitmap) == 1 << 14 and common.may_occur(bitmap, np.array(keys)).all()
    others = np.random.default_rng(0).integers(-(2**62), 2**62, 10_000)
    assert common.may_occur(bitmap, others).mean() < 0.02
    assert not common.may_occur(common.key_bitmap(spark.createDataFrame([], "k long"), "k"), others).any()


def test_sums_of_counts(spark):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for v in batch.column("id").to_pylist():
                part, counts = common.count_rows(np.arange(256) * v)
                yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "counts": counts})

    found = common.summed(spark.range(10).mapInArrow(run, "part int, counts binary"), 256)
    assert found.tolist() == (np.arange(256) * 45).tolist()


def test_tasks_that_do_not_encode_drop_the_memos(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, common.ENCODERS, sys)
    assert list(common.releasing(lambda batches: batches, encodes=True)(iter([1]))) == [1] and common.ENCODERS in sys.modules
    assert list(common.releasing(lambda batches: batches)(iter([1]))) == [1] and common.ENCODERS not in sys.modules
