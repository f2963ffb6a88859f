"""Repeated windows against a plain count."""

import random
import time

import pyarrow as pa
import pytest
from llm_fixtures import edge_rows
from postsieve.llm import substring_dedup
from pyspark.sql import functions as F


def plain(docs, length):
    first = {}
    parted = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in parted:
        if i is not None:
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in parted:
        gone = set()
        if i is not None:
            for k in range(len(w) - length + 1):
                if first[tuple(w[k : k + length])] < i:
                    gone.update(range(k, k + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), b" ".join(kept).decode()))
    return sorted(out, key=repr)


def found(frame, **options):
    return sorted((tuple(r) for r in substring_dedup.dedup(frame, **options).collect()), key=repr)


def test_edge_documents(edge_docs):
    docs = [(r[0], r[1]) for r in edge_rows()]
    want = plain(docs, 13)
    assert found(edge_docs) == want
    assert sum(r[2] > 0 for r in want) > 5


@pytest.mark.parametrize("length, seed, chunk", [(5, 2, 300), (13, 4, 1 << 20), (4, 1, 2000)])
def test_random_documents(spark, length, seed, chunk):
    rng = random.Random(length)
    docs = [(k, " ".join(rng.choice("ab cd ef g".split()) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    docs += [(100 + k, docs[rng.randrange(60)][1]) for k in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(frame, length=length, seed=seed, chunk_bytes=chunk) == plain(docs, length)


def test_no_documents(no_docs):
    assert found(no_docs) == []


class Taken:
    """Stands for a frame and takes the function that is mapped over it."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def repartition(self, *how):
        return self

    repartitionById = repartition


def repeated_texts(n):
    rng = random.Random(n)
    texts = [b" ".join(b"%x" % rng.randrange(1 << 20) for _ in range(200)) for _ in range(n)]
    return texts + texts


def test_work_of_a_bucket_does_not_grow_with_its_rows(spark):
    """The more input, the more chunks send a row to each bucket, and the fewer strings are in each."""
    texts, packing, meeting = repeated_texts(1000), Taken(), Taken()
    ids = pa.array(range(len(texts)), pa.int64())
    documents = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts, pa.binary())], names=["doc_id", "digest", "text"])
    substring_dedup.shared_windows(meeting, 13, 1)
    seconds, results, counts = [], [], []
    for chunk in (1 << 30, 1):
        substring_dedup.packed_stretches(packing, 13, 4, 1, chunk)
        packed = list(packing.run(iter([documents])))
        counts.append(len(packed))
        began = time.process_time()
        results.append(sorted(tuple(map(str, r.values())) for b in meeting.run(iter(packed)) for r in b.to_pylist()))
        seconds.append(time.process_time() - began)
    assert counts == [1, 2000]
    assert results[0] == results[1] and len(results[0]) > 10_000
    assert seconds[1] < 2.5 * seconds[0] + 0.5, seconds


@pytest.mark.parametrize("limit", [substring_dedup.ROUND_BYTES, 10_000])
def test_rounds_and_groups_of_rows(spark, monkeypatch, limit):
    """Strings are picked from the right rows, in rounds and where some rows have none to pick."""
    monkeypatch.setattr(substring_dedup, "ROUND_BYTES", limit)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 3000)
    rng = random.Random(limit)
    texts = [" ".join(rng.choice(["%x" % rng.randrange(400), "ab", "cd"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts = [t if k % 3 else " ".join([t, texts[0], rng.choice(texts)]) for k, t in enumerate(texts)]
    docs, packing, meeting = list(enumerate(texts)), Taken(), Taken()
    substring_dedup.packed_stretches(packing, 13, 4, 2, 500)
    substring_dedup.shared_windows(meeting, 13, 2)
    ids = pa.array(range(len(docs)), pa.int64())
    documents = pa.RecordBatch.from_arrays([ids, ids, pa.array([t.encode() for t in texts])], names=["doc_id", "digest", "text"])
    met = {}
    for batch in meeting.run(packing.run(iter([documents]))):
        for row in batch.to_pylist():
            assert met.setdefault((row["lo"], row["hi"]), row["firsts"]) == row["firsts"]
    first = {}
    for k, text in docs:
        words = text.split()
        for i in range(len(words) - 12):
            first.setdefault(tuple(words[i : i + 13]), []).append(k)
    several = {min(ids) for ids in first.values() if len(set(ids)) > 1}
    assert several and several <= {k for firsts in met.values() for k in firsts}


def test_a_task_has_one_bucket(spark):
    texts = [(k, t.decode()) for k, t in enumerate(repeated_texts(40))]
    keyed = substring_dedup.with_digest(spark.createDataFrame(texts, "doc_id long, text string"))
    shared = substring_dedup.shared_windows(substring_dedup.packed_stretches(keyed, 13, 4, 24, 1 << 20), 13, 24)
    assert shared.select(F.spark_partition_id().alias("task")).distinct().count() == 24


def test_equal_strings_are_compared_once(spark, monkeypatch):
    compared, met = [], Taken()
    answers = substring_dedup.answers
    monkeypatch.setattr(substring_dedup, "answers", lambda texts, *rest: compared.extend(texts) or answers(texts, *rest))
    substring_dedup.shared_windows(met, 13, 1)
    packing = substring_dedup.packed_stretches(Taken(), 13, 4, 1, 1)
    ids = pa.array([7, 3, 9, 3], pa.int64())
    texts = pa.array([b" ".join(b"%d" % k for k in range(40))] * 4)
    rows = [r for b in met.run(packing.run(iter([pa.RecordBatch.from_arrays([ids, ids, texts], names=["doc_id", "digest", "text"])]))) for r in b.to_pylist()]
    assert len(compared) == len(set(compared)) > 1
    assert sum(len(r["firsts"]) for r in rows) == 28 and {k for r in rows for k in r["firsts"]} == {3}
