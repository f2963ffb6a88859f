"""Phrase search over the positional index, against plain search."""

import random

import pytest
from llm_fixtures import edge_rows, passage
from postsieve.llm import decontamination as d

ITEMS = [
    (1, passage(3, 30)), (2, "one TWO three"), (3, None), (None, "one"), (4, " ?! "), (5, passage(1, 9)), (10, passage(3, 30)),
    (6, "a a a a a a a a a a a"), (7, passage(77, 20)), (8, "日本 12"),
]


def plain(text, items, length=10):
    words = d.words_of(None if text is None else text.encode())
    hit, found = set(), set()
    for item, body in items:
        if item is None or body is None:
            continue
        w = d.words_of(body.encode())
        for i in range(max(1, len(w) - length + 1) if w else 0):
            window = w[i : i + length]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(item)
    return len(words), sorted(hit), sorted(found)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, doc_id int, spans string")


@pytest.mark.parametrize("shard_bytes, block_bytes", [(1 << 20, 1 << 20), (3000, 200)])
def test_equals_plain_search(edge_docs, items, shard_bytes, block_bytes):
    index = d.write_index(edge_docs, shard_bytes=shard_bytes)
    got = d.contamination(index, items, block_bytes=block_bytes).collect()
    rows = [(r.doc_id, r.n_words, [p for s in r.spans for p in range(s.start, s.end)], list(r["items"])) for r in got]
    want = [(doc_id, *plain(text, ITEMS)) for doc_id, text, *_ in edge_rows()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert sum(bool(w[3]) for w in want) > 5
    assert all(s.start < s.end and (k == 0 or r.spans[k - 1].end < s.start) for r in got for k, s in enumerate(r.spans))


def test_empty_tables(spark, edge_docs, no_docs, items):
    assert d.contamination(d.write_index(no_docs), items).count() == 0
    got = d.contamination(d.write_index(edge_docs), items.limit(0)).collect()
    assert len(got) == len(edge_rows()) and not any(r.spans for r in got)


def test_whole_phrases_and_proximity(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for k in range(30)]
    phrases = [(1, "a b"), (2, "c a d"), (3, "b")]
    index = d.write_index(spark.createDataFrame(docs, "doc_id long, text string"), shard_bytes=500)
    asked = spark.createDataFrame(phrases, "item_id long, text string")
    got = sorted(tuple(r) for r in d.find(index, asked).collect())
    want = []
    for item, phrase in phrases:
        p = phrase.split()
        for doc, text in docs:
            w = text.split()
            want += [(item, doc, i, i + len(p)) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    assert got == sorted(want)
    for within in (3, 5):
        near = sorted(tuple(r) for r in d.find(index, asked, within=within).collect())
        want = []
        for item, phrase in phrases:
            p = set(phrase.split())
            for doc, text in docs:
                w = text.split()
                for i in range(len(w)):
                    ends = [j for j in range(i + 1, min(len(w), i + within) + 1) if p <= set(w[i:j])]
                    if ends and not p <= set(w[i + 1 : ends[0]]):
                        want.append((item, doc, i, ends[0]))
        assert near == sorted(want)
