"""The audit of filters against applying them one after the other."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from llm_fixtures import COLUMNS, words
from postsieve.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, good string, part int, n int"


def fails(rows):
    """For each row the letters of the filters that it fails, by the rules as they are written."""
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        bad = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        bad += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (doc_id is not None and least[text] < doc_id)
        out.append(set(bad))
    return out


def plain(rows, labels):
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for row, bad in zip(rows, fails(rows), strict=True):
        parts[row[3] or ""].append((row[0], bad))
    out, shapley = [], defaultdict(int)
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), sum(f in b for _, b in docs) - len(gone), sum(b == {f} for _, b in docs),
                            sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def some_rows():
    texts = [None, "", " \t\n", "a b " * 300, " ".join(words(1, 250)), " ".join(words(1, 250)), "ABC d", "x#y", "É" * 50 + "A", "É" * 49 + "A", "A" + "x" * 49, "A" + "x" * 48]
    texts += [" ".join(words(k, 190 + k % 20)) + (" #" if k % 3 else "") + (" Q" * (k % 40)) for k in range(60)] + ["same text"] * 20
    texts += [" ".join(words(7, 200_000)), "w" * 300_000 + " $"]
    rows = [(k, t, None, "s" if k % 3 == 0 else None if k % 5 == 0 else f"p{k % 4}", 1) for k, t in enumerate(texts)]
    rows += [(3, "same text", None, "", 1), (3, "same text", None, "s", 1), (None, "same text", None, "s", 1), (None, None, None, None, None), (-4, "", "x", "s", 2)]
    return [(*r, "t", "d", 1, "x", 1, 2, "p", "f") for r in rows]


SOME_LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, 0), (3, 1, 1), (3, None, None), (4, None, 1), (None, 1, 1), (40, 1, 0), (41, 1, 1), (900, 1, 1), (-4, 1, None)]


@pytest.mark.parametrize("range_rows", [1, 7, 100_000])
def test_as_if_applied(spark, range_rows):
    rows = some_rows()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    labels = spark.createDataFrame([(*r, "g", 1, 2) for r in SOME_LABELS], LABELS)
    found = filter_audit.audit(docs, labels, range_rows=range_rows)
    assert sorted(map(tuple, found.collect())) == plain(rows, SOME_LABELS)


def test_no_documents(spark, no_docs):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(no_docs, labels).count() == 0


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, labels, tests={"X": lambda text, words: text == b"a"}, copies="Y").collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.good_lost, r.shapley) for r in rows} == {
        ("XY", 1): (1, 2, 0, 1, 3), ("XY", 2): (1, 0, 1, 0, 1), ("YX", 1): (2, 1, 0, 1, 1), ("YX", 2): (1, 1, 1, 0, 3),
    }


def test_merges():
    a, b = np.array([1, 3, 9], np.int32), np.array([2, 3, 4, 9, 10], np.int32)
    none = np.empty(0, np.int32)
    assert filter_audit.union([a, b]).tolist() == [1, 2, 3, 4, 9, 10]
    assert filter_audit.union([none, none]).tolist() == []
    assert filter_audit.found_in(a, b).tolist() == [False, True, True]
    assert filter_audit.found_in(a, none).tolist() == [False] * 3
