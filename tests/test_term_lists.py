"""Term lists of all sizes: literals, automaton and gram index give the same rows."""

import random

import numpy as np
import pytest
from helpers import values
from postsieve.operators import term_index
from postsieve.operators.joins import by_terms
from postsieve.operators.skew import hot_keys

WAYS = [{}, {"literal_bytes": 0}, {"literal_bytes": 0, "automaton_bytes": 0}]


def kept(spark, texts, terms, how, ways):
    rows = values(spark, "k int, t string, term string, digest int", [(k, t, "x", 1) for k, t in texts]).repartition(3)
    listed = values(spark, "term string", [(t,) for t in terms])
    found = by_terms(rows, listed, "t", how, **ways)
    assert found.columns == rows.columns
    return sorted(r.k for r in found.collect())


@pytest.mark.parametrize("ways", WAYS)
@pytest.mark.parametrize("how", ["left_anti", "left_semi"])
def test_few_terms(spark, how, ways):
    texts = [(1, "a bad word"), (2, "fine"), (3, "worse still"), (4, None), (5, "ba"), (6, ""), (1, "a bad word")]
    hits = [1, 1, 3]
    got = kept(spark, texts, ["bad", "worse", "", None, "bad"], how, ways)
    assert got == (hits if how == "left_semi" else [2, 4, 5, 6])
    assert kept(spark, texts, [None, ""], how, ways) == ([] if how == "left_semi" else [1, 1, 2, 3, 4, 5, 6])
    assert kept(spark, [], ["bad"], how, ways) == []


@pytest.mark.parametrize("ways", WAYS)
def test_random_terms(spark, ways):
    dice = random.Random(4)
    word = lambda n: "".join(dice.choice("abé€😀 ") for _ in range(n))
    texts = [(k, word(dice.randrange(0, 60))) for k in range(600)] + [(k, "b" * 500) for k in range(600, 900)]
    terms = [word(dice.randint(3, 12)) for _ in range(300)] + ["b" * n for n in (9, 400, 501)] + [texts[7][1], "é€"]
    want = sorted(k for k, t in texts if any(x in t for x in terms if x))
    assert kept(spark, texts, terms, "left_semi", ways) == want
    assert kept(spark, texts, terms, "left_anti", ways) == sorted(set(range(900)) - set(want))
    assert 50 < len(want) < 850


def test_hot_texts_and_keys(spark, monkeypatch):
    monkeypatch.setattr(term_index, "hot_keys", lambda rows, on: hot_keys(rows, on, 5))
    texts = [(k, "the same text of many") for k in range(300)] + [(300 + k, f"the same text {k}") for k in range(300)]
    terms = [f"same text {k}" for k in range(0, 300, 2)] + ["not there at all"]
    want = [k for k, t in texts if any(x in t for x in terms)]
    assert kept(spark, texts, terms, "left_semi", WAYS[2]) == want


def test_size_is_checked_before_terms_reach_the_driver(spark):
    rows = values(spark, "k int, t string", [(1, "x"), (2, "long term here")])
    terms = spark.range(3000).selectExpr("concat('long term ', id) AS term").union(values(spark, "term string", [("term here",)]))
    plans = [by_terms(rows, terms, "t", "left_semi", literal_bytes=a, automaton_bytes=b)._jdf.queryExecution().optimizedPlan().toString() for a, b in ((1 << 20, 0), (0, 1 << 20), (0, 0))]
    assert "long term 2999" in plans[0] and "ArrowEvalPython" in plans[1]
    assert not any("long term 1" in p for p in plans[1:])


def test_grams_of_equal_bytes_have_equal_hashes():
    data = "aé€😀aé€😀b".encode()
    for n in range(1, 12):
        hashes = term_index.gram_hashes(data, n)
        grams = [data[k : k + n] for k in range(len(data) - n + 1)]
        assert len(np.unique(hashes)) == len(set(grams)) and len(hashes) == len(grams)
        for k, gram in enumerate(grams):
            assert hashes[k] == term_index.gram_hashes(gram, n)[0]
