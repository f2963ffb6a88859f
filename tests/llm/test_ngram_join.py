"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from llm_fixtures import edge_rows, passage
from postsieve.llm import ngram_join
from postsieve.llm.common import LOWER


def grams(text, n=5):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain(docs):
    sets = [grams(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * len(a & b) >= 3 * len(a | b):
                links += a != b
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    out = [(i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(docs)]
    return sorted(out, key=repr), links


def found(frame, **options):
    return sorted((tuple(r) for r in ngram_join.classes_of(frame, **options).collect()), key=repr)


def test_edge_documents(edge_docs):
    want, links = plain([(r[0], r[1]) for r in edge_rows()])
    assert found(edge_docs) == want
    assert links >= 2


def test_no_documents(no_docs):
    assert found(no_docs) == []


@pytest.mark.parametrize("cell, slots, frequent, chunk", [(4096, 1 << 20, 16, 4 << 20), (8, 1 << 12, 0.01, 2000)])
def test_chains_of_near_copies_and_common_passages(spark, monkeypatch, cell, slots, frequent, chunk):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rng = random.Random(7)
    docs = []
    for g in range(6):  # groups whose members drift away from the first, so that they hang together by chains
        text = passage(g, 100).split(" ")
        for _ in range(12):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(text))
    common = passage(99, 30)
    docs += [common + "\n" + passage(200 + k, 60 + k) for k in range(25)]
    docs += [common + " " + passage(300 + k, 7) for k in range(6)]
    docs += [docs[3], docs[3]]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    want, links = plain(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(frame, cell=cell, slots=slots, chunk_bytes=chunk) == want
    assert links > 100 and len({w[2] for w in want}) < len(docs) - 40


def test_a_list_keeps_every_pair_at_the_threshold(monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(0)
    base = rng.choice(10**6, 80, replace=False)
    sets = []
    for _ in range(150):
        s = base[rng.random(80) < rng.uniform(0.6, 1)]
        sets.append(np.unique(np.append(s, rng.integers(10**6, 10**7, rng.integers(0, 12)))))
    token = base[0]
    rows = [(k, s, int(np.flatnonzero(s == token)[0])) for k, s in enumerate(sets) if token in s]
    n = np.array([len(s) for _, s, _ in rows], np.int32)
    none = np.zeros(len(rows), np.int64)

    def short(c):
        monkeypatch.setattr(ngram_join, "BLOCK", 1000)
        return ngram_join.short_lists(c, none)

    def pairs_of(search, seen=none.astype(np.uint64), family=none):
        columns = {
            "fp": np.array([k for k, _, _ in rows]), "n": n, "pos": np.array([p for _, _, p in rows], np.int32), "comp": np.arange(len(rows)),
            "part": none, "i": none, "j": none, "family": family, "seen": seen,
        }
        return {(min(x, y), max(x, y)) for a, b in search(columns) for x, y in zip(a.tolist(), b.tolist(), strict=True)}

    for search in (ngram_join.long_list, short):
        pairs, good = pairs_of(search), 0
        for i, (k, s, _) in enumerate(rows):
            for m, t, _ in rows[:i]:
                both = np.intersect1d(s, t)
                if 7 * len(both) >= 3 * (len(s) + len(t)):
                    good += 1
                    assert both[0] != token or (m, k) in pairs  # pairs are answered by their first common n-gram
        assert good > 100
        assert not pairs_of(search, seen=np.ones(len(rows), np.uint64)) and not pairs_of(search, family=none + 5)


def test_an_earlier_common_ngram_leaves_a_pair_out():
    bits = ngram_join.bits_of(np.array([7, 8, 9, 7, 30, 31]), np.array([0, 0, 1, 2, 2, 3]), 5)
    together = [[bool(a & b) for b in bits.tolist()] for a in bits.tolist()]
    assert together == [[True, False, True, False, False], [False, True, False, False, False], [True, False, True, False, False], [False, False, False, True, False], [False] * 5]


@pytest.mark.parametrize("columns", [4096, 20])
def test_a_family_gives_links_that_join_its_components(monkeypatch, columns):
    monkeypatch.setattr(ngram_join, "COLUMNS_AT_ONCE", columns)
    monkeypatch.setattr(ngram_join, "ROWS_AT_ONCE", 16)
    rng = np.random.default_rng(1)
    base = rng.choice(10**6, 60, replace=False)
    sets = [np.unique(np.append(base[rng.random(60) < rng.uniform(0.5, 1)], rng.integers(10**6, 10**7, rng.integers(0, 20)))) for _ in range(120)]
    good = {(i, j) for i in range(120) for j in range(i + 1, 120) if (o := len(np.intersect1d(sets[i], sets[j]))) * 7 >= 3 * (len(sets[i]) + len(sets[j]))}

    def parts_by(links):
        root = list(range(120))
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        return root

    found = ngram_join.cell_links(list(range(120)), list(range(120)), [0] * 120, False, sets)
    assert set(found) <= good and parts_by(found) == parts_by(good) and len(found) == 120 - len(set(parts_by(good)))
    halves = [k % 2 for k in range(120)]
    crossing = ngram_join.cell_links(list(range(120)), list(range(120)), halves, True, sets)
    assert set(crossing) <= good and all((a + b) % 2 for a, b in crossing)
    assert parts_by(crossing) == parts_by({(a, b) for a, b in good if (a + b) % 2})
    assert ngram_join.cell_links(list(range(120)), [3] * 120, [0] * 120, False, sets) == []


def near_copies(rng, text, rate):
    return " ".join(f"x{rng.randrange(10**9)}" if rng.random() < rate else w for w in text)


@pytest.mark.parametrize("cell", [2_000_000, 3000])
def test_a_third_of_all_rows_are_near_copies(spark, monkeypatch, cell):
    monkeypatch.setattr(ngram_join, "FAMILY_CELL", cell)
    rng = random.Random(5)
    text = passage(50, 120).split()
    docs = [near_copies(rng, text, rng.random() * 0.12) for _ in range(200)] + [passage(1000 + k, 60) for k in range(400)]
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    want, links = plain(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(frame) == want
    assert links > 200


def test_links_through_rows_without_id(spark):
    rng = random.Random(2)
    text = passage(60, 200).split()
    middle, left, right = list(text), list(text), list(text)
    for k in range(3):
        left[20 + 30 * k] = f"l{k}"
        right[30 + 40 * k] = f"r{k}"
    docs = [(1, " ".join(left)), (None, " ".join(middle)), (3, " ".join(right)), (None, "only here " + passage(70, 30)), (None, None)]
    docs += [(None, near_copies(rng, passage(80, 90).split(), 0.01)) for _ in range(4)]
    want, links = plain(docs)
    assert links >= 2 and (3, 196, 1) in want
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)) == want


def test_entries_are_dealt_as_rows(spark):
    entries = spark.createDataFrame([(t, 7, 8, t, 2) for t in (1, 2, 2, 3)], ngram_join.ENTRY)
    kept = ngram_join.kept_entries(entries)
    assert [(r.fp, r.n, [tuple(e) for e in r.kept]) for r in kept.collect()] == [(7, 8, [(2, 1, 1), (2, 2, 2), (2, 3, 3)])]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan[plan.rindex("Exchange hashpartitioning") :]


def test_near_copies_below_the_threshold_are_one_family(spark, monkeypatch):
    """Most of them do not link, and lists have small sets that no copy can link with."""
    rng = random.Random(11)
    text = passage(51, 150).split()
    docs = [near_copies(rng, text, 0.04) for _ in range(300)] + [" ".join(text[a : a + 12]) for a in range(0, 138, 3)]
    docs = list(enumerate(docs))
    want, links = plain(docs)
    pairs, search = [], ngram_join.open_pairs
    monkeypatch.setattr(ngram_join, "open_pairs", lambda *a: pairs.append(search(*a)) or pairs[0])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(frame) == want
    assert 100 < links < 10_000 and pairs[0].count() < 5 * len(docs)


def test_sets_without_a_pair_are_not_shuffled(spark):
    sets = ngram_join.stage(spark.range(2000).selectExpr("id AS fp", "sequence(id, id + 9) AS shingles"))
    pairs = ngram_join.stage(spark.createDataFrame([(3, 5), (5, 1999)], ngram_join.PAIR))
    got = ngram_join.overlaps(pairs, sets)
    assert sorted(map(tuple, got.collect())) == [(3, 5, 10, 10, 8), (5, 1999, 10, 10, 0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_candidate_sets_are_shuffled_once(spark):
    text = passage(52, 40)
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (4, passage(53, 40)), (5, passage(54, 9))], "doc_id long, text string")
    slim = ngram_join.stage(ngram_join.slim_sets(ngram_join.keyed_texts(docs), 5, 1 << 12).where("part IS NULL"))
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")
    try:
        sets = ngram_join.candidate_sets(docs, slim, slim.where("doc_id <> 5").select("fp").distinct(), 5)
        assert sets._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # of the sets and of their names
        assert sorted(len(r.shingles) for r in sets.collect()) == [36, 36]
    finally:
        spark.conf.set(broadcast, before)
