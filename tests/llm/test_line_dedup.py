"""Line dedup against plain pairing, and the alignment's properties."""

import random

import pytest
from llm_fixtures import edge_rows, passage
from postsieve.llm import line_dedup as d


def patience(a, b, i=0, j=0):
    """Patience diff as it is told: equal ends first, then lines that are unique on both sides, then what lies between."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    out = [(i + k, j + k) for k in range(head)]
    a, b, i, j = a[head:], b[head:], i + head, j + head
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    end = [(i + len(a) - k, j + len(b) - k) for k in range(tail, 0, -1)]
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    unique = [(k, b.index(x)) for k, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    chains = []  # of all that ascend the longest; of equally long ones that which the piles of patience give
    piles, back = [], {}
    for k, (_, y) in enumerate(unique):
        at = next((p for p, pile in enumerate(piles) if unique[pile[-1]][1] >= y), len(piles))
        back[k] = piles[at - 1][-1] if at else None
        if at == len(piles):
            piles.append([])
        piles[at].append(k)
    k = piles[-1][-1] if piles else None
    while k is not None:
        chains.append(unique[k])
        k = back[k]
    chains.reverse()
    if chains:
        edges = [(-1, -1), *chains, (len(a), len(b))]
        for (x0, y0), (x1, y1) in zip(edges, edges[1:], strict=False):
            out += patience(a[x0 + 1 : x1], b[y0 + 1 : y1], i + x0 + 1, j + y0 + 1)
            if (x1, y1) != (len(a), len(b)):
                out.append((i + x1, j + y1))
    return out + end


def deleted_lines(a, b, min_words):
    """Places in ``b`` of lines in blocks that it shares with ``a``."""
    gone, block = set(), []
    for i, j in [*patience(a, b), (-5, -5)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(len(b[k].split()) for _, k in block) >= min_words:
                gone |= {k for _, k in block}
            block = []
        block.append((i, j))
    return gone


def all_pairs(docs, min_words=d.MIN_WORDS):
    """Every document aligned with every earlier one; lines are texts here, parted as bytes."""
    lines = {(i, t): [x.strip().decode() for x in t.encode().split(b"\n")] for i, t in docs if i is not None and t is not None}
    gone = {}
    for b in lines:
        for a in lines:
            if a[0] < b[0]:
                gone.setdefault(b, set()).update(deleted_lines(lines[a], lines[b], min_words))
    out = []
    for i, t in docs:
        own = t.split("\n") if t else []
        left = [x for k, x in enumerate(own) if k not in gone.get((i, t), ())]
        out.append((i, len(own), len(own) - len(left), None if t is None else "\n".join(left)))
    return sorted(out, key=repr)


def found(frame, **options):
    return sorted((tuple(r) for r in d.dedup(frame, **options).collect()), key=repr)


def test_edge_documents(edge_docs):
    want = all_pairs([(r[0], r[1]) for r in edge_rows()])
    assert found(edge_docs) == want
    by_id = {w[0]: w for w in want if w[0] not in (None, 15, 16)}
    assert by_id[2][3] == "" and by_id[14][2] > 0 and by_id[0][2] == 0 and by_id[13][2] == 0


def test_no_documents(no_docs):
    assert found(no_docs) == []


@pytest.mark.parametrize("rare, chunk", [(8, 200_000), (2, 40), (4, 300)])
def test_shared_blocks_and_frequent_lines(spark, monkeypatch, rare, chunk):
    monkeypatch.setattr(d, "CHUNK_LINES", chunk)
    monkeypatch.setattr(d, "RARE", rare)
    rng = random.Random(4)
    lines = [passage(k, 6, 6) for k in range(400)]
    common = ["all rights reserved by us", "the end of it"]
    docs = []
    for k in range(60):
        text = [lines[rng.randrange(400)] for _ in range(rng.randint(0, 8))]
        at = rng.randrange(300)
        text += lines[at : at + rng.randint(0, 6)] + [rng.choice([*common, "x", ""]) for _ in range(3)]
        docs.append((k, "\n".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = all_pairs(docs)
    assert found(frame) == want
    assert sum(w[2] > 0 for w in want) > 10


def test_alignment_ascends_and_finds_moved_blocks_once():
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randint(0, 15))]
        b = [rng.randrange(12) for _ in range(rng.randint(0, 15))]
        pairs = d.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        assert d.aligned(a, a) == [(i, i) for i in range(len(a))]
    assert d.aligned([1, 2, 3, 4, 5], [9, 1, 2, 3, 8, 5]) == [(0, 1), (1, 2), (2, 3), (4, 5)]
    assert d.rising([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]


def test_copies_of_lines_that_earlier_documents_have_one_by_one(spark):
    lines = [passage(k, 3 + k % 7, 3 + k % 7) for k in range(12)]
    docs = [(k, line) for k, line in enumerate(lines)] + [(100 + k, "\n".join(lines)) for k in range(20)]
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert got == all_pairs(docs)
    assert sum(w[2] == len(lines) for w in got) == 19


def test_holders_that_the_first_does_not_align_with_meet_all_others(spark):
    first, second = passage(1, 10, 10), passage(2, 12, 12)
    docs = [(0, f"{first}\n{second}"), *((k, f"{second}\n{first}") for k in range(1, 30))]
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert got == all_pairs(docs) and all(w[3] == "" for w in got if w[0] > 1)


@pytest.mark.parametrize("seed, slots", [(1, (8, 64)), (2, ()), (3, (2,))])
def test_random_orders_against_all_pairs(spark, monkeypatch, seed, slots):
    monkeypatch.setattr(d, "SLOTS", slots)
    rng = random.Random(seed)
    lines = [passage(k, 1, 1 + k % 13) for k in range(14)] + [""]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for k in range(150)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == all_pairs(docs)


def test_blocks_of_short_lines_and_of_scripts_without_blanks(spark):
    short = [passage(k, 1 + k % 2, 1 + k % 2) for k in range(12)]
    joined = ["".join(chr(0x4E00 + (k * 37 + i * 11) % 5000) for i in range(20)) for k in range(12)]
    docs = [(10 * n + k, "\n".join([f"own {n} {k}", *block])) for n, block in enumerate([short, joined]) for k in range(4)]
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert got == all_pairs(docs)
    assert [w[2] for w in sorted(got)] == [0, 12, 12, 12, 0, 12, 12, 12]


def test_names_of_other_columns_do_not_matter(spark):
    names = ["doc_id", "text", "key", "digest", "deleted", "made", "b", "b_digest", "_id", "_digest", "_made"]
    docs = [(k, passage(1, 40), *(f"{c}{k}" for c in names[2:])) for k in range(3)]
    rows = d.without_blocks(spark.createDataFrame(docs, names))
    assert rows.columns == [*names, "n_lines", "n_removed"]
    assert sorted(r[2:-2] for r in map(tuple, rows.collect())) == sorted(r[2:] for r in docs)
