"""Language id and the recurrent model: held-out quality, exact counts, gradients."""

import collections
import math
import os
import zlib

import numpy as np
import pytest
from llm_fixtures import edge_rows
from postsieve.llm import language_id, recurrent_lm as lm
from postsieve.llm.common import LOWER
from postsieve.llm.queries import QUERIES, held_out
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@tables
def test_languages_of_texts_not_learned_from(spark):
    got = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all() and 150 < got.held_out.sum() < 350
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert held.score.between(0, 1).all()


def test_edge_texts(edge_docs, no_docs):
    model = language_id.learn(edge_docs)
    assert model.languages == ["en"]
    rows = language_id.with_language(edge_docs.withColumn("score", F.lit("old")), model).collect()
    assert rows[0].asDict().keys() == {*edge_docs.columns, "lang_pred", "score"}
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == ("en" if letters else "und") and (r.score == 0) == (not letters)
    nothing = language_id.learn(no_docs)
    assert {(r.lang_pred, r.score) for r in language_id.with_language(edge_docs, nothing).collect()} == {("und", 0.0)}
    assert language_id.with_language(no_docs, model).count() == 0


def test_penalties_leave_most_weights_at_zero_and_scores_are_chances():
    rng = np.random.default_rng(1)
    sounds = {"x": ["ba", "bo", "na"], "y": ["ki", "ti", "na"], "z": ["su", "ru", "na"]}
    texts = [("".join(rng.choice(sounds[k]) + (" " if rng.random() < 0.4 else "") for _ in range(30)), k) for k in sounds for _ in range(120)]
    rng.shuffle(texts)
    model = language_id.fit([(t, k) for t, k in texts], np.ones(language_id.SLOTS))
    assert model.languages == ["x", "y", "z"] and (model.weights != 0).mean() < 0.05
    assert np.mean([model.predict(t)[0] == k for t, k in texts]) > 0.98
    logits = rng.normal(0, 1, (40_000, 3))
    targets = (language_id.softmax(logits / 2.5).cumsum(axis=1) > rng.random((40_000, 1))).argmax(axis=1)
    assert abs(language_id.temperature(logits, targets) - 2.5) < 0.2


def test_gradients():
    net = lm.Net(10, 3, 4, 1)
    net.p = {k: v.astype(np.float64) + np.random.default_rng(5).normal(0, 0.3, v.shape) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    words, targets, mask = rng.integers(0, 10, (5, 3)), rng.integers(0, 10, (5, 3)), np.ones((5, 3))
    mask[3:, 1] = 0
    h = rng.normal(0, 0.5, (3, 4))
    _, grads, _ = net.window(h, words, targets, mask)
    for k, v in net.p.items():
        for _ in range(10):
            i = tuple(rng.integers(0, s) for s in v.shape)
            old, step = v[i], 1e-5
            v[i] = old + step
            up = net.window(h, words, targets, mask)[0]
            v[i] = old - step
            down = net.window(h, words, targets, mask)[0]
            v[i] = old
            assert abs((up - down) / (2 * step) - grads[k][i]) < 1e-6


def test_chances_add_up_and_state_goes_on_across_windows(monkeypatch):
    net = lm.Net(7, 3, 4, 2)
    net.p["w"] += 0.3
    h = np.random.default_rng(0).normal(0, 1, (7, 4)).astype(np.float32)
    total = np.exp([net.output(h, np.full(7, w))[0] for w in range(7)]).sum(axis=0)
    assert np.allclose(total, 1, atol=1e-5)
    words, starts = lm.with_ends(np.array([1, 2, 3, 0, 4, 2, 2]), np.array([4, 0, 3]), 6)
    lengths = np.array([5, 1, 4])
    whole = lm.log_chances(net, words, starts, lengths, 6)
    monkeypatch.setattr(lm, "SCORE_STEPS", 2)
    assert np.allclose(whole, lm.log_chances(net, words, starts, lengths, 6), atol=1e-5)
    for k in range(3):
        state, before, want = np.zeros((1, 4), np.float32), 6, 0.0
        for w in words[starts[k] : starts[k] + lengths[k]]:
            state = net.step(np.array([before]), state)[0]
            want += net.output(state, np.array([w]))[0][0]
            before = w
        assert abs(want - whole[k]) < 1e-4


def counts(docs):
    count = collections.Counter()
    for doc_id, text in docs:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            count.update(tokens(text))
    return count


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), None]


def test_counts_and_base_score_of_edge_documents(edge_docs):
    docs = [(r[0], r[1]) for r in edge_rows()]
    count = counts(docs)
    total, kinds = sum(count.values()), len(count)
    want = []
    for doc_id, text in docs:
        t = tokens(text)
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in t)
        want.append((doc_id, len(t), sum(count[w] > 0 for w in t), total, round(base, 6)))
    got = lm.score(edge_docs, ~held_out(7), vocabulary=50, shard_bytes=5000).collect()
    assert sorted(((*r[:4], round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got)


def test_nothing_to_learn_from_and_no_documents(edge_docs, no_docs):
    got = lm.score(edge_docs, F.lit(False)).collect()
    assert len(got) == len(edge_rows()) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)
    assert all(math.isfinite(r.score) for r in got)
    assert lm.score(no_docs, F.lit(True)).count() == 0


@tables
def test_the_model_beats_word_frequencies_on_held_out_texts(spark):
    got = QUERIES["op10_recurrent_lm"](spark, SF).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.1 * held.n_tokens.sum()
    assert (held.score > held.base_score).mean() > 0.95


def test_all_learning_documents_train_in_every_round(spark):
    docs = [(k, " ".join(f"w{(k * i) % 23}" for i in range(1, 4 + k % 30))) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    shards = lm.write_shards(frame, F.col("doc_id") % 7 != 2)
    words = lm.Words(np.sort(lm.WordHashes().of([b"w%d" % k for k in range(23)])))
    counts = np.ones(words.size)
    tokens = 10**9  # as of a large corpus, of which these are some documents
    got = lm.trained(shards, words, counts, tokens, 2)
    want = lm.Net(words.size, lm.classes_of(words.size), lm.HIDDEN)
    want.start_from(counts)
    learned = [(i, t) for i, t in docs if i % 7 != 2]
    texts = [np.append(words.of(lm.WordHashes().of(t.encode().split())), words.end) for _, t in learned]
    for k in range(2):
        optimiser = lm.Adam(want, lm.RATE / (1 + k))
        lm.train(want, texts, words.end, lm.RATE, optimiser)
    assert np.allclose(got.flat(), want.flat(), atol=1e-4)


def test_few_documents_make_enough_steps(monkeypatch):
    updates = []
    monkeypatch.setattr(lm.Adam, "update", lambda self, grads, tokens: updates.append(tokens))
    docs = [np.arange(1 + k % 40) % 5 for k in range(512)]
    lm.train(lm.Net(8, 2, 4), docs, 7, 0.01)
    assert len(updates) >= 32 and sum(updates) == sum(map(len, docs))


def test_updates_work_on_the_words_met_and_end_like_those_of_all_words():
    rng = np.random.default_rng(3)
    net = lm.Net(200, lm.classes_of(200), 4)
    optimiser, x = lm.Adam(net, 0.01), net.p["x"].astype(np.float64)
    began, m, v = x.copy(), np.zeros_like(x), np.zeros_like(x)
    for t in range(1, 401):
        met = np.unique(rng.integers(0, 200, 8))
        grads = {k: np.zeros_like(p) for k, p in net.p.items()}
        grads["x"][met] = rng.normal(0.5, 1, (len(met), 12))
        g = grads["x"] / 10.0
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= 0.01 / (1 - 0.9**t) * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        optimiser.meet(met)
        others = np.delete(net.p["x"], met, axis=0)
        optimiser.update(grads, 10)
        assert (np.delete(net.p["x"], met, axis=0) == others).all()
    optimiser.meet(np.arange(200))
    optimiser.keep()
    moved = np.abs(x - began).mean()
    assert np.abs(net.p["x"] - x).mean() < 1e-3 * moved


def test_frequent_words_and_marks_need_few_scores():
    net = lm.Net(7682, lm.classes_of(7682), 4)
    assert net.kind.tolist() == sorted(net.kind.tolist()) and (np.bincount(net.kind)[-2:] == 1).all()
    counts = np.append(1 / np.arange(10, 7690), [4, 0.1])
    scores = net.classes + np.where(net.kind < net.inner, np.bincount(net.kind)[net.kind], 0)
    assert (scores * counts).sum() / counts.sum() < 110  # 176 with all classes of a size


def test_lanes_follow_the_documents_of_a_task_not_of_a_shard():
    words = lm.Words(np.sort(lm.WordHashes().of([b"a", b"b"])))
    lengths, learns = np.array([2, 0, 1]), np.array([True, False, True])
    shard = (learns.tobytes(), lengths.tobytes(), words.hashes.tobytes(), np.array([0, 1, 1], np.int32).tobytes())
    got = [[d.tolist() for d in docs] for docs in lm.gathered(iter([shard] * 6), words)]
    assert got == [[[0, 1, words.end], [1, words.end]] * 4, [[0, 1, words.end], [1, words.end]] * 2]
