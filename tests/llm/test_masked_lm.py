"""Masked language model: gradients, sums by brute force, and held-out order."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import masked_lm as m

SCHEMA = "doc_id long, text string, n_tokens string, part int"


def sentence(rng):
    return " ".join(f"{a} {b} then {c}" for a, b, c in (rng.choice([("red", "fox", "runs"), ("blue", "sea", "shines"), ("old", "tree", "stands")]) for _ in range(12)))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng), "own", 1) for i in range(600)] + [(None, None, None, None), (900, " ", "x", 1), (901, "word " * 30000, "x", 1)]
    return spark.createDataFrame(rows + rows[:1], SCHEMA).repartition(3)


def test_gradient_goes_down():
    rng = np.random.default_rng(0)
    token = rng.integers(0, 50, 4000).astype(np.int32)
    token[1::2] = token[::2] + 64
    net, squares = m.Network.start(), m.Network(np.full(m.SIZE, 1e-8, np.float32))
    c = m.contexts(token)
    before = net.log_probabilities(c, token).mean()
    for _ in range(30):
        net.learn(c, token, squares)
    assert net.log_probabilities(c, token).mean() > before + 3


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    net = m.Network.start()
    token = rng.integers(0, m.VOCABULARY, 40).astype(np.int32)
    c = m.contexts(token)
    grad, dh, by, first, sorted_ = net.gradient(c, token)
    whole = np.zeros(m.SIZE)
    whole[net.embed.size :] = grad
    embed = whole[: net.embed.size].reshape(net.embed.shape)
    for k in range(2 * m.WINDOW):
        np.add.at(embed[k], sorted_[:, k], dh)
        assert np.allclose(np.add.reduceat(dh[by[k]], first[k]), embed[k][sorted_[by[k][first[k]], k]], atol=1e-5)
    step = 1e-2
    for i in rng.choice(np.flatnonzero(np.abs(whole) > 0.05), 40, replace=False):
        old, ends = net.flat[i], []
        for x in (step, -step):
            net.flat[i] = old + x
            ends.append(net.log_probabilities(c, token).astype(float).sum())
        net.flat[i] = old
        assert abs((ends[1] - ends[0]) / (2 * step) - whole[i]) < 2e-2


def test_probabilities_sum_to_one():
    net = m.Network.start()
    c = np.tile(np.array([[1, 2, 3, m.VOCABULARY]]), (m.VOCABULARY, 1))
    assert abs(np.exp(net.log_probabilities(c, np.arange(m.VOCABULARY))).sum() - 1) < 1e-3


def test_scores_equal_plain_sums_and_prefer_real_order(spark, docs):
    out = m.score_documents(docs).collect()
    assert len(out) == docs.count()
    net = m.train(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(2)
    better = 0
    for r in out:
        token = m.tokens(rows[r.doc_id])
        assert r.n_tokens == len(token)
        if not len(token):
            assert r.log_likelihood == 0 and r.mean_log_likelihood is None
        elif r.doc_id < 40:
            plain = sum(float(net.log_probabilities(m.contexts(token)[k : k + 1], token[k : k + 1])[0]) for k in range(len(token)))
            assert abs(plain - r.log_likelihood) < 1e-2
            mixed = token.copy()
            rng.shuffle(mixed)
            better += net.log_probabilities(m.contexts(mixed), mixed).sum() < r.log_likelihood
    assert better >= 38


def test_empty(docs):
    assert m.score_documents(docs.limit(0)).count() == 0


def test_every_position_is_learned_from():
    texts = [sentence(random.Random(k)) for k in range(5)] + [None, "one", ""]
    (rows,) = m._train(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    assert set(rows.column("learned").to_pylist()) == {sum(len((t or "").split()) for t in texts)}


def test_words_of_one_number_have_their_own_probabilities(spark, monkeypatch):
    same = [w for w in (f"w{k}" for k in range(40000)) if m.tokens(w)[0] == 7][:3]
    rows = [(k, f"red {same[0]} runs") for k in range(90)] + [(100 + k, f"red {same[1]} runs") for k in range(10)] + [(200, f"red {same[2]} runs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.log_likelihood for r in m.score_documents(docs).collect()}
    assert abs(got[0] - got[100] - np.log(9)) < 1e-5 and abs(got[0] - got[200] - np.log(90)) < 1e-5
    monkeypatch.setattr(m, "WORDS", 4)  # the third word is spelled
    fewer = {r.doc_id: r.log_likelihood for r in m.score_documents(docs).collect()}
    assert abs(fewer[0] - fewer[100] - np.log(9)) < 1e-4 and fewer[200] < fewer[0] - np.log(90)


def test_words_and_contexts():
    texts = ["One  two\n", None, "", " \t ", "two ÉTÉ", "x"]
    words = m.Words(pa.array(texts))
    plain = [(t or "").lower().encode().split() for t in texts]
    assert words.length.tolist() == [len(p) for p in plain]
    assert [words.distinct[k].as_py() for k in words.at.tolist()] == [w for p in plain for w in p]
    token = words.numbers()
    apart = [m.contexts(np.concatenate([m.tokens(t)])) for t in texts]
    assert np.array_equal(m.contexts(token, words.length), np.concatenate(apart))
    assert [len(x) for x in m._slices(pa.array(["ab", "c" * 9, None, "d", "e" * 30]), 10)] == [1, 3, 1]
