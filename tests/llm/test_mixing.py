"""Mixing: shares meet their targets; the fit equals one in numpy."""

import random

import numpy as np
import pytest

from tessera.llm import mixing as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    words = [[f"{d}{i}" for i in range(200)] for d in m.DOMAINS] + [[f"common{i}" for i in range(100)]]
    docs, labels = [], []
    for i in range(600):
        kind = rng.choices(range(3), (7, 2, 1))[0]
        text = [rng.choice(words[3] if rng.random() < 0.8 else words[kind]) for _ in range(rng.randint(10, 120))]
        docs.append((i, " ".join(text), "en", "s", 1, "own"))
        if i % 2:
            labels.append((i, int(kind == 0), int(kind == 2)))
    docs += [(None, None, None, None, None, None), (7, "", "en", "s", 1, "own"), docs[3], docs[3]]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_shares_meet_targets(tables):
    docs, labels, rows = tables
    out = m.mixing_rates(docs, labels).toPandas()
    assert len(out) == len(rows) and (out.rate >= 0).all()
    p = out[[f"p_{d}" for d in m.DOMAINS]].to_numpy()
    assert np.allclose(p.sum(1), 1)
    shares = (out.n_words * out.rate).to_numpy() @ p / out.n_words.sum()
    assert np.abs(shares - [m.TARGETS[d] for d in m.DOMAINS]).max() < 2e-4
    # the same steps, over all rows at once
    w, r = out.n_words.to_numpy() / out.n_words.sum(), np.ones(len(out))
    for _ in range(m.ROUNDS):
        e = (w * r) @ p - np.array([m.TARGETS[d] for d in m.DOMAINS])
        if np.abs(e).max() < m.TOLERANCE:
            break
        at = r > 0
        r = np.maximum(0, r - p @ np.round(np.linalg.solve(p[at].T * w[at] @ p[at] + m.RIDGE * np.eye(3), e), m.DECIMALS))
    assert np.abs(r - out.rate).max() < 1e-5
    assert np.abs(out.copies - out.rate).max() < 1


def test_classifier_tells_domains_apart(tables, spark):
    docs, labels, _ = tables
    out = m.mixing_rates(docs, labels).join(labels, "doc_id").toPandas().drop_duplicates("doc_id")
    guess = out[[f"p_{d}" for d in m.DOMAINS]].to_numpy().argmax(1)
    truth = np.where(out.toxic == 1, 2, np.where(out.quality == 1, 0, 1))
    assert (guess == truth).mean() > 0.9


def test_stage_repeats_rows(tables):
    docs, labels, _ = tables
    rates = {}
    for r in m.mixing_rates(docs, labels).collect():
        rates[r.doc_id] = rates.get(r.doc_id, 0) + r.copies
    mixed = m.mix(docs, labels)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in rates.items() if v}


def test_empty(tables):
    docs, labels, _ = tables
    assert m.mixing_rates(docs.limit(0), labels).count() == 0
    assert m.mixing_rates(docs, labels.limit(0)).count() == docs.count()


def test_relative_targets_and_rates_of_zero(tables):
    docs, labels, _ = tables
    out = m.mixing_rates(docs, labels, {"toxic": 0.1}, relative=True).toPandas()
    p, w = out[[f"p_{d}" for d in m.DOMAINS]].to_numpy(), out.n_words.to_numpy() / out.n_words.sum()
    goal = (w @ p) * [1, 1, 0.1]
    assert np.abs((w * out.rate.to_numpy()) @ p - goal / goal.sum()).max() < 2e-4
    assert (out.rate == 0).any() and (out.copies[out.rate == 0] == 0).all()


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word other " * 100000), (2, "word")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_words for r in m.mixing_rates(docs, labels).collect()} == {1: 200000, 2: 1}


def test_posteriors_against_plain_counts(tables):
    """Naive Bayes over distinct hashed words, softened by the fourth root of their number, in plain Python."""
    docs, labels, rows = tables
    model = m.fit(docs, labels)
    hashed = docs.select("doc_id", m._features(docs.text).alias("f")).collect()
    out = {(r.doc_id, r.n_words): r for r in m.mixing_rates(docs, labels).collect()}
    texts = {r[0]: r[1] for r in rows[:600]}
    for r in hashed[:100]:
        e = [0.0] + [(model.prior[k] + sum(model.weights[k][i] for i in r.f) / max(1, len(r.f) ** 0.25)) / m.STEPS for k in range(2)]
        e = np.exp(np.clip(e, -50, 50))
        got = out[r.doc_id, len(texts[r.doc_id].split())]
        assert np.allclose([got[f"p_{d}"] for d in m.DOMAINS], e / e.sum(), atol=1e-9)
