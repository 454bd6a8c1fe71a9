"""Toxicity: neighbours against brute force, and accuracy on held-out rows."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import blockmax
from tessera.llm import toxicity as t

SCHEMA = "doc_id long, text string, toxic string, score string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    plain, bad = [f"word{i}" for i in range(400)], [f"insult{i}" for i in range(8)]
    docs, labels = [], []
    for i in range(900):
        toxic = int(i % 5 == 0)
        text = [rng.choice(plain) for _ in range(rng.randint(5, 80))] + [rng.choice(bad) for _ in range(4 * toxic)]
        rng.shuffle(text)
        docs.append((i, " ".join(text).capitalize() + ".", "x", "y"))
        labels.append((i, 1, toxic))
    docs += [(None, None, None, None), (5000, "", None, None), (5001, "word1 " * 50000 + "Insult3! insult4 insult5", None, None), docs[0], docs[0]]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_held_out_accuracy_and_cases(tables):
    docs, labels, rows = tables
    out = t.toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.doc_id is not None and r.doc_id < 900:
            assert r.predicted == (r.doc_id % 5 == 0)
    scores = {r.doc_id: r.score for r in out}
    assert scores[5001] > 0.7 and scores[None] == scores[5000] < 0.5


def test_neighbours_are_exact(tables, monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 8)
    docs, labels, rows = tables
    model = t.fit(docs, labels)
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in model.ids)
    dense = np.zeros((len(model.ids), len(model.term)))
    for k, (e, w) in enumerate(zip(model.examples, model.weights, strict=True)):
        dense[e, k] = w
    for _, text, *_ in rows[:200]:
        at, tf = model.count(t.words_of(text))
        found, near = model.nearest(at, tf)
        every = np.round(dense[:, at] @ model.weigh(at, tf), blockmax.DECIMALS)
        want = [i for i in np.lexsort((np.arange(len(every)), -every))[: t.NEIGHBOURS] if every[i] > 0]
        assert np.allclose(near, every[want], atol=2e-8) and sum(f in want for f in found) >= len(want) - 1


def test_without_labels(tables):
    docs, labels, rows = tables
    assert {r.predicted for r in t.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert t.toxicity(docs.limit(0), labels).count() == 0


def test_every_term_of_the_examples_counts(tables):
    docs, labels, rows = tables
    model = t.fit(docs, labels)
    texts = {i: text for i, text, *_ in rows if i is not None}
    words = lambda text: set(t._words((text or "").lower()))
    assert set(model.term) == set().union(*(words(texts[i]) for i in model.ids.tolist()))
    df = sum("word1" in words(text) for _, text, *_ in rows)  # over all documents, not the examples
    assert abs(model.idf[model.term["word1"]] - np.log((1 + len(rows)) / (1 + df)) - 1) < 1e-12
    found, _ = model.nearest(*model.count(["word17", "word18"]))
    assert len(found) and all(words(texts[model.ids[f]]) & {"word17", "word18"} for f in found.tolist())


def test_runs_of_texts_are_searched_together(tables, monkeypatch):
    docs, labels, rows = tables
    model = t.fit(docs, labels)
    texts = [text for _, text, *_ in rows[:300]] + [None, "", "?!", "none of these"]
    searched = []
    together = blockmax.BlockMax.search_together
    monkeypatch.setattr(blockmax.BlockMax, "search_together", lambda index, queries, *more: searched.append(len(queries)) or together(index, queries, *more))
    monkeypatch.setattr(blockmax.BlockMax, "search", None)  # no search of a text by itself
    scores, found, near = model.score(texts)
    assert searched == [len(texts)] * 2  # all terms, then the markers
    for text, s, f, c in zip(texts, scores, found, near, strict=True):
        one = model.score([text])
        assert s == one[0][0] and f.tolist() == one[1][0].tolist() and c.tolist() == one[2][0].tolist()
        dense = np.zeros(model.n)
        at, tf = model.count(t.words_of(text))
        for k, w in zip(at.tolist(), model.weigh(at, tf).tolist(), strict=True):
            dense[model.examples[k]] += w * model.weights[k]
        dense = np.round(dense, blockmax.DECIMALS)
        want = [i for i in np.lexsort((np.arange(model.n), -dense))[: t.NEIGHBOURS] if dense[i] > 0]
        assert f.tolist() == want and np.allclose(c, dense[want], atol=2e-8)


def test_words_are_those_of_the_pattern():
    rng = random.Random(8)
    alphabet = [chr(c) for c in range(256)] + list("aZ09_ ") * 20
    texts = ["".join(rng.choices(alphabet, k=60)) for _ in range(300)] + ["".join(map(chr, range(256))), "", "İstanbul K—x", "да 中文 café", "a\ud800b"]
    assert [t.words_of(x) for x in texts] == [t._words(x.lower()) for x in texts] and t.words_of(None) == []
