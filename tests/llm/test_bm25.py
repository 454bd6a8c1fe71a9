"""BM25 against plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import blockmax
from tessera.llm import bm25 as m

SCHEMA = "doc_id long, text string, score string, rank int"


def plain(rows):
    counts = [Counter(re.findall(r"\w+", (t or "").lower())) for _, t in rows]
    n, mean = len(rows), sum(sum(c.values()) for c in counts) / len(rows)
    df = Counter(t for c in counts for t in c)
    asked = {}
    for d, t in rows:
        if d is not None and t is not None and d % m.EVERY == 0:
            asked[d] = min(asked.get(d, t), t)
    out = {}
    for q, text in asked.items():
        terms = Counter(re.findall(r"\w+", text.lower()))
        scored = []
        for (d, _), c in zip(rows, counts, strict=True):
            size = sum(c.values())
            s = sum(f * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (m.K1 + 1) / (c[t] + m.K1 * (1 - m.B + m.B * size / mean)) for t, f in terms.items() if c[t])
            if s > 0:
                scored.append((-round(s, 6), d is None, d))
        out[q] = sorted(scored)[: m.TOP]
    return out


def test_against_all_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i * 10, " ".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=rng.randint(3, 60)))) for i in range(400)]
    rows += [(None, "w1 w2 w3"), (800, None), (2200, ""), rows[10], (1000, "w250 again"), (7, "w1 " * 30000)]
    rows += [(20000 + k, "same words w3 w8 w8") for k in range(60)]  # ties at the cut
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = {}
    for r in m.search_documents(docs, shard_docs=40, query_block=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -round(r.score, 6), r.doc_id is None, r.doc_id))
    want = {q: [(k + 1, *x) for k, x in enumerate(v)] for q, v in plain(rows).items() if v}
    got = {q: sorted(v) for q, v in got.items()}
    assert got.keys() == want.keys()
    for q in want:
        assert [x[0] for x in got[q]] == [x[0] for x in want[q]]
        assert all(abs(x[1] - y[1]) < 1e-5 for x, y in zip(got[q], want[q], strict=True))
        last = want[q][-1][1]
        top = lambda v: sorted(str(x[2:]) for x in v if abs(x[1] - last) > 1e-4)  # noqa: E731, B023
        assert top(got[q]) == top(want[q])
    assert [x[3] for x in got[20000]] == [20000 + k for k in range(10)]


def test_block_max_against_all_rows(monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 8)
    rng = np.random.default_rng(3)
    for n, most in ((200, 12_000_000), (203, 1000), (1, 100)):
        monkeypatch.setattr(blockmax, "MOST_NUMBERS", most)
        dense = np.round(rng.random((60, n)), 2) * (rng.random((60, n)) < 1 / (1 + np.arange(60)[:, None]))
        dense[:, -1] += dense.sum(1) == 0
        term, rows = np.nonzero(dense)
        index = blockmax.BlockMax(n, np.searchsorted(term, np.arange(61)), rows, dense[term, rows])
        for size in (1, 5, 40):
            terms, weights = rng.choice(60, size, replace=False), rng.random(size)
            every = np.round(weights @ dense[terms], blockmax.DECIMALS)
            for least in (0.0, float(np.sort(every)[-3:][0]), 1e9):
                want = np.flatnonzero((every > 0) & (every >= least - 1e-9) & (every >= np.sort(every)[-4:][0] - 1e-9))
                found, score = index.search(terms, weights, 4, least - 1e-9)
                assert found.tolist() == want.tolist() and np.allclose(score, every[want], atol=1e-7)


def test_many_queries_are_searched_as_one_by_one(monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 8)
    rng = np.random.default_rng(4)
    for n, together, wide in ((200, 7, 8), (203, 128, 1), (1, 3, 8)):
        monkeypatch.setattr(blockmax, "TOGETHER", together)
        monkeypatch.setattr(blockmax, "WIDE", wide)
        dense = np.round(rng.random((60, n)), 2) * (rng.random((60, n)) < 1 / (1 + np.arange(60)[:, None]))
        dense[:, -1] += dense.sum(1) == 0
        term, rows = np.nonzero(dense)
        many = blockmax.ManyQueries(n, np.searchsorted(term, np.arange(61)), rows, dense[term, rows])
        asked, want = [(np.zeros(0, np.int64), np.zeros(0), 0.0)], [blockmax.NOTHING]
        for size in (1, 5, 40) * 4:
            terms, weights = rng.choice(60, size, replace=False), np.round(rng.random(size), 1)  # with ties
            every = np.round(weights @ dense[terms], blockmax.DECIMALS)
            for least in (0.0, float(np.sort(every)[-3:][0]), 1e9):
                asked.append((terms, weights, least - 1e-9))
                at = np.flatnonzero((every > 0) & (every >= least - 1e-9) & (every >= np.sort(every)[-4:][0] - 1e-9))
                want.append((at, every[at]))
        for (found, score), (at, every) in zip(many.search_many(asked, 4), want, strict=True):
            assert found.tolist() == at.tolist() and np.allclose(score, every, atol=1e-7)


def test_queries_together_against_all_rows(monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 8)
    rng = np.random.default_rng(9)
    for n, most in ((200, 12_000_000), (203, 1000), (3, 100)):
        monkeypatch.setattr(blockmax, "MOST_NUMBERS", most)
        dense = np.round(rng.random((60, n)), 1) * (rng.random((60, n)) < 1 / (1 + np.arange(60)[:, None]))  # with ties
        dense[:, -1] += dense.sum(1) == 0
        term, rows = np.nonzero(dense)
        index = blockmax.BlockMax(n, np.searchsorted(term, np.arange(61)), rows, dense[term, rows])
        queries = [(np.zeros(0, np.int64), np.zeros(0))] + [(rng.choice(60, size, replace=False), np.round(rng.random(size), 1)) for size in (1, 5, 40) * 4]
        for without in (None, [int(x) for x in rng.integers(0, n, len(queries))]):
            for q, (found, score) in enumerate(index.search_together(queries, 4, without)):
                every = np.round(queries[q][1] @ dense[queries[q][0]], blockmax.DECIMALS) if len(queries[q][0]) else np.zeros(n)
                if without:
                    every[without[q]] = 0
                want = np.flatnonzero((every > 0) & (every >= np.sort(every)[-4:][0]))
                assert found.tolist() == want.tolist() and np.array_equal(score, every[want])


def test_empty(spark):
    assert m.search_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert m.search_documents(spark.createDataFrame([(1, "no query", "x", 1)], SCHEMA)).count() == 0
