"""Suffix dedup against brute force over all 50-byte strings."""

import random

import numpy as np

from tessera.llm import suffix_dedup as s

SCHEMA = "doc_id long, text string, kept string, part string, bucket long"


def brute(rows):
    first = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - 49):
            w = data[i : i + 50]
            if d is not None:
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - 49):
            f = first.get(data[i : i + 50])
            if f is not None and (d is None or f < d):
                gone[i : i + 50] = True
        spans = sum(gone[i] and not gone[i - 1] for i in range(len(data)))
        out.append((d is None, d, len(data), int(gone.sum()), spans, bytes(b for b, g in zip(data, gone, strict=False) if not g)))
    return sorted(out, key=repr)


def rows_of(rng):
    def words(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))

    passage = words(30)
    rows = [(4, None), (5, ""), (6, "x" * 200), (7, "x" * 49), (8, "y" * 50), (9, "y" * 51), (10, "x" * 99)]
    for i in range(70):
        text = words(rng.randint(5, 120))
        kind = rng.random()
        if kind < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + passage[rng.randint(0, 20) : len(passage) - rng.randint(0, 20)] + text[at:]
        elif kind < 0.45:
            text = rows[rng.randrange(len(rows))][1] or ""
        elif kind < 0.55:
            old = list(rows[rng.randrange(7, len(rows))][1]) if len(rows) > 9 else list(text)
            old.insert(rng.randrange(len(old) + 1), "#")
            text = "".join(old)
        rows.append((rng.randint(20, 90) if i % 9 == 0 else 1000 - i, text))
    rows += [(None, passage), (None, passage + " tail"), (2, words(9000) + passage)]
    return rows


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA)
    got = [(r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_against_all_strings(spark, monkeypatch):
    monkeypatch.setattr(s, "PART_BYTES", 20_000)
    monkeypatch.setattr(s, "PIECE", 700)
    check(spark, rows_of(random.Random(4)))


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(s, "PART_BYTES", 30_000)
    monkeypatch.setattr(s, "CROWDED", 2)
    check(spark, rows_of(random.Random(8)))


def test_stage_and_empty(spark):
    docs = spark.createDataFrame([(1, "é" * 60, "a", "b", 1), (2, "xé" * 3 + "é" * 60, "a", "b", 1)], SCHEMA)
    out = s.suffix_dedup(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {1: "é" * 60, 2: "xéxéx"}
    assert s.suffix_dedup(docs.limit(0)).count() == 0


def test_deep_shallow():
    rng = np.random.default_rng(1)
    for _ in range(30):
        text = rng.integers(97, 99, (int(rng.integers(1, 60)), 50)).astype(np.uint8)
        text[:, : int(rng.integers(0, 50))] = 97
        order, shared = s.deep_shallow(text)
        rows = [text[i].tobytes() for i in order]
        assert rows == sorted(x.tobytes() for x in text)
        for k in range(1, len(rows)):
            common = next((j for j in range(50) if rows[k][j] != rows[k - 1][j]), 50)
            assert shared[k] == (common if common >= s.SHALLOW else 0)
