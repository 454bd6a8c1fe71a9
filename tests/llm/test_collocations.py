"""Collocations against plain counting of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import collocations as m

SCHEMA = "lang string, text string, phrase string, n long, score long"


def plain(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= m.LEAST}
    out = []
    for (lang, w), a in found.items():
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        longer = [b for (other, v), b in found.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= 80 * a for b in longer):
            out.append((lang, -score, -a, " ".join(w).encode(), left, right, n[lang]))
    ranked, at = [], Counter()
    for lang, score, a, phrase, left, right, words in sorted(out):
        at[lang] += 1
        if at[lang] <= m.TOP:
            ranked.append((lang, at[lang], phrase.decode(), -a, left, right, words, -score))
    return ranked


def texts(seed, n=150):
    rng = random.Random(seed)
    words = "a b the The of é ÉX 日本 x-y New york CITY 10 \x00 ok".split(" ")
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ", "\x1c", "!?"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.choice((4, 13))]) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, "und", ""]), text + rng.choice(["", "new york city hall ", " a a a a a a a"])))
    return [*rows, ("en", None), (None, ""), ("en", rows[0][1]), ("en", rows[0][1]), ("de", "long " * 3000), ("en", "y" * 70_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("top", "tight"), [(2000, False), (5, True)])
def test_against_plain(spark, monkeypatch, top, tight):
    monkeypatch.setattr(m, "TOP", top)
    if tight:  # many small chunks, files and sketches
        for name, value in {"CHUNK_BYTES": 500, "HELD": 20, "CELLS": 300, "FILE_BYTES": 300, "ROW_BITS": (6, 8), "BUCKET_BITS": 4}.items():
            monkeypatch.setattr(m, name, value)
    rows = texts(7)
    got = m.collocations(frame(spark, rows), top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_no_phrases(spark):
    assert m.collocations(frame(spark, []).limit(0)).count() == 0
    assert m.collocations(frame(spark, [("en", "a b c"), (None, None)])).count() == 0


def test_scores_pass_64_bits(spark):
    big = 3 * 10**13
    phrases = spark.createDataFrame([("en", "a b", big), ("en", "a b c", big - 1)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", w, big + k) for k, w in enumerate("abc")], "lang string, phrase string, a long")
    got = {r.phrase: r for r in m.scored(phrases, words).collect()}
    assert got["a b"].score == 2000000 * big // (2 * big + 1)
    cuts = [(2000000 * (big - 1) // (big + big + 2), big, big + 2)]
    assert (got["a b c"].score, got["a b c"].r) >= cuts[0][:1] and m.absorbed(phrases).collect()[0].phrase == "a b"


def test_sieve_lets_all_frequent_phrases_through():
    hashes = m._mixed(np.arange(5000, dtype=np.uint64) * m._TIMES)
    for row in range(m.ROWS):
        cells = m.cells_of(hashes, row, 20)
        packed = list(m._packed(2, row, np.concatenate([cells, cells])))
        assert sum(len(p[3]) for p in packed) == 4 * len(set(cells.tolist())) and all(min(p[4]) >= 2 for p in packed)


def test_oracle(spark):
    import duckdb

    from tessera.llm import queries

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = queries.op13_collocations(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(m.oracle_sql()).fetchall())


def test_more_candidates_are_no_more_scans(spark, monkeypatch):
    spelling = m.chunks(frame(spark, texts(9)).select("lang", "text").dropna())
    words = m.word_counts(spelling).where(f"n >= {m.LEAST}")
    plans = []
    for size in (2_000_000, 200):
        monkeypatch.setattr(m, "FILE_BYTES", size)
        plans.append(m.phrase_counts(spelling, words, 5000)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
    assert plans[0] == plans[1]
