"""Quality rules against a brute-force version in plain Python and numpy."""

import math
import re

import numpy as np
import pytest

from tessera.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def brute_stats(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


CASES = [
    None,
    "",
    " \t\n",
    "one two three",
    "word " * 30,
    "a b c d e f g h " * 2 + "x " * 3,
    " ".join(f"w{i}" for i in range(40)) + "\nsame line\nsame line\n\n",
    "# $ % & | < > *** " + " ".join(f"é{i}" for i in range(25)),
    " ".join(f"long{i % 977}x{i}" for i in range(30000)),
    "non breaking space stays " + " ".join(f"k{i}" for i in range(20)),
    " ".join(f"p{i}" for i in range(12)) + " " + " ".join(f"p{i}" for i in range(12)) + " " + " ".join(f"r{i}" for i in range(60)),
]


def test_base_statistics(spark):
    rows = [(i if i else None, t, None if i % 3 == 0 else "en", "s", None, "clash") for i, t in enumerate(CASES + CASES[-2:])]
    out = q.quality_scores(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == sorted(brute_stats(r[1]) for r in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert isinstance(r.kept, bool) and not (r.base_failed and r.kept)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert q.quality_rules(empty).count() == 0


FLOOR = np.diag((np.array(q.FLOORS) * q.STEPS) ** 2)


def brute_mcd(x):
    """Mean and covariance of least determinant, from the plain estimate and from medians, in numpy."""
    found = []
    middle = np.sort(x, 0)[(len(x) - 1) // 2]
    spread = np.sort(np.abs(x - middle), 0)[(len(x) - 1) // 2]
    for mean, cov in ((x.mean(0), np.cov(x.T, bias=True)), (middle, np.diag((q.MAD * spread) ** 2))):
        for _ in range(q.ROUNDS):
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + FLOOR), x - mean)
            bucket = np.floor(q.BUCKETS * np.log(d2 + 1e-3))
            rows = x[bucket <= np.sort(bucket)[math.ceil(q.SUPPORT * len(x)) - 1]]
            mean, cov = rows.mean(0), np.cov(rows.T, bias=True).reshape(len(mean), -1)
        found.append((round(np.linalg.slogdet(cov + FLOOR)[1], 9), len(found), mean, cov))
    return min(found, key=lambda f: f[:2])[2:]


def blend(n, own, wider):
    return tuple((n * a + q.WEIGHT * b) / (n + q.WEIGHT) for a, b in zip(own, wider, strict=True))


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(500):
        n = int(rng.integers(30, 400))
        words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) for _ in range(n)]
        if i % 25 == 0:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 2}", n, "x"))
    return rows


def test_outliers_match_numpy(spark, mixed):
    mixed = [(*r[:2], "de" if r[0] % 10 == 3 else None if r[0] % 10 == 4 else r[2], *r[3:]) for r in mixed] + [(900, " ".join(f"odd{k}" for k in range(40)), "x/=y", "z", 1, "")]
    out = {r.doc_id: r for r in q.quality_scores(spark.createDataFrame(mixed, SCHEMA)).collect()}
    step = lambda v: math.floor(q.STEPS * math.log(v) + 0.5)
    x, group = {}, {}
    for i, text, lang, source, *_ in mixed:
        if not out[i].base_failed:
            n, c, s, d, w = brute_stats(text)
            x[i] = [step(n), step(c / n), step(1 + 100 * s / c), step(1 + 100 * d / n), step(1 + 100 * w / n)]
            group[i] = (lang, source)
    of = lambda ids: (len(ids), brute_mcd(np.array([x[i] for i in ids], float)))
    every = of(list(x))[1]
    for g in set(group.values()):
        n, own = of([i for i in x if group[i] == g])
        nl, lang = of([i for i in x if group[i][0] == g[0]])
        mean, cov = blend(n, own, blend(nl, lang, every))
        at = [i for i in x if group[i] == g]
        v = np.array([x[i] for i in at], float) - mean
        d2 = np.einsum("ij,jk,ik->i", v, np.linalg.inv(q.CONSISTENCY * cov + FLOOR), v)
        assert np.allclose([out[i].distance2 for i in at], d2, rtol=1e-6)
    assert {i for i, r in out.items() if not r.kept} == {i for i in range(0, 500, 25)} | {i for i, r in out.items() if r.base_failed}


def test_a_third_of_outliers_does_not_hide_itself(spark, mixed):
    """All of one group; the plain estimate, where three in four rows count, keeps them."""
    rows = [(i, t if i % 3 else t.replace(" ", "### "), "en", "s", 1, "x") for i, t, *_ in mixed if i % 25]
    out = {r.doc_id: r for r in q.quality_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r.kept for i, r in out.items() if i % 3 == 0)
    assert sum(r.kept for i, r in out.items() if i % 3) > 0.98 * sum(not r.base_failed for i, r in out.items() if i % 3)


def test_filter_keeps_columns(spark, mixed):
    docs = spark.createDataFrame(mixed, SCHEMA)
    kept = q.quality_rules(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in q.quality_scores(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == ids
    assert {r.kept for r in kept.collect()} == {"x"}
