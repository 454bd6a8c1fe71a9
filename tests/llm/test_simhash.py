"""SimHash against brute force over all pairs."""

import random

import numpy as np
import xxhash

from tessera.llm import simhash as s

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows):
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d is None, d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True)))


def test_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"W{i}é" if i % 7 == 0 else f"word{i}" for i in range(300)]
    rows = [(5, None), (6, ""), (None, " \n"), (9, "one"), (9, "one"), (10, "two words")]
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        for k in range(rng.choice((1, 1, 2, 5))):
            copy = list(text)
            if k > 1:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((1000 - len(rows), " ".join(copy)))
    rows.append((3, " ".join(rng.choice(words) for _ in range(40000))))
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in s.simhash_components(docs).collect())
    assert got == brute(rows)
    kept = s.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in got})


def test_empty(spark):
    assert s.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def near_pairs(fp, blocks):
    rows, anchors = s.visits(fp, blocks)
    home, found = s.homes(fp, blocks), set()
    by = {}
    for r, a in zip(rows.tolist(), anchors.tolist(), strict=True):
        by.setdefault(a, []).append(r)
    for i, a in enumerate(home.tolist()):
        found |= {(i, j) for j in by[a] if i < j and int(fp[i] ^ fp[j]).bit_count() <= 3} | {(j, i) for j in by[a] if j < i and int(fp[i] ^ fp[j]).bit_count() <= 3}
    return found


def test_cover_finds_every_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 200, np.uint64) * np.uint64(2)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 200, np.uint64)
    fp = np.concatenate([base, near])
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert len(want) >= 200
    for blocks in (1, 2):
        assert near_pairs(fp, blocks) == want


def test_crowded_anchor_is_split(spark, monkeypatch):
    monkeypatch.setattr(s, "HOMES_PER_PART", 8)
    monkeypatch.setattr(s, "BUCKET_ENTRIES", 500)
    fps = [(1 << 60) | v for v in range(64)] + [(0xFF << 30) | (v << 40) for v in range(5)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from tessera.operators.graph import connected_components

    got = {(r.node, r.component) for r in connected_components(s._links(df, len(fps))).collect()}
    assert got == {((1 << 60) | v, 1 << 60) for v in range(64)} | {((0xFF << 30) | (v << 40), 0xFF << 30) for v in range(5)}
