"""Alignment of two tokenizers against sets of byte offsets and plain counting."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import alignment as m

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, links string, n_a long"


@pytest.fixture(scope="module")
def plain():
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    spelt = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    spelt |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in spelt.values())}

    def of_a(i):
        return bytes(spelt[c] for c in library.id_to_token(i))

    def of_b(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    def one(text):
        """Tokens of both with where they end, and the shared ends."""
        if not text:
            return [], [], []
        sides = [[(i, of_a(i)) for i in library.encode(f" {text}", add_special_tokens=False).ids], [(i, of_b(i)) for i in pieces.encode(text)]]
        if any(b"".join(x for _, x in s) != f" {text}".encode() for s in sides):
            return [], [], []
        ended = []
        for s in sides:
            at, out = 0, []
            for i, x in s:
                at += len(x)
                out.append((at, i))
            ended.append(out)
        return *ended, sorted({e for e, _ in ended[0]} & {e for e, _ in ended[1]})

    def all_of(texts):
        done = [one(t) for t in texts]
        links = [[(i, j) for e, i in a for f, j in b if e == f] if len(a) < 500 else [(dict(a)[e], dict(b)[e]) for e in c] for a, b, c in done]
        counts, best = Counter(x for k in links for x in k), defaultdict(int)
        for (_, j), n in counts.items():
            best[j] = max(best[j], n)
        out = []
        for (a, b, c), k in zip(done, links, strict=True):
            groups, low = [], 0
            for e in c:
                groups.append("|".join(",".join(str(i) for f, i in s if low < f <= e) for s in (a, b)))
                low = e
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
            out.append((len(a), len(b), len(c), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), sha))
        return out

    return all_of


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_against_plain(spark, plain, monkeypatch):
    monkeypatch.setattr(m, "CHUNK_BYTES", 300)
    monkeypatch.setattr(m, "LINKS", 200)
    monkeypatch.setattr(m, "FILE_PAIRS", 20)
    rng = random.Random(3)
    words = "the of and Über naïve 日本語 don't 12345 x\ty <s> <|endoftext|> ▁ <0x41> a--b \n\n  wide   gap".split(" ")
    texts = [None, "", " ", "  ", "\n", "▁ is no blank", "<|endoftext|></s><unk>", "plain words here", "plain words here", "é" * 300, "z" * 3000]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)]
    rows = [(k if k % 7 else None, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((r.doc_id or 0, tuple(r[c] for c in COLUMNS)) for r in m.link_statistics(docs, BYTES, PIECES).collect())
    assert got == sorted((r[0] or 0, p) for r, p in zip(rows, plain(texts), strict=True))
    assert m.link_statistics(docs.limit(0), BYTES, PIECES).count() == 0


def test_texts_without_any_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert all(tuple(r)[1:] == (0, 0, 0, "", 0, 0, 0) for r in m.link_statistics(docs, BYTES, PIECES).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.text("ab \n'stré▁<>", max_size=30))))
def test_each_text(plain, texts):
    got = m.aligner(BYTES, PIECES).align(texts)
    assert [(*x[:3], x[3]) for x in got] == [(*x[:3], x[6]) for x in plain(texts)]


@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)))
def test_bitsets(a, b):
    first, second = (m.Bits.of(np.array(sorted(x), int), 301) for x in (a, b))
    both = first & second
    assert both.places().tolist() == sorted(a & b)
    at = np.arange(301)
    assert first.rank(at).tolist() == [sum(x < k for x in a) for k in at]


def test_other_vocabularies_go_to_the_library(tmp_path):
    with open(BYTES, encoding="utf-8") as f:
        plain = json.load(f)
    plain["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(plain))
    other, same = m.ByteTokens(str(tmp_path / "other.json")), m.ByteTokens(BYTES)
    assert other.encode(["word <|endoftext|>"]) == same.encode([" word <|endoftext|>"]) and other.bytes == same.bytes
