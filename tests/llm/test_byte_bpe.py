"""Byte-level BPE against the tiktoken library, and round trips."""

import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import byte_bpe as b

PATH = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, decoded long"


def library():
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = library()
ENCODER = b.Encoder(PATH, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab \n'stré", max_size=30), st.sampled_from(["aaaaaaa", "    x", "'ll 've", "12345", "ababaabab"]))))
def test_equals_library(texts):
    text = "".join(texts)
    assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_words_are_replayed_together():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeéß ") for _ in range(rng.randint(0, 400))) for _ in range(50)]
    assert [x.tolist() for x in b.Encoder(PATH, P.PATTERN).encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(b, "CHUNK_BYTES", 100)
    texts = [None, "", " ", "Plain words, twice. Plain words, twice.", "日本語 and ümlaut 12345\n\n\tend ", "<|endoftext|>", "z" * 30000, "word " * 20000]
    rows = [(i if i else None, t, "x", 7) for i, t in enumerate([*texts, texts[3]])]
    docs = spark.createDataFrame(rows, SCHEMA)
    done = b.decode_documents(b.encode_documents(docs, PATH, P.PATTERN), PATH)
    for r in done.collect():
        text = rows[r.doc_id or 0][1] or ""
        assert r.ids == LIBRARY.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    digest = {r.doc_id: r for r in b.digests(done).collect()}
    ids = LIBRARY.encode_ordinary(texts[3])
    assert digest[3].n_tokens == len(ids) and digest[3].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert digest[3].decoded_sha256 == hashlib.sha256(texts[3].encode()).hexdigest()
    assert digest[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and digest[None].n_tokens == 0
    assert b.encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0
