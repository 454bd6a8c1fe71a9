"""Token files against the tokenizers library, by round trips."""

import io
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import token_frames as t

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = t.Encoder(PATH)
SCHEMA = "doc_id long, text string, ids string, start long, file int"


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(), st.sampled_from([" ", "́", "É", "Σ", "<|endoftext|>", "\x1c", "\xa0", "word's", "\n\t", "12 3", "<|", "Straße.", "ÀÉ,", "İx", "ǅ", "ŉ.", "word.,", "Ñandú", "×", "ſŸ", "\x7f", "</w>", "it'LL", "²", "Ɔ"]))))
def test_pieces_equal_whole_texts(parts):
    text = "".join(parts)
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == ids_of(text)


def test_one_frame_is_read_alone():
    docs = [(5, b"abcd" * 300), (None, b""), (9, b"efgh")]
    out = io.BytesIO()
    assert t.write_file(out, docs) == (3, 301)
    reader = t.Reader(pa.BufferReader(out.getvalue()))
    assert reader.ids == [5, None, 9] and [reader.frame(k) for k in (2, 0, 1)] == [docs[k][1] for k in (2, 0, 1)]
    broken = bytearray(out.getvalue())
    broken[12] ^= 0xFF
    with pytest.raises(Exception):
        t.Reader(pa.BufferReader(bytes(broken))).frame(0)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x17F)))
def test_plain_texts_equal_the_library(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == ids_of(text)


@pytest.mark.parametrize("ranges", [10_000, 2])
def test_documents(spark, monkeypatch, tmp_path, ranges):
    monkeypatch.setattr(t, "RANGES", ranges)
    texts = [None, "", " ", "Plain words, twice.", "Ümlaut ÀÉ 123 日本", "<|endoftext|> x", "word " * 3000]
    rows = [((i * 37) % 50, texts[i % 7]) for i in range(40)] + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    files = t.write_tokens(docs, PATH, 2, f"file://{tmp_path}/tokens", 2000)
    assert files.count() > 3
    got = t.digests(t.read_tokens(files)).collect()
    want, start = [], 0
    for d, x in sorted(((d, np.array([*ids_of(x), 2], "<u4").tobytes()) for d, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want.append((d, start, len(x) // 4, zlib.crc32(x)))
        start += len(x) // 4
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    none = t.write_tokens(docs.limit(0), PATH, 2, f"file://{tmp_path}/none")
    assert none.count() == 0 and t.read_tokens(none).count() == 0


def test_other_tokenizers_get_whole_texts():
    other = t.Encoder(P.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert not other.fast and np.frombuffer(other.encode(["Some text, 12."])[0], "<u4").tolist() == library.encode("Some text, 12.", add_special_tokens=False).ids
