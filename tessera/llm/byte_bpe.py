"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task gathers the distinct words of many documents and replays the merges over all of them at once:
an inverted index leads from each pair that a rank merges to the places where it stands, and the
lowest rank in the index is applied everywhere before the next. A merge changes only the pairs with
its two neighbours, which move to other entries of the index.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes of documents whose new words are replayed together, and words remembered between.
CHUNK_BYTES = 16_000_000
REMEMBERED = 400_000
#: Places that one replay indexes at most (a longer word is replayed alone).
REPLAY_BYTES = 4_000_000


class Ranks:
    """A vocabulary of byte strings by rank, and the rank of every pair that makes one of them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.shift = max(self.tokens).bit_length()
        get = self.ranks.get
        keys, merged, early = [], [], set()
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = get(token[:k]), get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << self.shift | right)
                    merged.append(rank)
                    early |= {x for x in (left, right) if x > rank}
        order = np.argsort(keys)
        #: Pairs that make a token, sorted, and the ranks of those tokens.
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        #: Ranks whose merge can bring up a pair of lower rank.
        self.early = early
        byte = np.repeat(self.single, 256), np.tile(self.single, 256)
        self.of_bytes = self.pair_ranks(*byte)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        key = left.astype(np.int64) << self.shift | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1).astype(np.int32)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word (not empty).

        Places are the bytes of all words; a token stands at its first byte, dead places have no token.
        The place n stands for what is before the first and after the last token of a word.
        """
        whole = [self.ranks.get(w) for w in words]
        rest = [w for w, r in zip(words, whole, strict=True) if r is None]
        text = np.frombuffer(b"".join(rest), np.uint8)
        n, size = len(text), np.array([len(w) for w in rest], np.int64)
        start = np.cumsum(size) - size
        tok = np.append(self.single[text], -1).astype(np.int32)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[start + size - 1], before[start] = n, n
        rank_at = np.full(n + 1, -1, np.int32)
        if n:
            rank_at[: n - 1] = self.of_bytes[text[:-1].astype(np.int64) << 8 | text[1:]]
            rank_at[start + size - 1] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Put places under the ranks of the pairs that begin there."""
            ranks = rank_at[places]
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, some in zip(ranks[np.append(0, cuts)].tolist() if len(ranks) else (), np.split(places, cuts), strict=False):
                if rank in index:
                    index[rank].append(some)
                else:
                    index[rank] = [some]
                    heapq.heappush(heap, rank)

        enter(np.arange(n, dtype=np.int32))
        while heap:
            rank = heapq.heappop(heap)
            some = index.pop(rank)
            p = some[0] if len(some) == 1 else np.concatenate(some)
            p = np.unique(p[rank_at[p] == rank])
            if rank in self.early and len(p):  # one place of a word at a time, as a lower rank may come up
                _, first = np.unique(np.searchsorted(start, p, "right"), return_index=True)
                if len(first) < len(p):
                    index[rank] = [p]
                    heapq.heappush(heap, rank)
                    p = p[first]
            q = after[p]
            for i in np.flatnonzero(rank_at[q] == rank).tolist():  # of overlapping places the left one goes first
                if p[i] >= 0 and (k := int(np.searchsorted(np.abs(p), q[i]))) < len(p) and p[k] == q[i]:
                    p[k] = -p[k]
            if len(p) and p.min() < 0:
                p = p[p >= 0]
                q = after[p]
            far = after[q]
            tok[p], after[p], rank_at[q], before[far] = rank, far, -1, p
            left = before[p]
            p = np.concatenate([p, left[left < n]])
            right = tok[after[p]]
            rank_at[p] = np.where(right >= 0, self.pair_ranks(tok[p], right), -1)
            enter(p)
        alive = np.ones(n + 1, bool)
        alive[n] = False
        # A place is dead if the token before it reaches over it.
        alive[:n] = False
        at = start
        while len(at):
            alive[at] = True
            at = after[at]
            at = at[at < n]
        ids = tok[alive].tolist()
        ends = np.cumsum(np.add.reduceat(alive[:n], start, dtype=np.int64)).tolist() if len(start) else []
        done = iter(zip([0, *ends], ends, strict=False))
        return [[r] if r is not None else ids[slice(*next(done))] for r in whole]


@functools.lru_cache(4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


class Numbers(dict):
    """Numbers of words in the order in which they turn up."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts, chunk by chunk, remembering the words that it has replayed."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.find = ranks(path), regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.ids: list[list[int]] = []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        numbers = self.numbers
        spelt = [array("I", map(numbers.__getitem__, self.find(t))) if t else array("I") for t in texts]
        new = [w.encode() for w in list(numbers)[len(self.ids) :]] if len(numbers) > len(self.ids) else []
        at, size = 0, 0
        for i, w in enumerate(new):
            size += len(w)
            if size > REPLAY_BYTES or i + 1 == len(new):
                self.ids += self.ranks.replay(new[at : i + 1])
                at, size = i + 1, 0
        ids = self.ids
        out = []
        for words in spelt:
            out.append(np.array(list(chain.from_iterable(map(ids.__getitem__, words))), np.int32))
        if len(numbers) > REMEMBERED:
            self.forget()
        return out


def _encoder(path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for b in batches:
            texts, at, size = b.column(1), 0, 0
            lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1])
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= CHUNK_BYTES or i + 1 == len(texts):
                    part = encoder.encode(texts.slice(at, i + 1 - at).to_pylist())
                    offsets = np.cumsum([0, *map(len, part)])
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(part), pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, i + 1 - at), ids], ["doc_id", "ids"])
                    at, size = i + 1, 0

    return encode


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs (doc_id, text; more columns are ignored).

    Each match of pattern is merged by itself, without special tokens. Null and empty texts have no
    ids; repeated rows are encoded alike; an empty table gives no rows. ranks_path is read by executors.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_encoder(ranks_path, pattern), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded binary) for every row of encode_documents(): the bytes that its ids stand for.

    Null ids are none. An id that the vocabulary doesn't have is an error.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranks(ranks_path).tokens
        token = np.array([known.get(k) for k in range(max(known) + 1)], object)
        for b in batches:
            for k in range(0, len(b), 1024):
                part = b.slice(k, 1024)
                ids = part.column(1)
                values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy().tolist()
                texts = [b"".join(token[values[i:j]].tolist()) for i, j in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and hashes of decode_documents()."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
