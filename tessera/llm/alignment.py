"""Alignment of two tokenizers over the same bytes by bitsets of token ends.

A task lays the bytes of many documents side by side and marks where tokens end in one packed bitset a
tokenizer. Their AND has the shared cuts; popcounts of the words before (a rank directory) and of the
bits below lead from a cut to the tokens that end there. The tokens that end together are linked.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import files, load, load_cached
from tessera.session import cut

#: Text bytes of documents that are tokenized and laid side by side at once (a longer document is alone).
CHUNK_BYTES = 1_000_000
#: Links that are counted, or looked up, together.
LINKS = 4_000_000
#: Pairs in a file of counts, about, which a task reads whole.
FILE_PAIRS = 250_000

#: Fixed value: how byte-level pre-tokenizers split texts.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The bytes that characters stand for in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """A byte-level BPE vocabulary from its JSON file.

    Where every merge makes the id after those before it, merging by rank and by the id of what is made are
    the same, and the texts go to tiktoken, which is faster; tests hold it against the tokenizers library.
    A file with other steps goes to that library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            plain = json.load(f)
        model, pre = plain["model"], plain["pre_tokenizer"] or {}
        of = byte_characters()
        added = {t["id"]: t["content"].encode() for t in plain["added_tokens"]}
        by_id = {i: bytes(of[c] for c in t) for t, i in model["vocab"].items() if i not in added} | added
        self.bytes = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ordered = all(model["vocab"].get(m) == 256 + k for k, m in enumerate(merges))
        simple = not plain["normalizer"] and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        if ordered and simple and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True):
            import tiktoken

            encoding = tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks={b: i for i, b in by_id.items() if i not in added}, special_tokens={})
            self.encode = lambda texts: list(map(encoding.encode_ordinary, texts))
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        self.encode = lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


class PieceTokens:
    """A sentencepiece vocabulary with byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(library.vocab_size())
        self.bytes = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, library.id_to_piece(i)) for i in ids)]
        self.encode = lambda texts: library.encode(texts, num_threads=1)


class Bits:
    """A packed bitset with ranks."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    @functools.cached_property
    def before(self) -> np.ndarray:
        """Set bits in all words before each."""
        n = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        return np.concatenate([[0], n])[:-1]

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def places(self) -> np.ndarray:
        """The places of all set bits, ascending."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Aligner:
    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a, self.b = ByteTokens(byte_path), PieceTokens(piece_path)
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        #: Low bits of a link, for the id of B.
        self.shift = (len(self.b.bytes) - 1).bit_length()
        self.kind = np.int32 if (len(self.a.bytes) - 1) << self.shift < 1 << 31 else np.int64
        # Each id as it is written within a group's side and as its last: 2 id, 2 id + 1, then those of B.
        self.written = [f"{i}{e}".encode() for n, ends in ((len(self.a.bytes), ",|"), (len(self.b.bytes), ",;")) for i in range(n) for e in ends]
        self.written_sizes = np.array([len(x) for x in self.written], np.int64)

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none where a side's bytes differ from a space and the text."""
        some = [t or "" for t in texts]
        spaced = [f" {t}" for t in some]
        both = [self.a.encode(spaced), self.b.encode(some)]
        of_a, of_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        for k, t in enumerate(spaced):
            whole = t.encode()
            if len(whole) == 1 or b"".join(map(of_a, both[0][k])) != whole or b"".join(map(of_b, both[1][k])) != whole:
                both[0][k], both[1][k] = [], []
        return both[0], both[1]

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups_sha256, links as bytes) of each text."""
        ids, ends, counts = [], [], []
        for tokens, size in zip(self.tokens(texts), self.sizes, strict=True):
            counts.append(np.array([len(t) for t in tokens], np.int64))
            ids.append(np.fromiter(itertools.chain.from_iterable(tokens), np.int64, int(counts[-1].sum())))
            ends.append(np.cumsum(size[ids[-1]]) - 1)
        if not len(ids[0]):
            return [(0, 0, 0, "", b"")] * len(texts)
        total = int(ends[0][-1]) + 1
        bits = [Bits.of(e, total) for e in ends]
        cuts = (bits[0] & bits[1]).places()
        last = [b.rank(cuts) for b in bits]  # the token of each side that ends at a cut
        links = (ids[0][last[0]] << self.shift | ids[1][last[1]]).astype(self.kind)
        stop = np.cumsum(counts[0])  # the last tokens of documents end at cuts, so groups of a document are whole
        groups = np.diff(np.searchsorted(last[0], stop - 1, "right"), prepend=0)
        data, cut_at = self._groups(ids, last), np.cumsum(counts[0] + counts[1])
        edges = np.concatenate([[0], np.cumsum(self.written_sizes[data])])[np.concatenate([[0], cut_at])].tolist()
        text = memoryview(b"".join(map(self.written.__getitem__, data.tolist())))
        out, at = [], 0
        for k, n in enumerate(groups.tolist()):
            sha = hashlib.sha256(text[edges[k] : edges[k + 1] - 1]).hexdigest() if n else ""
            out.append((int(counts[0][k]), int(counts[1][k]), n, sha, links[at : at + n].tobytes()))
            at += n
        return out

    def _groups(self, ids: list[np.ndarray], last: list[np.ndarray]) -> np.ndarray:
        """The entries of `written` that spell all groups: tokens of A, then of B, group by group."""
        ends = [x + 1 for x in last]
        sizes = [np.diff(e, prepend=0) for e in ends]
        out = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        before_b, through_a = ends[1] - sizes[1], ends[0]
        for side, moved, code in ((0, before_b, 0), (1, through_a, 2 * len(self.a.bytes))):
            codes = 2 * ids[side] + code
            codes[last[side]] += 1
            out[np.arange(len(codes)) + np.repeat(moved, sizes[side])] = codes
        return out


@functools.lru_cache(2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK_BYTES."""
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        size += n
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            yield at, i + 1
            at, size = i + 1, 0


def align_documents(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links binary) of every row of docs (doc_id, text; more columns are ignored).

    byte_path is a byte-level vocabulary (A), which encodes a space and the text; piece_path a
    sentencepiece model (B), which adds that space itself. Null and empty texts, and those that a side
    doesn't give back byte for byte, have no tokens. links has a number for each pair of tokens that end
    together: the id of A above the bits of the id of B. Repeated rows are aligned alike; an empty table
    gives no rows. The files are read by executors.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = aligner(byte_path, piece_path)
        for b in batches:
            for i, j in _chunks(b.column(1)):
                part = b.slice(i, j - i)
                columns = zip(*with_.align(part.column(1).to_pylist()), strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(align, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def _gathered(batches: Iterator[pa.RecordBatch], kind) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """Batches with about LINKS links (in their last column) together, and those links."""
    held, parts, n = [], [], 0
    for b in batches:
        for k in range(0, len(b), 64):
            held.append(b.slice(k, 64))
            parts += [np.frombuffer(x.as_buffer() or b"", kind) for x in held[-1].column(held[-1].num_columns - 1)]
            n += sum(map(len, parts[-len(held[-1]) :]))
            if n >= LINKS:
                yield held, np.concatenate(parts)
                held, parts, n = [], [], 0
    if held:
        yield held, np.concatenate(parts)


def pair_counts(aligned: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(pair, n): how many links of the whole corpus each pair has; pair is a number as in links."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, links in _gathered(batches, aligner(byte_path, piece_path).kind):
            pairs, n = np.unique(links, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    return aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_statistics(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """align_documents() with n_links, n_best (links whose pair is the most frequent of its id of B, ties included) and count_sum (of the pairs' counts over links).

    Counts are of the whole corpus. Tasks read those over one from files sorted by pair, a file at a time,
    and look up the links that they hold in each; the highest count of each id of B is a row an id, as many as
    the vocabulary has. So memory is bounded, however many pairs there are.
    """
    aligned = cut(align_documents(docs, byte_path, piece_path))
    counts = cut(pair_counts(aligned, byte_path, piece_path))
    shift = aligner(byte_path, piece_path).shift
    best = cut(counts.groupBy(F.col("pair").bitwiseAND(F.lit((1 << shift) - 1)).alias("id")).agg(F.max("n").alias("n")))
    many = counts.where("n > 1")
    parts = max(1, -(-many.count() // FILE_PAIRS))
    tables, best_files = files(cut(many.repartitionByRange(parts, "pair").sortWithinPartitions("pair"))), files(best)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = aligner(byte_path, piece_path)
        top = np.zeros(len(with_.b.bytes), np.int64)
        for f in best_files:
            t = load(f)
            top[t["id"].to_numpy()] = t["n"].to_numpy()
        for held, links in _gathered(batches, with_.kind):
            pairs, which = np.unique(links, return_inverse=True)
            n = np.ones(len(pairs), np.int64)
            for f in tables if len(pairs) else ():
                known, counted = (c.to_numpy() for c in load_cached(f).columns)
                if len(known):
                    here = slice(*np.searchsorted(pairs, [known[0], known[-1] + 1]))
                    at = np.searchsorted(known, pairs[here])
                    n[here] = np.where(known[at] == pairs[here], counted[at], 1)
            is_best = n == top[pairs & ((1 << with_.shift) - 1)]
            sums = [np.concatenate([[0], np.cumsum(v[which])]) for v in (n, is_best.astype(np.int64))]
            stop = 0
            for b in held:
                sizes = pc.binary_length(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False) // links.itemsize
                edges = stop + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                stop = int(edges[-1])
                count_sum, n_best = (np.diff(s[edges]) for s in sums)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes.astype(np.int64)), pa.array(n_best), pa.array(count_sum)], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]
    return aligned.mapInArrow(look_up, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")
