"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds one frame for each document (its ids as little-endian unsigned 32-bit integers), then a
skippable frame with the documents' ids, then the seek table of the public seekable format: for each
frame its compressed size, its size, and the low 32 bits of the XXH64 of its contents. A reader finds
a document's frame from the end of the file and decompresses that frame only.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.session import cut, open_folder, shared_dir, text_parts

#: Fixed values of the formats: skippable frames for the documents' ids and the seek table, and the table's end.
SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

#: Bytes of text whose ids go into a file, about, and ranges of doc_id at most; a range makes as many files as it needs.
FILE_TEXT_BYTES, RANGES = 16_000_000, 10_000
#: Accuracy of the cuts between ranges, as percentile_approx has it.
ACCURACY = 100_000
#: Words that an encoder remembers, and words sent to the library at once.
REMEMBERED, AT_ONCE = 600_000, 10_000

#: The steps before the vocabulary that the fast way knows.
NORMALS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Texts of these characters are left alone by NFC, and lower-case one by one into others of them.
_CAPITALS, _SMALL = "A-Z\u00c0-\u00d6\u00d8-\u00de", "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
_plain = re.compile(f"[\t\n\r -~{_CAPITALS}{_SMALL}]*").fullmatch
#: SPLIT over such texts in lower case.
_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_SMALL}]+|[0-9]|[^\\s{_SMALL}0-9]+").findall


class Encoder:
    """The tokenizers library, asked once for each word.

    The tokenizer drops white space and never merges over its splits, so a text's ids are those of its
    words. Texts of plain Latin characters are lower-cased and split here, and new words go to the library
    with these steps and its cache taken out: many at once, each ending with a token that ends a word.
    Other texts are cut at ASCII white space, and those pieces go to the whole library, many in one call,
    with a special token between them. Tokenizers with other steps get whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = "<|startoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        with open(path, encoding="utf-8") as f:
            plain = json.load(f)
        model = plain["model"]
        suffix = model.get("end_of_word_suffix")
        normals = [n["type"] for n in (plain["normalizer"] or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (plain["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.known: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.fast = bool(suffix) and self.mark_id is not None and normals == NORMALS and splits[:1] == [SPLIT] and not model.get("dropout")
        if not self.fast:
            return
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.letters = Tokenizer.from_str(json.dumps(plain | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.letters.model = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix, cache_capacity=0)
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        # The characters that stand for bytes: printable ones for themselves, others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)} | {32: " "}

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), AT_ONCE):
            some = words[k : k + AT_ONCE]
            text = " ".join(some).encode().decode("latin-1").translate(self.bytes)
            ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            self.known.update((w, data[i:j]) for w, i, j in zip(some, [0, *cuts], cuts, strict=False))
            if len(cuts) != len(some):
                raise ValueError("a word doesn't end with the end of a word")

    def _learn_pieces(self, pieces: list[bytes]) -> None:
        for p in pieces:
            if b"<|" in p:  # may hold special tokens
                self.pieces[p] = np.array(self.tokenizer.encode(p.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        pieces = [p for p in pieces if b"<|" not in p]
        for k in range(0, len(pieces), AT_ONCE):
            some = pieces[k : k + AT_ONCE]
            ids = np.array(self.tokenizer.encode(self.mark.join(p.decode() for p in some), add_special_tokens=False).ids, "<u4")
            cuts = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            data = ids.tobytes()
            for p, (i, j) in zip(some, itertools.pairwise(cuts), strict=True):
                self.pieces[p] = data[4 * i + 4 : 4 * j]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if not self.fast:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        for known in (self.known, self.pieces):
            if len(known) > REMEMBERED:
                known.clear()
        split: list[list] = []
        words: set[str] = set()
        pieces: set[bytes] = set()
        for t in texts:
            t = t or ""
            if "<|" not in t and _plain(t):
                split.append(_words(t.lower()))
                words.update(itertools.filterfalse(self.known.__contains__, split[-1]))
            else:
                split.append(t.encode().split())
                pieces.update(itertools.filterfalse(self.pieces.__contains__, split[-1]))
        self._learn(list(words))
        self._learn_pieces(list(pieces))
        return [b"".join(map((self.pieces if s and isinstance(s[0], bytes) else self.known).__getitem__, s)) for s in split]


@functools.lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_file(out, documents: Iterable[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write (id, ids as bytes) documents to a binary file object; the numbers of documents and token ids."""
    compress = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
    entries, names, tokens = [], [], 0
    for name, data in documents:
        if len(data) >= 1 << 32:
            raise ValueError("a document of 4 GB of ids doesn't fit the seek table")
        frame = compress(data)
        out.write(frame)
        entries.append(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        names.append(struct.pack("<?q", name is not None, name or 0))
        tokens += len(data) // 4
    body = b"".join(names)
    out.write(struct.pack("<II", SKIPPABLE_IDS, len(body)) + body)
    table = b"".join(entries) + struct.pack("<IBI", len(entries), CHECKSUMS, SEEKABLE)
    out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
    return len(entries), tokens


class Reader:
    """Random access to the documents of a file, in their order."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a file of seekable frames with checksums")
        head = size - 9 - 12 * n - 8
        if struct.unpack("<II", source.read_at(8, head)) != (SKIPPABLE_TABLE, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(source.read_at(12 * n, head + 8), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.append(0, np.cumsum(self.table[:, 0]))
        names = source.read_at(9 * n + 8, int(self.starts[-1]))
        if struct.unpack("<II", names[:8]) != (SKIPPABLE_IDS, 9 * n):
            raise ValueError("the list of documents is damaged")
        self.ids = [v if has else None for has, v in struct.iter_unpack("<?q", names[8:])]

    def __len__(self) -> int:
        return len(self.table)

    def frame(self, k: int) -> bytes:
        """The contents of document k, decompressing nothing else."""
        packed, size, check = self.table[k].tolist()
        return self._open(self.source.read_at(packed, int(self.starts[k])), size, check)

    def frames(self, at_once: int = 512) -> Iterator[bytes]:
        """The contents of all documents, reading many frames at once."""
        for k in range(0, len(self), at_once):
            end = min(k + at_once, len(self))
            data = self.source.read_at(int(self.starts[end] - self.starts[k]), int(self.starts[k]))
            for i in range(k, end):
                a = int(self.starts[i] - self.starts[k])
                yield self._open(data[a : a + int(self.table[i, 0])], *self.table[i, 1:].tolist())

    def _open(self, frame: bytes, size: int, check: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(frame, max_output_size=max(1, size))
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError("a frame doesn't match its checksum")
        return data


def _encode(tokenizer: str, end_id: int, cuts: list[int]):
    edges, end = np.array(cuts, np.int64), np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for b in batches:
            for k in range(0, len(b), 1000):
                part = b.slice(k, 1000)
                ids = [x + end for x in encoder.encode(part.column(1).to_pylist())]
                at = [-1 if d is None else int(np.searchsorted(edges, d, "left")) for d in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), part.column(0), pa.array(ids, pa.binary())], ["range", "doc_id", "ids"])

    return encode


def _write(folder: str, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range and document. A file appears under its name only when it is whole."""
        fs, base = open_folder(folder)
        rows = ((f, d, i) for b in batches for f, d, i in zip(*(c.to_pylist() for c in b.columns), strict=True))
        done, row, part = [], next(rows, None), 0

        def one(at: int) -> Iterator[tuple[int | None, bytes]]:
            nonlocal row
            size = 0
            while row is not None and row[0] == at and size < most:
                size += len(row[2])
                yield row[1:]
                row = next(rows, None)

        while row is not None:
            at = row[0]
            part = part + 1 if done and done[-1][0] == at else 0
            file = f"{at + 1:05d}-{part:06d}.zst"
            name, draft = f"{base}/{file}", f"{base}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                counts = write_file(out, one(at))
            if fs.get_file_info(name).type != pa.fs.FileType.NotFound:
                fs.delete_file(name)  # of an earlier attempt, with the same contents
            fs.move(draft, name)
            done.append((at, part, f"{folder}/{file}", *counts))
        if done:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], ["range", "part", "path", "n_docs", "n_tokens"])

    return write


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, file_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Encode every row of docs (doc_id, text; more columns are ignored) into files under folder.

    (range, part, path, n_docs, n_tokens, start) of each file: ids ascend through ranges and their parts,
    rows without an id come first, rows of one id are in the order of their token ids; start counts the
    token ids of all files before. Null and empty texts have the end id alone; an empty table makes no
    file. A file holds the ids of about file_bytes of text.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = min(text_parts(plain, "text", file_bytes), RANGES)
    cuts = plain.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], ACCURACY)).first()[0] if ranges > 1 else []
    fs, base = open_folder(folder)
    fs.create_dir(base)
    encoded = plain.mapInArrow(_encode(tokenizer, end_id, sorted(set(cuts or []))), "range int, doc_id long, ids binary")
    dealt = encoded.repartitionById(ranges + 1, F.col("range") + 1).sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "ids")
    written = cut(dealt.mapInArrow(_write(folder, 2 * file_bytes), "range int, part int, path string, n_docs long, n_tokens long"))
    totals = sorted(written.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r.range)  # a row a range
    before = list(itertools.accumulate((r.n for r in totals), initial=0))
    starts = docs.sparkSession.createDataFrame([(r.range, n) for r, n in zip(totals, before, strict=False)], "range int, before long")
    own = W.Window.partitionBy("range").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    return written.join(F.broadcast(starts), "range").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).drop("before")


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids binary) for every document of files (as write_tokens() returns them), checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, name = open_folder(path)
                with fs.open_input_file(name) as source:
                    reader = Reader(source)
                    out, size = [], 0
                    for name, data in zip(reader.ids, reader.frames(), strict=True):
                        out.append((name, start, data))
                        start += len(data) // 4
                        size += len(data)
                        if size > 4_000_000:
                            yield _batch(out)
                            out, size = [], 0
                    if out:
                        yield _batch(out)

    files = cut(files.select("path", "start"))
    tasks = max(1, min(files.count(), RANGES))
    return files.repartition(tasks).mapInArrow(read, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])


def digests(tokens: DataFrame) -> DataFrame:
    """Counts and checksums of read_tokens()."""
    return tokens.select("doc_id", "start", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
