"""Collocations of two to four words, counted exactly by automata over candidates from sketches.

0. Texts are spelt once: chunks of one language with their words as numbers.
1. Words are counted exactly; those that are too rare can't stand in a phrase.
2. Count-min sketches of phrases bound their counts from above, first of two words, then of three and four
   whose shorter phrases all pass. A sketch is two rows of cells that lie with Spark, in buckets of cells;
   tasks send the cells that they met, and only which cells reach the least count comes back, as bits.
3. Phrases whose words, shorter phrases and cells all pass are the candidates.
4. A task's own candidates become automata over texts whose words stand between single blanks; each runs over
   the task's chunks in which they were met, and matches, overlapping ones included, are summed.
5. Thresholds, scores and the rest are joins and aggregates over the exact counts.

Sketches only choose what is counted: too small ones make more candidates, never other results.
"""

from __future__ import annotations

import functools
import operator
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count as counter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.llm.shared import files, load
from tessera.session import cut

#: The contract's numbers: words of a phrase, the least count, the share of a longer phrase that absorbs one, and rows a language.
LONGEST, LEAST, ABSORBS_PERCENT, TOP = 4, 30, 80, 2000

#: Bytes of text of one language taken together, words and phrases that a task holds before it sends them on.
CHUNK_BYTES, HELD = 4_000_000, 400_000
#: Cells that a task counts before it sends them on, cells of a bucket, and the bits of a row's cells at least and at most.
CELLS, BUCKET_BITS, ROW_BITS = 3_000_000, 20, (16, 28)
ROWS = 2
#: Bytes of the phrases whose automaton is in a task's memory, and of the chunks that a task holds for it, about.
FILE_BYTES, SCANNED_BYTES = 2_000_000, 48_000_000

_CAPITALS, _ENDS = bytes(range(65, 91)), b".,;:!?\n\x0b\x0c\r"
_SPELL = bytes.maketrans(_CAPITALS + b"\t" + _ENDS, _CAPITALS.lower() + b" " + b"\n" * len(_ENDS))
#: Fixed odd numbers that mix hashes.
_TIMES, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def spelt(texts: bytes) -> list[bytes]:
    """The words of texts with lower-case A-Z, b"\\n" wherever a piece ends, and empty strings between blanks."""
    return texts.translate(_SPELL).replace(b"\n", b" \n ").split(b" ")


def _blobs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts with an end of a piece between them) of batches of (lang, text)."""
    held, size = defaultdict(list), 0
    for b in batches:
        for k in range(0, len(b), 256):
            for lang, text in zip(*(c.to_pylist() for c in b.slice(k, 256).columns), strict=True):
                held[lang].append(data := text.encode())
                size += len(data)
            if size >= CHUNK_BYTES:
                yield from ((lang, b"\n".join(t)) for lang, t in held.items())
                held, size = defaultdict(list), 0
    yield from ((lang, b"\n".join(t)) for lang, t in held.items())


def _batch(columns: Iterable, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


#: A chunk: its words, each once, with b"\n" between them, and the numbers (32 bits) of all words in order: from 1, 0 for the end of a piece.
CHUNK = {"lang": pa.string(), "words": pa.binary(), "ids": pa.binary()}
CHUNK_SCHEMA = "lang string, words binary, ids binary"


def chunks(docs: DataFrame) -> DataFrame:
    """docs (lang, text, both without nulls) as chunks of many texts of one language."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _blobs(batches):
            numbers = defaultdict(counter().__next__)
            numbers[b"\n"]
            found = list(filter(None, spelt(texts)))
            ids = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
            words = list(numbers)[1:]
            if words:
                yield _batch([[lang], [b"\n".join(words)], [ids.tobytes()]], CHUNK)

    return docs.select("lang", "text").mapInArrow(spell, CHUNK_SCHEMA)


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words from number 0 on, numbers in order) of each chunk."""
    for b in batches:
        for k in range(len(b)):
            lang, words, ids = (c[k] for c in b.columns)
            yield lang.as_py(), [b"\n", *words.as_py().split(b"\n")], np.frombuffer(ids.as_buffer(), np.int32)


def word_counts(spelling: DataFrame) -> DataFrame:
    """(lang, word, n) of chunks()."""
    kinds = {"lang": pa.string(), "word": pa.string(), "n": pa.int64()}

    def flush(held: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            words = list(counts)
            for k in range(0, len(words), 50_000):
                some = words[k : k + 50_000]
                yield _batch([[lang] * len(some), [w.decode() for w in some], list(map(counts.__getitem__, some))], kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {}
        for lang, words, ids in _opened(batches):
            counts = held.setdefault(lang, {})
            n, known = np.bincount(ids, minlength=len(words))[1:].tolist(), counts.get
            counts.update((w, known(w, 0) + k) for w, k in zip(words[1:], n, strict=True))
            if sum(map(len, held.values())) > HELD:
                yield from flush(held)
                held = {}
        yield from flush(held)

    return spelling.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


@functools.lru_cache(1024)
def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def word_hashes(lang: str, words: Iterable[bytes]) -> np.ndarray:
    digest, seed = xxhash.xxh3_64_intdigest, _seed(lang)
    return np.array([digest(w, seed) for w in words], np.uint64)


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of a sketch; rows take different bits of it."""
    return (hashes >> np.uint64(32 * row) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Sieve:
    """Which cells pass, as packed bits for each (words of a phrase, row)."""

    def __init__(self, paths: tuple[str, ...], bits: int) -> None:
        self.bits, self.rows = bits, {}
        for path in paths:
            t = load(path)
            for words, row, cells in zip(*(t[c].to_pylist() for c in ("words", "row", "cells")), strict=True):
                at = np.frombuffer(cells, "<u4")
                flags = self.rows.setdefault((words, row), np.zeros(1 << max(0, bits - 3), np.uint8))
                if len(at):  # ascending, each once
                    byte, first = np.unique(at >> 3, return_index=True)
                    flags[byte] |= np.bitwise_or.reduceat(np.uint8(1) << (at & 7).astype(np.uint8), first)

    def passing(self, hashes: np.ndarray, words: int) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for row in range(ROWS):
            flags = self.rows.get((words, row))
            if flags is None:
                return np.zeros(len(hashes), bool)
            at = cells_of(hashes, row, self.bits)
            ok &= (flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return ok


@functools.lru_cache(1)
def _sieve(paths: tuple[str, ...], bits: int) -> Sieve:
    return Sieve(paths, bits)


def phrases_of(lang: str, words: list[bytes], ids: np.ndarray, sieve: Sieve, known: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length up to LONGEST the places in ids where phrases begin, and their hashes.

    A phrase is there if all shorter ones in it pass the sieve, which knows phrases of up to `known` words.
    """
    each = word_hashes(lang, words)
    good = sieve.passing(each, 1)
    good[0] = False
    hashes, alive = each[ids], good[ids]
    whole, out = hashes, {}
    for k in range(2, LONGEST + 1):
        n = max(0, len(ids) - k + 1)
        whole = _mixed(whole[:n] * _TIMES + hashes[k - 1 : k - 1 + n])
        alive = alive[:n] & alive[1 : n + 1]
        at = np.flatnonzero(alive)
        if k <= known:
            at = at[sieve.passing(whole[at], k)]
            alive = np.zeros(n, bool)
            alive[at] = True
        out[k] = at, whole[at]
    return out


SKETCH = {"words": pa.int32(), "row": pa.int32(), "bucket": pa.int32(), "cells": pa.binary(), "counts": pa.binary()}
SKETCH_SCHEMA = "words int, row int, bucket int, cells binary, counts binary"


def _packed(words: int, row: int, cells: np.ndarray) -> Iterator[tuple]:
    """Rows of SKETCH: each cell once, its count up to 255, by buckets."""
    cells, n = np.unique(cells, return_counts=True)
    n = np.minimum(n, 255).astype(np.uint8)
    buckets, first = np.unique(cells >> BUCKET_BITS, return_index=True)
    for b, i, j in zip(buckets.tolist(), first.tolist(), [*first[1:].tolist(), len(cells)], strict=True):
        yield words, row, b, cells[i:j].astype("<u4").tobytes(), n[i:j].tobytes()


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells that reach LEAST; rows come sorted by (words, row, bucket), one bucket's counts are held at a time."""
    of, total = None, np.zeros(1 << BUCKET_BITS, np.int64)

    def done() -> pa.RecordBatch:
        passing = np.flatnonzero(total >= LEAST).astype(np.uint32) + np.uint32(of[2] << BUCKET_BITS)
        return _batch([[v] for v in (*of, passing.astype("<u4").tobytes(), b"")], SKETCH)

    for b in batches:
        for *key, cells, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != of:
                if of:
                    yield done()
                of, total[:] = key, 0
            total[np.frombuffer(cells, "<u4") & np.uint32((1 << BUCKET_BITS) - 1)] += np.frombuffer(n, np.uint8)
    if of:
        yield done()


def _passing_cells(spelling: DataFrame, lengths: tuple[int, ...], sieve: tuple[tuple[str, ...], int]) -> DataFrame:
    """The cells of phrases of some lengths that reach LEAST, in a sketch of all documents."""
    paths, bits = sieve

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (k, row), cells in held.items():
                yield _batch(zip(*_packed(k, row, np.concatenate(cells)), strict=True), SKETCH)

        for lang, words, ids in _opened(batches):
            found = phrases_of(lang, words, ids, _sieve(paths, bits), min(lengths) - 1)
            for k in lengths:
                hashes = found[k][1]
                for row in range(ROWS if len(hashes) else 0):
                    held[k, row].append(cells_of(hashes, row, bits))
                size += ROWS * len(hashes)
            if size >= CELLS:
                yield from flush()
                held.clear()
                size = 0
        yield from flush()

    sent = spelling.mapInArrow(sketch, SKETCH_SCHEMA)
    dealt = sent.repartition("words", "row", "bucket").sortWithinPartitions("words", "row", "bucket")
    return cut(dealt.mapInArrow(_combined, SKETCH_SCHEMA))


def _word_cells(words: DataFrame, bits: int) -> DataFrame:
    """The cells of words (lang, word), in the form of a sketch."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_lang = defaultdict(list)
            for lang, word in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by_lang[lang].append(word.encode())
            hashes = np.concatenate([word_hashes(lang, w) for lang, w in by_lang.items()] or [np.zeros(0, np.uint64)])
            rows = [r for row in range(ROWS if len(hashes) else 0) for r in _packed(1, row, cells_of(hashes, row, bits))]
            if rows:
                yield _batch(zip(*rows, strict=True), SKETCH)

    return cut(words.select("lang", "word").mapInArrow(mark, SKETCH_SCHEMA))


def guarded(words: list[bytes], ids: np.ndarray, wanted: set[bytes]) -> str:
    """The wanted words with a blank on either side; where others or ends of pieces stand, one b"\n" for all that follow each other."""
    here = np.array([w in wanted for w in words])[ids]
    beside = np.zeros(len(ids), bool)  # a word on its own is in no phrase
    beside[1:] |= here[:-1]
    beside[:-1] |= here[1:]
    here &= beside
    keep = here.copy()
    keep[1:] |= here[:-1]
    text = b" ".join([words[i] for i in np.where(here, ids, 0)[keep].tolist()])
    return f" {text.decode()} "


PACK = {"bucket": pa.int32(), "lang": pa.string(), "phrases": pa.binary(), "counts": pa.binary()}
PACK_SCHEMA = "bucket int, lang string, phrases binary, counts binary"


class Candidates:
    """The candidates that occur in some chunks of a language, and those chunks, for one automaton."""

    def __init__(self, lang: str, sieve: Sieve) -> None:
        self.lang, self.sieve = lang, sieve
        self.seen, self.phrases, self.hashes, self.chunks, self.bytes = np.zeros(0, np.uint64), [], [], [], 0

    def add(self, words: list[bytes], ids: np.ndarray) -> None:
        for k, (at, hashes) in phrases_of(self.lang, words, ids, self.sieve, LONGEST).items():
            hashes, first = np.unique(hashes, return_index=True)
            new = ~np.isin(hashes, self.seen, assume_unique=True)
            hashes, starts = hashes[new], at[first[new]]
            self.seen = np.concatenate([self.seen, hashes])
            self.hashes.append(hashes)
            fresh = [b" ".join([words[i] for i in row]) for row in ids[starts[:, None] + np.arange(k)].tolist()]
            self.bytes += sum(map(len, fresh)) + 2 * len(fresh)
            self.phrases += fresh
        self.chunks.append((words, ids))

    def counted(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """Rows of PACK: how often each candidate occurs in the chunks, overlaps included."""
        if not self.phrases:
            return
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, phrase in enumerate(self.phrases):
            automaton.add_word(f" {phrase.decode()} ", k)
        automaton.make_automaton()
        wanted = {w for p in self.phrases for w in p.split(b" ")}
        total = np.zeros(len(self.phrases), np.int64)
        for words, ids in self.chunks:
            found = np.fromiter(map(operator.itemgetter(1), automaton.iter(guarded(words, ids, wanted))), np.int64)
            total += np.bincount(found, minlength=len(total))
        bucket = (np.concatenate(self.hashes) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, first = np.unique(bucket[order], return_index=True)
        packs = np.split(order, first[1:])
        yield _batch([own.tolist(), [self.lang] * len(own), [b"\n".join([self.phrases[i] for i in p.tolist()]) for p in packs], [total[p].astype("<i8").tobytes() for p in packs]], PACK)


def phrase_counts(spelling: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """(lang, phrase, a): how often phrases of 2 to LONGEST words occur, overlaps included, of all that occur LEAST times.

    words has (lang, word) that occur LEAST times. Rows of sketches have a cell for about every three words
    of the corpus, and 2^28 (32 MB of bits) at most. A task makes automata of the candidates that occur in its
    own chunks, FILE_BYTES of them at a time, and runs each over just those chunks, so all text is scanned once,
    however many candidates the corpus has. Counts go out in packs by the phrase's hash, and a bucket's packs are added up.
    """
    bits = min(max(n_words.bit_length() - 2, ROW_BITS[0]), ROW_BITS[1])
    paths = tuple(files(_word_cells(words, bits)))
    for lengths in ((2,), tuple(range(3, LONGEST + 1))):
        paths += tuple(files(_passing_cells(spelling, lengths, (paths, bits))))
    buckets = 1 << max(4, bits - BUCKET_BITS + 4)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, rows in held.items():
                some = Candidates(lang, _sieve(paths, bits))
                for _, words, ids in _opened(rows):
                    some.add(words, ids)
                    if some.bytes >= FILE_BYTES:
                        yield from some.counted(buckets)
                        some = Candidates(lang, some.sieve)
                yield from some.counted(buckets)

        for b in batches:
            for k in range(len(b)):
                held[b.column(0)[k].as_py()].append(b.slice(k, 1))
                size += sum(len(b.column(c)[k].as_buffer()) for c in (1, 2))
                if size >= SCANNED_BYTES:
                    yield from flush()
                    held, size = defaultdict(list), 0
        yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            some = [(p.decode(), n) for p, n in total.items() if n >= LEAST]
            if some:
                phrases, n = zip(*some, strict=True)
                yield _batch([[of[1]] * len(some), phrases, n], {"lang": pa.string(), "phrase": pa.string(), "a": pa.int64()})

        for b in batches:
            for *key, packed, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != of:
                    yield from done()
                    of, total = key, {}
                known = total.get
                total.update([(p, known(p, 0) + n) for p, n in zip(packed.split(b"\n"), np.frombuffer(counts, "<i8").tolist(), strict=True)])
        yield from done()

    sent = spelling.mapInArrow(scan, PACK_SCHEMA)
    return sent.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(add, "lang string, phrase string, a long")


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases (lang, phrase, a) with l, r and score of their lowest-scoring cut; words has the counts (lang, phrase, a) of single words."""
    size = F.size("w")
    cuts = phrases.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    parts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, size - F.col("k")).alias("right"))
    known = phrases.select("lang", "phrase", "a").unionByName(words)
    for side, count in (("left", "l"), ("right", "r")):
        parts = parts.join(known.select("lang", F.col("phrase").alias(side), F.col("a").alias(count)), ["lang", side])
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + r)").cast("long")
    low = parts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"), F.first("a").alias("a"))
    return low.select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def absorbed(phrases: DataFrame) -> DataFrame:
    """(lang, phrase) of those of phrases (lang, phrase, a) that lie in a longer one that has ABSORBS_PERCENT of their count."""
    words = phrases.withColumn("w", F.split("phrase", " ")).withColumn("s", F.size("w")).where("s > 2")
    length = words.withColumn("k", F.explode(F.sequence(F.lit(2), F.col("s") - 1)))
    inner = length.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("s") - F.col("k") + 1))).select("lang", _part(F.col("w"), F.col("i"), F.col("k")).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    enough = F.expr(f"CAST(longer AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {ABSORBS_PERCENT}")
    return phrases.join(longer, ["lang", "phrase"]).where(enough).select("lang", "phrase")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language of docs (lang, text; more columns are ignored).

    Null texts are empty, a null lang is `und`. Repeated rows count each time. Equal scores go by count,
    then by the phrase's bytes; an empty table, or one without frequent phrases, gives no rows.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spelling = cut(chunks(docs))
    counts = cut(word_counts(spelling))
    per_lang = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = cut(counts.where(F.col("n") >= LEAST))
    n_words = counts.agg(F.sum("n")).first()[0] or 0
    found = cut(phrase_counts(spelling, frequent, n_words))
    rest = scored(found, frequent.select("lang", F.col("word").alias("phrase"), F.col("n").alias("a"))).join(absorbed(found), ["lang", "phrase"], "left_anti")
    order = W.Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rest.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)  # Spark keeps `top` rows a language before it shuffles
    return best.join(per_lang, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) AS phrase FROM words" for k in range(1, LONGEST + 1))
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x : x <> '') AS w FROM pieces),
f AS (SELECT lang, k, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {LEAST}),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM c),
parts AS (
  SELECT cuts.*, x.a AS l, y.a AS r, 2000000 * CAST(cuts.a AS HUGEINT) // (x.a + y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(list_slice(cuts.w, 1, cuts.c), ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(list_slice(cuts.w, cuts.c + 1, cuts.k), ' ')),
low AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
sizes AS (SELECT lang, a, w, k, unnest(range(2, k)) AS s FROM c WHERE k > 2),
inner_ AS (SELECT lang, a, unnest([array_to_string(w[i:i + s - 1], ' ') FOR i IN range(1, k - s + 2)]) AS phrase FROM sizes),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
ranked AS (
  SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, low.a DESC, low.phrase) AS rank
  FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.phrase = low.phrase
  WHERE longer IS NULL OR 100 * longer.longer < {ABSORBS_PERCENT} * low.a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}"""
