"""Masked pseudo-likelihood of documents by a small bidirectional window network, trained in numpy.

Tokens are lower-case words, hashed to VOCABULARY numbers. The network sees the WINDOW tokens on either
side of a masked one: each place has its own embedding table, their sum goes through tanh, and the number
is predicted in two steps, its group of GROUP numbers and its place in the group. Which of the words of
that number it is comes from counts over the whole corpus: the most frequent ones (WORDS at most) have
their share of the number's count each, all others share what is left and are spelled by pairs of bytes.
A document's score is the sum of the log-probabilities of all its words, each from both sides.

Training covers every position of every document: each task starts from the same weights, learns from
its documents, and the tasks' weights are averaged by the tokens learned from, in three combining steps
of blocks, so that no task gathers all weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

VOCABULARY, GROUP = 4096, 64
GROUPS = VOCABULARY // GROUP
WINDOW, WIDTH = 2, 16
#: Steps: tokens in the first one, which doubles with every GROWTH steps up to the last; Adagrad's rate; tokens scored at once.
BATCH, GROWTH, LAST_BATCH, RATE, AT_ONCE = 1024, 32, 16384, 0.15, 16384
#: Blocks of weights that are averaged apart, and tasks whose weights are added first.
BLOCKS, FAN = 16, 32
SEED = 7
#: Logits are held to this on either side.
FAR = np.float32(40)
#: Bytes of text whose words are counted, learned from or scored together.
COUNT_BYTES, LEARN_BYTES, SCORE_BYTES = 16_000_000, 2_000_000, 2_000_000
#: Words with counts of their own at most, and the bytes that such a word has at most; the others are spelled.
WORDS, LONGEST = 65536, 64

SHAPES = {"embed": (2 * WINDOW, VOCABULARY + 1, WIDTH), "bias": (WIDTH,), "group": (GROUPS, WIDTH), "group_bias": (GROUPS,), "inner": (GROUPS, GROUP, WIDTH), "inner_bias": (GROUPS, GROUP)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


class Network:
    """Weights as views of one flat array."""

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, at = flat, 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls) -> Network:
        rng = np.random.default_rng(SEED)
        net = cls(np.zeros(SIZE, np.float32))
        for x in (net.embed, net.group, net.inner):
            x[:] = rng.normal(0, 0.1, x.shape)
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = np.broadcast_to(self.bias, (len(context), WIDTH)).copy()
        for k in range(2 * WINDOW):
            h += self.embed[k][context[:, k]]
        return np.tanh(h)

    def _inner(self, h: np.ndarray, cuts: list[int]) -> np.ndarray:
        """Logits of places within groups, for rows sorted by group."""
        z = np.empty((len(h), GROUP), np.float32)
        for k in range(GROUPS):
            if cuts[k] < cuts[k + 1]:
                at = slice(cuts[k], cuts[k + 1])
                np.matmul(h[at], self.inner[k].T, out=z[at])
                z[at] += self.inner_bias[k]
        return z

    @staticmethod
    def _by_group(token: np.ndarray) -> tuple[np.ndarray, list[int]]:
        g = (token // GROUP).astype(np.int16)  # short numbers sort by radix
        return np.argsort(g, kind="stable"), np.append(0, np.cumsum(np.bincount(g, minlength=GROUPS))).tolist()

    @staticmethod
    def _exp(z: np.ndarray) -> np.ndarray:
        """Exponentials in place; logits beyond FAR count as FAR, which keeps sums finite."""
        return np.exp(np.clip(z, -FAR, FAR, out=z), out=z)

    @classmethod
    def _log(cls, z: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probabilities of a column of each row; z is used up."""
        e = cls._exp(z)
        return np.log(e[np.arange(len(e)), at] / (e @ np.ones(e.shape[1], np.float32)))

    @classmethod
    def _slope(cls, z: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities less 1 at a column of each row; z is used up."""
        e = cls._exp(z)
        e /= (e @ np.ones(e.shape[1], np.float32))[:, None]
        e[np.arange(len(e)), at] -= 1
        return e

    def log_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        order, cuts = self._by_group(token)
        token = token[order]
        h = self.hidden(context[order])
        out = np.empty(len(token), np.float32)
        out[order] = self._log(h @ self.group.T + self.group_bias, token // GROUP) + self._log(self._inner(h, cuts), token % GROUP)
        return out

    def learn(self, context: np.ndarray, token: np.ndarray, squares: Network) -> None:
        """One Adagrad step down the mean loss of a batch."""
        grad, dh, by, first, context = self.gradient(context, token)
        n = len(token)
        for k in range(2 * WINDOW):
            at = by[k][first[k]]
            self._step(self.embed[k], np.add.reduceat(dh[by[k]], first[k]), squares.embed[k], n, context[at, k])
        rest = slice(self.embed.size, None)
        self._step(self.flat[rest], grad, squares.flat[rest], n, slice(None))

    def gradient(self, context: np.ndarray, token: np.ndarray) -> tuple:
        """Sums over a batch: the gradient of all but the embeddings; of the hidden sums; and per place, rows by token and where each token begins."""
        order, cuts = self._by_group(token)
        token, context = token[order], context[order]
        h = self.hidden(context)
        grad = np.zeros(SIZE - self.embed.size, np.float32)
        at, own = 0, {}
        for name, shape in list(SHAPES.items())[1:]:
            size = int(np.prod(shape))
            own[name] = grad[at : at + size].reshape(shape)
            at += size
        d = self._slope(h @ self.group.T + self.group_bias, token // GROUP)
        own["group"][:], own["group_bias"][:] = d.T @ h, np.ones(len(d), np.float32) @ d
        dh = d @ self.group
        d = self._slope(self._inner(h, cuts), token % GROUP)
        for k in range(GROUPS):
            if cuts[k] < cuts[k + 1]:
                at = slice(cuts[k], cuts[k + 1])
                own["inner"][k], own["inner_bias"][k] = d[at].T @ h[at], np.ones(cuts[k + 1] - cuts[k], np.float32) @ d[at]
                dh[at] += d[at] @ self.inner[k]
        dh *= 1 - h * h
        own["bias"][:] = dh.sum(0)
        by = [np.argsort(context[:, k].astype(np.int16), kind="stable") for k in range(2 * WINDOW)]
        first = [np.flatnonzero(np.append(True, np.diff(context[b, k]) != 0)) for k, b in enumerate(by)]
        return grad, dh, by, first, context

    @staticmethod
    def _step(weights: np.ndarray, grad: np.ndarray, squares: np.ndarray, n: int, at: np.ndarray | slice) -> None:
        """Adagrad where the gradient may differ from 0; elsewhere a step changes nothing."""
        step = grad / np.float32(n)
        total = squares[at] + step * step
        squares[at] = total
        weights[at] -= np.float32(RATE) * step / (np.sqrt(total) + np.float32(1e-6))


class Words:
    """The words of texts: how many each text has, the distinct ones, and which of them stands at each place."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pa.compute.ascii_split_whitespace(pa.compute.utf8_lower(pa.compute.fill_null(texts.cast(pa.large_string()), "")))
        every = pa.compute.list_flatten(lists)
        full = pa.compute.not_equal(every, "")  # there is one beside white space at either end
        own = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(lists).to_numpy())[full.to_numpy(zero_copy_only=False)]
        self.length = np.bincount(own, minlength=len(texts))
        coded = every.filter(full).dictionary_encode()
        self.distinct = coded.dictionary.cast(pa.large_binary())
        self.at = coded.indices.to_numpy()

    def numbers(self) -> np.ndarray:
        """The hashed number of the word at each place."""
        known = np.fromiter(map(zlib.crc32, self.distinct.to_pylist()), np.int64, len(self.distinct)) % VOCABULARY
        return known.astype(np.int32)[self.at]


def tokens(text: str | None) -> np.ndarray:
    """The numbers of a text's words."""
    return Words(pa.array([text], pa.string())).numbers()


def _slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of texts of about `most` bytes each, one text at least."""
    size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy())
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
        yield texts.slice(start, end - start)
        start = end


def _pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of bytes of words, as 256 * first + second, and how many each word has; a blank stands before and after a word."""
    line = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int32)
    return line[:-1] * 256 + line[1:], np.fromiter(map(len, words), np.int64, len(words)) + 1


class Counts:
    """Log-probabilities of words given their numbers, from counts of the corpus.

    Spellings are not held to the words that a number has left, so what they get is a lower bound.
    """

    def __init__(self, words: dict[bytes, int], total: np.ndarray, rest: np.ndarray, pairs: np.ndarray) -> None:
        log = np.log(np.maximum(total, 1))
        self.words = {w: float(np.log(n) - log[zlib.crc32(w) % VOCABULARY]) for w, n in words.items()}
        self.rest = np.log(np.maximum(rest, 1)) - log
        pairs = pairs.reshape(256, 256) + 1.0
        self.spelled = np.log(pairs / pairs.sum(1, keepdims=True)).ravel()

    def log_probabilities(self, words: list[bytes], token: np.ndarray) -> np.ndarray:
        out = np.fromiter(map(self.words.get, words, repeat(1.0)), np.float64, len(words))
        rare = np.flatnonzero(out > 0)
        if len(rare):
            pair, size = _pairs([words[k] for k in rare.tolist()])
            out[rare] = self.rest[token[rare]] + np.add.reduceat(self.spelled[pair], np.cumsum(size) - size)
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, n), a word once or more."""
    for b in batches:
        for part in _slices(b.column(0), COUNT_BYTES):
            words = Words(part)
            n = np.bincount(words.at, minlength=len(words.distinct))
            for k in range(0, len(n), 10_000):
                yield pa.RecordBatch.from_arrays([words.distinct.slice(k, 10_000).cast(pa.binary()), pa.array(n[k : k + 10_000], pa.int64())], ["word", "n"])


def _tally(known: set[bytes]):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, n) to (kind, key, n): 0 for all words of a number, 1 for those that are spelled, 2 for their pairs of bytes."""
        sums = [np.zeros(VOCABULARY, np.int64), np.zeros(VOCABULARY, np.int64), np.zeros(65536, np.int64)]
        for b in batches:
            words, n = b.column(0).to_pylist(), np.asarray(b.column(1))
            token = np.fromiter((zlib.crc32(w) % VOCABULARY for w in words), np.int64, len(words))
            np.add.at(sums[0], token, n)
            rare = np.array([k for k, w in enumerate(words) if w not in known], np.int64)
            if len(rare):
                np.add.at(sums[1], token[rare], n[rare])
                pair, size = _pairs([words[k] for k in rare.tolist()])
                np.add.at(sums[2], pair, np.repeat(n[rare], size))
        for kind, x in enumerate(sums):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], ["kind", "key", "n"])

    return tally


def count(docs: DataFrame) -> Counts:
    """Counts of all words. The driver gets WORDS words at most, how many words have each count, and sums by number and by pair of bytes."""
    every = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "word binary, n long")
    every = cut(every.groupBy("word").agg(F.sum("n").alias("n")))
    short = every.where(F.length("word") <= LONGEST)
    least, have = 1 << 62, 0
    for r in sorted(short.groupBy("n").count().collect(), key=lambda r: -r.n):  # words of one count are in or out together
        have += r["count"]
        if have > WORDS:
            break
        least = r.n
    words = {bytes(r.word): r.n for r in short.where(F.col("n") >= least).collect()}
    sums = [np.zeros(k, np.int64) for k in (VOCABULARY, VOCABULARY, 65536)]
    for r in every.mapInArrow(_tally(set(words)), "kind int, key int, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect():
        sums[r.kind][r.key] = r.n
    return Counts(words, *sums)


def contexts(token: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """The WINDOW tokens before and after each, within its text (by lengths; else all are one text); VOCABULARY stands for none."""
    n = len(token)
    lengths = np.array([n]) if lengths is None else lengths
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts, at = ends - np.repeat(lengths, lengths), np.arange(n)
    out = []
    for k in (k for k in range(-WINDOW, WINDOW + 1) if k):
        to = at + k
        out.append(np.where((to >= starts) & (to < ends), token[np.clip(to, 0, max(0, n - 1))] if n else token, VOCABULARY))
    return np.stack(out, 1).astype(np.int32)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    net, squares = Network.start(), Network(np.full(SIZE, 1e-8, np.float32))
    have, size, learned, steps = [], 0, 0, 0
    rng = np.random.default_rng(SEED)

    def flush() -> None:
        nonlocal have, size, learned, steps
        context, token = (np.concatenate(x) for x in zip(*have, strict=True))
        order, k = rng.permutation(len(token)), 0  # neighbours in a text go to different steps
        while k < len(order):
            at = order[k : k + min(BATCH << min(20, steps // GROWTH), LAST_BATCH)]
            net.learn(context[at], token[at], squares)
            k, steps = k + len(at), steps + 1
        learned += len(token)
        have, size = [], 0

    for b in batches:
        for part in _slices(b.column(0), LEARN_BYTES):
            words = Words(part)
            if len(words.at):
                token = words.numbers()
                have.append((contexts(token, words.length), token))
                size += len(words.at)
                if size >= 4 * LAST_BATCH:
                    flush()
    if size:
        flush()
    if learned:
        task = TaskContext.get()
        cuts = np.linspace(0, SIZE, BLOCKS + 1).astype(int)
        part = (task.partitionId() if task else 0) // FAN
        rows = [(k, part, learned, (net.flat[cuts[k] : cuts[k + 1]].astype(np.float64) * learned).tobytes()) for k in range(BLOCKS)]
        yield _rows(rows)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["block", "part", "learned", "weights"])


SUMS = "block int, part int, learned long, weights binary"


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(len(table.column("weights")[0].as_py()) // 8)
    for x in table.column("weights"):
        total += np.frombuffer(x.as_buffer())
    return pa.Table.from_batches([_rows([(table.column("block")[0].as_py(), table.column("part")[0].as_py() // FAN, sum(table.column("learned").to_pylist()), total.tobytes())])])


def train(docs: DataFrame) -> Network:
    """The network of all documents; without any tokens the starting one. The driver gets BLOCKS rows, SIZE numbers in all."""
    tasks = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_train, SUMS)
    level = tasks.groupBy("block", "part").applyInArrow(_add, SUMS)  # of FAN tasks
    level = level.groupBy("block", "part").applyInArrow(_add, SUMS)  # of FAN of those
    rows = level.groupBy("block").applyInArrow(_add, SUMS).collect()
    if not rows:
        return Network.start()
    return Network(np.concatenate([np.frombuffer(r.weights) / r.learned for r in sorted(rows, key=lambda r: r.block)]).astype(np.float32))


def _scorer(flat: np.ndarray, counts: Counts):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat)
        for b in batches:
            done = 0
            for part in _slices(b.column(1), SCORE_BYTES):
                words = Words(part)
                plain = words.distinct.to_pylist()
                known = (np.fromiter(map(zlib.crc32, plain), np.int64, len(plain)) % VOCABULARY).astype(np.int32)
                token = known[words.at]
                context = contexts(token, words.length)
                p = np.concatenate([net.log_probabilities(context[k : k + AT_ONCE], token[k : k + AT_ONCE]) for k in range(0, len(token), AT_ONCE)] or [np.zeros(0, np.float32)]).astype(np.float64)
                p += counts.log_probabilities(plain, known)[words.at]
                ends = np.cumsum(words.length)
                total = np.append(0.0, np.cumsum(p))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(part)), pa.array(words.length), pa.array(total[ends] - total[ends - words.length])], ["doc_id", "n_tokens", "log_likelihood"])
                done += len(part)

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for every row of docs (doc_id, text; more columns are ignored).

    Null and empty texts have no tokens, a sum of 0 and no mean. Repeated rows score alike; an empty
    table gives no rows. Beyond either end of a text stands a number of its own.
    """
    flat, counts = train(docs).flat, count(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = plain.mapInArrow(_scorer(flat, counts), "doc_id long, n_tokens long, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
