"""Toxicity by the nearest labelled examples.

A bounded sample of labelled rows gives the examples. Each text is compared with them by exact TF-IDF
cosine over all their terms, with document counts from the whole corpus, through an inverted index
(blockmax.py): a run of texts is searched together, rare terms by their postings and frequent ones by one
product. The neighbours are the evidence. The terms whose presence tells the classes apart (chi-square) have a second
index of the same kind. Both indexes' votes, weighted by similarity, are turned into a probability by a
logistic curve that is fitted on the examples themselves, each left out of its own neighbours.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.blockmax import TOGETHER, BlockMax
from tessera.session import cut

#: Labelled rows of each class that become examples at most: those whose ids hash lowest.
EXAMPLES = 2000
#: Terms of the second index at most, and the chi-square value from which a term tells the classes apart.
TERMS, CHI_SQUARE = 2000, 20.0
#: Neighbours that vote.
NEIGHBOURS = 15
THRESHOLD = 0.7

_words = re.compile(r"\w+").findall
#: The bytes of Latin-1, spaces where they are no part of a word.
_SPACED = bytes(c if re.match(r"\w", chr(c)) else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    """The words (\\w+) of the lower-cased text; Latin-1 is split at spaces, which is the same and faster."""
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(_SPACED).decode("latin-1").split()
    except UnicodeEncodeError:
        return _words(low)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from (a null id is one, as no label can be its own)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, text) to a row for each distinct term."""
    for b in batches:
        for d, x, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            count = Counter(words_of(t))
            if count:
                n = len(count)
                yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int64()), pa.array([x] * n, pa.int32()), pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["doc_id", "toxic", "term", "tf"])


def _frequencies(terms: dict[str, int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to (term, n): a task's texts with each of the terms."""
        df = np.zeros(len(terms), np.int64)
        get = terms.get
        for b in batches:
            for k in range(0, len(b), TOGETHER):
                words = (set(words_of(t)) for t in b.column(0).slice(k, TOGETHER).to_pylist())
                found = np.concatenate([np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)) for w in words])
                df += np.bincount(found[found >= 0], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    return count


class Index:
    """Examples by term: (example, term) pairs without repeats, tf of each, and the terms' IDF."""

    def __init__(self, term: dict[str, int], example: np.ndarray, at: np.ndarray, tf: np.ndarray, n: int, idf: np.ndarray) -> None:
        self.term, self.idf, self.n = term, idf, n
        w = (1 + np.log(tf)) * idf[at]
        w = w / np.sqrt(np.bincount(example, w * w, n))[example]
        order = np.lexsort((example, at))
        self.postings = BlockMax(n, np.searchsorted(at[order], np.arange(len(term) + 1)), example[order].astype(np.int32), w[order])

    @property
    def examples(self) -> list[np.ndarray]:
        return np.split(self.postings.rows, self.postings.begin[1:-1]) if self.term else []

    @property
    def weights(self) -> list[np.ndarray]:
        return np.split(self.postings.impact, self.postings.begin[1:-1]) if self.term else []

    def weigh(self, at: np.ndarray, tf: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
        """Terms' weights: 1 + ln(tf) times idf, to length 1 within each text (None: all are of one)."""
        text = np.zeros(len(at), np.int64) if text is None else text
        w = (1 + np.log(tf)) * self.idf[at]
        return w / np.sqrt(np.bincount(text, w * w))[text] if len(at) else w

    def count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known terms among words, and how often they stand there."""
        return self.count_together([words])[1:]

    def count_together(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf) of the known terms of each text's words, in that order."""
        found = [np.fromiter(map(self.term.get, words, repeat(-1)), np.int64, len(words)) for words in texts]
        every = np.concatenate(found)
        key = np.repeat(np.arange(len(found)), [len(f) for f in found]) * len(self.term) + every
        key = np.sort(key[every >= 0])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        text, at = np.divmod(key[first], max(1, len(self.term)))
        return text, at, np.diff(first, append=len(key))

    def nearest(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The NEIGHBOURS examples of largest cosine over 0, and the cosines; ties go to the lower number."""
        return self.nearest_together(1, np.zeros(len(at), np.int64), at, tf)[0]

    def nearest_together(self, n: int, text: np.ndarray, at: np.ndarray, tf: np.ndarray, without: Sequence[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() for each of n texts, whose terms are in order, each without one example."""
        w = self.weigh(at, tf, text)
        queries = [(at[i:j], w[i:j]) for i, j in pairwise(np.searchsorted(text, np.arange(n + 1)).tolist())]
        out = []
        for found, near in self.postings.search_together(queries, NEIGHBOURS, without):
            best = np.lexsort((found, -near))[:NEIGHBOURS]
            out.append((found[best], near[best]))
        return out

    def nearest_others(self, example: np.ndarray, at: np.ndarray, tf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nearest of each example but itself, from the examples' terms."""
        order = np.lexsort((at, example))
        example, at, tf = example[order], at[order], tf[order]
        out = []
        for k in range(0, self.n, TOGETHER):
            these = range(k, min(k + TOGETHER, self.n))
            i, j = np.searchsorted(example, (these.start, these.stop))
            out += self.nearest_together(len(these), example[i:j] - k, at[i:j], tf[i:j], these)
        return out


class Model(Index):
    """The index of all terms, that of the markers, and the curve from their votes to scores."""

    def __init__(self, index: tuple, markers: tuple, ids: list[int], toxic: np.ndarray, share: float) -> None:
        super().__init__(*index)
        self.markers = Index(*markers)
        self.marker = np.full(len(self.term), -1)
        self.marker[[self.term[t] for t in self.markers.term]] = np.arange(len(self.markers.term))
        self.ids, self.toxic = np.array(ids, np.int64), toxic
        self.curve = np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, 0.0, 0.0, 0.0])
        if self.n and 0 < toxic.sum() < self.n:
            self._calibrate(index, markers, share)

    def votes(self, found: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Share of the votes for toxic, each neighbour's being its squared cosine, and that share times the largest cosine."""
        if not len(found):
            return np.zeros(2)
        weight = near**2
        vote = (weight * self.toxic[found]).sum() / weight.sum()
        return np.array([vote, vote * near[0]])

    def features(self, near: tuple, marked: tuple) -> np.ndarray:
        return np.concatenate([[1.0], self.votes(*near), self.votes(*marked)])

    def _calibrate(self, index: tuple, markers: tuple, share: float) -> None:
        """Logistic regression by Newton steps; classes count as they do among all labelled rows."""
        x = np.array([*map(self.features, self.nearest_others(*index[1:4]), self.markers.nearest_others(*markers[1:4]))])
        y = self.toxic.astype(float)
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        beta = np.zeros(5)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            slope = x.T @ (weight * (p - y)) + 0.1 * beta * [0, 1, 1, 1, 1]
            curve = (x.T * (weight * p * (1 - p))) @ x + 0.1 * np.diag([1e-3, 1, 1, 1, 1])
            beta = beta - np.linalg.solve(curve, slope)
        self.curve = beta

    def score(self, texts: list[str | None]) -> tuple[list[float], list[np.ndarray], list[np.ndarray]]:
        """The score of each text, its neighbours and their cosines."""
        text, at, tf = self.count_together(map(words_of, texts))
        near = self.nearest_together(len(texts), text, at, tf)
        marker = self.marker[at]
        own = marker >= 0
        marked = self.markers.nearest_together(len(texts), text[own], marker[own], tf[own])
        scores = [float(1 / (1 + np.exp(-self.features(v, m) @ self.curve))) for v, m in zip(near, marked, strict=True)]
        return scores, [f for f, _ in near], [c for _, c in near]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, from labelled rows that are not held out. The driver gets the terms of the examples."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = [known.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for x in (0, 1)]
    sample = cut(sample[0].unionByName(sample[1]).select("doc_id", "toxic"))  # 2 x EXAMPLES rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = cut(texts.select("doc_id", "toxic", "text").mapInArrow(_terms, "doc_id long, toxic int, term string, tf long"))
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    by = rows.dropDuplicates(["doc_id", "term"]).groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    n, a, b = float(pos + neg), F.col("a"), F.col("b")
    chi = n * (a * (neg - b) - b * (pos - a)) ** 2 / ((a + b) * (n - a - b) * float(max(1, pos)) * float(max(1, neg)))
    chosen = by.where(F.col("a") + F.col("b") < n).withColumn("chi", chi).where(F.col("chi") >= CHI_SQUARE)
    terms = [r.term for r in chosen.orderBy(F.desc("chi"), "term").limit(TERMS).collect()]
    at = {t: k for k, t in enumerate(terms)}
    toxic = {r.doc_id: r.toxic for r in sample.collect()}
    ids = sorted(toxic)
    got = rows.groupBy("doc_id", "term").agg(F.max("tf").alias("tf")).toArrow()
    coded = got.column("term").combine_chunks().dictionary_encode()
    every = {t: k for k, t in enumerate(coded.dictionary.to_pylist())}
    example, term, tf = np.searchsorted(ids, got.column("doc_id").to_numpy()), coded.indices.to_numpy().astype(np.int64), got.column("tf").to_numpy()
    df, size = np.zeros(len(every)), docs.count()
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies(every), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        df[r["term"]] = r["n"]
    idf = np.log((1 + size) / (1 + df)) + 1
    marker = np.full(len(every) + 1, -1)
    marker[[every[t] for t in terms]] = np.arange(len(terms))
    kept = marker[term] >= 0
    own = np.array([idf[every[t]] for t in terms])
    share = total.get(1, 0) / max(1, sum(total.values()))
    n = len(ids)
    return Model((every, example, term, tf, n, idf), (at, example[kept], marker[term[kept]], tf[kept], n, own), ids, np.array([toxic[i] for i in ids], int), share)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours, similarities) for every row of docs (doc_id, text; more columns are ignored).

    Null and empty texts, and texts without any term of the examples, have no neighbours and the score of
    no votes. Repeated rows score alike; an empty table gives no rows. Without labels of both classes
    every score is the share of toxic rows. neighbours are the examples' doc_ids, the evidence of a score.
    """
    model = fit(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), TOGETHER):
                part = b.slice(k, TOGETHER)
                scores, found, near = model.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores), pa.array([model.ids[f].tolist() for f in found], pa.list_(pa.int64())), pa.array([x.tolist() for x in near], pa.list_(pa.float64()))],
                    ["doc_id", "score", "neighbours", "similarities"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = plain.mapInArrow(score, "doc_id long, score double, neighbours array<long>, similarities array<double>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours", "similarities")
