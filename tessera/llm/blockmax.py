"""An inverted index with block maxima, for exact top-k sums of weighted impacts.

Rows stand in blocks of BLOCK. A frequent term is a line of impacts with the largest one of each block; a
rare term has about one posting a block, so its postings are their own block maxima. A search adds up the
rare postings of its terms. The pivot test of block-max WAND then holds row by row: a row is opened only
if its rare impacts and its block's maxima of the frequent terms can reach the k-th best score so far,
which starts at any bound that the caller already has.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BLOCK = 64
#: A term of over 1/DENSE of the rows is frequent; for these lines a task's memory holds this many numbers at most.
DENSE, MOST_NUMBERS = 16, 12_000_000
#: Rows opened first, for a threshold, times k.
FIRST = 4
#: Scores are rounded so that sums in another order tie.
DECIMALS = 8
SLACK = 1e-6

NOTHING = np.zeros(0, np.int64), np.zeros(0)


class BlockMax:
    kind = np.float64

    def __init__(self, n: int, begin: np.ndarray, rows: np.ndarray, impact: np.ndarray, dense: int = DENSE) -> None:
        """Of n rows; the postings of term t are rows and impact from begin[t] to begin[t + 1], rows ascending. A term of over 1/dense of the rows is frequent."""
        self.n, self.begin, self.rows, self.impact = n, begin, rows, impact
        self.blocks = -(-n // BLOCK)
        df = np.diff(begin)
        common = np.flatnonzero(df * dense > n)
        room = max(1, MOST_NUMBERS // max(1, self.blocks * BLOCK))
        if len(common) > room:  # the others stay postings; this changes the plan, not the sums
            common = np.sort(common[np.argsort(-df[common], kind="stable")[:room]])
        self.place = np.full(len(df), -1, np.int32)
        self.place[common] = np.arange(len(common), dtype=np.int32)
        self.lines = np.zeros((len(common), self.blocks * BLOCK), self.kind)
        for k, t in enumerate(common.tolist()):
            i, j = begin[t], begin[t + 1]
            self.lines[k, rows[i:j]] = impact[i:j]
        self.most = self.lines.reshape(len(common), self.blocks, BLOCK).max(2) if len(common) and self.blocks else np.zeros((len(common), self.blocks))
        self.largest = np.maximum.reduceat(impact, begin[:-1]) if len(df) else np.zeros(0)  # every term has a posting

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows of score over 0, at least `least` and no less than the k-th best, and their scores; ties of the k-th are all there."""
        if not len(terms) or (least > 0 and weights @ self.largest[terms] < least - SLACK):
            return NOTHING
        place = self.place[terms]
        few = place < 0
        rare = self._rare(terms[few], weights[few])
        at, w = place[~few], weights[~few]
        bound = (rare.reshape(-1, BLOCK) + (w @ self.most[at])[:, None]).ravel() if len(at) else rare
        floor = max(least - SLACK, 1e-300)
        open_ = np.flatnonzero(bound >= floor)
        if len(open_) > 4 * FIRST * k:
            first = open_[np.argpartition(-bound[open_], FIRST * k)[: FIRST * k]]
            score = self._score(first, rare, at, w)
            if len(score) >= k:
                floor = max(floor, np.partition(score, len(score) - k)[len(score) - k] - SLACK)
            open_ = open_[bound[open_] >= floor]
        score = self._score(open_, rare, at, w)
        good = (score > 0) & (score >= least)
        if good.sum() > k:
            kept = score[good]
            good &= score >= np.partition(kept, len(kept) - k)[len(kept) - k]
        return open_[good], score[good]

    def search_together(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: Sequence[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) what search() finds without a bound to start from, query q never row without[q].

        For few rows and no bound, one product of the frequent terms of all queries takes less time than choosing
        rows by block maxima for one query after another. Callers bound the number of queries.
        """
        weights = np.zeros((len(queries), len(self.lines)))
        rare = []
        for q, (terms, w) in enumerate(queries):
            place = self.place[terms]
            few = place < 0
            weights[q, place[~few]] = w[~few]
            rare.append((terms[few], w[few]))
        out = []
        for q, (own, (terms, w)) in enumerate(zip(weights @ self.lines, rare, strict=True)):
            if not len(queries[q][0]):
                out.append(NOTHING)
                continue
            if len(terms):
                own += self._rare(terms, w)
            if without is not None:
                own[without[q]] = 0
            floor = np.partition(own, len(own) - k)[len(own) - k] - SLACK if len(own) > k else 0.0
            some = np.flatnonzero(own >= max(floor, 1e-300))
            score = np.round(own[some], DECIMALS)
            good = score > 0
            if good.sum() > k:
                kept = score[good]
                good &= score >= np.partition(kept, len(kept) - k)[len(kept) - k]
            out.append((some[good], score[good]))
        return out

    def _rare(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The sums of rare terms' weighted postings, a row each."""
        if not len(terms):
            return np.zeros(self.blocks * BLOCK)
        i = self.begin[terms]
        size = self.begin[terms + 1] - i
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(i - ends + size, size)
        return np.bincount(self.rows[at], np.repeat(weights, size) * self.impact[at], self.blocks * BLOCK)

    def _score(self, rows: np.ndarray, rare: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        if 4 * len(rows) < self.n or not len(at):  # few open rows are picked from the lines
            own = rare[rows] + w @ self.lines[np.ix_(at, rows)] if len(at) else rare[rows]
        else:
            every = rare.copy()
            for k, x in zip(at.tolist(), w.tolist(), strict=True):
                every += x * self.lines[k]
            own = every[rows]
        return np.round(own, DECIMALS)


#: For many queries at once: a term of over 1/MANY_DENSE of the rows is frequent, queries are taken so many at a time, and
#: those that leave over 1/WIDE of the rows open go into one matrix product.
MANY_DENSE, TOGETHER, WIDE = 32, 128, 8
#: How far a sum in single precision may be off by each of its terms, as a share of the largest possible sum.
COARSE = 2.0**-24


class ManyQueries(BlockMax):
    """The same index for many queries at once.

    Lines are in single precision, and only choose rows: those whose rounding may reach the k-th best are added up anew from
    their own postings. Block maxima of all queries are one small product. A query whose bounds open few rows
    picks those from the lines; for the others, which no bound narrows, lines times weights is one large product.
    """

    kind = np.float32

    def __init__(self, n: int, begin: np.ndarray, rows: np.ndarray, impact: np.ndarray) -> None:
        super().__init__(n, begin, rows, impact, MANY_DENSE)
        self.own = np.argsort(rows, kind="stable").astype(np.int32)  # postings by row
        self.first = np.append(0, np.cumsum(np.bincount(rows, minlength=n)))
        self.term = np.repeat(np.arange(len(begin) - 1, dtype=np.int32), np.diff(begin))[self.own]
        self.weight = np.zeros(len(begin) - 1)

    def search_many(self, queries: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights, least) what search() finds."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(queries), TOGETHER):
            out += self._together(queries[start : start + TOGETHER], k)
        return out

    def _together(self, queries: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = [NOTHING] * len(queries)
        reach = [w @ self.largest[t] if len(t) else 0.0 for t, w, _ in queries]
        live = [q for q, (t, _, least) in enumerate(queries) if len(t) and not (least > 0 and reach[q] < least - SLACK)]
        if not live:
            return out
        weights = np.zeros((len(live), len(self.lines)), np.float32)
        for j, q in enumerate(live):
            place = self.place[queries[q][0]]
            weights[j, place[place >= 0]] = queries[q][1][place >= 0]
        most = weights @ self.most
        wide = []
        for j, q in enumerate(live):
            terms, w, least = queries[q]
            slack = SLACK + COARSE * (len(terms) + 4) * reach[q]
            few = self.place[terms] < 0
            rare = self._rare(terms[few], w[few])
            if least <= 0 or few.all():
                wide.append((j, q, rare, slack))
                continue
            bound = (rare.reshape(-1, BLOCK) + most[j][:, None]).ravel()
            open_ = np.flatnonzero(bound >= least - slack)
            if WIDE * len(open_) > self.n:
                wide.append((j, q, rare, slack))
            elif len(open_):
                at = np.flatnonzero(weights[j])
                out[q] = self._best(queries[q], open_, rare[open_] + weights[j, at] @ self.lines[np.ix_(at, open_)], k, slack)
        if wide:
            sums = weights[[j for j, *_ in wide]] @ self.lines
            for (_, q, rare, slack), line in zip(wide, sums, strict=True):
                out[q] = self._best(queries[q], None, line + rare, k, slack)
        return out

    def _best(self, query: tuple[np.ndarray, np.ndarray, float], rows: np.ndarray | None, coarse: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Of rows (None: all) with coarse sums those that search() would find, with exact scores."""
        terms, weights, least = query
        floor = max(least - slack, 1e-300)
        some = np.flatnonzero(coarse >= floor)
        if len(some) > k:
            kept = coarse[some]
            some = some[kept >= np.partition(kept, len(kept) - k)[len(kept) - k] - 2 * slack]
        some = some if rows is None else rows[some]
        some = some[some < self.n]
        self.weight[terms] = weights
        size = self.first[some + 1] - self.first[some]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[some] - ends + size, size)
        score = np.bincount(np.repeat(np.arange(len(some)), size), self.weight[self.term[at]] * self.impact[self.own[at]], len(some))
        self.weight[terms] = 0
        score = np.round(score, DECIMALS)
        good = (score > 0) & (score >= least)
        if good.sum() > k:
            kept = score[good]
            good &= score >= np.partition(kept, len(kept) - k)[len(kept) - k]
        return some[good], score[good]
