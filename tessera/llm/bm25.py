"""Exact BM25 top-k by inverted indexes with block-max WAND, run per shard and merged.

A shard is a run of documents with its own inverted index (blockmax.py), built once and written to the
shared folder. Document frequencies and lengths are those of all documents, so shards score alike and
their lists merge exactly.

Queries lie in the shared folder in blocks of bounded size, with weights for their terms. A block is
searched in rounds, each over SPREAD times the shards of all before; what a round finds gives each query
a bound (its k-th score so far) from which all pruning of the next round starts, and rows below it are
never sent. So a query's results that leave the shards grow with the logarithm of their number. No set of
queries, terms or results comes to the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.llm.blockmax import ManyQueries
from tessera.session import cut, drop_cut, open_folder

K1, B = 1.2, 0.75
#: Results of a query; rows whose id this divides are queries.
TOP, EVERY = 10, 100
#: Queries in a block, about; documents and text characters in a shard.
QUERY_BLOCK, SHARD_DOCS, SHARD_CHARS = 512, 8192, 32_000_000
#: Shards of a block's first round, and how many times as many are done after each later one.
START, SPREAD = 2, 4
#: The place of documents without an id among equal scores.
LAST = (1 << 63) - 1

_words = re.compile(r"\w+").findall

INDEX = "place double, n_docs long, n_words long, ids array<long>, sizes binary, terms array<string>, dfs array<int>, rows binary, tfs binary"
FOUND = "block int, query_id long, doc_id long, score double"


class Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _shard(place: float, ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
    """A row of INDEX: documents with postings by term."""
    number = Numbers()
    found = [np.fromiter(map(number.__getitem__, _words((t or "").lower())), np.int64) for t in texts]
    size = np.array([len(x) for x in found], np.int64)
    every = np.concatenate(found) if found else np.zeros(0, np.int64)
    every *= len(ids)
    every += np.repeat(np.arange(len(ids)), size)
    pair, tf = np.unique(every, return_counts=True)
    term = pair // max(1, len(ids))
    df = np.bincount(term, minlength=len(number)) if len(number) else np.zeros(0, np.int64)
    rows = (pair - term * len(ids)).astype("<i4")
    row = [place, len(ids), int(size.sum()), ids, size.astype("<i8").tobytes(), list(number), df.astype(np.int32), rows.tobytes(), tf.astype("<i4").tobytes()]
    kinds = [pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])


def _index(shard_docs: int):
    """(doc_id, text) to shards; their places in [0, 1) are spread evenly by the golden ratio."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, ids, texts, chars, k = task.partitionId() if task else 0, [], [], 0, 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(d)
                texts.append(t)
                chars += len(t or "")
                if len(ids) >= shard_docs or chars >= SHARD_CHARS:
                    yield _shard(_spread(part, k), ids, texts)
                    ids, texts, chars, k = [], [], 0, k + 1
        if ids:
            yield _shard(_spread(part, k), ids, texts)

    return index


def _spread(part: int, k: int = 0) -> float:
    return math.fmod(part * 0.6180339887498949 + k * 0.7548776662466927, 1.0)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, query_id, text) to the terms of each query and how often they stand in it."""
    for b in batches:
        for k in range(0, len(b), 200):
            part = b.slice(k, 200)
            counts = [Counter(_words(t.lower())) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["block", "query_id", "terms", "tfs"])


def _folder(df: DataFrame) -> str:
    return df._tessera_path


def _block(path: str, block: int, columns: list[str]) -> pa.Table:
    """A block of a table that cut() wrote by blocks."""
    fs, base = open_folder(path)
    folder = f"{base}/block={block}"
    if fs.get_file_info(folder).type == pa.fs.FileType.NotFound:
        return pa.table({c: [] for c in columns})
    return pa.dataset.dataset(folder, filesystem=fs, format="parquet").to_table(columns=columns)


def _open(shard: dict, mean: float) -> tuple[ManyQueries, dict[str, int]]:
    """The index of a shard, with impacts by the mean length of all documents, and its terms' numbers."""
    size, rows, tf = np.frombuffer(shard["sizes"], "<i8"), np.frombuffer(shard["rows"], "<i4"), np.frombuffer(shard["tfs"], "<i4")
    norm = K1 * (1 - B + B * size / max(mean, 1e-9))
    begin = np.append(0, np.cumsum(np.array(shard["dfs"], np.int64)))
    return ManyQueries(len(size), begin, rows, tf * (K1 + 1) / (tf + norm[rows])), {t: k for k, t in enumerate(shard["terms"])}


def _search(queries: str, best: str | None, blocks: int, mean: float, low: float, high: float):
    """Shards to what their documents score, for the blocks whose places are low to high before the shard's."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                place = b.column(0)[r].as_py()
                todo = [k for k in range(blocks) if low <= (place - _spread(k)) % 1.0 < high]
                if not todo:
                    continue
                shard = {c: b.column(c)[r].as_py() for c in ("ids", "sizes", "terms", "dfs", "rows", "tfs")}
                index, number = _open(shard, mean)
                order = np.array([LAST if d is None else d for d in shard["ids"]], np.int64)
                for k in todo:
                    least = {}
                    if best:
                        known = _block(best, k, ["query_id", "score", "doc_id", "rank"])
                        least = {q: (s, LAST if d is None else d) for q, s, d, n in zip(*(known.column(c).to_pylist() for c in ("query_id", "score", "doc_id", "rank")), strict=True) if n == TOP}
                    asked = _block(queries, k, ["query_id", "terms", "weights"]).combine_chunks()
                    if not len(asked):
                        continue
                    terms = pa.compute.list_flatten(asked.column("terms")).combine_chunks().dictionary_encode()
                    known = np.array([number.get(t, -1) for t in terms.dictionary.to_pylist()], np.int64)
                    terms, weights = known[terms.indices.to_numpy()], pa.compute.list_flatten(asked.column("weights")).to_numpy()
                    ends = np.cumsum(pa.compute.list_value_length(asked.column("terms")).to_numpy())
                    out: list[tuple[int, int | None, float]] = []
                    ids = asked.column("query_id").to_pylist()
                    bounds = [least.get(q, (0.0, LAST)) for q in ids]
                    wanted = []
                    for (bound, _), i, j in zip(bounds, [0, *ends.tolist()], ends.tolist(), strict=False):
                        have = terms[i:j] >= 0
                        wanted.append((terms[i:j][have], weights[i:j][have], bound))
                    for q, (bound, last), (rows, scores) in zip(ids, bounds, index.search_many(wanted, TOP), strict=True):
                        if len(rows):  # of equal scores the smaller ids stay
                            own = order[rows]
                            first = np.lexsort((own, -scores))[:TOP]
                            first = first[(scores[first] > bound) | (own[first] <= last)]
                            out += [(q, shard["ids"][d], s) for d, s in zip(rows[first].tolist(), scores[first].tolist(), strict=True)]
                    if out:
                        qs, ds, ss = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(out), pa.int32()), pa.array(qs, pa.int64()), pa.array(ds, pa.int64()), pa.array(ss, pa.float64())], ["block", "query_id", "doc_id", "score"])

    return search


def _weighted(plain: DataFrame, index: DataFrame, n: int, blocks: int) -> DataFrame:
    """(block, query_id, terms, weights) of the queries, one file a block; a weight is a term's count in the query times its IDF."""
    asked = plain.where(f"doc_id % {EVERY} = 0 AND text IS NOT NULL").groupBy(F.col("doc_id").alias("query_id")).agg(F.min("text").alias("text"))
    blocked = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))).cast("int").alias("block"), "query_id", "text")
    terms = blocked.mapInArrow(_terms, "block int, query_id long, terms array<string>, tfs array<int>").select("block", "query_id", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))
    df = index.select(F.inline(F.arrays_zip("terms", "dfs")).alias("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.col("tf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    listed = terms.join(df, "term").groupBy("block", "query_id").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("t"))
    return cut(listed.select("block", "query_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")).repartition("block"), "block")


def search_documents(docs: DataFrame, shard_docs: int = SHARD_DOCS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, doc_id, score): the TOP documents for every document whose id EVERY divides, as a query.

    docs has doc_id and text; more columns are ignored. A query's terms are the lower-case words of its
    whole text, each as often as it stands there; its own document is among the results. Scores over 0
    only; ties go to the smaller doc_id, null last. Rows that repeat a query's id are one query, of the
    smallest text, but documents of their own. Null and empty texts are found by nothing and find nothing.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = cut(plain.mapInArrow(_index(shard_docs), INDEX))
    count = plain.where(f"doc_id % {EVERY} = 0 AND text IS NOT NULL").select("doc_id").distinct().count()
    blocks = -(-count // query_block)
    total = index.agg(F.count("*").alias("shards"), F.sum("n_docs").alias("n"), F.sum("n_words").alias("words")).first()
    queries = _weighted(plain, index, total.n or 0, blocks)
    mean = (total.words or 0) / (total.n or 1)
    by = W.Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best, low, high = None, 0.0, min(1.0, START / max(1, total.shards))
    while True:
        found = index.mapInArrow(_search(_folder(queries), _folder(best) if best else None, blocks, mean, low, high), FOUND)
        if best:
            found = found.unionByName(best.drop("rank").select("block", "query_id", "doc_id", "score"))
        ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TOP)
        done, best = best, cut(ranked.repartition("block"), "block")
        if done:
            drop_cut(done)
        if high >= 1:
            drop_cut(index)
            drop_cut(queries)
            return best.select("query_id", "rank", "doc_id", "score")
        low, high = high, min(1.0, high * SPREAD)
