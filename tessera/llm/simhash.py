"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: the perfect binary Golay code on 23 bits (covering radius
3), used on one or two blocks of the 64. A fingerprint has one home, the anchor next to it, and
visits every anchor within the covering radius plus the threshold. If x and y differ in at most 3
bits, y visits the home of x: with x at distance at most 3 from its home in each block, y is at most
3 + e_i away in block i, where the e_i add up to at most 3. So comparing the homes of each anchor
with its visitors finds every pair.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.llm.columns import ROW, packed, unpacked
from tessera.operators.graph import connected_components
from tessera.session import cut

THRESHOLD = 3
SHINGLE = 3
SEED = 42

#: Golay code: length, message bits, covering radius, generator polynomial (fixed values).
LENGTH, MESSAGE, RADIUS, GENERATOR = 23, 12, 3, 0xAE3

#: Homes an anchor has on average at most with one block; beyond, two blocks are used.
HOMES_PER_ANCHOR = 256
#: An anchor with more homes is split into parts of about so many.
HOMES_PER_PART = 4096
#: (anchor, fingerprint) entries in a bucket that one task compares.
BUCKET_ENTRIES = 400_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """64 bits: a bit is 1 if it is set in over half the hashes of the text's word shingles (none: 0)."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter((hashed(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["doc_id", "fp"])


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the words of 12 and 11 bits at either end, and the errors up to weight 6 by syndrome.

    Errors are in one list, by syndrome then weight; ends[s, t] is where those of excess over t begin.
    """
    def remainder(x: int) -> int:
        for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - (LENGTH - MESSAGE))
        return x

    unit = np.array([remainder(1 << i) for i in range(LENGTH)])
    errors, syndromes, weights = [], [], []
    for w in range(RADIUS + THRESHOLD + 1):
        at = np.array(list(itertools.combinations(range(LENGTH), w)), int).reshape(math.comb(LENGTH, w), w)
        errors.append((1 << at).sum(1))
        syndromes.append(np.bitwise_xor.reduce(unit[at], axis=1) if w else np.zeros(1, int))
        weights.append(np.full(len(at), w))
    errors, syndromes, weights = map(np.concatenate, (errors, syndromes, weights))
    order = np.lexsort((errors, weights, syndromes))
    errors, syndromes, excess = errors[order], syndromes[order], np.maximum(0, weights[order] - RADIUS)
    n = 1 << (LENGTH - MESSAGE)
    ends = np.stack([np.searchsorted(syndromes * 8 + excess, np.arange(n) * 8 + t, "right") for t in range(-1, THRESHOLD + 1)], 1)
    low = np.zeros(1 << 12, int)
    high = np.zeros(1 << 11, int)
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ unit[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ unit[12 + i]
    return low, high, errors, ends


def _expand(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, and all integers of the ranges [start, stop) row by row."""
    size = stop - start
    rows = np.repeat(np.arange(len(size)), size)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(size) - size - start, size)


def _block(fp: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of block k, and their syndromes."""
    v = (fp >> np.uint64(LENGTH * k)).astype(np.int64) & ((1 << LENGTH) - 1)
    low, high, _, _ = _golay()
    return v, low[v & 0xFFF] ^ high[v >> 12]


def homes(fp: np.ndarray, blocks: int) -> np.ndarray:
    """The anchor next to each fingerprint: the message bits of each block's code word."""
    _, _, errors, ends = _golay()
    out = np.zeros(len(fp), np.int64)
    for k in range(blocks):
        v, s = _block(fp, k)
        out = out << MESSAGE | (v ^ errors[ends[s, 0]]) >> (LENGTH - MESSAGE)  # least weight first
    return out


def visits(fp: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors of all visits."""
    _, _, errors, ends = _golay()
    rows, anchors, spent = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
    for k in range(blocks):
        v, s = _block(fp, k)
        parts = []
        for t in range(THRESHOLD + 1):  # excess t in this block
            able = np.flatnonzero(spent + t <= THRESHOLD)
            at, e = _expand(ends[s[rows[able]], t], ends[s[rows[able]], t + 1])
            at = able[at]
            parts.append((rows[at], anchors[at] << MESSAGE | (v[rows[at]] ^ errors[e]) >> (LENGTH - MESSAGE), spent[at] + t))
        rows, anchors, spent = (np.concatenate(x) for x in zip(*parts, strict=True))
    return rows, anchors


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _dealt(split: dict[int, int], blocks: int, buckets: int):
    """Batches of fingerprints to rows (bucket, keys, fps, home flags); keys are sorted and sent as packed differences."""
    names, counts = (np.array(x, np.int64) for x in (sorted(split), [split[k] for k in sorted(split)]))

    def parts_of(anchor: np.ndarray) -> np.ndarray:
        if not len(names):
            return np.ones(len(anchor), np.int64)
        at = np.minimum(np.searchsorted(names, anchor), len(names) - 1)
        return np.where(names[at] == anchor, counts[at], 1)

    def squeeze(x: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(x.tobytes())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(every), 4096):
                fp = every[k : k + 4096]
                rows, anchors = visits(fp, blocks)
                home = anchors == homes(fp, blocks)[rows]
                many = parts_of(anchors)
                if (many > 1).any():  # a home goes to one part, as a visitor it goes to all
                    own = (_mixed(fp[rows]) >> np.uint64(7)).astype(np.int64) % many
                    at, part = _expand(np.zeros(len(many), np.int64), many)
                    rows, anchors, home = rows[at], anchors[at], home[at] & (own[at] == part)
                else:
                    part = np.zeros(len(anchors), np.int64)
                key = (part << 24) | anchors
                bucket = (_mixed(key) >> np.uint64(20)).astype(np.int64) % buckets
                order = np.lexsort((key, bucket))
                first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
                cuts = [*first, len(order)]
                key, out, home = key[order], fp[rows[order]], home[order]
                runs = list(itertools.pairwise(cuts))
                pieces = [[squeeze(np.diff(key[i:j], prepend=0)) for i, j in runs], [out[i:j].tobytes() for i, j in runs], [squeeze(np.packbits(home[i:j])) for i, j in runs]]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][first]), *[pa.array(p, pa.binary()) for p in pieces]], ["bucket", "keys", "fps", "home"])

    return deal


def _forest(own: np.ndarray, all_: np.ndarray, out: list[np.ndarray]) -> None:
    """Add a spanning forest, over all_, of the links between own and all_ (sorted, distinct) to out."""
    label = np.arange(len(all_))
    for i in range(0, len(own), 128):
        tile = own[i : i + 128]
        near = np.empty((len(tile), len(all_)), bool)
        for j in range(0, len(all_), 8192):
            np.less_equal(np.bitwise_count(tile[:, None] ^ all_[None, j : j + 8192]), THRESHOLD, out=near[:, j : j + 8192])
        for r in np.flatnonzero(near.sum(1) > 1):
            found = label[near[r]]
            least = found.min()
            joined = np.unique(found[found != least])
            if len(joined):
                out.append(np.stack([np.full(len(joined), all_[least]), all_[joined]], 1))
                label[np.isin(label, joined)] = least


def _compare(table: pa.Table) -> pa.Table:
    """Links of one bucket, as a spanning forest for each anchor."""
    opened = zstandard.ZstdDecompressor().decompress
    key = np.concatenate([np.cumsum(np.frombuffer(opened(x), np.int64)) for x in table.column("keys").to_pylist()])
    each = [np.frombuffer(x, np.uint64) for x in table.column("fps").to_pylist()]
    fp = np.concatenate(each)
    home = np.concatenate([np.unpackbits(np.frombuffer(opened(x), np.uint8), count=len(e)).astype(bool) for x, e in zip(table.column("home").to_pylist(), each, strict=True)])
    order = np.lexsort((fp, key))
    key, fp, home = key[order], fp[order], home[order]
    edges: list[np.ndarray] = []
    for i, j in itertools.pairwise([*np.flatnonzero(np.r_[True, np.diff(key) != 0]), len(key)]):
        if home[i:j].any() and j - i > 1:
            _forest(fp[i:j][home[i:j]], fp[i:j], edges)
    both = np.concatenate(edges).view(np.int64) if edges else np.zeros((0, 2), np.int64)
    return pa.table({"a": both[:, 0], "b": both[:, 1]})


def _links(fps: DataFrame, n: int) -> DataFrame:
    """Links between distinct fingerprints (column fp, n rows): enough of them to join what is connected."""
    blocks = 1 if n <= HOMES_PER_ANCHOR << MESSAGE else 2
    per = (71, 301)[blocks - 1]  # visits of a fingerprint, on average
    buckets = max(1, -(-n * per // BUCKET_ENTRIES))

    def home_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(homes(b.column(0).to_numpy().view(np.uint64), blocks))], ["anchor"])

    # At most n / HOMES_PER_PART anchors are crowded; only their numbers come to the driver.
    crowded = fps.select("fp").mapInArrow(home_of, "anchor long").groupBy("anchor").count().where(F.col("count") > HOMES_PER_PART)
    split = {r.anchor: -(-r["count"] // HOMES_PER_PART) for r in crowded.collect()}
    dealt = fps.select("fp").mapInArrow(_dealt(split, blocks, buckets), "bucket long, keys binary, fps binary, home binary")
    return dealt.groupBy("bucket").applyInArrow(_compare, "a long, b long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text; more columns are ignored).

    Rows with fingerprints at 3 or fewer differing bits are linked; component_id is the smallest doc_id
    that links lead to. Null and empty texts have fingerprint zero. Equal fingerprints are one node, so
    copies make no pairs. Repeated doc_ids stay rows of their own; a null doc_id keeps its row, and counts
    for component_id only if all of its component are null (then it is null).
    """
    signed = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"))
    fps = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = fps.count()
    joined = connected_components(cut(_links(fps, n)))
    of = fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = of.select("fp", "component").join(least, "component").select("fp", "component_id")
    return signed.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs with one document of each component: that of the smallest doc_id.

    Of rows that repeat such a doc_id the one of the smallest text stays (null first). Rows without a doc_id stay only if their whole
    component has none. Columns are those of docs, whatever their names. An empty table gives no rows.
    """
    comp = cut(simhash_components(docs))
    keep = comp.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("_keep")).count()
    # As many ids as documents stay: never broadcast, however few they are here.
    rows = packed(docs, F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    kept = rows.join(keep.select("_keep").hint("merge"), F.col("_id").eqNullSafe(F.col("_keep")), "left_semi")
    if not keep.where("_keep IS NOT NULL AND count > 1").isEmpty():
        place = F.row_number().over(W.Window.partitionBy("_id").orderBy("_text", F.xxhash64(ROW)))
        kept = kept.where("_id IS NOT NULL").withColumn("_place", place).where("_place = 1").drop("_place").unionByName(kept.where("_id IS NULL"))
    return unpacked(kept, docs.columns)
