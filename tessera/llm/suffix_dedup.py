"""Removal of long strings that an earlier document has, by sorted suffixes.

Suffixes that can matter are picked by content: of the K-byte strings in a window of SPAN bytes the one
of least hash is the window's anchor, so that equal windows have equal anchors wherever they stand.
Anchors whose K bytes turn up in one document only are dropped. The suffixes at the other anchors,
dealt by those K bytes, are sorted deep-shallow: multikey quicksort to a shallow depth, then blind
tries for what still agrees. Common prefix lengths, forwards and backwards, then tell which windows
around an anchor also stand in a smaller document.

Documents are dealt into parts of bounded size; all messages are packed arrays between a part and a
bucket of anchors, one entry for each distinct string in the part. So a passage in a third of all
documents makes as many entries as there are parts. An anchor with very many entries is replaced by
the windows around it, dealt by their whole content.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.columns import packed, unpacked
from tessera.session import text_parts

#: Bytes of a string that is removed, of an anchor, and places of an anchor in a window.
SPAN, K = 50, 24
PLACES = SPAN - K + 1
BACK = SPAN - K
WIDTH = BACK + SPAN
#: Bytes of text in a part, and in the pieces whose hashes are worked out at once.
PART_BYTES = 12_000_000
PIECE = 1 << 16
#: Contexts that are spelt out at once.
ROWS = 50_000
#: Distinct contexts of an anchor (counted by part) beyond which the windows around it are dealt on their own.
CROWDED = 20_000
#: The depth in bytes from which blind tries sort.
SHALLOW = 24

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = {k: np.uint64(m) | np.uint64(1) for k, m in zip((1, 2, 4, 8, 16, 32), _rng.integers(1 << 40, 1 << 63, 6, np.uint64), strict=True)}
_LAST = np.int64(np.iinfo(np.int64).max)


def _rolled(text: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each string of so many bytes (a multiple of 2), by doubling."""
    have = {1: _BYTE[text]}
    size = 1
    while size * 2 <= length:
        h = have[size]
        have[size * 2] = h[:-size] * _MUL[size] + h[size:]
        size *= 2
    out, done = have[size], size
    while done < length:
        step = max(k for k in have if k <= length - done)
        n = len(text) - done - step + 1
        out = out[:n] * _MUL[step] + have[step][done : done + n]
        done += step
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return x if size == width else least(x[: len(x) - (width - size)], x[width - size :])


class Part:
    """The documents of a part in one buffer, with SPAN zero bytes around each."""

    def __init__(self, table: pa.Table) -> None:
        texts = [t or b"" for t in table.column("text").cast(pa.large_binary()).to_pylist()]
        ids = table.column("doc_id").to_pylist()
        self.ids = np.array([_LAST if i is None else i for i in ids], np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        pad = bytes(SPAN)
        self.text = np.frombuffer(pad + b"".join(x for t in texts for x in (t, pad)), np.uint8)
        self.starts = SPAN + np.cumsum(self.sizes + SPAN) - self.sizes - SPAN
        self.ends = self.starts + self.sizes

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (in the buffer) of anchors, their hashes, and hashes of the WIDTH bytes around them."""
        places, hashes, around = [], [], []
        window = np.zeros(len(self.text), bool)  # does a window begin here?
        for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            if e - s >= SPAN:
                window[s : e - SPAN + 1] = True
        gap = np.zeros(PLACES - 1, np.uint64)
        for at in range(0, len(self.text) - SPAN + 1, PIECE):
            ok = window[at : at + PIECE]
            if not ok.any():
                continue
            low = max(0, at - BACK)
            every = _rolled(self.text[low : at + PIECE + 2 * SPAN], K)
            h = every[at - low : at - low + PIECE + PLACES - 1]
            least = _sliding(h, PLACES, np.minimum)
            least = np.where(ok[: len(least)], least, 0)
            best = _sliding(np.concatenate([gap, least, gap]), PLACES, np.maximum)
            found = np.flatnonzero(best == h[: len(best)])
            places.append(found + at)
            hashes.append(h[found])
            name = np.zeros(len(found), np.uint64)
            for k in (-BACK, -BACK + 2, K, SPAN - K):
                beside = np.clip(found + at - low + k, 0, len(every) - 1)
                name = (name ^ every[beside]) * np.uint64(0x9E3779B97F4A7C15)
                name ^= name >> np.uint64(31)
            around.append(name)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        places, first = np.unique(np.concatenate(places), return_index=True)  # pieces overlap
        return places, np.concatenate(hashes)[first], np.concatenate(around)[first]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])), len(sorted_keys)) if len(sorted_keys) else np.zeros(1, int)


def _split(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit name of anchors in it."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets, (h >> np.uint64(32)).astype(np.uint32)


def _offer(buckets: int):
    """Phase 1: a part's distinct anchors, by bucket."""

    def offer(key: tuple, table: pa.Table) -> pa.Table:
        part = Part(table)
        places, h, around = part.anchors()
        bucket, name = _split(h, buckets)
        ids = part.ids[part.document(places)] if len(places) else np.zeros(0, np.int64)
        both = bucket << 32 | name
        order = np.lexsort((around, both))
        both, ids, around = both[order], ids[order], around[order]
        cuts = _groups(both)
        if len(both):
            low, high = np.minimum.reduceat(ids, cuts[:-1]), np.maximum.reduceat(ids, cuts[:-1])
            count = np.add.reduceat(np.append(True, (around[1:] != around[:-1]) | (both[1:] != both[:-1])).astype(np.int64), cuts[:-1])
            both = both[cuts[:-1]]
            # Twice the logarithm of the number of distinct contexts, and 1 more for two documents or more.
            weight = (2 * np.log2(count).astype(int) + (low < high)).astype(np.uint8)
        else:
            weight = np.zeros(0, np.uint8)
        at = _groups(both >> 32)
        rows = list(itertools.pairwise(at.tolist()))
        return pa.table(
            {
                "bucket": pa.array([int(both[i] >> 32) for i, _ in rows], pa.int64()),
                "part": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                "names": pa.array([(both[i:j] & 0xFFFFFFFF).astype(np.uint32).tobytes() for i, j in rows], pa.binary()),
                "weights": pa.array([_pack(weight[i:j]) for i, j in rows], pa.binary()),
            }
        )

    return offer


def _shared(table: pa.Table) -> pa.Table:
    """For each part, which of its anchors in this bucket are in two documents or more (1), or crowded (2)."""
    bucket = table.column("bucket")[0].as_py()
    names = [np.frombuffer(x, np.uint32) for x in table.column("names").to_pylist()]
    weights = [_unpack(x, np.uint8) for x in table.column("weights").to_pylist()]
    every, w = np.concatenate(names), np.concatenate(weights)
    order = np.argsort(every, kind="stable")
    cuts = _groups(every[order])[:-1]
    w = w[order].astype(np.int64)
    parts, own, entries = np.diff(np.append(cuts, len(w))), np.maximum.reduceat(w & 1, cuts), np.add.reduceat(1 << (w >> 1), cuts)
    kind = np.where((parts > 1) | (own > 0), 1 + (entries > CROWDED), 0).astype(np.uint8)
    verdict = np.empty(len(every), np.uint8)
    verdict[order] = np.repeat(kind, parts)
    out = {"part": [], "kinds": []}
    for p, v in zip(table.column("part").to_pylist(), np.split(verdict, np.cumsum([len(n) for n in names])[:-1]), strict=True):
        out["part"].append(p)
        out["kinds"].append(_pack(v))
    n = len(out["part"])
    return _messages(out["part"], [bucket] * n, [names[i].tobytes() for i in range(n)], out["kinds"], [None] * n)


def _messages(part, bucket, a, b, c) -> pa.Table:
    """Rows to parts."""
    return pa.table({"part": pa.array(part, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "c": pa.array(c, pa.binary())})


MESSAGE = "part long, bucket long, a binary, b binary, c binary"


class Contexts:
    """A part's shared anchors with the bytes around them: BACK before, SPAN from it, and how many of each are text."""

    def __init__(self, part: Part, verdict: pa.Table, buckets: int) -> None:
        places, h, _ = part.anchors()
        bucket, name = _split(h, buckets)
        known, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for b, a, k in zip(*(verdict.column(c).to_pylist() for c in ("bucket", "a", "b")), strict=True):
            names = np.frombuffer(a, np.uint32)
            kind = _unpack(k, np.uint8)
            known.append((b << 32 | names.astype(np.int64))[kind > 0])
            kinds.append(kind[kind > 0])
        known, kinds = np.concatenate(known), np.concatenate(kinds)
        order = np.argsort(known)
        known, kinds = known[order], kinds[order]
        key = bucket << 32 | name
        at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        kind = np.where(known[at] == key, kinds[at], 0) if len(known) else np.zeros(len(key), np.uint8)
        single, crowd = places[kind == 1], places[kind == 2]
        # Crowded anchors give way to each window around them.
        extra = [np.zeros(0, np.int64)]
        for k in range(0, len(crowd), ROWS):
            extra.append(np.unique((crowd[k : k + ROWS, None] - np.arange(PLACES)).ravel()))
        crowd = np.unique(np.concatenate(extra))
        document = part.document(crowd)
        crowd = crowd[(document >= 0) & (crowd >= part.starts[document]) & (crowd <= part.ends[document] - SPAN)] if len(crowd) else crowd
        whole = len(single)
        self.places = np.concatenate([single, crowd])
        self.document = part.document(self.places).astype(np.int32) if len(self.places) else np.zeros(0, np.int32)
        self.back = np.minimum(BACK, self.places - part.starts[self.document]).astype(np.uint8)
        self.ahead = np.minimum(SPAN, part.ends[self.document] - self.places).astype(np.uint8)
        self.back[whole:] = 0
        bucket = bucket[kind == 1]
        width = 4 + WIDTH + 2
        kinds_of, numbers, at = [np.zeros(0, f"S{width}")], [np.zeros(0, np.int64)], 0
        for k in range(0, len(self.places), ROWS):
            places = self.places[k : k + ROWS]
            rows = np.zeros((len(places), width), np.uint8)
            # SPAN bytes of padding on either side, so that these bytes always exist.
            rows[:, 4 : 4 + WIDTH] = np.lib.stride_tricks.sliding_window_view(part.text, WIDTH)[places - BACK]
            alone = max(0, whole - k)  # rows from here on are windows
            rows[alone:, 4 : 4 + BACK] = 0
            own = bucket[k : k + ROWS]
            if alone < len(places):
                h = _rolled(np.ascontiguousarray(rows[alone:, 4 + BACK : 4 + WIDTH]).ravel(), SPAN)[::SPAN]
                own = np.concatenate([own, (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets])
            rows[:, :4] = own.astype(">u4").view(np.uint8).reshape(len(places), 4)
            rows[:, -2], rows[:, -1] = self.back[k : k + ROWS], self.ahead[k : k + ROWS]
            distinct, number = np.unique(rows.view(f"S{width}").ravel(), return_inverse=True)
            kinds_of.append(distinct)
            numbers.append(number + at)
            at += len(distinct)
        distinct, number = np.unique(np.concatenate(kinds_of), return_inverse=True)
        self.number = number[np.concatenate(numbers)]
        self.rows = np.frombuffer(distinct.tobytes(), np.uint8).reshape(len(distinct), width)
        self.least = np.full(len(distinct), _LAST)
        np.minimum.at(self.least, self.number, part.ids[self.document])
        self.bucket = np.frombuffer(np.ascontiguousarray(self.rows[:, :4]).tobytes(), ">u4").astype(np.int64)


def _contexts(buckets: int):
    """Phase 2: a part's distinct contexts, by bucket."""

    def contexts(key: tuple, docs: pa.Table, verdict: pa.Table) -> pa.Table:
        c = Contexts(Part(docs), verdict, buckets)
        cuts = list(itertools.pairwise(_groups(c.bucket).tolist()))
        return _messages([key[0].as_py()] * len(cuts), [int(c.bucket[i]) for i, _ in cuts], [_pack(c.rows[i:j, 4:]) for i, j in cuts], [_pack(c.least[i:j]) for i, j in cuts], [None] * len(cuts))

    return contexts


def blind_trie(keys: list[int], bits: int) -> tuple[list[int], list[int]]:
    """Sort the numbers of keys (of so many bits) by a blind trie: their order, and the bits each shares with the one before.

    Inner nodes hold only the bit that they test. A key goes down by those bits to some leaf; comparing
    with that leaf alone gives the bit to branch at.
    """
    test, left, right = [], [], []  # inner nodes
    leaf: list[list[int]] = [[0]]  # of equal keys; leaf k is child ~k
    root = ~0
    for i in range(1, len(keys)):
        key, node = keys[i], root
        while node >= 0:
            node = right[node] if key >> test[node] & 1 else left[node]
        differ = key ^ keys[leaf[~node][0]]
        if not differ:
            leaf[~node].append(i)
            continue
        at = differ.bit_length() - 1
        up, node = -1, root
        while node >= 0 and test[node] > at:
            up, node = node, right[node] if key >> test[node] & 1 else left[node]
        new = len(test)
        test.append(at)
        leaf.append([i])
        one = key >> at & 1
        left.append(node if one else ~(len(leaf) - 1))
        right.append(~(len(leaf) - 1) if one else node)
        if up < 0:
            root = new
        elif key >> test[up] & 1:
            right[up] = new
        else:
            left[up] = new
    order, shared = [], []
    stack = [(root, 0)]
    while stack:
        node, common = stack.pop()
        if node >= 0:
            stack += [(right[node], bits - 1 - test[node]), (left[node], common)]
        else:
            order += leaf[~node]
            shared += [common] + [bits] * (len(leaf[~node]) - 1)
    return order, shared


def deep_shallow(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of bytes: their order, and the bytes each shares with the one before.

    Multikey quicksort with symbols of eight bytes, all groups of a depth in one pass, up to SHALLOW
    bytes; rows that agree so far go to a blind trie for each group. Shared bytes under SHALLOW
    count as 0.
    """
    n, width = text.shape
    order, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(0, SHALLOW, 8):
        symbol = np.ascontiguousarray(text[:, d : d + 8]).view(">u8").ravel().astype(np.uint64)
        own = np.empty(n, np.int64)
        own[order] = group
        order = np.lexsort((symbol, own))
        s, o = symbol[order], own[order]
        group = np.cumsum(np.append(0, (s[1:] != s[:-1]) | (o[1:] != o[:-1]))) if n else group
    shared = np.zeros(n, np.int64)
    bits, cuts = 8 * (width - SHALLOW), _groups(group)
    tails = text[:, SHALLOW:]
    for i in np.flatnonzero(np.diff(cuts) > 1).tolist():
        a, b = cuts[i], cuts[i + 1]
        at = order[a:b]
        found, common = blind_trie([int.from_bytes(x.tobytes()) for x in tails[at]], bits)
        order[a:b] = at[found]
        shared[a + 1 : b] = SHALLOW + np.array(common[1:]) // 8
    return order, shared


def earlier(back: np.ndarray, ahead: np.ndarray, has_back: np.ndarray, has_ahead: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct contexts, the least and the largest offset of windows that a smaller document has (255, 0: none)."""
    n = len(ids)
    low, high = np.full(n, 255, np.uint8), np.zeros(n, np.uint8)
    order, shared = deep_shallow(ahead)
    behind = np.zeros(n, np.int64)
    for o in range(PLACES):
        if o:  # groups that agree in one byte more before the anchor
            _, behind = np.unique(behind << 8 | back[:, BACK - o], return_inverse=True)
        front = np.empty(n, np.int64)
        front[order] = np.cumsum(shared < SPAN - o)
        ok = np.flatnonzero((has_back >= o) & (has_ahead >= SPAN - o))
        key = front[ok] * np.int64(n + 1) + behind[ok]
        by = np.argsort(key, kind="stable")
        cuts = _groups(key[by])
        if not len(ok):
            continue
        size = np.diff(cuts)
        if (size > 1).any():
            least = np.repeat(np.minimum.reduceat(ids[ok][by], cuts[:-1]), size)
            hit = ok[by[ids[ok][by] > least]]
            low[hit] = np.minimum(low[hit], o)
            high[hit] = o
    return low, high


def _answer(table: pa.Table) -> pa.Table:
    """For each context that a part sent: the smallest document that has it, and that one's own windows in smaller ones."""
    bucket = table.column("bucket")[0].as_py()
    rows = [_unpack(x, np.uint8).reshape(-1, WIDTH + 2) for x in table.column("a").to_pylist()]
    ids = np.concatenate([_unpack(x, np.int64) for x in table.column("b").to_pylist()])
    sizes = [len(r) for r in rows]
    every = np.concatenate(rows)
    distinct, number = np.unique(every.view(f"S{WIDTH + 2}").ravel(), return_inverse=True)
    every = np.frombuffer(distinct.tobytes(), np.uint8).reshape(-1, WIDTH + 2)
    least = np.full(len(every), _LAST)
    np.minimum.at(least, number, ids)
    low, high = earlier(every[:, :BACK], every[:, BACK:WIDTH], every[:, -2], every[:, -1], least)
    cuts = np.cumsum(sizes)[:-1]
    packed = [[_pack(x) for x in np.split(v[number], cuts)] for v in (least, low, high)]
    return _messages(table.column("part").to_pylist(), [bucket] * len(sizes), *packed)


def _apply(buckets: int, names: list[str], binary: bool):
    """Phase 3: the documents of a part without their removed bytes."""

    def apply(key: tuple, docs: pa.Table, mail: pa.Table) -> pa.Table:
        part = Part(docs)
        answers = mail.filter(pa.compute.is_valid(mail.column("c")))
        c = Contexts(part, mail.filter(pa.compute.is_null(mail.column("c"))), buckets)
        least, low, high = np.full(len(c.rows), _LAST), np.full(len(c.rows), 255, np.uint8), np.zeros(len(c.rows), np.uint8)
        at = dict(zip(c.bucket[(cuts := _groups(c.bucket))[:-1]].tolist() if len(c.bucket) else [], itertools.pairwise(cuts.tolist()), strict=False))
        for b, *blobs in zip(*(answers.column(x).to_pylist() for x in ("bucket", "a", "b", "c")), strict=True):
            i, j = at[b]
            least[i:j], low[i:j], high[i:j] = _unpack(blobs[0], np.int64), _unpack(blobs[1], np.uint8), _unpack(blobs[2], np.uint8)
        later = part.ids[c.document] > least[c.number]
        first = np.where(later, SPAN - c.ahead, low[c.number]).astype(np.int64)
        last = np.where(later, c.back, high[c.number]).astype(np.int64)
        hit = (first <= last) & (first < PLACES)
        change = np.zeros(len(part.text) + 1, np.int32)
        np.add.at(change, c.places[hit] - last[hit], 1)
        np.add.at(change, c.places[hit] - first[hit] + SPAN, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        kept, removed, spans = [], [], []
        for s, e in zip(part.starts.tolist(), part.ends.tolist(), strict=True):
            g = gone[s:e]
            kept.append(part.text[s:e][~g].tobytes())
            removed.append(int(g.sum()))
            spans.append(int(np.count_nonzero(g & ~gone[s - 1 : e - 1])) if e > s else 0)
        out = {n: docs.column(n) for n in docs.column_names if n in names}
        out |= {"_n_bytes": pa.array(part.sizes), "_n_removed": pa.array(removed, pa.int64()), "_n_spans": pa.array(spans, pa.int64()), "_kept": pa.array(kept, pa.binary()) if binary else pa.array([k.decode(errors="ignore") for k in kept], pa.string())}
        return pa.table({n: out[n] for n in names})

    return apply


#: Columns that the operator adds; columns of the input with these names are replaced.
ADDED = ("n_bytes", "n_removed", "n_spans", "kept")


def remove_repeats(docs: DataFrame, binary: bool = True) -> DataFrame:
    """Every row of docs with n_bytes, n_removed, n_spans and kept (binary, or a string) in place of text.

    A text is its UTF-8 bytes, a null one is empty. Bytes are removed if a string of SPAN bytes that covers
    them also stands in a row of smaller doc_id. Rows of the same doc_id take nothing from each other; rows
    without a doc_id count as larger than all others. Columns of docs named as the added ones are replaced,
    others may have any name. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c != "text" and c not in ADDED]
    plain = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), without=("text", *ADDED))
    done = _removed(plain, binary)
    return unpacked(done, names, *[F.col(f"_{n}").alias(n) for n in ADDED])


def _removed(plain: DataFrame, binary: bool) -> DataFrame:
    """ROW, doc_id and text to ROW, doc_id and ADDED after an underscore."""
    parts = text_parts(plain, "text", PART_BYTES)
    own = [f for f in plain.schema.fields if f.name != "text"]
    keyed = plain.withColumn("_part", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 100)), F.lit(parts))).repartition(parts, "_part")
    offers = keyed.groupBy("_part").applyInArrow(_offer(parts), "bucket long, part long, names binary, weights binary")
    verdict = offers.groupBy("bucket").applyInArrow(_shared, MESSAGE).repartition(parts, "part")
    sent = keyed.groupBy("_part").cogroup(verdict.groupBy("part")).applyInArrow(_contexts(parts), MESSAGE)
    answers = sent.groupBy("bucket").applyInArrow(_answer, MESSAGE)
    mail = verdict.unionByName(answers)
    result = T.StructType([*own, *[T.StructField(n, T.LongType()) for n in ("_n_bytes", "_n_removed", "_n_spans")], T.StructField("_kept", T.BinaryType() if binary else T.StringType())])
    return keyed.groupBy("_part").cogroup(mail.groupBy("part")).applyInArrow(_apply(parts, result.fieldNames(), binary), result)


def digests(removed: DataFrame) -> DataFrame:
    """The numbers of remove_repeats() with the SHA-256 of the kept bytes; nothing kept is the hash of no bytes."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, with the kept bytes as text (pieces of cut characters are left out; null texts are empty).

    Columns may have any names; an empty table gives no rows.
    """
    plain = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), without=("text",))
    return unpacked(_removed(plain, binary=False), docs.columns, instead={"text": F.col("_kept")})
