"""Operator 1: exact substring dedup with fixed-block anchors.

A repeated window of ``window`` words always holds a whole block of ``(window + 1) // 2`` words
that starts at a multiple of the block length in its document. So the non-overlapping blocks of
all documents are indexed, every rolling window of block length probes that index, and each hit
is extended to the windows around it; windows that are equal to an earlier one join to maximal
repeated spans, whose words are removed.

On Spark: documents are dealt into batches by a hash of their id and text. A batch sends each distinct
rolling-block hash once (with marks "stands at a block's place" and "more than once here"),
packed by hash range; a range's task answers which hashes are anchors. Batches then send the
96-bit hashes of the windows around their hits, again once each, with the earliest place; the
range's task answers which of them start earlier in another batch. However often a passage
occurs, a batch sends it once, no pairs of documents are made, and ranges and batches grow in
number with the input, not in size.

Defined cases: null or empty text has no words (n_words 0, hash of the empty string); a text
shorter than the window loses nothing; rows that repeat a doc_id are each returned, and of
windows that tie in (doc_id, start) none is earlier; a null doc_id counts as before all others;
a very long text is one document, held whole by the tasks that group its batch; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_key, partitions, pick, text_bytes
from ._words import Words, U, spread

WINDOW = 20
#: Bytes of text in a batch: what one task holds at once; and bytes of text for each range of hashes.
BATCH_BYTES, RANGE_BYTES = 4 << 20, 16 << 20
_ALIGNED, _AGAIN = U(1), U(2)
_NULL_ID = np.iinfo(np.int64).min


def _planes(keys: np.ndarray, width: int) -> bytes:
    """Sorted keys, highest bytes first and together, so that shuffles compress them."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :width].T[::-1]).tobytes()


def _keys(packed: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(packed) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(width, -1)[::-1].T
    return out.view(U).ravel()


def _lanes(rows: np.ndarray) -> bytes:
    """Rows as their first bytes, then their second ones, and so on: of sorted rows with small numbers, most lanes are nearly constant."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(-1, rows.itemsize).T).tobytes()


def _rows(packed: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the length as the last."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


class _Batch:
    """A batch of documents in order of doc_id, with its words' hashes."""

    def __init__(self, table: pa.Table, window: int):
        ids = table["doc_id"].combine_chunks()
        ids = ids.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        self.table, self.ids = table.take(pa.array(order)), ids[order]
        self.words, self.window, self.block = Words(self.table["text"]), window, (window + 1) // 2
        self.of = self.words.text_of
        self.nth = np.arange(len(self.words)) - self.words.first[:-1][self.of] if len(self.words) else np.zeros(0, np.int64)

    def anchors(self) -> np.ndarray:
        """46-bit hashes of the rolling blocks, over two bits for marks."""
        return (self.words.windows(self.block) >> U(18)) << U(2)

    def whole(self, n: int) -> np.ndarray:
        return self.words.left >= n

    def candidates(self, hits: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchored block."""
        hit = _among(self.anchors(), hits) & self.whole(self.block)
        return np.flatnonzero(spread(hit, self.window - self.block, 0) & self.whole(self.window))

    def named(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.words.windows(self.window)[at], self.words.windows(self.window, 1)[at] & U(0xFFFFFFFF)


_ANSWER = "bucket long, batch long, packed binary"


def _send_anchors(window: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        b = _Batch(table, window)
        keys = b.anchors() | np.where(b.nth % b.block == 0, _ALIGNED, U(0)) if len(b.words) else np.zeros(0, U)
        keys = np.sort(keys[b.whole(b.block)])
        runs = _runs(keys >> U(2))
        some = np.bitwise_or.reduceat(keys, runs[:-1]) if len(keys) else keys
        some |= np.where(np.diff(runs) > 1, _AGAIN, U(0))
        return _by_bucket(table["batch"][0].as_py(), some >> U(16), buckets, lambda a, z: _planes(some[a:z], 6))

    return send


def _by_bucket(batch: int, high: np.ndarray, buckets: int, packed) -> pa.Table:
    """A row for each hash range that has some rows; high: the rows' sorted hashes, as numbers of 32 bits."""
    bucket = (high * U(buckets)) >> U(32)
    cut = _runs(bucket)
    full = bucket[cut[:-1]].astype(np.int64)
    return pa.table({"bucket": pa.array(full, pa.int64()), "batch": pa.array(np.full(len(full), batch), pa.int64()), "packed": pa.array([packed(a, z) for a, z in zip(cut[:-1], cut[1:])], pa.binary())})


def _answers(bucket, batch: np.ndarray, keys: np.ndarray, packed) -> pa.Table:
    """For each batch, what it is told; batch: sorted."""
    cut = _runs(batch)
    to = batch[cut[:-1]]
    return pa.table({"bucket": pa.array(np.full(len(to), bucket), pa.int64()), "batch": pa.array(to, pa.int64()), "packed": pa.array([packed(keys[a:z]) for a, z in zip(cut[:-1], cut[1:])], pa.binary())})


def _match_anchors(table: pa.Table) -> pa.Table:
    """Hashes that stand at a block's place somewhere and occur once more anywhere."""
    parts = [_keys(x, 6) for x in table["packed"].to_pylist()]
    batch = np.repeat(table["batch"].to_numpy(), [len(x) for x in parts])
    keys = np.concatenate(parts)
    order = np.argsort(keys >> U(2), kind="stable")
    keys, batch = keys[order], batch[order]
    runs = _runs(keys >> U(2))
    marks, size = np.bitwise_or.reduceat(keys, runs[:-1]), np.diff(runs)
    good = np.repeat((marks & _ALIGNED > 0) & ((marks & _AGAIN > 0) | (size > 1)), size)
    keys, batch = keys[good] >> U(2), batch[good]
    order = np.argsort(batch, kind="stable")
    return _answers(table["bucket"][0].as_py(), batch[order], keys[order] << U(2), lambda x: _planes(x, 6))


def _hits(told: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, U), *(_keys(x, 6) for x in told["packed"].to_pylist())]))


_NAME = np.dtype([("a", "<u8"), ("b", "<u4")])
_PLACE = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8"), ("nth", "<i4")])


def _send_windows(window: int, buckets: int):
    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return _by_bucket(0, np.zeros(0, U), buckets, bytes)
        b = _Batch(docs, window)
        at = b.candidates(_hits(told))
        rows = np.zeros(len(at), _PLACE)
        rows["a"], rows["b"] = b.named(at)
        rows["doc"], rows["nth"] = b.ids[b.of[at]], b.nth[at]
        rows = rows[np.lexsort([rows["nth"], rows["doc"], rows["b"], rows["a"]])]  # the earliest of each name first
        new = np.ones(len(rows), bool)
        new[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
        rows = rows[new]
        return _by_bucket(docs["batch"][0].as_py(), rows["a"] >> U(32), buckets, lambda x, z: _lanes(rows[x:z]))

    return send


def _match_windows(table: pa.Table) -> pa.Table:
    """For each batch, the windows that another batch has earlier."""
    parts = [_rows(x, _PLACE) for x in table["packed"].to_pylist()]
    batch = np.repeat(table["batch"].to_numpy(), [len(x) for x in parts])
    rows = np.concatenate(parts)
    order = np.lexsort([rows["nth"], rows["doc"], rows["b"], rows["a"]])
    rows, batch = rows[order], batch[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
    lead = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    later = (rows["doc"] > lead["doc"]) | (rows["nth"] > lead["nth"])
    rows, batch = rows[later], batch[later]
    order = np.argsort(batch, kind="stable")
    named = np.zeros(len(rows), _NAME)
    named["a"], named["b"] = rows["a"], rows["b"]
    return _answers(table["bucket"][0].as_py(), batch[order], named[order], _lanes)


def _remove(window: int):
    def remove(docs: pa.Table, told: pa.Table) -> pa.Table:
        b = _Batch(docs, window)
        kind = told["kind"].to_numpy() if told.num_rows else np.zeros(0, np.int32)
        at = b.candidates(_hits(told.filter(pa.array(kind == 0)))) if len(kind) else np.zeros(0, np.int64)
        gone = np.zeros(len(b.words), bool)
        if len(at):
            names = np.zeros(len(at), _NAME)
            names["a"], names["b"] = b.named(at)
            order = np.lexsort([b.nth[at], b.ids[b.of[at]], names["b"], names["a"]])
            names, at = names[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = (names["a"][1:] != names["a"][:-1]) | (names["b"][1:] != names["b"][:-1])
            lead = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            later = (b.ids[b.of[at]] > b.ids[b.of[lead]]) | (b.nth[at] > b.nth[lead])
            elsewhere = np.concatenate([np.zeros(0, _NAME), *(_rows(x, _NAME) for x in told.filter(pa.array(kind == 1))["packed"].to_pylist())])
            elsewhere = elsewhere[np.lexsort([elsewhere["b"], elsewhere["a"]])]
            # names of one 64-bit half are looked up, then held against the other half
            lo, hi = np.searchsorted(elsewhere["a"], names["a"]), np.searchsorted(elsewhere["a"], names["a"], side="right")
            told_of = np.zeros(len(at), bool)
            for i in range(int((hi - lo).max(initial=0))):
                j = np.minimum(lo + i, len(elsewhere) - 1)
                told_of |= (lo + i < hi) & (elsewhere["b"][j] == names["b"])
            start = np.zeros(len(b.words), bool)
            start[at[later | told_of]] = True
            gone = spread(start, 0, window - 1)
        lost = np.concatenate([[0], np.cumsum(gone)])
        lost = lost[b.words.first[1:]] - lost[b.words.first[:-1]]
        digests = []
        for i, text in enumerate(b.table["text"].to_pylist()):
            words = (text or "").encode().split()
            if lost[i]:
                stays = ~gone[b.words.first[i] : b.words.first[i + 1]]
                words = [words[j] for j in np.flatnonzero(stays)]
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table({"doc_id": b.table["doc_id"].cast(pa.int64()), "n_words": pa.array(b.words.count, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    return remove


def kept_digests(docs: DataFrame, window: int = WINDOW, batch_bytes: int = BATCH_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id="long", text="string")
    size = text_bytes(docs)
    batches, ranges = (max(partitions(spark), -(-size // each)) for each in (batch_bytes, range_bytes))
    # by text too: rows without an id, or with one that repeats, are spread like all others
    dealt = by_key(docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))), "batch", batches)
    to_ranges, to_batches = (lambda df: by_key(df, "bucket", ranges, 1).groupBy("bucket")), (lambda df: by_key(df, "batch", batches).groupBy("batch"))
    hits = to_ranges(dealt.groupBy("batch").applyInArrow(_send_anchors(window, ranges), _ANSWER)).applyInArrow(_match_anchors, _ANSWER)
    earlier = to_ranges(dealt.groupBy("batch").cogroup(to_batches(hits)).applyInArrow(_send_windows(window, ranges), _ANSWER)).applyInArrow(_match_windows, _ANSWER)
    told = hits.withColumn("kind", F.lit(0)).unionByName(earlier.withColumn("kind", F.lit(1)))
    return dealt.groupBy("batch").cogroup(to_batches(told)).applyInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
