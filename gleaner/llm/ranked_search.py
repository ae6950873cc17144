"""Operator 13: ranked lexical search by range maxima over posting lists.

The index has a row for each shard, some thousand documents that lie together in the table: their
ids and sizes, and for each term (named by 64 bits) the documents that hold it and how often.
Searching, a shard's lists are turned to impacts (the part of the score that a term adds, without
its weight), and a sparse table over each list gives the place of the greatest impact of any
stretch of it at once. A shard's documents are then an interval that no document of can score more
than the sum over the terms of weight times the greatest impact within. Intervals wait best first;
one is split at the document that holds the greatest weighted impact in it, which is scored
exactly, and the two sides are bounded anew. What can't reach the k-th best score found so far, in
this shard or an earlier one of the task, is never looked at.

Items are searched in blocks of bounded size, each broadcast; a task hands on k documents an item
at most, and these are ranked in two steps, so that no task ranks what all tasks found for an item.

Defined cases: each row of documents is a document, also where doc_id repeats or is null (null
counts last among ties); null or empty text has no terms and is never found; the texts of one
item_id are one item, null being one as well; items without terms, or whose terms no document
has, have no rows; an empty table on either side gives an empty result; a text of any length is
one document, read whole; further columns are ignored. Terms are told apart by 64-bit hashes: that
a term of any document is taken for a given term of an item has a chance of 2^-64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut, partitions, pick
from ._words import PLAIN, Words

#: A shard ends with the batch of texts in which it reaches so many documents or bytes.
SHARD_DOCS, SHARD_BYTES = 4096, 16 << 20
#: Items, and bytes of their terms, that are searched at once.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 8 << 20
#: Intervals of an item that are split at a time.
AT_ONCE = 32
_INDEX = "n_docs long, n_words long, doc_ids binary, sizes binary, terms binary, ends binary, docs binary, times binary"
_CODEC = "zstd"


def _packed(a: np.ndarray) -> bytes:
    """Its bytes, compressed, behind the number of them."""
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, _CODEC, asbytes=True)


def _unpacked(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), _CODEC, asbytes=True), kind)


def index(docs: DataFrame) -> DataFrame:
    """The index of all documents, a row for each shard; kept in the shared folder."""

    def shard(parts: list[tuple]) -> pa.RecordBatch:
        ids, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        doc, term = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        terms, name = np.unique(term, return_inverse=True)
        post, times = np.unique(name.astype(np.int64) * len(sizes) + doc, return_counts=True)
        ends = np.cumsum(np.bincount(post // len(sizes), minlength=len(terms)))
        row = [len(sizes), int(sizes.sum()), *(_packed(x) for x in (ids, sizes, terms, ends, (post % len(sizes)).astype(np.uint32), times.astype(np.uint32)))]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if k < 2 else pa.binary()) for k, x in enumerate(row)], [x.split()[0] for x in _INDEX.split(", ")])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, size = [], 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, SHARD_DOCS // 4):
                b = whole.slice(at, SHARD_DOCS // 4)
                words = Words(b["text"], PLAIN, lower=True)
                held = np.flatnonzero(words.count)
                if not len(held):
                    continue
                ids = b["doc_id"].take(pa.array(held))
                # null ids: the greatest value, which counts last, and a mark
                known = np.asarray(ids.fill_null(np.iinfo(np.int64).max))
                rank = np.zeros(b.num_rows, np.int64)
                rank[held] = np.arange(n, n + len(held))
                parts.append((np.stack([known, np.asarray(ids.is_null(), dtype=np.int64)], 1), words.count[held].astype(np.int64), rank[words.text_of], words.hashes))
                n, size = n + len(held), size + len(words.data)
                if n >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield shard(parts)
                    parts, n, size = [], 0, 0
        if parts:
            yield shard(parts)

    return cut(pick(docs, doc_id="long", text="string").mapInArrow(shards, _INDEX))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and the 64-bit name of each of its terms, once."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(b["text"], PLAIN, lower=True)
            yield pa.RecordBatch.from_arrays([b["item_id"].take(pa.array(words.text_of)), pa.array(words.hashes.view(np.int64))], ["item_id", "term"])

    return pick(items, item_id="long", text="string").mapInArrow(terms, "item_id long, term long").distinct()


class Lists:
    """A shard's posting lists of some terms, with impacts and their range maxima.

    Lists lie behind each other; ``first[t]:first[t + 1]`` is that of term t, with ascending
    documents. ``top[k, i]`` is where the greatest impact of the 2^k postings from i on lies."""

    def __init__(self, row: dict, wanted: np.ndarray, n_docs: int, n_words: int):
        self.ids, self.sizes = _unpacked(row["doc_ids"], np.int64).reshape(-1, 2), _unpacked(row["sizes"], np.int64)
        terms, ends = _unpacked(row["terms"], np.uint64), _unpacked(row["ends"], np.int64)
        at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        here = terms[at] == wanted
        begin = np.where(here, np.concatenate([[0], ends[:-1]])[at], 0)
        count = np.where(here, ends[at], 0) - begin
        self.first = np.concatenate([[0], np.cumsum(count)])
        take = np.arange(self.first[-1]) - np.repeat(self.first[:-1] - begin, count)
        self.docs = _unpacked(row["docs"], np.uint32)[take].astype(np.int64)
        times = _unpacked(row["times"], np.uint32)[take].astype(np.int64)
        m = 10 + 90 * self.sizes * n_docs // n_words
        self.impact = 1_000_000_000 * times // (1000 * times + 8 * m[self.docs])
        self.keys = np.repeat(np.arange(len(wanted)), count) * len(self.sizes) + self.docs
        self.top = np.empty((max(int(count.max(initial=0)).bit_length(), 1), len(self.docs)), np.int32)
        self.top[0] = np.arange(len(self.docs))
        for k in range(1, len(self.top)):
            n, half = len(self.docs) - (1 << k) + 1, 1 << k - 1
            x, y = self.top[k - 1, :n], self.top[k - 1, half : half + n]
            self.top[k, :n] = np.where(self.impact[x] >= self.impact[y], x, y)

    def place(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Of the first posting of each term that is not before the document."""
        return np.searchsorted(self.keys, terms * len(self.sizes) + docs)

    def greatest(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Where the greatest impact among postings a to z (not included, and beyond a) lies."""
        level = np.frexp(z - a)[1] - 1
        x, y = self.top[level, a], self.top[level, z - (1 << level)]
        return np.where(self.impact[x] >= self.impact[y], x, y)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The k best of ``best`` and this shard's documents as (-score, doc_id, 1 if that is null), ascending."""
        has = self.first[terms + 1] > self.first[terms]
        terms, weights = terms[has], weights[has]
        if not len(terms):
            return best
        least = -best[-1][0] if len(best) == k else 1

        def bounded(lo, hi):
            """Intervals with their bounds and the documents to split them at, without those that can't reach ``least``."""
            rows, of = np.nonzero(hi > lo)  # an interval has postings of few terms
            top = self.greatest(lo[rows, of], hi[rows, of])
            worth = np.zeros(lo.shape, np.int64)
            worth[rows, of] = weights[of] * self.impact[top]
            bound = worth.sum(1)
            at = np.zeros(lo.shape, np.int32)
            at[rows, of] = top
            keep = np.flatnonzero(bound >= least)
            return lo[keep], hi[keep], bound[keep], self.docs[at[keep, worth[keep].argmax(1)]]

        wait = bounded(self.first[terms][None], self.first[terms + 1][None])
        while len(wait[2]):
            if len(wait[2]) > AT_ONCE:
                order = np.argpartition(-wait[2], AT_ONCE)
                now, wait = ([x[o] for x in wait] for o in (order[:AT_ONCE], order[AT_ONCE:]))
            else:
                now, wait = wait, [x[:0] for x in wait]
            lo, hi, _, doc = now
            rows, of = np.nonzero(hi > lo)
            at = self.place(terms[of], doc[rows])
            here = at < hi[rows, of]
            here[here] = self.docs[at[here]] == doc[rows[here]]
            score, middle, after = np.zeros(lo.shape, np.int64), lo.copy(), lo.copy()
            score[rows[here], of[here]] = weights[of[here]] * self.impact[at[here]]
            middle[rows, of], after[rows, of] = at, at + here
            score = score.sum(1)
            good = np.flatnonzero(score >= least)
            if len(good):
                best = sorted([*best, *zip((-score[good]).tolist(), *self.ids[doc[good]].T.tolist())])[:k]
                if len(best) == k and -best[-1][0] > least:
                    least = -best[-1][0]
                    keep = wait[2] >= least
                    wait = [x[keep] for x in wait]
            sides = bounded(np.concatenate([lo, after]), np.concatenate([middle, hi]))
            wait = [np.concatenate([x, y]) for x, y in zip(wait, sides)]
        return best


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_block(shards: DataFrame, rows: list, n_docs: int, n_words: int, k: int) -> DataFrame:
    """item (a number in this block), doc_id, score: of each task the k best documents of each item."""
    wanted = np.unique(np.array([t for r in rows for t in r.terms], np.int64).view(np.uint64))
    held = shards.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for b in batches:
            for row in b.to_pylist():
                terms, ends = _unpacked(row["terms"], np.uint64), _unpacked(row["ends"], np.int64)
                at = np.minimum(np.searchsorted(terms, held.value), len(terms) - 1)
                total += np.where(terms[at] == held.value, np.diff(ends, prepend=0)[at], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    df = np.zeros(len(wanted), np.int64)
    for r in shards.select("terms", "ends").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term of the block
        df[r.term] = r.df
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    asked = shards.sparkSession.sparkContext.broadcast([np.searchsorted(wanted, np.array(r.terms, np.int64).view(np.uint64)) for r in rows])
    weighed = shards.sparkSession.sparkContext.broadcast(weights)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in asked.value]
        for b in batches:
            for row in b.to_pylist():
                lists = Lists(row, held.value, n_docs, n_words)
                for i, terms in enumerate(asked.value):
                    best[i] = lists.search(terms, weighed.value[terms], k, best[i])
        found = [(i, None if null else doc, -score) for i, own in enumerate(best) for score, doc, null in own]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(zip(*found)) or [(), (), ()])], ["item", "doc_id", "score"])

    return shards.select("doc_ids", "sizes", "terms", "ends", "docs", "times").mapInArrow(search, "item long, doc_id long, score long")


def search(shards: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents with a score above 0."""
    spark = shards.sparkSession
    sums = shards.agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).first()
    terms = cut(item_terms(items).groupBy("item_id").agg(F.collect_list("term").alias("terms")))
    size = terms.agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("terms") * 8).alias("bytes")).first()
    blocks = max(-(-size.items // BLOCK_ITEMS), -(-(size.bytes or 0) // BLOCK_BYTES), 1)
    found = None
    for block in range(blocks if sums.docs else 0):
        rows = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect() if blocks > 1 else terms.collect()
        if rows:
            own = _search_block(shards, rows, sums.docs, sums.words, k).withColumn("block", F.lit(block))
            names = spark.createDataFrame([(block, i, r.item_id) for i, r in enumerate(rows)], "block int, item long, item_id long")
            own = own.join(F.broadcast(names), ["block", "item"]).select("item_id", "doc_id", "score")
            found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    last = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    part = F.pmod(F.xxhash64("doc_id"), F.lit(partitions(spark)))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*last))).filter(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*last))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item."""
    return search(index(docs), items, k)
