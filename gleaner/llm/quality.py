"""Operator 6: quality classifier, logistic regression over hashed word n-grams.

A document's features are its words and pairs of neighbouring words, and the same of the words'
shapes (classes of their first and last bytes), all hashed to 2**BITS columns and weighted by
their share of the document; further hashed features tell the share of repeated word triples and
the size. Weights are trained by follow-the-regularised-leader updates, document by document,
over a bounded sample of labelled rows, in one task. Scores are sparse dot products, made in
Arrow batches.

Only labelled rows whose crc32(doc_id as text) mod 3 isn't 1, and that have a document, are learned
from: the ``SAMPLE_ROWS`` ones whose ids have the least hashes, and of these, in order of that hash,
the ones whose texts have ``SAMPLE_BYTES`` together. The first row of each label is learned in any
case; its text is cut only where it is longer than the label's part of half of the bytes. Labels,
lang, source and doc_id are no inputs of a score.

Defined cases: null or empty text is scored by its size alone; of a doc_id with several labels
the least is learned, of one with several texts that with the least hash; labels without a row, or
null ones, are not used; without any label the
score is 0.5; a very long text is scored whole; repeated rows are each scored; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut, pick
from ._words import U, Words, mix

BITS = 18
#: At most so many labelled rows (and the first of each label), and bytes of their texts, are learned from.
SAMPLE_ROWS, SAMPLE_BYTES = 8_000, 256 << 20
#: Of the updates: step size, its damping, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.001
EPOCHS = 3
#: Features of n-grams are shares times this.
SCALE = 20.0

_CLASS = np.zeros(256, np.uint64)
_CLASS[:] = np.arange(256)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48


def _columns(w: Words) -> list[np.ndarray]:
    """Hashed columns of each word: of itself and its shape, with the next word or without."""
    size = w.end - w.start
    ends = [w.start, w.end - 1, np.maximum(w.end - 2, w.start), np.maximum(w.end - 3, w.start)]
    shape = np.minimum(size, 3).astype(U)
    for at in ends:
        shape = shape * U(131) + _CLASS[w.data[at]]
    shape = mix(shape)
    out = []
    for h in (w.hashes, shape ^ U(0x51A7E)):
        after = np.where(w.left > 1, np.append(h[1:], U(0)), U(0)) if len(h) else h
        out += [mix(h) >> U(64 - BITS), mix(h * U(3) + mix(after)) >> U(64 - BITS)]
    return out


def _traits(w: Words) -> np.ndarray:
    """For each text, the hashed columns of its share of repeated triples and its size."""
    triples, texts = w.windows(3), w.text_of
    order = np.lexsort([triples, texts])
    t, d = triples[order], texts[order]
    again = np.zeros(len(t), bool)
    again[1:] = (t[1:] == t[:-1]) & (d[1:] == d[:-1])
    share = np.bincount(d, again, len(w.count)) / np.maximum(w.count, 1)
    steps = np.stack([np.digitize(share, [0.01, 0.05, 0.1, 0.2, 0.3, 0.5]), np.digitize(w.count, [1, 20, 50, 100, 300, 1000])], 1)
    return (mix((steps + np.array([1000, 2000])).astype(U)) >> U(64 - BITS)).astype(np.int64)


def vectors(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns and values of each text."""
    columns, traits = _columns(w), _traits(w)
    for i, (a, z) in enumerate(zip(w.first[:-1], w.first[1:])):
        at, n = np.unique(np.concatenate([c[a:z] for c in columns]), return_counts=True)
        yield np.append(at.astype(np.int64), traits[i]), np.append(n * (SCALE / max(z - a, 1)), [1.0, 1.0])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal updates; the last is the constant's."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = np.append(rows[k][0], 1 << BITS), np.append(rows[k][1], 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[k]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def scores(w: Words, weights: np.ndarray) -> np.ndarray:
    each = sum((weights[c.astype(np.int64)] for c in _columns(w)), np.zeros(len(w), np.float32)).astype(np.float64)
    total = np.concatenate([[0], np.cumsum(each)])
    dot = (total[w.first[1:]] - total[w.first[:-1]]) * (SCALE / np.maximum(w.count, 1)) + weights[_traits(w)].sum(1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(dot, -30, 30)))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text, quality of the rows to learn from: one a doc_id, bounded in number and size, and never none of a label that has any."""
    docs = pick(docs, doc_id="long", text="string")
    labels = pick(labels, doc_id="long", quality="int").dropna().filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labels = cut(labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("by", F.struct(F.xxhash64("doc_id"), "doc_id")))
    firsts = labels.groupBy("quality").agg(F.min("by").alias("by")).select("by", F.lit(True).alias("first"))  # a row for each label
    chosen = labels.orderBy("by").limit(sample_rows).unionByName(labels.join(F.broadcast(firsts.select("by")), "by", "left_semi")).distinct()
    chosen = chosen.join(F.broadcast(firsts), "by", "left").select("doc_id", "quality", F.coalesce("first", F.lit(False)).alias("first"))
    found = docs.join(F.broadcast(chosen), "doc_id")  # about sample_rows rows of three values
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"), F.first("quality").alias("quality"), F.first("first").alias("first"))
    kinds = max(firsts.count(), 1)
    most = sample_bytes // (2 * kinds)  # bytes of a label's first text
    short = F.when(F.col("first") & (F.octet_length("one.text") > most), F.left("one.text", F.lit(max(most // 4, 1)))).otherwise(F.col("one.text"))
    kept = cut(one.select("doc_id", short.alias("text"), "quality", "first"))
    sizes = kept.select("doc_id", "first", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    upto = F.sum("size").over(Window.orderBy(~F.col("first"), F.xxhash64("doc_id"), "doc_id"))  # about sample_rows rows of three values
    enough = sizes.withColumn("upto", upto).filter(F.col("first") | (F.col("upto") <= sample_bytes)).select("doc_id")
    return kept.drop("first").join(F.broadcast(enough), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Weights learned from the labelled rows that aren't held out."""

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        parts = [table.slice(k, 500) for k in range(0, table.num_rows, 500)]
        rows = [(a.astype(np.int32), v.astype(np.float32)) for p in parts for a, v in vectors(Words(p["text"]))]
        w = train(rows, table["quality"].to_numpy().astype(float))
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary())})

    found = sample(docs, labels, sample_rows, sample_bytes).groupBy(F.lit(0).alias("one")).applyInArrow(_without_key(learn), "weights binary").first()
    return np.frombuffer(found.weights, np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def _without_key(f):
    return lambda table: f(table.select(["doc_id", "text", "quality"]))


def score(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the score of every row; ``text`` is read."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"])

    def apply(batches):
        for b in batches:
            parts = [scores(Words(b["text"].slice(k, 1000)), weights) for k in range(0, b.num_rows, 1000)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(np.concatenate([np.zeros(0), *parts]))], [*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(apply, schema)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    docs = pick(docs, doc_id="long", text="string")
    scored = score(docs, fit(docs, labels, sample_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
