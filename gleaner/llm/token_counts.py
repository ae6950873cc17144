"""Operator 10: token counts from an exact histogram of encoded lengths.

Every text is encoded once, in Arrow batches; documents are then counted by encoded length, and
sums over that histogram answer for every context limit how many documents fit, how many tokens
there are in all, how many remain when each document is cut to the limit, and which quantile of
length the limit is. Sums are made within ranges of lengths and then carried across the ranges,
so no task holds all lengths.

Defined cases: a null text counts as empty (length 0); repeated rows count each; a very long text is
encoded whole; an empty table
has no lengths, and every limit answers zeros; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut, pick

#: Ranks of the vocabulary ``byte_bpe_50k.json``: the same ids, encoded several times faster.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The token that ``byte_bpe_50k.json`` adds to its ranks; its string is that one id wherever it stands in a text.
ADDED = {"<|endoftext|>": 50256}
#: Width of the ranges of lengths that are summed apart.
RANGE = 1024


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> array of ids, by the vocabulary file at ``path``, as its ``tokenizers`` file gives them: added tokens' strings are their ids."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
        plain, special = (lambda text: own.encode_to_numpy(text, disallowed_special=())), set(ADDED)
        return lambda text: own.encode_to_numpy(text, allowed_special=special) if any(x in text for x in special) else plain(text)
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(path)
    return lambda text: np.array(file.encode(text, add_special_tokens=False).ids, np.uint32)


def encoded_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row."""
    path = vocabulary or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            sizes = np.fromiter((len(encode(x.as_py() or "")) for x in b["text"]), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes)], ["doc_id", "n_tokens"])

    return pick(docs, doc_id="long", text="string").mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length; kept, so that texts are encoded once for all answers."""
    return cut(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))


def by_limit(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: n_docs of that length, docs_fit
    (no longer than it), docs_cut (longer), tokens_fit (of those that fit), tokens_kept (when
    each document is cut to it), tokens_total, and quantile (share of documents no longer)."""
    rows = histogram.withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    within = Window.partitionBy("range").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.sum("n_docs").over(within).alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).over(within).alias("tokens"))
    sums = rows.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    below = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = sums.select("range", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, w, n in (("d", below, "d0"), ("t", below, "t0"), ("d", everything, "d1"), ("t", everything, "t1"))))
    fit, tokens = F.col("docs") + F.col("d0"), F.col("tokens") + F.col("t0")
    return rows.join(carried, "range").select(
        "n_tokens",
        "n_docs",
        fit.alias("docs_fit"),
        (F.col("d1") - fit).alias("docs_cut"),
        tokens.alias("tokens_fit"),
        (tokens + (F.col("d1") - fit) * F.col("n_tokens")).alias("tokens_kept"),
        F.col("t1").alias("tokens_total"),
        (fit / F.col("d1")).alias("quantile"),
    )


def quantiles(limits: DataFrame, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """share, n_tokens: the least length that at least so many documents don't exceed."""
    return limits.select(F.explode(F.array(*map(F.lit, shares))).alias("share"), "n_tokens", "quantile").filter("quantile >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def totals_at(histogram: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """limit, n_docs, docs_cut, tokens_kept for any context limits; a row for each, also over no documents."""
    spark = histogram.sparkSession
    pairs = histogram.select("n_tokens", "n_docs", F.explode(F.array(*(F.lit(x).cast("long") for x in limits))).alias("limit"))
    sums = pairs.groupBy("limit").agg(F.sum("n_docs").alias("n_docs"), F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs"))).alias("docs_cut"), F.sum(F.col("n_docs") * F.least("n_tokens", "limit")).alias("tokens_kept"))
    asked = spark.createDataFrame([(x,) for x in limits], "limit long")
    return asked.join(F.broadcast(sums), "limit", "left").na.fill(0)
