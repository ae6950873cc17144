"""Operator 4: quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets base measures (exact) and ratios made from them. For every language and source
a mergeable sketch of each ratio gives its quartiles and outer tenths; a document is kept if no
ratio lies beyond its group's fence, ``FENCE`` times the distance from the median to the quartile
on that side. Where a ratio's values are mostly equal (symbols, repeated lines and words are 0 in
most documents) and yet a tenth of them lie apart, the tenth tells the distance, in the proportion
of a bell curve, so the fence follows the group there too. A distance is no less than one count in
a document of median size (a symbol, a letter, a line, a window found twice), below which a ratio
can't be told; there are no fixed cutoffs.
Documents that fail the base rules don't count for thresholds.

The sketch is a histogram of logarithmic buckets, ``ACCURACY`` wide: it is deterministic, so
verdicts don't change between runs, it has a bounded number of rows a group, and sketches merge by
adding up. Groups with fewer than ``GROUP_ROWS`` documents take the merged sketch of their
language, and those of such languages that of all.

Repeated words are found per document without comparing all its windows: hashes of three-word
windows, with their places in the low bits, are sorted as numbers, and only places whose hash
repeats are compared by their words.

Defined cases: null or empty text has no words and fails the base rules; lines that tie count all
but the first; null lang or source are a group of their own; rows that repeat a doc_id are each
returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut, pick, small
from .decontaminate import once

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]+"
FENCE, GROUP_ROWS = 8.0, 100
#: Base rules: least words, most words in repeated windows (per cent).
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Ratios: the side on which they are suspect, what they are a share of, and the least count that changes them.
RATIOS = {
    "symbol_share": ("high", "word_chars", 1),
    "upper_share": ("high", "word_chars", 1),
    "dup_line_share": ("high", "n_lines", 1),
    "repeat_share": ("high", "n_words", 6),
    "word_length": ("both", "n_words", 1),
    "mark_share": ("both", "n_words", 1),
}
#: The distance to a quartile, where the one to the outer tenth is 1, on a bell curve.
TENTH = NormalDist().inv_cdf(0.75) / NormalDist().inv_cdf(0.9)
#: Width of a bucket of the sketch, as a share of its value.
ACCURACY = 0.01
#: Bits of a sorted number that hold a place; longer documents are compared by words alone.
PLACE_BITS = 24
_PLACE = (1 << PLACE_BITS) - 1


def _repeated(df: DataFrame) -> DataFrame:
    """df, which has words ``w``, with n_repeat_words; w is dropped."""
    n = F.size("w")
    hashes = F.transform(
        F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long")),
    )
    df = once(df, "h", F.sort_array(F.when(n <= _PLACE, hashes).otherwise(F.array().cast("array<long>"))))
    same = lambda x, y: F.coalesce(F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS), F.lit(False))
    places = F.transform(F.filter("h", lambda x, i: same(x, F.get("h", i + 1)) | same(x, F.when(i > 0, F.get("h", i - 1)))), lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int"))
    places = F.when(n <= _PLACE, places).otherwise(F.sequence(F.lit(0), n - 3))
    df = once(df, "at", places)
    named = F.array_sort(F.transform("at", lambda p: F.struct(F.array_join(F.slice("w", p + 1, 3), " ").alias("k"), p.alias("p"))))
    df = once(df, "named", named)
    equal = lambda x, i: F.coalesce(x["k"] == F.get("named", i)["k"], F.lit(False))
    again = F.transform(F.filter("named", lambda x, i: equal(x, i + 1) | F.when(i > 0, equal(x, i - 1)).otherwise(False)), lambda x: x["p"])
    df = once(df, "again", F.sort_array(again))
    covered = F.aggregate(F.transform("again", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("again", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", covered).drop("w", "h", "at", "named", "again")


def measures(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns with the exact base measures and base_failed; ``text`` is read."""
    docs = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    df = once(docs, "w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = once(df, "lines", lines)
    without = lambda pattern: F.char_length("text") - F.char_length(F.regexp_replace("text", pattern, ""))
    df = df.select(
        *keep,
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        without(SYMBOL).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        without("[A-Z]+").alias("n_upper"),
        without("[.,;:!?]+").alias("n_marks"),
    )
    df = _repeated(df)
    return df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def _with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "symbol_share": _share("n_symbols", "word_chars"),
        "upper_share": _share("n_upper", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "word_length": _share("word_chars", "n_words"),
        "mark_share": _share("n_marks", "n_words"),
    })


def sketches(good: DataFrame, group: tuple[str, str]) -> DataFrame:
    """key_1, key_2, measure, bucket, n: of each group, how many documents have a value in a bucket (null: 0)."""
    named = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in (*RATIOS, *dict.fromkeys(of for _, of, _ in RATIOS.values()))))
    each = good.select(F.col(group[0]).alias("key_1"), F.col(group[1]).alias("key_2"), F.inline(named))
    bucket = F.when(F.col("x") > 0, F.round(F.log("x") / math.log1p(ACCURACY)).cast("int"))
    return each.groupBy("key_1", "key_2", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(held: DataFrame, *by: str) -> DataFrame:
    """by, and for each measure m: its quartiles m_1, m_2, m_3 and outer tenths m_0, m_4, from sketches that are merged by these columns."""
    merged = held.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*by, "measure")  # as many rows as a sketch has buckets
    ranked = merged.select("*", F.sum("n").over(of.orderBy(F.asc_nulls_first("bucket"))).alias("upto"), F.sum("n").over(of).alias("all"))
    value = F.coalesce(F.exp(F.col("bucket") * math.log1p(ACCURACY)), F.lit(0.0))
    twentieths = (2, 5, 10, 15, 18)
    at = lambda m, k: F.min(F.when((F.col("measure") == m) & (20 * F.col("upto") >= twentieths[k] * F.col("all")), value)).alias(f"{m}_{k}")
    return ranked.groupBy(*by).agg(*(at(m, k) for m in (*RATIOS, *dict.fromkeys(of for _, of, _ in RATIOS.values())) for k in range(5)))


def thresholds(measured: DataFrame, group: tuple[str, str] = ("lang", "source"), fence: float = FENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """key_1, key_2 of each group, and low_/high_ fences of each ratio."""
    held = cut(sketches(_with_ratios(measured).filter(~F.col("base_failed")), group))
    sizes = held.filter("measure = 'n_words'").groupBy("key_1", "key_2").agg(F.sum("n").alias("rows"))
    outer = sizes.groupBy(F.col("key_1").alias("of")).agg(F.sum("rows").alias("outer_rows"))
    sizes = sizes.join(outer, F.col("key_1").eqNullSafe(F.col("of")))
    # each group's pool: itself, its language or all
    level = F.when(F.col("rows") >= group_rows, 2).when(F.col("outer_rows") >= group_rows, 1).otherwise(0)
    pools = cut(sizes.select("key_1", "key_2", level.alias("level"), F.when(level > 0, F.col("key_1")).alias("pool_1"), F.when(level > 1, F.col("key_2")).alias("pool_2")))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), (F.col("key_1") if k else F.lit(None).cast("string")).alias("pool_1"), (F.col("key_2") if k > 1 else F.lit(None).cast("string")).alias("pool_2")) for k in range(3)))
    pooled = held.select("measure", "bucket", "n", F.inline(levels))
    asked = pools.select(F.col("level").alias("l"), F.col("pool_1").alias("p1"), F.col("pool_2").alias("p2")).distinct()
    same = (F.col("level") == F.col("l")) & F.col("pool_1").eqNullSafe(F.col("p1")) & F.col("pool_2").eqNullSafe(F.col("p2"))
    of = quartiles(pooled.join(asked, same, "left_semi"), "level", "pool_1", "pool_2")
    columns = []
    for m, (side, share_of, step) in RATIOS.items():
        t0, q1, q2, q3, t4 = (F.col(f"{m}_{k}") for k in range(5))
        least = step / F.greatest(F.col(f"{share_of}_2"), F.lit(1.0))
        above, below = F.greatest(q3 - q2, TENTH * (t4 - q2)), F.greatest(q2 - q1, TENTH * (q2 - t0))
        high = q2 + fence * F.greatest(above, least)
        low = q2 - fence * F.greatest(below, least) if side == "both" else F.lit(float("-inf"))
        columns += [low.alias(f"low_{m}"), high.alias(f"high_{m}"), (above >= least).alias(f"by_spread_{m}")]
    fences = of.select(F.col("level").alias("l"), F.col("pool_1").alias("p1"), F.col("pool_2").alias("p2"), *columns)
    return pools.join(fences, same).drop("level", "pool_1", "pool_2", "l", "p1", "p2")


def apply_rules(docs: DataFrame, fence: float = FENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    measured = cut(measures(pick(docs, doc_id="long", text="string", lang="string", source="string"), ("doc_id", "lang", "source")))
    limits = small(cut(thresholds(measured, fence=fence, group_rows=group_rows)))
    inside = F.lit(True)
    for m in RATIOS:
        inside &= F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    joined = _with_ratios(measured).join(limits, F.col("lang").eqNullSafe(F.col("key_1")) & F.col("source").eqNullSafe(F.col("key_2")), "left")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
