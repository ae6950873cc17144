"""Operator 3: benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Every benchmark item gives windows of ``window`` words (one shorter window if it has fewer). A
window's set is its shingles of ``SHINGLE`` words (a shorter window is one shingle). All places of
all documents where a benchmark shingle stands are found in one pass; shingles are ordered by how
often that is. As a window is only found where all of its shingles are, its prefix is its rarest
shingle alone: the places of that shingle are joined with the windows whose prefix it is, the
bounds on place and length are checked, and what is left is verified word by word in the text.

Spark joins the places by hashes of shingles: sides that are small, once counted, are broadcast,
larger ones are shuffled and skewed keys split. Counts are made before their shuffle. Nothing of
the benchmark or the documents but the kinds of shingle (at most ``SHINGLE``) goes to the driver.

Defined cases: null or wordless documents and items have no words and no hits; rows that repeat
a doc_id are each returned, rows that repeat an item_id are one item; a null item_id is the
empty string; an empty benchmark hits nothing; a very long text is searched whole; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, pick, small

WINDOW = 10
#: Words of a shingle.
SHINGLE = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased: for counting.
WORD_OF_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, however often it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _shingles(w: Column, kinds: list[int]) -> Column:
    """Array of (at, key) of the shingles of these numbers of words; at: from 0."""
    each = []
    for k in kinds:
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
        each.append(F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(k), *(F.get(w, i + j) for j in range(k))).alias("key"))))  # noqa: B023
    return F.concat(*each)


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item, window (array of words): every window of every item."""
    items = once(pick(benchmark, item_id="string", text="string"), "w", words(F.col("text")))
    size = F.size("w")
    starts = F.when(size > 0, F.sequence(F.lit(1), F.greatest(size - window + 1, F.lit(1))))
    named = items.select(F.coalesce("item_id", F.lit("")).alias("item"), F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("window"))
    return named.distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """window, at, key: the shingles of each distinct window."""
    each = [windows.filter(least).select("window", F.inline(_shingles(F.col("window"), [k]))) for k, least in [(k, F.size("window") == k) for k in range(1, SHINGLE)] + [(SHINGLE, F.size("window") >= SHINGLE)]]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def places(docs: DataFrame, keys: DataFrame, kinds: list[int]) -> DataFrame:
    """doc_id, text_hash, n_words, at, key: where the shingles among ``keys`` stand in documents."""
    rows = once(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), "w", words(F.col("text")))
    each = rows.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.inline(_shingles(F.col("w"), kinds)))
    return each.join(small(keys), "key", "left_semi")


def _hits(docs: DataFrame, near: DataFrame) -> DataFrame:
    """of, of_text, hits: the (first, window) among those near that stand in the text word by word."""
    asked = near.groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text")).agg(F.collect_set(F.struct("first", "window")).alias("asked"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("of_text"))
    rows = docs.select("doc_id", "text").join(small(cut(asked)), same)
    one = rows.groupBy("of", "of_text").agg(F.first("text").alias("text"), F.first("asked").alias("asked"))  # rows of one id and text have equal hits
    one = once(one, "w", words(F.col("text")))
    stands = F.filter("asked", lambda h: F.slice("w", h["first"] + 1, F.size(h["window"])) == h["window"])
    return one.select("of", "of_text", stands.alias("hits")).filter(F.size("hits") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    items = cut(item_windows(benchmark, window))
    shingles = cut(window_shingles(items.select("window").distinct()))
    kinds = sorted(r.k for r in shingles.select(F.least(F.size("window"), F.lit(SHINGLE)).alias("k")).distinct().collect())  # at most SHINGLE rows
    found = cut(places(docs, cut(shingles.select("key").distinct()), kinds or [SHINGLE]))
    often = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ranked = shingles.join(often, "key", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "key")).alias("rarest"))
    # a window with a shingle that stands nowhere is nowhere
    prefixes = ranked.filter("rarest.n > 0").select("window", F.size("window").alias("size"), F.col("rarest.at").alias("place"), F.col("rarest.key").alias("prefix"))
    near = found.join(small(cut(prefixes)), F.col("key") == F.col("prefix")).withColumn("first", F.col("at") - F.col("place"))
    hits = cut(_hits(docs, near.filter("first >= 0 and first + size <= n_words")))
    windows = hits.select("of", "of_text", F.explode(F.array_distinct(F.transform("hits", lambda h: h["window"]))).alias("window"))
    named = windows.join(small(items), "window").groupBy("of", "of_text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["first"], h["first"] + F.size(h["window"]) - 1))))
    measured = hits.select(F.col("of").alias("id"), F.col("of_text").alias("id_text"), F.size(covered).cast("long").alias("hit"))
    told = measured.join(named, F.col("id").eqNullSafe(F.col("of")) & (F.col("id_text") == F.col("of_text")))
    told = small(cut(told.select("of", "of_text", "hit", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"))))
    rows = docs.join(told, F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("of_text")), "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select(
        *keep, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_OF_ANY_CASE)).cast("long").alias("n_words"), count("hit").alias("n_hit"), count("n").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (count("hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(pick(docs, doc_id="long", text="string"), benchmark, window)
