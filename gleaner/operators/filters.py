"""A Bloom filter as rows of bitmaps: a mergeable aggregate that is asked before a shuffle (P5).

A key belongs to one block, and sets a few of the block's bits. A block is a row (its number and a
bitmap of 4 KiB), so a filter is built by a partial aggregate, and asking it is one broadcast join
and a few bit tests in compiled expressions. What it lets through is checked exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept

#: Bits of a block; bits for each key, and how many of them a key sets.
BLOCK_BITS, KEY_BITS, HASHES = 32_768, 12, 5
#: Blocks that may be broadcast (4 KiB each): beyond, there is no filter.
MOST_BLOCKS = 16_384


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(BLOCK_BITS)).cast("int") for k in range(1, HASHES + 1)]


def bloom(keys: DataFrame, key: str, count: int) -> tuple[DataFrame, int] | None:
    """block, bits of a filter of so many keys, and its number of blocks; None if it would be too large to broadcast."""
    blocks = max(1, -(-count * KEY_BITS // BLOCK_BITS))
    if blocks > MOST_BLOCKS:
        return None
    each = keys.select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_bits(F.col(key)))).alias("bit"))
    return each.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), blocks


def marked(df: DataFrame, key: str, found: tuple[DataFrame, int], name: str = "maybe") -> DataFrame:
    """df with whether the filter may hold its key: false is certain."""
    filter_, blocks = found
    f = filter_.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    byte = lambda bit: F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = lambda bit: F.call_function("shiftright", byte(bit), bit % 8).bitwiseAND(F.lit(1)) == 1
    every = reduce(Column.__and__, map(has, _bits(F.col(key))))
    joined = df.join(F.broadcast(f), _block(F.col(key), blocks) == F.col("_block"), "left")
    return joined.withColumn(name, F.coalesce(every, F.lit(False))).drop("_block", "_bits")


def not_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose key is not among the keys (one column of that name); null is among none.

    Rows that the filter knows to be absent pass where they are read; only the others are shuffled
    and checked."""
    keys = kept(keys.select(key).filter(F.col(key).isNotNull()).distinct())
    found = bloom(keys, key, keys.count())
    if found is None:
        return df.join(keys, key, "left_anti")
    asked = marked(df, key, (kept(found[0]), found[1]), "_maybe")
    return asked.filter(~F.col("_maybe")).drop("_maybe").unionByName(asked.filter("_maybe").drop("_maybe").join(keys, key, "left_anti"))
