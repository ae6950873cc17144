"""Connected components of an edge table by alternating stars, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least neighbour of u. The key is renamed by an expression,
    so that both sides are exchanged and adaptive execution can split a centre with many edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select((F.col("u") + F.lit(0).cast("long")).alias("k"), "m")
    return edges.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: for every node of an edge the least node of its component."""
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _least(down).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        e = cut(small.filter("u != v").distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
