"""Running sums in an order without one task that holds the order: ranges count their own, then carry what came before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import kept


def running(df: DataFrame, order: list[str], value: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with ``name``: the sum of value over the rows before each one, in this order, of equal ``by``.

    The order must tell rows apart. Rows are dealt by ranges of by and order, so a hot value of by
    is split too; a range sends on one row for each value of by that it has."""
    parts = kept(df.withColumn("_value", value).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(F.col("_part").alias("_of"), *(F.col(b).alias(f"_of_{b}") for b in by)).agg(F.sum("_value").alias("_own"))
    before = Window.partitionBy(*(f"_of_{b}" for b in by)).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_carried", F.coalesce(F.sum("_own").over(before), F.lit(0)))
    same = reduce(lambda x, b: x & F.col(b).eqNullSafe(F.col(f"_of_{b}")), by, F.col("_part") == F.col("_of"))
    placed = parts.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(sums, same)
    return placed.withColumn(name, F.col("_carried") + F.col("_inside")).select(*(c for c in df.columns if c != name), name)
