"""Statistics that are kept up to date from the differences of two versions.

A view is a table of counts by group and value. What two versions differ in takes the old rows out
and puts the new ones in; counts that become 0 leave. Sums, shares and medians follow from the
counts, exactly, so a view after any number of changes equals one made from all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .analytics import percent


def _signed(rows: DataFrame, groups: dict[str, Column], value: Column | None, sign: Column) -> DataFrame:
    return rows.select(*(c.alias(k) for k, c in groups.items()), (F.lit(None).cast("double") if value is None else value.cast("double")).alias("valor"), sign.cast("long").alias("n"))


def build(table: DataFrame, groups: dict[str, Column], value: Column | None = None) -> DataFrame:
    """groups, valor, n: how many rows have each value in each group."""
    return _added(_signed(table, groups, value, F.lit(1)), groups)


def _added(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*groups, "valor").agg(F.sum("n").alias("n")).filter("n <> 0")


def refresh(view: DataFrame, changes: DataFrame, groups: dict[str, Column], value: Column | None = None) -> DataFrame:
    """The view after changes (antes, despues): only the changed rows are read, and as many counts as they have groups change."""
    out = changes.filter("antes is not null").select("antes.*")
    new = changes.filter("despues is not null").select("despues.*")
    moved = _added(_signed(out, groups, value, F.lit(-1)).unionByName(_signed(new, groups, value, F.lit(1))), groups)
    return _added(view.unionByName(moved), groups)


def totals(view: DataFrame, *by: str) -> DataFrame:
    """by, n: rows of each group."""
    return view.groupBy(*by).agg(F.sum("n").alias("n"))


def shares(view: DataFrame, by: list[str], of: str) -> DataFrame:
    """by, total, con_sueldo, sin_sueldo, pct: a group's rows, and those for which the boolean group ``of`` holds."""
    some = F.coalesce(F.sum(F.when(F.col(of), F.col("n"))), F.lit(0))
    all_ = F.sum("n")
    return view.groupBy(*by).agg(all_.alias("total"), some.alias("con_sueldo"), (all_ - some).alias("sin_sueldo"), percent(some, all_).cast("int").alias("pct"))


def medians(view: DataFrame, *by: str) -> DataFrame:
    """by, mediana: the value in place count/2 (from 0) of a group's sorted ones (G2). Distinct values are ranked, not rows."""
    known = view.filter("valor is not null").groupBy(*by, "valor").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy(*(by or [F.lit(0)])).orderBy("valor")
    all_ = Window.partitionBy(*(by or [F.lit(0)]))
    placed = known.withColumn("upto", F.sum("n").over(ordered)).withColumn("all", F.sum("n").over(all_))
    return placed.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*by).agg(F.min("valor").alias("mediana"))
