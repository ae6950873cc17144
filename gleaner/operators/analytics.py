"""Statistics and salary-transparency rankings over postings or any table with the same measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def percent(part: Column, whole: Column, digits: int = 0) -> Column:
    """100 * part / whole rounded half to even; 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(100.0 * part, whole), digits), F.lit(0.0))


def overview(table: DataFrame) -> DataFrame:
    """Totals, approval rate and share without salary (G1); zeros for an empty table."""
    n, live = F.count(F.lit(1)), F.count_if(F.col("aprobada") & F.col("vigente"))
    without = F.count_if(F.exists("motivos_rechazo", lambda m: F.lower(m).contains("ueldo")))
    return table.agg(n.alias("total"), live.alias("vigentes"), percent(live, n, 1).alias("tasa"), without.alias("sin_sueldo"), percent(without, n).cast("int").alias("pct_sin_sueldo"))


def upper_median(table: DataFrame, value: str, *by: str, accuracy: int = 10_000) -> DataFrame:
    """The value in place count/2 (from 0) of the sorted ones, by group.

    A sketch of each group brackets the place to within a few of its ``accuracy`` parts; rows below
    the bracket are only counted, and only the bracket's distinct values are ranked."""
    known = table.filter(F.col(value).isNotNull()).select(*by, F.lit(0).alias("_one"), F.col(value).alias("_v"))
    keys, slack = ("_one", *by), 2.0 / accuracy
    bracket = F.percentile_approx("_v", [0.5 - slack, 0.5 + slack], accuracy)
    groups = known.groupBy(*(F.col(b).alias(f"_of{b}") for b in keys)).agg(bracket.alias("_bracket"), F.count(F.lit(1)).alias("_all"))
    same = reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"_of{b}")) for b in keys))
    placed = known.join(groups, same).withColumn("_low", F.get("_bracket", F.lit(0))).filter(F.col("_v") <= F.get("_bracket", F.lit(1)))
    counts = placed.groupBy(*keys, "_all", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")))
    return counts.withColumn("_upto", upto).filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min("_v").alias("mediana")).drop("_one")


def count_by(table: DataFrame, field: str, empty: str | None = None) -> DataFrame:
    """Rows by field, most first (G3); with a name for empty ones."""
    name = F.coalesce(F.nullif(F.col(field), F.lit("")), F.lit(empty)) if empty is not None else F.col(field)
    return table.groupBy(name.alias(field)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), field)


def regions_with_page(table: DataFrame, field: str = "departamento", least: int = 5) -> DataFrame:
    """Regions with enough postings for a page, without the unknown."""
    return count_by(table.filter(F.coalesce(F.col(field), F.lit("")) != ""), field).filter(F.col("n") >= least)


def _measures(paid: Column) -> list[Column]:
    total, some = F.count(F.lit(1)), F.count_if(paid)
    return [total.alias("total"), some.alias("con_sueldo"), (total - some).alias("sin_sueldo"), percent(some, total).cast("int").alias("pct")]


def transparency(table: DataFrame, field: str, paid: Column, least: int = 1, order: str = "id") -> DataFrame:
    """Per value of a field, folded to lower case: total, with and without salary, per cent.
    The name shown is that of the least row by ``order``."""
    keyed = table.withColumn("clave", F.lower(F.trim(field))).filter("clave <> ''")
    return keyed.groupBy("clave").agg(F.min_by(F.trim(field), F.col(order)).alias("nombre"), *_measures(paid)).filter(F.col("total") >= least)


def transparency_overall(table: DataFrame, paid: Column, captured: str) -> DataFrame:
    """Totals over all rows and the range of capture dates."""
    return table.agg(*_measures(paid), F.min(F.to_date(captured)).alias("desde"), F.max(F.to_date(captured)).alias("hasta"))


def transparency_sets(table: DataFrame, fields: list[str], paid: Column) -> DataFrame:
    """The measures by each of several fields in one pass of grouping sets: campo, valor, ...."""
    keyed = table.select(*(F.lower(F.trim(f)).alias(f) for f in fields), paid.alias("_paid"))
    sets = keyed.groupingSets([[F.col(f)] for f in fields], *map(F.col, fields)).agg(*_measures(F.col("_paid")), F.grouping_id().alias("_set"))
    bit = lambda k: 2 ** len(fields) - 1 - 2 ** (len(fields) - 1 - k)  # noqa: E731  all fields but one are aggregated
    name, value = F, F
    for k, f in enumerate(fields):
        name, value = name.when(F.col("_set") == bit(k), f), value.when(F.col("_set") == bit(k), F.col(f))
    return sets.select(name.alias("campo"), value.alias("valor"), "total", "con_sueldo", "sin_sueldo", "pct")


def rankings(groups: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """The most transparent (pct >= 80) and the opaque (pct = 0) groups, largest first."""
    clear = groups.filter("pct >= 80").orderBy(F.desc("pct"), F.desc("total"), "clave").limit(top)
    return clear, groups.filter("pct = 0").orderBy("pct", F.desc("total"), "clave").limit(top)


def level(pct: Column) -> Column:
    """alta from 80, media from 30, else baja."""
    return F.when(pct >= 80, "alta").when(pct >= 30, "media").otherwise("baja")
