"""The composed scan of sources: which discovered pages are looked at, what each gives, and where a source's scan ends.

A source's settings are a row of a table. Its addresses are put in order and bounded; those that
were seen are passed over, the others' pages are read and parsed; old and closed postings are
dropped. The scan of a source ends when it has given as many postings as asked, when forty old
ones came in a row (where addresses are ordered by number), or with its addresses. All sources are
scanned in one pass over the pages; what decides where each ends are narrow rows, counted in
stretches of the order, so no task holds a source's pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import once
from .crawl import STRETCH, correlative, stale_stops
from .pages import job_posting_fields, job_posting_node

SETTINGS = "fuente string, limite int, patron string, por_id boolean, navegador boolean, dias_ventana int, dias_publicado int"
# Days of the window of addresses and of postings where a source tells none; addresses looked at for each posting asked, without a browser and with one; old ones in a row.
WINDOW_DAYS, POSTING_DAYS, EXPLORED, EXPLORED_BY_BROWSER, STALE_RUN = 120, 60, 4, 2, 40
RESULTS = ("vista", "sin_leer", "antigua", "cerrada", "entregada", "ilegible", "sin_revisar")
#: Parts of a source's addresses whose best are taken before they are put together.
PARTS = 64


def candidates(settings: DataFrame, found: DataFrame, fixed: DataFrame, as_of: Column) -> DataFrame:
    """fuente, url, pos: the addresses that each source's scan looks at, in order from 1 (S3).

    found: fuente, url, place, lastmod as discovered; fixed: fuente, url, place of addresses to read
    again: a source that has some looks at these only, as many as it is asked for. Else those
    that match its pattern and its window, by falling number or date, EXPLORED for each posting asked.
    An address counts once, by its first place."""
    s = settings.select(F.col("fuente").alias("_of"), "limite", F.coalesce("patron", F.lit("")).alias("patron"), F.coalesce("por_id", F.lit(False)).alias("por_id"), F.coalesce("navegador", F.lit(False)).alias("navegador"), F.coalesce("dias_ventana", F.lit(WINDOW_DAYS)).alias("dias"))
    s = F.broadcast(s)  # a row for each source
    again = fixed.join(s, F.col("fuente") == F.col("_of")).select("fuente", "url", F.struct(F.lit(0).cast("long").alias("a"), F.col("place").cast("long").alias("b")).alias("order"), F.col("limite").alias("most"))
    all_ = found.join(s, F.col("fuente") == F.col("_of")).join(F.broadcast(fixed.select(F.col("fuente").alias("_f")).distinct()), F.col("fuente") == F.col("_f"), "left_anti")
    fresh = F.col("lastmod").isNull() | (F.col("lastmod") >= F.date_sub(as_of, F.col("dias")))
    first = F.when(F.col("por_id"), -correlative(F.col("url"))).otherwise(F.coalesce(-F.unix_date("lastmod").cast("long"), F.lit(2**40)))
    by_rule = all_.filter((F.col("patron") == "") | F.expr("url rlike patron")).filter(fresh | F.col("por_id"))
    by_rule = by_rule.select("fuente", "url", F.struct(first.alias("a"), F.col("place").cast("long").alias("b")).alias("order"), (F.col("limite") * F.when(F.col("navegador"), EXPLORED_BY_BROWSER).otherwise(EXPLORED)).alias("most"))
    each = again.unionByName(by_rule).groupBy("fuente", "url").agg(F.min("order").alias("order"), F.first("most").alias("most"))
    part = F.row_number().over(Window.partitionBy("fuente", F.pmod(F.xxhash64("url"), F.lit(PARTS))).orderBy("order", "url"))
    best = each.withColumn("nth", part).filter(F.col("nth") <= F.col("most"))  # no task ranks all addresses of a source
    pos = F.row_number().over(Window.partitionBy("fuente").orderBy("order", "url"))
    return best.withColumn("pos", pos).filter(F.col("pos") <= F.col("most")).select("fuente", "url", "pos")


def by_jsonld(pages: DataFrame) -> DataFrame:
    """pages with ``leida`` (whether there is a posting) and its puesto, publicado, vence: those of the JSON-LD."""
    df = once(pages, _node=job_posting_node(F.coalesce("html", F.lit(""))))
    df = once(df, _j=job_posting_fields(F.col("_node")))
    return df.select(*pages.columns, F.col("_node").isNotNull().alias("leida"), *(F.when(F.col("_node").isNotNull(), F.col(f"_j.{c}")).alias(c) for c in ("puesto", "publicado", "vence")))


def _nth(rows: DataFrame, n: DataFrame, of: Column, stretch: int) -> DataFrame:
    """_by, stop: the place of each source's n-th row for which ``of`` holds (n: _by, n)."""
    keyed = rows.filter(of).select("fuente", "pos", F.floor(F.col("pos") / stretch).alias("part"))
    parts = keyed.groupBy("fuente", "part").agg(F.count(F.lit(1)).alias("own"))
    before = F.sum("own").over(Window.partitionBy("fuente").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")
    parts = parts.withColumn("before", before).join(F.broadcast(n), F.col("fuente") == F.col("_by")).filter((F.col("n") > F.col("before")) & (F.col("n") <= F.col("before") + F.col("own")))
    wanted = parts.select(F.col("fuente").alias("f"), F.col("part").alias("p"), (F.col("n") - F.col("before")).alias("k"))
    inside = keyed.join(wanted, (F.col("fuente") == F.col("f")) & (F.col("part") == F.col("p")))
    nth = F.row_number().over(Window.partitionBy("fuente", "part").orderBy("pos"))
    return inside.withColumn("nth", nth).filter(F.col("nth") == F.col("k")).select(F.col("fuente").alias("_by"), F.col("pos").alias("stop"))


def scan(settings: DataFrame, addresses: DataFrame, seen: DataFrame, pages: DataFrame, as_of: Column, parse: Callable[[DataFrame], DataFrame] = by_jsonld, stretch: int = STRETCH) -> DataFrame:
    """fuente, url, pos, resultado (one of RESULTS), puesto, publicado, vence of every address.

    addresses: as of candidates; seen: url; pages: url, html of what could be read; an address
    without one is 'sin_leer'. What lies behind the end of its source's scan is 'sin_revisar'."""
    own = F.broadcast(settings.select(F.col("fuente").alias("_of"), "limite", F.coalesce("por_id", F.lit(False)).alias("por_id"), F.coalesce("dias_publicado", F.lit(POSTING_DAYS)).alias("dias")))
    known = seen.select(F.col("url").alias("_seen")).distinct()
    at = addresses.join(known, F.col("url") == F.col("_seen"), "left").withColumn("vista", F.col("_seen").isNotNull()).drop("_seen")
    asked = at.filter(~F.col("vista")).select("url").distinct()
    there = pages.select(F.col("url").alias("_url"), "html").join(asked, F.col("_url") == F.col("url"), "left_semi")
    parsed = parse(there).select("_url", "leida", F.trim("puesto").alias("puesto"), "publicado", "vence")
    rows = at.join(parsed, F.col("url") == F.col("_url"), "left").join(own, F.col("fuente") == F.col("_of"))
    old = F.col("leida") & F.coalesce(F.datediff(as_of, F.col("publicado")) > F.col("dias"), F.lit(False))
    closed = F.col("leida") & F.coalesce(F.col("vence") < as_of, F.lit(False))
    given = F.col("leida") & (F.coalesce("puesto", F.lit("")) != "")
    outcome = F.when(F.col("vista"), "vista").when(F.col("_url").isNull(), "sin_leer").when(old, "antigua").when(closed, "cerrada").when(given, "entregada").otherwise("ilegible")
    rows = rows.select("fuente", "url", "pos", outcome.alias("resultado"), "leida", "puesto", "publicado", "vence", "limite", "por_id")
    narrow = rows.select("fuente", "pos", "resultado", "leida", "por_id")
    enough = _nth(narrow, settings.select(F.col("fuente").alias("_by"), F.col("limite").cast("long").alias("n")), F.col("resultado") == "entregada", stretch)
    told = narrow.filter("por_id and coalesce(leida, false) and resultado <> 'vista'")  # pages without a posting neither go on with a run nor end it
    stale = stale_stops(told, "pos", F.col("resultado") == "antigua", STALE_RUN, "fuente", stretch)
    stops = enough.unionByName(stale).groupBy("_by").agg(F.min("stop").alias("stop"))
    nothing = F.col("limite") <= 0
    rows = rows.join(stops, F.col("fuente") == F.col("_by"), "left")
    result = F.when(nothing | F.coalesce(F.col("pos") > F.col("stop"), F.lit(False)), "sin_revisar").otherwise(F.col("resultado"))
    shown = lambda c: F.when(result == "entregada", F.col(c)).alias(c)
    return rows.select("fuente", "url", "pos", result.alias("resultado"), shown("puesto"), shown("publicado"), shown("vence"))


def endings(settings: DataFrame, scanned: DataFrame) -> DataFrame:
    """fuente, the number of addresses of each result, and how the scan ended: limite, racha or agotada."""
    counts = scanned.groupBy(F.col("fuente").alias("_by")).agg(*(F.count_if(F.col("resultado") == r).alias(r) for r in RESULTS), F.max(F.when(F.col("resultado") != "sin_revisar", F.struct("pos", "resultado")))["resultado"].alias("_last"))
    rows = settings.select("fuente", "limite").join(counts, F.col("fuente") == F.col("_by"), "left")
    n = lambda r: F.coalesce(r, F.lit(0)).cast("int")
    end = F.when(n("entregada") >= F.col("limite"), "limite").when((n("sin_revisar") > 0) & (F.col("_last") == "antigua"), "racha").otherwise("agotada")
    return rows.select("fuente", *(n(r).alias(r) for r in RESULTS), end.alias("fin"))
