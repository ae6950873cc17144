"""Queries of stored pages as a source, and of the composed scan over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.shared import scratch
from ..sources import archive, scan
from ..streaming import ingest
from .queries import AS_OF, register, table

_SOURCE, _DAY = "concat('f ', page_id % 4)", "date '2026-01-01' + cast(page_id % 10 as int)"


def _stored(spark, d, loads=(0, 1, 2)) -> str:
    """The pages table as an archive of three loads."""
    where = scratch(spark)
    p = table(spark, d, "pages")
    for k in loads:
        archive.store_pages(p.filter(F.col("page_id") % 3 == k), where, k, F.expr(_SOURCE), F.expr("date_add(date '2026-01-01', cast(page_id % 10 as int))"), F.col("page_id"))
    return where


@register("page_archive", f"select {_SOURCE} as fuente, {_DAY} as dia, page_id % 3 as carga, count(*) as n, cast(sum(length(html)) as bigint) as chars, max(page_id) as last from pages where page_id % 10 >= 6 and page_id % 4 in (1, 2) group by all")
def page_archive(spark, d):
    """Pages of two sources since a day: the source opens the folders of these only."""
    p = archive.read_pages(spark, _stored(spark, d)).filter(F.col("fuente").isin("f 1", "f 2") & (F.col("dia") >= F.lit("2026-01-07").cast("date")))
    return p.groupBy("fuente", "dia", "carga").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("html")).alias("chars"), F.max("pos").alias("last"))


@register("page_archive_newest", f"with p as (select {_SOURCE} as fuente, {_DAY} as dia, page_id as pos, url from pages) select fuente, dia, pos, url from p qualify row_number() over (partition by fuente order by dia desc, pos) <= 7")
def page_archive_newest(spark, d):
    """The seven newest pages of each source, read lazily."""
    return archive.read_pages(spark, _stored(spark, d), 7).select("fuente", "dia", "pos", "url")


@register("page_archive_stream", f"select {_SOURCE} as fuente, page_id as pos, 1::bigint as times from pages")
def page_archive_stream(spark, d):
    """The archive as a stream that is started again after a further load: each page once."""
    where, out = _stored(spark, d, (0, 2)), scratch(spark)
    columns = lambda: archive.stream_pages(spark, where).select("fuente", "pos")
    ingest.drain(columns(), f"{out}/rows", f"{out}/checkpoint")
    archive.store_pages(table(spark, d, "pages").filter("page_id % 3 = 1"), where, 1, F.expr(_SOURCE), F.expr("date_add(date '2026-01-01', cast(page_id % 10 as int))"), F.col("page_id"))
    rows = ingest.drain(columns(), f"{out}/rows", f"{out}/checkpoint")
    return rows.groupBy("fuente", "pos").agg(F.count(F.lit(1)).alias("times"))


# Orders as pages of sources: each source (order key modulo 40) has its own settings; what a page gives hangs on its key.
_OF, _LIMIT = "cast(o_orderkey % 40 as int)", "case k when 0 then 0 when 1 then 5 when 2 then 1000000 else 3 * k end"
_URL = "concat('https://f', o_orderkey % 40, '.pe/aviso-', 1000000 + o_orderkey)"
_AGE = "cast(case when k % 3 = 1 and o_orderkey % 7 <> 0 then 61 + o_orderkey % 9 when o_orderkey % 11 = 0 then 99 else o_orderkey % 50 end as int)"
_CLOSED, _BARE, _NAMELESS, _LOST, _SEEN = "o_orderkey % 13 = 0", "o_orderkey % 17 = 0", "o_orderkey % 19 = 0", "o_orderkey % 23 = 0", "o_orderkey % 5 = 0"
_SETTINGS = f"select k, concat('f', k) as fuente, cast({_LIMIT} as int) as limite, '/aviso-[0-9]*[0-8]$' as patron, k % 2 = 1 as por_id, k % 5 = 4 as navegador, case when k % 4 = 0 then 20 end as dias_ventana, case when k % 6 = 5 then 40 end as dias_publicado from (select unnest(range(40)) as k)"
_LASTMOD = "o_orderkey % 30"

_SCAN_SQL = f"""
with recursive s as ({_SETTINGS}),
u as (select fuente, o.o_orderkey as key, o.o_orderkey, {_URL} as url, s.*, row_number() over (partition by s.fuente order by case when por_id then -(1000000 + o_orderkey) else {_LASTMOD} end, o_orderkey) as pos
  from orders o join s on o.o_orderkey % 40 = s.k where o_orderkey % 10 <> 9 and (por_id or {_LASTMOD} <= coalesce(dias_ventana, 120))),
c as (select * from u where pos <= limite * case when navegador then 2 else 4 end),
r as (select *, case when {_SEEN} then 'vista' when {_LOST} then 'sin_leer' when {_BARE} then 'ilegible' when {_AGE} > coalesce(dias_publicado, 60) then 'antigua' when {_CLOSED} then 'cerrada' when {_NAMELESS} then 'ilegible' else 'entregada' end as r0, {_BARE} as bare from c),
w as (select *, sum(case when r0 = 'entregada' then 1 else 0 end) over (partition by fuente order by pos) as given,
  sum(case when r0 in ('cerrada', 'entregada') or r0 = 'ilegible' and not bare then 1 else 0 end) over (partition by fuente order by pos) as resets from r),
x as (select *, case when r0 = 'antigua' then row_number() over (partition by fuente, resets, r0 order by pos) end as run from w),
e as (select fuente, least(min(case when r0 = 'entregada' and given = limite then pos end), min(case when por_id and run = 40 then pos end)) as stop from x group by fuente),
f as (select x.fuente, x.key, case when x.pos > e.stop then 'sin_revisar' else r0 end as resultado, x.pos, limite from x join e using (fuente))
"""


def _scanned(spark, d, stretch=64):
    o = table(spark, d, "orders").withColumn("k", F.expr(_OF))
    raw = spark.range(40).select(F.col("id").cast("int").alias("k"))
    settings = raw.select(F.concat(F.lit("f"), "k").alias("fuente"), F.expr(f"cast({_LIMIT} as int)").alias("limite"), F.lit("/aviso-[0-9]*[0-8]$").alias("patron"), F.expr("k % 2 = 1").alias("por_id"), F.expr("k % 5 = 4").alias("navegador"), F.expr("case when k % 4 = 0 then 20 end").alias("dias_ventana"), F.expr("case when k % 6 = 5 then 40 end").alias("dias_publicado"))
    as_of = F.lit(AS_OF).cast("date")
    url = F.expr(_URL)
    found = o.select(F.concat(F.lit("f"), "k").alias("fuente"), url.alias("url"), F.col("o_orderkey").alias("place"), F.date_sub(as_of, F.expr(f"cast({_LASTMOD} as int)")).alias("lastmod"))
    found = found.unionByName(found.withColumn("place", F.col("place") + 10**9))  # discovered twice
    fields = F.struct(F.lit("JobPosting").alias("@type"), F.when(F.expr(_NAMELESS), " ").otherwise(F.concat(F.lit("Aviso "), "o_orderkey")).alias("title"), F.date_sub(as_of, F.expr(_AGE)).cast("string").alias("datePosted"), F.when(F.expr(_CLOSED), "1998-07-31").otherwise("1998-08-01").alias("validThrough"))
    html = F.when(F.expr(_BARE), "<h1>nada</h1>").otherwise(F.concat(F.lit("<script type='application/ld+json'>"), F.to_json(fields), F.lit("</script>")))
    pages = o.filter(f"not ({_LOST})").select(url.alias("url"), html.alias("html"))
    seen = o.filter(_SEEN).select(url.alias("url"))
    nothing = spark.createDataFrame([], "fuente string, url string, place long")
    at = scan.candidates(settings, found, nothing, as_of)
    return settings, scan.scan(settings, at, seen, pages, as_of, stretch=stretch)


@register("source_scan", _SCAN_SQL + " select fuente, key, resultado, cast(pos as integer) as pos from f")
def source_scan(spark, d):
    """Forty sources over pages of JSON-LD: every address with what it gave, up to where its source's scan ended."""
    _, rows = _scanned(spark, d)
    return rows.select("fuente", (F.substring_index("url", "-", -1).cast("long") - 1000000).alias("key"), "resultado", "pos")


@register("scan_endings", _SCAN_SQL + """, g as (select fuente, limite, count(*) filter (resultado = 'vista') as vista, count(*) filter (resultado = 'sin_leer') as sin_leer, count(*) filter (resultado = 'antigua') as antigua, count(*) filter (resultado = 'cerrada') as cerrada,
 count(*) filter (resultado = 'entregada') as entregada, count(*) filter (resultado = 'ilegible') as ilegible, count(*) filter (resultado = 'sin_revisar') as sin_revisar, arg_max(resultado, pos) filter (resultado <> 'sin_revisar') as last from f group by all)
select s.fuente, cast(coalesce(vista, 0) as integer) as vista, cast(coalesce(sin_leer, 0) as integer) as sin_leer, cast(coalesce(antigua, 0) as integer) as antigua, cast(coalesce(cerrada, 0) as integer) as cerrada, cast(coalesce(entregada, 0) as integer) as entregada, cast(coalesce(ilegible, 0) as integer) as ilegible, cast(coalesce(sin_revisar, 0) as integer) as sin_revisar,
case when coalesce(entregada, 0) >= s.limite then 'limite' when sin_revisar > 0 and last = 'antigua' then 'racha' else 'agotada' end as fin from s left join g using (fuente)""")
def scan_endings(spark, d):
    """How the scan of each source ended: with its limit, a run of old postings, or its addresses."""
    return scan.endings(*_scanned(spark, d))
