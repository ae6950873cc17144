"""Queries of the longer chains: tender pages, enrichment, discovery, diagnosis, run log, stored titles, export."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F

from ..functions import score, text
from ..operators import analytics, publish, store
from ..sources import crawl, documents, pages
from . import postings, sql
from .queries import _HASH, _HOOK, _KEPT, _REASON, _RUBRIC, _SWEEP_AT, _TRADE, _cards, _kept, _scored, dealt, register, table
from ..operators.shared import scratch

# -- text and links ------------------------------------------------------------------------------

_CODE = "192 + c_custkey % 60"


@register("html_entities", f"select c_custkey, concat(chr(cast(65 + c_custkey % 26 as int)), ' ', chr(cast({_CODE} as int)), ' € é♥∉Á &lt; ©2 &bogus; €|', chr(65533), ' a & b ', chr(128512)) as t from customer")
def html_entities(spark, d):
    coded = F.concat(F.lit("&#"), F.expr("65 + c_custkey % 26"), F.lit("; &#x"), F.lower(F.hex(F.expr(_CODE))), F.lit("; &#8364 &eacute;&hearts;&notin;&Aacute &amp;lt; &copy2 &bogus; &#128;|&#0; a & b &#x1F600;"))
    return dealt(table(spark, d, "customer")).select("c_custkey", text.unescape(coded).alias("t"))


_HREFS = ("../a.pdf", "/b.pdf", "c/./d.pdf", "https://o.pe/../e.pdf", "//h.pe/f.pdf", "../../../g.pdf?x=1#y", "h.pdf")
_RESOLVED = ("https://x.pe/p/a.pdf", "https://x.pe/b.pdf", "https://x.pe/p/{}/c/d.pdf", "https://o.pe/../e.pdf", "https://h.pe/f.pdf", "https://x.pe/g.pdf?x=1#y", "https://x.pe/p/{}/h.pdf")


def _case(of: str, values, show=sql.lit) -> str:
    return f"case {of} " + " ".join(f"when {k} then {show(v)}" for k, v in enumerate(values)) + " end"


@register("pdf_links_relative", f"select page_id, replace({_case('page_id % 7', _RESOLVED)}, '{{}}', cast(page_id as varchar)) as href from pages")
def pdf_links_relative(spark, d):
    html = F.concat(F.lit("<a href='"), F.expr(_case("page_id % 7", _HREFS)), F.lit("'>bases</a>"))
    p = table(spark, d, "pages").select("page_id", html.alias("html"), F.concat(F.lit("https://x.pe/p/"), "page_id").alias("base"))
    return pages.pdf_links(p, ["page_id"], base="base").select("page_id", "href")


# -- pages ---------------------------------------------------------------------------------------

_SHAPES = (
    '[{"@type":"WebSite"},{"@type":"JobPosting","title":" Puesto ","baseSalary":{"currency":"PEN","value":{"minValue":1000,"maxValue":0}}}]',
    '{"@graph":[{"@graph":[{"@type":"jobposting","title":"Anidado","validThrough":"2026-03-01T10:00"}]},{"@type":"JobPosting","title":"Otro"}],"@type":"JobPosting"}',
    '{"@type":"JobPosting","title":"Por hora","jobLocation":[{"address":{"addressLocality":"Cusco"}}],"baseSalary":{"currencyCode":"USD","value":{"value":12.5,"unitText":"HOUR"}},}',
    '{"@type":"JobPosting","title":"Escalar","jobLocation":{"address":"Av. Uno 1"},"baseSalary":{"currency":"PEN","value":1500},"identifier":77}',
    '{"@type":"JobPosting","title":{"name":"Nombre"},"hiringOrganization":"Entidad","baseSalary":"A tratar","identifier":{"value":"x-1"},"jobLocationType":["TELECOMMUTE"]}',
    '{"@type":["JobPosting"],"title":"Lista de tipos"}',
    "{oops</script><script type='application/ld+json'>{\"@type\":\"JobPosting\",\"title\":[\"Primero\",\"x\"],\"jobLocation\":\"Puno\"}",
)
_READ = (
    ("Puesto", "", "", "S/ 1000 mensual", "", ""), ("Anidado", "", "", "", "", ""), ("Por hora", "", "Cusco", "US$ 12.5 por hora", "", ""), ("Escalar", "", "Av. Uno 1", "S/ 1500", "77", ""),
    ("Nombre", "Entidad", "", "A tratar", "x-1", "remoto"), (None, None, None, None, None, None), ("Primero", "", "Puno", "", "", ""),
)
_READ_NAMES = ("puesto", "empresa", "ubicacion", "sueldo_texto", "id_externo", "modalidad")


@register("jsonld_shapes", "select o_orderkey, " + ", ".join(_case("o_orderkey % 7", [r[k] for r in _READ], lambda v: "null" if v is None else sql.lit(v)) + f" as {n}" for k, n in enumerate(_READ_NAMES)) + ", case when o_orderkey % 7 = 1 then date '2026-03-01' end as vence from orders")
def jsonld_shapes(spark, d):
    """JSON-LD as lists, nested graphs, scalars, lists of places and broken scripts."""
    script = F.concat(F.lit("<script type='application/ld+json'>"), F.expr(_case("o_orderkey % 7", _SHAPES, lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'")), F.lit("</script>"))
    o = text.once(dealt(table(spark, d, "orders")).select("o_orderkey", script.alias("html")), node=pages.job_posting_node(F.col("html")))
    o = text.once(o, j=pages.job_posting_fields(F.col("node")))
    return o.select("o_orderkey", *(F.when(F.col("node").isNotNull(), F.col(f"j.{c}")).alias(c) for c in (*_READ_NAMES, "vence")))


_TENDER = (
    "concat('<html><head><meta property=\"og:title\" content=\"Analista ', cast(o_orderkey as varchar(20)), ' - Municipalidad ', cast(o_custkey as varchar(20)), ' | Portal\"><meta name=\"description\" content=\"Remuneración mensual: S/ 2500. Postula antes del 24 jul. 2026\"></head><body>',"
    " case when o_orderkey % 4 <> 0 then concat('<h1>Técnico <b>', cast(o_orderkey as varchar(20)), '</b></h1>') else '' end,"
    " case when o_orderkey % 3 = 0 then '<p>Sueldo</p><p>S/ 1800</p>' else '' end, '<p>Ubicación: Cusco</p>',"
    " case when o_orderkey % 2 = 0 then '<p>Fecha límite: 3 de agosto de 2026</p>' else '' end, '<p>Modalidad: Presencial</p>',"
    " case o_orderkey % 5 when 0 then '<p>Contrato: CAS temporal</p>' when 1 then '<p>Régimen: D. Leg. 728</p>' when 2 then '<p>Contrato: ley 276</p>' else '' end, '</body></html>')"
)


@register(
    "tender_pages",
    """with t as (select *, concat(o_orderkey, ' ', o_custkey) as numbers from orders), r as (select *, case when o_orderkey % 5 = 0 or contains(numbers, '1057') then 'CAS' when o_orderkey % 5 = 1 or contains(numbers, '728') then '728' when o_orderkey % 5 = 2 or contains(numbers, '276') then '276' else '' end as regimen from t)
    select concat('https://x.pe/', o_orderkey) as url, case when o_orderkey % 4 <> 0 then concat('Técnico ', o_orderkey) else concat('Analista ', o_orderkey) end as puesto, concat('Municipalidad ', o_custkey) as empresa,
    case when o_orderkey % 3 = 0 then 'S/ 1800' else 'S/ 2500.' end as sueldo_texto, 'Cusco Presencial' as ubicacion_texto, regimen,
    case when o_orderkey % 2 = 0 then '2026-08-03' else '2026-07-24' end as vence, cast(case regimen when 'CAS' then 5 when '728' then 4 when '276' then 5 else 0 end as int) as n_beneficios from r""",
)
def tender_pages(spark, d):
    """Public tender pages read into raw postings; their benefits are counted as the reader of sections sees them (one of regime 728 reads as a heading)."""
    o = dealt(table(spark, d, "orders")).select(F.concat(F.lit("https://x.pe/"), "o_orderkey").alias("url"), F.expr(_TENDER).alias("html"))
    raw = pages.public_postings(o, F.lit("estado"), lines=True)
    raw = text.once(raw, b=text.partition(F.col("lineas")))
    return raw.select("url", "puesto", "empresa", "sueldo_texto", "ubicacion_texto", F.col("extra")["regimen"].alias("regimen"), F.col("extra")["vence"].alias("vence"), F.size("b.beneficios").alias("n_beneficios"))


# -- enrichment ----------------------------------------------------------------------------------

_DUTIES = "FUNCIONES DEL PUESTO:\na) Elaborar informes tecnicos del area usuaria;\nb) Coordinar las compras de la oficina central.\nc) Atender los pedidos de otras entidades.\n4. REQUISITOS\n"
_LONG = "Bases del concurso que no dicen en ninguna parte lo que se va a hacer. " * 4
_PDF = "concat('https://x.pe/doc/bases-', cast(o_orderkey as varchar(20)), '.pdf')"
_SITE = "concat('https://e', cast(o_orderkey as varchar(20)), '.gob.pe/convocatoria')"


@register(
    "enrich_postings",
    f"""select o_orderkey, case o_orderkey % 11 when 2 then 'sin_respuesta' when 3 then 'sin_permiso' when 4 then 'sin_encabezado' when 5 then 'escaneado' when 6 then 'sin_bases' when 10 then 'sin_respuesta' end as por_que_no,
    cast(case when o_orderkey % 11 in (0, 1, 7, 8, 9) then 3 else 1 end as int) as n, case o_orderkey % 11 when 1 then {_PDF} when 7 then {_PDF} when 8 then {_SITE} when 9 then replace({_SITE}, 'convocatoria', 'anexos/tdr.pdf') end as funciones_desde,
    case when o_orderkey % 11 = 9 then {_SITE} end as via_oficial, case o_orderkey % 11 when 1 then false when 7 then true when 8 then false when 9 then false end as por_ocr, o_orderkey % 11 in (1, 7, 8, 9) as con_bloque from orders""",
)
def enrich_postings(spark, d):
    """Postings with few duties: their documents, then official pages and the documents of these; five reasons why not."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    case = k % 11
    to_pdf, to_site = F.concat(F.lit("<a href='/doc/bases-"), k.cast("string"), F.lit(".pdf'>Bases</a>")), F.concat(F.lit("<a href='"), F.expr(_SITE), F.lit("'>Anuncio oficial</a>"))
    items = lambda n: F.array_repeat(F.lit("Gestionar la cartera"), n)
    posted = o.select("o_orderkey", F.concat(F.lit("https://x.pe/aviso/"), k.cast("string")).alias("url"), F.when(case == 6, "<p>Sin enlaces</p>").when(case.isin(8, 9), to_site).otherwise(to_pdf).alias("descripcion_html"), F.when(case == 0, items(3)).otherwise(items(1)).alias("funciones"))
    error = F.when(case == 2, "No se pudo leer robots.txt de la entidad").when(case == 3, "403")
    body = F.when(case.isin(1, 9), F.lit(_DUTIES)).when(case == 4, F.lit(_LONG)).when(case.isin(5, 7), F.lit("caratula"))
    where = F.when(case == 9, F.replace(F.expr(_SITE), F.lit("convocatoria"), F.lit("anexos/tdr.pdf"))).otherwise(F.expr(_PDF))
    files = o.filter(case.isin(1, 2, 3, 4, 5, 7, 9)).select(where.alias("url"), error.alias("error"), body.alias("text"), F.when(case == 7, F.lit(_DUTIES)).alias("ocr_text"))
    page = F.when(case == 8, F.lit("<h2>Funciones</h2><ul><li>Elaborar informes tecnicos</li><li>Coordinar compras locales</li><li>Atender pedidos diversos</li></ul>")).otherwise("<a href='../anexos/tdr.pdf'>TDR</a>")
    official = o.filter(case.isin(8, 9)).select(F.expr(_SITE).alias("url"), page.alias("html"))
    e = documents.enrich(posted, files, official)
    return e.select("o_orderkey", "por_que_no", F.size("funciones").alias("n"), "funciones_desde", "via_oficial", "por_ocr", F.col("descripcion_html").contains("<br><p>Funciones</p><ul><li>").alias("con_bloque"))


# -- discovery -----------------------------------------------------------------------------------


def _sitemaps(spark, d):
    """A map of maps for each nation, with twelve children of its customers; the root names itself again first."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 12).alias("k"))
    of = lambda n, k: F.concat(F.lit("https://x.pe/"), n, F.lit("/"), k, F.lit(".xml"))
    url = F.concat(F.lit("<url><loc>https://x.pe/"), "n", F.lit("/aviso-"), (10000 + F.col("c_custkey")).cast("string"), F.lit("</loc></url>"))
    leaves = c.groupBy("n", "k").agg(F.array_sort(F.collect_list(F.struct("c_custkey", url.alias("x")))).alias("u")).select("n", of(F.col("n"), F.col("k")).alias("map_url"), F.concat(F.lit("<urlset>"), F.array_join(F.transform("u", lambda x: x["x"]), ""), F.lit("</urlset>")).alias("xml"))
    root = F.concat(F.lit("https://x.pe/"), "n", F.lit(".xml"))
    named = F.transform(F.array(*map(F.lit, range(12))), lambda k: F.concat(F.lit("<sitemap><loc>"), of(F.col("n"), k), F.lit("</loc></sitemap>")))
    roots = c.select("n").distinct().select("n", root.alias("map_url"), F.concat(F.lit("<sitemapindex><sitemap><loc>"), root, F.lit("</loc></sitemap>"), F.array_join(named, ""), F.lit("</sitemapindex>")).alias("xml"))
    return roots, roots.unionByName(leaves).select("map_url", "xml")


@register("sitemap_discovery", """with c as (select c_nationkey as n, c_custkey % 12 as k, c_custkey from customer where c_custkey % 12 < 8), s as (select n, k, count(*) as m from c group by all),
b as (select n, k, coalesce(sum(m) over (partition by n order by k rows between unbounded preceding and 1 preceding), 0) as before from s),
u as (select c.n, concat('https://x.pe/', c.n, '/aviso-', 10000 + c_custkey) as url, row_number() over (partition by c.n order by c_custkey desc) as rank from c join b on c.n = b.n and c.k = b.k where before < 15 and c_custkey % 10 <> 3) select cast(n as varchar) as fuente, url, rank from u where rank <= 5""")
def sitemap_discovery(spark, d):
    roots, maps = _sitemaps(spark, d)
    found = crawl.discover(maps, roots.select(F.col("n").cast("string").alias("fuente"), "map_url", F.lit(0).alias("pos")), 5, pattern=r"/aviso-\d*[^3]$")
    return found.select("fuente", "url", F.col("rank").cast("long").alias("rank"))


def _gzip(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: gzip.compress(x.encode(), mtime=0))


@register("sitemap_files", "select n_nationkey, case n_nationkey % 4 when 3 then 0 else n_nationkey % 5 + 1 end as n_urls, cast(case when n_nationkey % 4 = 2 then n_nationkey % 5 + 1 else 0 end as bigint) as n_maps from nation")
def sitemap_files(spark, d):
    """Sitemaps as files: plain, packed, an index, and a packed one that is damaged."""
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 5 + 1).alias("size"), (F.col("n_nationkey") % 4).alias("kind"))
    entry = F.when(F.col("kind") == 2, "<sitemap><loc>https://x.pe/ñ\n.xml</loc></sitemap>").otherwise("<url><loc>https://x.pe/ñ</loc></url>")
    n = n.withColumn("plain", F.concat(F.lit("﻿ junk <x>"), F.array_join(F.array_repeat(entry, F.col("size")), ""), F.lit("</x>")))
    packed = F.pandas_udf(_gzip, "binary")("plain")
    content = F.when(F.col("kind") == 0, F.encode("plain", "UTF-8")).when(F.col("kind") == 3, F.substring(packed, 1, 25)).otherwise(packed)
    urls = crawl.sitemap_urls(crawl.sitemap_text(n.select("n_nationkey", content.alias("content"))))
    counts = urls.groupBy(F.col("n_nationkey").alias("of")).agg(F.count(F.lit(1)).alias("u"), F.count_if("is_map").alias("m"))
    return n.join(counts, F.col("n_nationkey") == F.col("of"), "left").select("n_nationkey", F.coalesce("u", F.lit(0)).cast("int").alias("n_urls"), F.coalesce("m", F.lit(0)).alias("n_maps"))


@register("robots_policy", "select n_name as host, case when n_nationkey % 3 = 0 then 9.0::double when n_nationkey % 3 = 1 then cast(n_nationkey as double) + 0.5 end as delay, case when n_nationkey % 2 = 0 then concat('https://', n_nationkey, '/s.xml,https://x/t.xml') else '' end as mapas from nation")
def robots_policy(spark, d):
    k = F.col("n_nationkey")
    own = F.when(k % 3 == 1, F.concat(F.lit("User-agent: otro\nUser-Agent: Lector\nDisallow: /x\nCrawl-delay: nada\nCrawl-delay: "), k, F.lit(".5\n"))).when(k % 3 == 2, "User-agent: lector\nDisallow:\n").otherwise("")
    maps = F.when(k % 2 == 0, F.concat(F.lit("Sitemap: https://"), k, F.lit("/s .xml # uno\nSITEMAP:https://x/t.xml\n"))).otherwise("")
    files = table(spark, d, "nation").select(F.col("n_name").alias("host"), F.concat(own, maps, F.lit("\nUser-agent: *\nCrawl-delay: 9\nDisallow: /y")).alias("text"))
    p = crawl.robots_policy(files, "lector/1.0")
    return p.select("host", "delay", F.array_join("sitemaps", ",").alias("mapas"))


_MARKS = ("<a href='https://boards.greenhouse.io/acme-1'>", "<a href='https://jobs.lever.co/acme_2'>", "x.csod.com/ux/careersite/12/home", "https://acme3.gupy.io", "x.myworkdayjobs.com", "", "")
_ADVICE = (
    "Usa Greenhouse. Agrega:  Greenhouse('acme-1', 'Nombre de la empresa')", "Usa Lever. Agrega:  Lever('acme_2', 'Nombre de la empresa')",
    "Usa Cornerstone OnDemand (careersite 12). Los avisos se piden por su API interna; revisá qué llama la página antes de raspar.",
    "Usa Gupy (acme3.gupy.io). Expone los avisos en JSON; vale la pena escribirle un lector, sirve para varias empresas.",
    "Usa workday. No hay lector directo todavía; probá si la página del aviso trae JSON-LD (motor probar-url --parser jsonld <url del aviso>).", "No se puede leer: bloqueado", "No respondió: tiempo agotado",
)


@register("connector_advice", f"select page_id, case when page_id % 7 < 7 and page_id % 9 <> 8 then {_case('page_id % 7', _ADVICE)} when page_id % 7 in (5, 6) then {_case('page_id % 7', _ADVICE)} when page_id % 2 = 0 then 'Web propia con JSON-LD. Usa portal_propio(...) y funcionará sin más.' when length(html) < 2000 then 'Web propia hecha en JavaScript: necesita Playwright (necesita_render=True).' else 'Web propia sin JSON-LD: hay que revisar el HTML a mano y escribirle un parser, o pedirle a la empresa un feed.' end as consejo from pages")
def connector_advice(spark, d):
    k = F.col("page_id")
    p = table(spark, d, "pages").select("page_id", "url", F.when(k % 7 != 6, F.concat("html", F.when(k % 9 == 8, "").otherwise(F.expr(_case("page_id % 7", _MARKS))))).alias("html"))
    return p.select("page_id", crawl.connector_advice(F.lit("https://bolsa.pe"), F.col("html"), k % 7 != 5, F.when(k % 7 == 5, "bloqueado").otherwise("tiempo agotado"), k % 2 == 0).alias("consejo"))


@register(
    "diagnose",
    """with c as (select c_nationkey as n, min(c_custkey) as first, least(count(*), 5) as u from customer where c_custkey % 4 <> 0 or c_nationkey % 4 <> 0 group by 1) select n_name as fuente, case when n_nationkey % 5 = 0 then 'bloquea' else 'permite' end as robots,
    cast(case when n_nationkey % 5 = 0 then 0 else coalesce(u, 0) end as int) as urls, case when n_nationkey % 5 <> 0 and u > 0 then first % 2 = 0 end as con_jsonld,
    array_to_string(list_filter([case when n_nationkey % 3 = 0 then 'de prueba' end, 'robots leído', case when n_nationkey % 2 = 0 then 'Sitemaps declarados: 2' end, case when n_nationkey % 5 <> 0 and u is null then 'No se descubrieron avisos: revisar sitemap o patrón' end,
    case when n_nationkey % 5 <> 0 and u > 0 then case when first % 2 = 0 then concat('Muestra: Cargo — E', first, ' [sin campo de sueldo]') when first % 3 = 0 then 'La página llega vacía: es una SPA, marcar necesita_render=True' else 'HTML completo pero sin JSON-LD: hay que escribir un parser propio' end end], lambda x: x is not null), '|') as detalle
    from nation left join c on n = n_nationkey""",
)
def diagnose(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation")
    sources = n.select(F.col("n_name").alias("fuente"), F.when(k % 3 == 0, "de prueba").otherwise("").alias("nota"), F.lit(0).alias("sitemaps"))
    policies = n.select(F.col("n_name").alias("fuente"), (k % 5 != 0).alias("legible"), F.lit("robots leído").alias("nota_robots"), F.when(k % 2 == 0, 2).otherwise(0).alias("declarados"))
    c = table(spark, d, "customer").filter("c_custkey % 4 <> 0 or c_nationkey % 4 <> 0").join(F.broadcast(n), F.col("c_nationkey") == k)  # 25 rows
    urls = c.select(F.col("n_name").alias("fuente"), F.col("c_custkey").cast("string").alias("url"), F.row_number().over(_by_nation()).alias("rank")).filter("rank <= 5")
    x = F.col("c_custkey")
    samples = c.select(x.cast("string").alias("url"), F.lit("Cargo").alias("puesto"), F.concat(F.lit("E"), x).alias("empresa"), F.lit("").alias("sueldo_texto"), (x % 2 == 0).alias("con_jsonld"), F.when(x % 3 == 0, "corta").otherwise(F.repeat(F.lit("largo "), F.lit(400))).alias("html"))
    found = crawl.diagnose(sources, policies, urls, samples)
    return found.select("fuente", "robots", "urls", "con_jsonld", F.array_join("detalle", "|").alias("detalle"))


def _by_nation():
    from pyspark.sql.window import Window

    return Window.partitionBy("c_nationkey").orderBy("c_custkey")


@register("catalogue", "select name, cast(min(part) as int) as part, min_by(rank, part * 1000000 + rank) as rank from (select concat('Portal ', s_suppkey % 7) as name, 0 as part, s_suppkey as rank from supplier union all select concat('Portal ', s_suppkey % 11), 1, s_suppkey from supplier) group by 1")
def catalogue(spark, d):
    s = table(spark, d, "supplier")
    part = lambda m: s.select(F.concat(F.lit("Portal "), (F.col("s_suppkey") % m).cast("string")).alias("name"), F.col("s_suppkey").alias("rank"))
    return crawl.catalogue(part(7), part(11))


# -- runs and stored postings --------------------------------------------------------------------

_RUN = "select o_orderpriority as fuente, o_custkey % 700 as huella, (o_custkey % 700) % 3 = 0 as aprobada from orders"


def _run(spark, d):
    key = F.col("o_custkey") % 700
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("fuente"), key.alias("huella"), (key % 3 == 0).alias("aprobada"))


@register("run_log", f"select fuente, cast(count(*) as int) as leidas, cast(count(distinct huella) filter (aprobada) as int) as aprobadas, cast(count(distinct huella) filter (not aprobada) as int) as rechazadas, timestamp '2026-01-01' as inicio, timestamp '2026-01-01 01:00:00' as fin, '{{\"limite\": 100}}' as detalle from ({_RUN}) group by 1")
def run_log(spark, d):
    """A run of each source, put into the log in two appends and read again."""
    where, at = f"{scratch(spark)}/corridas", lambda t: F.lit(t).cast("timestamp_ntz")
    rows = store.run_rows(_run(spark, d), at("2026-01-01"), at("2026-01-01 01:00:00"), F.lit('{"limite": 100}'))
    store.append_runs(rows.filter("fuente < '3'"), where)
    store.append_runs(rows.filter("fuente >= '3'"), where)
    return spark.read.parquet(where)


@register("run_summary", f"with r as ({_RUN}), k as ({_KEPT}), f as (select huella, any_value(aprobada) as ok, count(*) as n from r group by 1) select cast(sum(n) as bigint) as leidas, count(*) filter (ok) as aprobadas, count(*) filter (not ok) as rechazadas, count(*) filter (huella % 4 <> 0) as nuevas, cast(sum(n) as bigint) - count(*) as duplicadas, (select count(*) from k where vigente and {_REASON} is not null) as vencidas, {sql.percent('count(*) filter (ok)', 'count(*)', 1)} as tasa from f")
def run_summary(spark, d):
    stored = _run(spark, d).filter("huella % 4 = 0").select("huella")
    return postings.run_summary(_run(spark, d), stored, store.sweep(_kept(spark, d), F.lit(_SWEEP_AT).cast("date")))


_STORED_TITLE = f"case when p_partkey % 2 = 0 then {_HOOK} else 'Operario de planta' end"


@register("clean_stored_titles", f"select p_partkey, case when p_partkey % 2 = 0 then concat(upper(left({_TRADE}, 1)), substr({_TRADE}, 2), ' de ', upper(left(lower(replace(p_brand, '#', '')), 1)), substr(lower(replace(p_brand, '#', '')), 2)) else 'Operario de planta' end as puesto, p_partkey % 2 = 0 as cambio, false as otra_vez from part")
def clean_stored_titles(spark, d):
    """Stored titles cleaned, and that a second time changes none."""
    once = store.clean_titles(dealt(table(spark, d, "part")).select("p_partkey", F.expr(_STORED_TITLE).alias("puesto"))).withColumnRenamed("cambio", "_cambio")
    again = store.clean_titles(once)
    return again.select("p_partkey", "puesto", F.col("_cambio").alias("cambio"), F.col("cambio").alias("otra_vez"))


@register("review_titles", f"select p_partkey, case when p_partkey % 5 <> 0 and p_partkey % 2 = 0 and p_partkey % 4 = 0 then concat(upper(left({_TRADE}, 1)), substr({_TRADE}, 2), ' de planta') when p_partkey % 2 = 0 then 'Papa Johns' else 'Operario de planta' end as puesto, p_partkey % 5 <> 0 and (p_partkey % 2 = 1 or p_partkey % 4 = 0) as aprobada, case when p_partkey % 5 = 0 or p_partkey % 2 = 1 then 'igual' when p_partkey % 4 = 0 then 'deducido' else 'retirado' end as titulo, case when p_partkey % 5 <> 0 and p_partkey % 4 = 2 then 'El aviso no dice qué puesto es' else '' end as motivos from part")
def review_titles(spark, d):
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    t = dealt(table(spark, d, "part")).select("p_partkey", F.when(k % 2 == 0, "Papa Johns").otherwise("Operario de planta").alias("puesto"), (k % 5 != 0).alias("aprobada"), F.expr(f"case when p_partkey % 4 = 0 then concat('Se busca ', {_TRADE}, ' de planta para Lima') else 'Trabaja cerca de casa' end").alias("resumen"), none.alias("funciones"), none.alias("requisitos"), none.alias("motivos_rechazo"))
    return store.review_titles(t).select("p_partkey", "puesto", "aprobada", "titulo", F.array_join("motivos_rechazo", ";").alias("motivos"))


@register("decode_lists", "select c_custkey, cast(case c_custkey % 4 when 0 then 2 else 0 end as int) as n, case c_custkey % 4 when 0 then concat(c_custkey, '|b \"c\"') else '' end as items from customer")
def decode_lists(spark, d):
    k = F.col("c_custkey")
    stored = F.when(k % 4 == 0, F.concat(F.lit('["'), k, F.lit('", "b \\"c\\""]'))).when(k % 4 == 1, "[").when(k % 4 == 2, "")
    c = table(spark, d, "customer").select("c_custkey", store.decode_list(stored).alias("x"))
    return c.select("c_custkey", F.size("x").alias("n"), F.array_join("x", "|").alias("items"))


_PARTS = ("sueldo", "funciones", "requisitos", "beneficios", "metadata")


@register(
    "explain_score",
    _RUBRIC
    + "select o_orderkey, array_to_string(list_concat([concat('Score: ', total, '/100  ->  ', case when len(motivos) = 0 and total >= 70 then 'APROBADA' else 'RECHAZADA' end), "
    + ", ".join(f"concat('  ', rpad('{k}', 12, ' '), ' ', lpad(cast({k} as varchar), 3, ' '))" for k in _PARTS)
    + "], list_transform(motivos, lambda m: concat('  ✗ ', m)), list_filter([case when f = 0 and least = 0 then '  · Las funciones están en las bases del concurso' end, case when oculta then '  · Empresa no identificada' end], lambda x: x is not null)), chr(10)) as explicacion from e",
)
def explain_score(spark, d):
    return _scored(spark, d).select("o_orderkey", score.explain(F.col("r")).alias("explicacion"))


@register("overview_empty", "select cast(0 as bigint) as total, cast(0 as bigint) as vigentes, 0.0::double as tasa, cast(0 as bigint) as sin_sueldo, cast(0 as int) as pct_sin_sueldo, cast(0 as bigint) as con_sueldo, cast(0 as int) as pct from orders having count(*) filter (o_totalprice < 0) = 0")
def overview_empty(spark, d):
    """Statistics over the orders with a negative price: none, so zeros."""
    t = table(spark, d, "orders").filter("o_totalprice < 0").select(F.lit(True).alias("aprobada"), F.lit(True).alias("vigente"), F.array(F.lit("x")).alias("motivos_rechazo"), "o_orderdate")
    o = analytics.overview(t).withColumn("k", F.lit(1))
    w = analytics.transparency_overall(t, F.col("aprobada"), "o_orderdate").select("con_sueldo", "pct", F.lit(1).alias("k"))
    return o.join(w, "k").drop("k")


_EXPORT_AT = "1998-08-01"


@register(
    "export_payload",
    f"""with c as (select *, {_HASH} as huella, cast(o_orderdate as date) as day from orders where o_custkey % 3 = 0), s as (select *, case when o_orderkey % 4 = 0 then day + 30 end as vence from c),
    l as (select * from s where not coalesce(vence < date '{_EXPORT_AT}', false) and not (vence is null and datediff('day', day, date '{_EXPORT_AT}') > 45) and datediff('day', day, date '{_EXPORT_AT}') <= 60),
    t as (select * from l order by day desc, huella limit 500)
    select cast((select count(*) from t) as varchar) as total, '{_EXPORT_AT}' as generado, cast((select count(*) from orders) as varchar) as filas, cast((select count(*) from l) as varchar) as vigentes, (select md5(string_agg(huella, ',' order by greatest(datediff('day', day, date '{_EXPORT_AT}'), 0), huella)) from t) as huellas""",
)
def export_payload(spark, d):
    cards = _cards(spark, d, "o_custkey").withColumns({"aprobada": F.col("o_custkey") % 3 == 0, "vigente": F.lit(True), "perfil": F.lit("privado"), "motivos_rechazo": F.array().cast("array<string>")})
    p = publish.export_payload(cards, F.lit(_EXPORT_AT).cast("date"))
    get = lambda path: F.get_json_object("documento", path)
    keys = F.from_json(get("$.ofertas[*].huella"), "array<string>")
    return p.select(get("$.total").alias("total"), get("$.generado").alias("generado"), get("$.stats.total").alias("filas"), get("$.stats.vigentes").alias("vigentes"), F.md5(F.array_join(keys, ",")).alias("huellas"))


@register(
    "site_build",
    f"""with c as (select *, {_HASH} as huella, cast(o_orderdate as date) as day from orders where o_custkey % 3 = 0), s as (select *, case when o_orderkey % 4 = 0 then day + 30 end as vence from c),
    l as (select * from s where not coalesce(vence < date '{_EXPORT_AT}', false) and not (vence is null and datediff('day', day, date '{_EXPORT_AT}') > 45) and datediff('day', day, date '{_EXPORT_AT}') <= 60),
    t as (select * from l order by day desc, huella limit 1000), p as (select concat('operario-', left(huella, 8)) as slug from t), old as (select concat('operario-', left({_HASH}, 8)) as slug from orders where o_orderkey % 2 = 0)
    select 'pages' as parte, slug as valor from p union all select 'gone', slug from (select slug from old except all select slug from p) union all select 'sitemap', concat('<url><loc>https://x.pe/oferta/operario-', left(huella, 8), '/</loc><lastmod>', cast(day as varchar), '</lastmod></url>') from t""",
)
def site_build(spark, d):
    """The pages, sitemap entries and pages to take down of a build of the site."""
    cards = _cards(spark, d, "o_custkey").withColumns({"aprobada": F.col("o_custkey") % 3 == 0, "vigente": F.lit(True), "perfil": F.lit("privado"), "motivos_rechazo": F.array().cast("array<string>")})
    old = _cards(spark, d, "o_orderkey").filter("o_orderkey % 2 = 0").select(publish.slug(F.col("puesto"), F.col("huella")).alias("slug"))
    built = publish.site(cards, old, F.lit(_EXPORT_AT).cast("date"), "https://x.pe")
    part = lambda k, c: built[k].select(F.lit(k).alias("parte"), F.col(c).alias("valor"))
    return part("pages", "slug").unionByName(part("gone", "slug")).unionByName(part("sitemap", "entry"))
