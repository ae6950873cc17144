"""Queries of the readers: pages, sitemaps, robots rules, links, cards, job boards, documents, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import deltas, store
from ..operators.shared import scratch
from ..sources import crawl, documents, pages
from ..streaming import ingest

from .queries import AS_OF, dealt, register, table

_PATH = "regexp_extract(url, '^https?://[^/]+(/.*)$', 1)"


@register("meta_and_heading", r"""select page_id, regexp_extract(html, '(?i)<meta[^>]+name="d"[^>]*content="([^"]*)"', 1) as d, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as h1 from (select page_id, concat('<meta name="d" content="p', page_id, '">', html) as html from pages)""")
def meta_and_heading(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit('<meta name="d" content="p'), "page_id", F.lit('">'), "html").alias("html"))
    return p.select("page_id", pages.meta(F.col("html"), "d").alias("d"), pages.heading_text(F.col("html")).alias("h1"))


_SHEET = "array('Ubicación', c_name, concat('Sueldo: S/ ', cast(c_custkey as varchar(20))), 'Plazo para postular:', concat(cast(c_custkey % 28 + 1 as varchar(20)), ' de ', case c_nationkey % 3 when 0 then 'Agosto' when 1 then 'setiembre' else 'enero' end, ' del 2026'))"


@register("label_values", "select c_custkey, c_name as ubicacion, concat('S/ ', c_custkey) as sueldo, make_date(2026, case c_nationkey % 3 when 0 then 8 when 1 then 9 else 1 end, c_custkey % 28 + 1) as plazo from customer")
def label_values(spark, d):
    c = dealt(table(spark, d, "customer")).withColumn("lines", F.expr(_SHEET))
    line = F.col("lines")
    return c.select("c_custkey", pages.value_beside(line, "Ubicación").alias("ubicacion"), pages.value_beside(line, "Sueldo").alias("sueldo"), pages.spanish_date(pages.field(line, "Plazo para postular")).alias("plazo"))


@register("dates_and_regimes", "select o_orderkey, cast(o_orderdate as date) as a, cast(o_orderdate as date) as b, case o_orderkey % 4 when 0 then 'CAS' when 1 then '728' when 2 then '276' else '' end as regimen from orders")
def dates_and_regimes(spark, d):
    o, day = dealt(table(spark, d, "orders")), F.to_date("o_orderdate")
    short = F.element_at(F.array(*(F.lit(m[:3]) for m in ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "set", "oct", "nov", "dic"))), F.month(day))
    contract = F.expr("case o_orderkey % 4 when 0 then 'Contrato CAS vigente' when 1 then 'D. Leg. 728' when 2 then 'ley 276' else 'CASA' end")
    return o.select("o_orderkey", pages.spanish_date(F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), short, F.lit(". "), F.year(day).cast("string"))).alias("a"), pages.flexible_date(F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string")).alias("b"), pages.regime(contract).alias("regimen"))


_CARD_LINE = "case when l_linenumber % 3 = 1 then concat('► Vacantes: ', cast(l_linenumber as varchar(20))) when l_linenumber = 6 then 'Cronograma' else concat('Experiencia: ', cast(l_partkey as varchar(20))) end"


@register("cards", f"""with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_CARD_LINE} as line from lineitem), s as (select *, sum(case when line like '%Vacantes%' then 1 else 0 end) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) as card from l),
e as (select *, max(case when line = 'Cronograma' and card = mx then 1 else 0 end) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) as gone from (select *, max(card) over (partition by l_orderkey) as mx from s))
select l_orderkey, cast(card as bigint) as card, count(*) as n from e where card > 0 and gone = 0 group by all""")
def cards(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), F.expr(_CARD_LINE).alias("line"))
    return pages.cards(lines, "l_orderkey", "pos").groupBy("l_orderkey", "card").agg(F.count(F.lit(1)).alias("n"))


def _tenders(spark, d):
    part = lambda title, pay: F.concat(F.lit(f"<p>{title}</p><p>► Vacantes: 2</p><p>Experiencia: mínima de un año en el cargo</p><p>Manejo de herramientas</p><p>Salario: S/ "), pay, F.lit("</p>"))
    k = F.col("o_orderkey")
    body = F.concat(F.lit("<p>Plazo para postular: "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" de enero del 2026</p>"), part("Operario de limpieza", F.lit("1350")), F.when(k % 3 == 0, part("Operario de limpieza", F.lit("1350"))).when(k % 3 == 1, part("Operario de Limpieza", F.lit("2800"))).otherwise(part("Especialista legal", F.lit("2800"))), F.lit("<p>¿Cómo postular?</p><p>Mesa de partes</p>"))
    return dealt(table(spark, d, "orders")).select(k.cast("string").alias("url"), body.alias("html"))


@register("tender_postings", """select cast(o_orderkey as varchar) as url, cast(card as bigint) as card, case when card = 1 then 'Operario de limpieza' else 'Especialista legal' end as puesto, case when card = 1 then 'S/ 1350' else 'S/ 2800' end as sueldo_texto, 'mínima de un año en el cargo|Manejo de herramientas' as requisitos, make_date(2026, 1, day(o_orderdate)) as vence
from orders, (select unnest([1, 2]) as card) where day(o_orderdate) >= 15 and ((o_orderkey % 3 = 0 and card = 1) or o_orderkey % 3 = 2)""")
def tender_postings(spark, d):
    p = pages.tender_postings(_tenders(spark, d), F.lit("2026-01-15").cast("date"))
    return p.select("url", "card", "puesto", "sueldo_texto", F.array_join("requisitos", "|").alias("requisitos"), "vence")


_NODE = """concat('<script type="application/ld+json">', case when o_orderkey % 3 = 0 then '{"@graph":[{"@type":"WebSite"},' else '' end, '{"@type":"JobPosting","title":"Puesto ', cast(o_orderkey as varchar(20)), '","hiringOrganization":{"name":"Empresa"},"jobLocation":{"address":{"addressLocality":"Lima","addressRegion":"LIM"}},"baseSalary":{"currency":"PEN","value":{"minValue":', cast(o_custkey as varchar(20)), ',"maxValue":', cast(o_custkey + 9 as varchar(20)), ',"unitText":"MONTH"}},"datePosted":"2026-01-02T00:00:00","jobLocationType":"TELECOMMUTE",}', case when o_orderkey % 3 = 0 then ']}' else '' end, '</script>')"""


@register("jsonld_fields", "select o_orderkey, concat('Puesto ', o_orderkey) as puesto, 'Empresa' as empresa, 'Lima, LIM' as ubicacion, case when o_custkey = 0 then 'S/ 9 mensual' else concat('S/ ', o_custkey, ' a S/ ', o_custkey + 9, ' mensual') end as sueldo_texto, date '2026-01-02' as publicado, 'remoto' as modalidad from orders")
def jsonld_fields(spark, d):
    o = text.once(dealt(table(spark, d, "orders")), html=F.expr(_NODE))
    o = text.once(o, node=pages.job_posting_node(F.col("html")))
    o = text.once(o, j=pages.job_posting_fields(F.col("node")))
    return o.select("o_orderkey", "j.puesto", "j.empresa", "j.ubicacion", "j.sueldo_texto", "j.publicado", "j.modalidad")


@register("job_boards", "select concat('g', o_orderkey) as id_externo, concat('Cargo ', o_custkey) as puesto, '<p>a & b</p>' as descripcion_html, '' as sueldo_texto, date '2026-01-02' as publicado from orders where o_orderkey % 2 = 0 union all select concat('l', o_orderkey), concat('Cargo ', o_custkey), 'plano<p>Lista</p><li>x</li>', 'PEN 1000 a 2000', date '1970-01-03' from orders where o_orderkey % 2 = 1")
def job_boards(spark, d):
    o = table(spark, d, "orders")
    g = o.filter("o_orderkey % 2 = 0").select(F.expr("""concat('{"jobs":[{"id":"g', o_orderkey, '","title":"Cargo ', o_custkey, '","absolute_url":"u","content":"&lt;p&gt;a &amp;amp; b&lt;/p&gt;","location":{"name":"Lima"},"updated_at":"2026-01-02T10:00:00Z"}]}')""").alias("json"))
    l = o.filter("o_orderkey % 2 = 1").select(F.expr("""concat('[{"id":"l', o_orderkey, '","text":"Cargo ', o_custkey, '","hostedUrl":"u","descriptionPlain":"plano","lists":[{"text":"Lista","content":"<li>x</li>"}],"categories":{"location":"Lima"},"createdAt":172800000,"salaryRange":{"currency":"PEN","min":1000,"max":2000}}]')""").alias("json"))
    columns = ["id_externo", "puesto", "descripcion_html", "sueldo_texto", "publicado"]
    a = pages.greenhouse(g).withColumn("sueldo_texto", F.lit("")).withColumn("descripcion_html", text.unescape(F.col("descripcion_html")))
    return a.select(*columns).unionByName(pages.lever(l).select(*columns))


_ANCHORS = r"""select page_id, unnest(regexp_extract_all(html, '<a href="/([^"]+)">', 1)) as href, unnest(range(len(regexp_extract_all(html, '<a href="/([^"]+)">', 1)))) as pos from pages"""


@register("pdf_links", f"""with a as (select page_id, pos, concat('/', href, case when pos % 3 = 0 then '-bases' when pos % 3 = 1 then '-anexo' else '' end, '.pdf') as href, case pos % 3 when 0 then 10 when 1 then -10 else 0 end as score from ({_ANCHORS})),
b as (select page_id, href, max(score) as score, arg_max(pos, score * 1000 - pos) as pos from a group by all) select page_id, href, cast(score as int) as score, row_number() over (partition by page_id order by score desc, pos) as rank from b""")
def pdf_links(spark, d):
    each = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="/([^"]+)">'), F.lit(1))).alias("pos", "href"))
    name = F.concat(F.lit("/"), "href", F.when(F.col("pos") % 3 == 0, "-bases").when(F.col("pos") % 3 == 1, "-anexo").otherwise(""), F.lit(".pdf"))
    links = each.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit('<a href="'), name, F.lit('">x</a>')).alias("a")))).alias("l"))
    return pages.pdf_links(links.select("page_id", F.array_join(F.transform("l", lambda x: x["a"]), "").alias("html")), ["page_id"])


@register("official_links", f"""select page_id, concat('https://', regexp_replace(href, '[^A-Za-z0-9]+', '-', 'g'), '.gob.pe/ver') as href, cast(6 as int) as score, row_number() over (partition by page_id order by min(pos)) as rank from ({_ANCHORS}) where pos % 2 = 0 group by page_id, 2""")
def official_links(spark, d):
    each = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="/([^"]+)">'), F.lit(1))).alias("pos", "href"))
    name = F.regexp_replace("href", "[^A-Za-z0-9]+", "-")
    to = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("https://"), name, F.lit(".gob.pe/ver"))).otherwise(F.concat(F.lit("https://facebook.com/"), name))
    links = each.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit('<a href="'), to, F.lit('">x</a>')).alias("a")))).alias("l"))
    return pages.official_links(links.select("page_id", F.lit("portal.pe").alias("host"), F.array_join(F.transform("l", lambda x: x["a"]), "").alias("html")), ["page_id"])


@register("listing_urls", r"""select concat('https://x.pe/', h) as url, min(page_id) as page_pos from (select page_id, unnest(regexp_extract_all(html, '/[A-Za-z]+"')) as h0, rtrim(ltrim(h0, '/'), '"') as h from pages) group by 1""")
def listing_urls(spark, d):
    u = crawl.listing_urls(table(spark, d, "pages"), '/[A-Za-z]+"', F.lit("https://x.pe"), rank="page_id")
    return u.select("url", F.col("first.page_pos").alias("page_pos"))


@register("url_correlative", "select page_id, coalesce(list_max(list_transform(regexp_extract_all(u, '[0-9]{4,}'), lambda x: cast(x as bigint))), 0) as n from (select page_id, concat(url, '-', page_id * 37, '-', page_id * 1001) as u from pages)")
def url_correlative(spark, d):
    return table(spark, d, "pages").select("page_id", crawl.correlative(F.concat_ws("-", "url", (F.col("page_id") * 37).cast("string"), (F.col("page_id") * 1001).cast("string"))).alias("n"))


@register("url_quota", "select url from (select url, min(case when page_id % 3 = 0 then 0 else 1 end * 1000000000 + page_id) as p from pages group by url) order by p, url limit 60")
def url_quota(spark, d):
    """A third of the pages as the listing, the others as the sitemap: the first 60 URLs of both."""
    p = table(spark, d, "pages").select("url", F.col("page_id").alias("pos"))
    return crawl.fill_up(p.filter("pos % 3 = 0"), p.filter("pos % 3 <> 0"), 60).select("url")


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@register("stale_run", f"""with p as (select page_id, {_HOST} as host, case when page_id % 17 > 3 then 1 else 0 end as old from pages),
b as (select *, sum(1 - old) over (partition by host order by page_id) as brk from p), r as (select *, sum(old) over (partition by host, brk order by page_id) as run from b)
select host, page_id from (select *, coalesce(max(case when run >= 4 then 1 else 0 end) over (partition by host order by page_id rows between unbounded preceding and 1 preceding), 0) as stop from r) where stop = 0""")
def stale_run(spark, d):
    p = table(spark, d, "pages").select("page_id", F.expr(_HOST).alias("host"))
    return crawl.until_stale(p, "page_id", F.col("page_id") % 17 > 3, 4, "host", 50).select("host", "page_id")


@register("vacancy_counts", "select count(*) filter (n > 1) as de_varias_plazas, coalesce(sum(n) filter (n > 1), 0) as plazas_en_juego from (select page_id % 7 as n from pages)")
def vacancy_counts(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("https://x.pe/a-"), (F.col("page_id") % 7).cast("string"), F.lit("-plazas-"), "page_id", F.lit(".html")).alias("url"))
    return crawl.vacancy_counts(p, pages.vacancies(F.col("url")))


@register("sitemap_recency", "select concat('https://x.pe/', o_orderkey) as loc, case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) end as lastmod from orders where o_orderkey % 5 = 0 or cast(o_orderdate as date) >= date '1998-08-01' - 365")
def sitemap_recency(spark, d):
    xml = F.concat(F.lit("junk <urlset xmlns='http://x'><url><loc>https://x.pe\n/"), "o_orderkey", F.lit("</loc>"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("<lastmod>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</lastmod>"))), F.lit("</url></urlset>"))
    urls = crawl.sitemap_urls(table(spark, d, "orders").select(xml.alias("xml")))
    return crawl.recent(urls, F.lit(AS_OF).cast("date"), 365).select("loc", "lastmod")


_ROBOTS = (
    "User-agent: otro\nDisallow: /\n\nUser-agent: *\nDisallow: /en # lengua\nAllow: /en/*5\nDisallow: /*page=3\nAllow: /fr$\nDisallow: /de/\nCrawl-delay: 4\nSitemap: https://x/s.xml",
    "User-agent: Lector\nUser-agent: otro\nDisallow: /*?page=\nAllow: /*?page=1$\n\nUser-agent: *\nDisallow: /",
    "User-agent: *\nDisallow:\nDisallow: /e",
)
_RULES = (
    (("/en", False), ("/en/*5", True), ("/*page=3", False), ("/fr$", True), ("/de/", False)),
    (("/*?page=", False), ("/*?page=1$", True)),
    (("/", True), ("/e", False)),
)
_ASKED = f"concat({_PATH}, case page_id % 4 when 1 then '?page=1' when 2 then '?page=2' when 3 then '?x=1&page=3' else '' end)"
_RULE_ROWS = ", ".join(f"({h}, {len(p)}, {ok}, '{'^' + p.replace('?', chr(92) + '?').replace('*', '.*')}')" for h, rules in enumerate(_RULES) for p, ok in rules)


@register("robots_allowed", f"with r(h, n, ok, re) as (values {_RULE_ROWS}), u as (select page_id, page_id % 5 as h, {_ASKED} as path from pages) select u.page_id, coalesce(arg_max(ok, n * 10 + cast(ok as int)), true) as permitted from u left join r on u.h = r.h and regexp_matches(u.path, r.re) group by 1")
def robots_allowed(spark, d):
    """Paths with queries under the rules of five hosts, of which two have none."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("h"), (F.col("page_id") % 5).cast("string")).alias("host"), F.expr(_ASKED).alias("path"))
    text_of = F.when(F.col("r_regionkey") == 0, _ROBOTS[0]).when(F.col("r_regionkey") == 1, _ROBOTS[1]).when(F.col("r_regionkey") == 2, _ROBOTS[2]).otherwise("")
    files = table(spark, d, "region").select(F.concat(F.lit("h"), "r_regionkey").alias("host"), text_of.alias("text"))
    return crawl.allowed(p, crawl.robots_rules(files, "lector/1.0"), "page_id").select("page_id", "permitted")


@register("domain_policy", "select event_id, case when event_id % 5 = 1 then true when event_id % 5 in (2, 3, 4) then false else true end as leer, greatest(case when event_id % 3 = 0 then 5.0 else 0.0 end, 2.0) as espera from events")
def domain_policy(spark, d):
    k = F.col("event_id")
    status = F.when(k % 5 == 1, 404).when(k % 5 == 2, 503).when(k % 5 != 3, 200)
    return table(spark, d, "events").select("event_id", crawl.domain_policy(status, F.when(k % 5 == 4, "").otherwise("User-agent: *")).alias("leer"), crawl.wait_seconds(F.when(k % 3 == 0, F.lit(5.0))).alias("espera"))


@register("problem_log", "select concat('fallo en <url> por ', event_type) as clave, min_by(concat('fallo en https://x.pe/', user_id, ' por ', event_type), event_id) as mensaje, count(*) as n from events group by event_type")
def problem_log(spark, d):
    m = table(spark, d, "events").select("event_id", F.concat(F.lit("fallo en https://x.pe/"), "user_id", F.lit(" por "), "event_type").alias("message"))
    return crawl.problem_log(m, order="event_id")


@register("cache_keys", "select page_id, left(sha1(url), 20) as nombre from pages")
def cache_keys(spark, d):
    return table(spark, d, "pages").select("page_id", crawl.cache_key(F.col("url")).alias("nombre"))


@register("startup_sources", "select name, min(s_suppkey) as rank from (select s_suppkey, concat('Portal ', s_suppkey % 7) as name from supplier) where contains(lower(name), 'al 3') or contains(lower(name), 'al 5') group by 1")
def startup_sources(spark, d):
    s = crawl.startup_sources(table(spark, d, "supplier").select(F.concat(F.lit("Portal "), (F.col("s_suppkey") % 7).cast("string")).alias("name"), F.col("s_suppkey").alias("rank")))
    return crawl.select_sources(s, "AL 3").unionByName(crawl.select_sources(s, "al 5"))


def _broken(key: str) -> str:
    return f"concat(coalesce(text, ''), case when {key} % 4 = 0 then ' a¡b' when {key} % 4 = 1 then ' ||//..//||//..//||//..//||//' else '' end)"


def _illegible_sql(columns: str, key: str, of: str) -> str:
    shown = f"trim({_broken(key)}, ' ')"
    return rf"select {columns}, length({shown}) < 12 or regexp_matches({shown}, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}][¡¿]') or length(regexp_replace({shown}, '[^\p{{L}}\s\p{{Z}}\x0B\x{{85}}]', '', 'g')) / greatest(length({shown}), 1) < 0.8 as roto from {of}"


@register("illegible", _illegible_sql("conv_id, turn", "conv_id", "conversations"))
def illegible(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", documents.illegible(F.expr(_broken("conv_id"))).alias("roto"))


@register("illegible_whole", _illegible_sql("doc_id", "doc_id", "documents"))
def illegible_whole(spark, d):
    """As illegible, over whole long texts."""
    return table(spark, d, "documents").select("doc_id", documents.illegible(F.expr(_broken("doc_id"))).alias("roto"))


@register("document_duties", "select cast(o_orderkey as varchar) as url, concat('Elaborar informes tecnicos del area ', o_custkey, ' de la entidad', case when o_orderkey % 2 = 0 then '|Coordinar las compras de la oficina central' else '' end) as funciones from orders where o_orderkey % 5 <> 0")
def document_duties(spark, d):
    k = F.col("o_orderkey")
    body = F.concat(F.lit("I. GENERALIDADES\nTexto\n"), F.when(k % 5 == 0, "II. OTROS").otherwise("III. FUNCIONES DEL PUESTO:"), F.lit("\na) Elaborar informes tecnicos del\narea "), "o_custkey", F.lit(" de la entidad;\n"), F.when(k % 2 == 0, "b) Coordinar las compras de la oficina central.\n").otherwise(""), F.lit("4. REQUISITOS\n- Titulo profesional de la carrera"))
    found = documents.duties(dealt(table(spark, d, "orders")).select(k.cast("string").alias("url"), body.alias("text")))
    return found.select("url", F.array_join("funciones", "|").alias("funciones"))


@register("stream_first_seen", "select distinct user_id, event_type from events")
def stream_first_seen(spark, d):
    """Events as a stream of the table's file: each user's first event of a type within the time to live."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder_of(spark, d, "events"))
    where = scratch(spark)
    return ingest.drain(ingest.first_seen(stream, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"), f"{where}/out", f"{where}/checkpoint")


def _folder_of(spark, d, name: str, files: int | None = None) -> str:
    """A folder with only this table's files, as a stream source reads folders: the table is written there, by time in several files if asked."""
    where = f"{scratch(spark)}/{name}"
    df = table(spark, d, name)
    if files is None:
        df.write.parquet(where)
        return where
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = df.agg(F.min(at).alias("a"), F.max(at).alias("z")).first()
    part = F.floor((at - low) * files / (high - low + 1))
    for k in range(files):  # one after the other, as they would come in
        df.filter(part == k).coalesce(1).write.mode("append").parquet(where)
    return where


@register("stream_upsert", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def stream_upsert(spark, d):
    """Events as a stream, put by key into a versioned table, one micro-batch after the other."""
    where = scratch(spark)
    deltas.create(spark, f"{where}/t", "user_id bigint, event_id bigint, at timestamp, capturado timestamp, visto_ultima_vez timestamp, vigente boolean", "user_id")
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(_folder_of(spark, d, "events", 3))
    rows = stream.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"))
    ingest.upsert_stream(rows, f"{where}/t", "user_id", ("at", "event_id"), "2030-01-01 00:00:00", f"{where}/checkpoint", 2).awaitTermination()
    return deltas.read(spark, f"{where}/t").select("user_id", "event_id")


@register("stream_windows", "select date_trunc('hour', ts) as desde, event_type, count(*) as n from events group by all")
def stream_windows(spark, d):
    """Events as a stream, counted by hour and type; with all of them late enough in the day, none is dropped."""
    where = scratch(spark)
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(_folder_of(spark, d, "events"))
    counts = ingest.counts_by_window(stream, "ts", ["event_type"], "1 hour", "3650 days")
    return ingest.totals(counts, f"{where}/out", f"{where}/checkpoint").select(F.col("desde").cast("timestamp_ntz").alias("desde"), "event_type", "n")
