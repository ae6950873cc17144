"""Queries of retention as time passes, permission by an index of patterns, filters before shuffles, and sitemap files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import publish, store
from ..operators.shared import scratch
from ..sources import crawl, schedule
from ..streaming import ingest, retention
from .queries import AS_OF, as_of, register, table

# Customers as postings: published over 200 days up to a month before AS_OF, two thirds with a deadline, one of two profiles.
_PUBLISHED, _DEADLINE = "date '1998-01-01' + cast(c_custkey % 200 as int)", "case when c_custkey % 3 > 0 then date '1998-01-01' + cast(c_custkey % 200 + c_custkey % 47 as int) end"
_PROFILE = "case when c_custkey % 2 = 0 then 'publico' else 'privado' end"


def _spark_sql(duck: str) -> str:
    return duck.replace("date '1998-01-01' + ", "date_add(date '1998-01-01', ").replace(" as int)", " as int))")


@register("retention_stream", f"""with p as (select c_custkey as clave, {_PUBLISHED} as p, {_DEADLINE} as v, {_PROFILE} as f from customer),
d as (select clave, v + 1 as a, case when v is null then p + case when f = 'publico' then 22 else 46 end end as b, p + 61 as c from p), m as (select *, least(a, b, c) as dia from d)
select cast(clave as varchar) as clave, cast(dia as date) as retirada, case when a = dia then 'plazo_vencido' when b = dia then 'sin_plazo' else 'antiguedad' end as motivo from m where dia <= date '{AS_OF}'""")
def retention_stream(spark, d):
    """Postings as a stream in the order they were seen: those whose timers have run out by AS_OF, and why."""
    where, c = scratch(spark), table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("huella"), F.expr(_spark_sql(_PUBLISHED)).alias("publicado"), F.expr(_spark_sql(_DEADLINE)).alias("vence"), F.expr(_PROFILE).alias("perfil"))
    rows = rows.withColumn("visto", F.to_timestamp("publicado"))
    clock = spark.range(1).select(F.lit("reloj").alias("huella"), F.lit(None).cast("date").alias("publicado"), F.lit(None).cast("date").alias("vence"), F.lit("").alias("perfil"), F.to_timestamp(F.lit(f"{AS_OF} 00:00:01")).alias("visto"))
    groups = max(64, c.count() // 1000)
    for low, high in ((0, 70), (70, 140), (140, 200)):  # one after the other, as they would come in: each is one batch, in files of all tasks
        part = rows.filter(F.datediff("publicado", F.lit("1998-01-01").cast("date")).between(low, high - 1))
        (part if high < 200 else part.unionByName(clock)).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{where}/in")
        out = ingest.drain(retention.retired(stream, "huella", "visto", "0 seconds", groups), f"{where}/out", f"{where}/checkpoint")
    return out.select("clave", F.to_date("retirada").alias("retirada"), "motivo")


# Five hosts with hundreds of rules of all shapes, told by part keys.
_RULE = "case p_partkey % 6 when 0 then concat('/p/', p_partkey % 97) when 1 then concat('/p/', p_partkey % 89, '$') when 2 then concat('/p/', p_partkey % 53, '/*/x') when 3 then concat('/*', p_partkey % 31, '$') when 4 then concat('/p/', p_partkey % 11, '*', p_partkey % 7) else concat('/q', p_partkey % 13, '?a=*') end"
_PATH = "concat(case o_orderkey % 5 when 0 then concat('/p/', o_orderkey % 101) when 1 then concat('/p/', o_orderkey % 101, '/a/', case when o_orderkey % 2 = 0 then 'x' else 'y' end) when 2 then concat('/q', o_orderkey % 15, '?a=', o_orderkey % 9) when 3 then concat('/r/', o_orderkey % 67) else concat('/p/', o_orderkey % 23, o_orderkey % 10) end)"


@register("robots_many_rules", f"""with r as (select distinct p_size % 5 as h, {_RULE} as pattern, p_partkey % 4 = 0 as ok from part), q as (select *, concat('^', replace(regexp_replace(regexp_replace(pattern, '[$]$', ''), '([.?])', '\\\\\\1', 'g'), '*', '.*'), case when pattern like '%$' then '$' else '' end) as re from r),
u as (select o_orderkey, o_custkey % 6 as h, {_PATH} as path from orders)
select o_orderkey, coalesce(arg_max(ok, length(pattern) * 10 + cast(ok as int)), true) as permitted from u left join q on u.h = q.h and regexp_matches(path, re) group by 1""")
def robots_many_rules(spark, d):
    """Paths under hundreds of rules a host, found by their literal beginnings."""
    rules = table(spark, d, "part").select(F.expr("p_size % 5").alias("host"), F.expr(_RULE).alias("pattern"), F.expr("p_partkey % 4 = 0").alias("allowed"))
    rules = rules.withColumn("regex", crawl.pattern_regex(F.col("pattern")))
    urls = table(spark, d, "orders").select("o_orderkey", F.expr("o_custkey % 6").alias("host"), F.expr(_PATH).alias("path"))
    return crawl.allowed(urls, rules, "o_orderkey").select("o_orderkey", "permitted")


_NOW = "2024-01-20"
_READ_LATELY = f"case when event_type = 'purchase' then epoch(timestamp '{_NOW}' - ts) / 86400.0 < 7 else epoch(timestamp '{_NOW}' - ts) / 86400.0 < 30 end and event_id % 5 = 0"


@register("unread_urls", f"select c_custkey, cast(c_custkey as varchar) as url from customer where cast(c_custkey as varchar) not in (select cast(user_id as varchar) from events where {_READ_LATELY})")
def unread_urls(spark, d):
    """URLs that were not read lately, most of them told by the filter."""
    e = table(spark, d, "events").filter("event_id % 5 = 0").select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("visto_ultima_vez"), (F.col("event_type") == "purchase").alias("aprobada"))
    urls = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("url"))
    return store.unread(urls, e, F.lit(f"{_NOW} 00:00:00").cast("timestamp_ntz"))


@register("skip_set_lately", f"select distinct cast(user_id as varchar) as url from events where {_READ_LATELY}")
def skip_set_lately(spark, d):
    e = table(spark, d, "events").filter("event_id % 5 = 0").select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("visto_ultima_vez"), (F.col("event_type") == "purchase").alias("aprobada"))
    return store.skip_set(e, F.lit(f"{_NOW} 00:00:00").cast("timestamp_ntz"))


@register("stale_pages_found", "select distinct concat('aviso-', o_orderkey % 900) as slug from orders where o_orderkey % 900 not in (select o_orderkey % 900 from orders where o_orderkey % 7 = 0 and o_orderkey % 900 < 500)")
def stale_pages_found(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("aviso-"), F.col("o_orderkey") % 900).alias("slug"))
    return publish.stale_pages(o.select("slug").distinct(), o.filter("o_orderkey % 7 = 0 and o_orderkey % 900 < 500"))


@register("sitemap_sink", """with e as (select distinct concat('https://x.pe/oferta/', lpad(cast(o_custkey as varchar), 9, '0'), '/') as loc, max(cast(o_orderdate as date)) over (partition by o_custkey) as day from orders),
n as (select *, row_number() over (order by loc) - 1 as k from e)
select cast(k // 400 as bigint) as file, count(*) as n, min(loc) as first, max(loc) as last, max(day) as lastmod, concat('https://x.pe/sitemap-', k // 400, '.xml') as in_index from n group by k // 400""")
def sitemap_sink(spark, d):
    """Sitemap files of at most 400 entries and the index over them, written and read again."""
    where = scratch(spark)
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.max("o_orderdate")).alias("day"))
    loc = F.concat(F.lit("https://x.pe/oferta/"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("/"))
    entry = F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><lastmod>"), F.date_format("day", "yyyy-MM-dd"), F.lit("</lastmod></url>"))
    publish.write_sitemap(o.select(entry.alias("entry")), where, "https://x.pe", 400)
    files = lambda name: spark.read.format("binaryFile").load(f"{where}/{name}-*.xml").select(F.regexp_extract("path", name + r"-(\d+)\.xml$", 1).cast("long").alias("file"), "content")
    found = crawl.sitemap_urls(crawl.sitemap_text(files("sitemap"))).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("loc").alias("first"), F.max("loc").alias("last"), F.max("lastmod").alias("lastmod"))
    index = crawl.sitemap_urls(crawl.sitemap_text(files("index"))).filter("is_map").select(F.col("loc").alias("in_index"), F.regexp_extract("loc", r"(\d+)\.xml$", 1).cast("long").alias("file"))
    return found.join(index, "file")


# Orders as addresses of hosts, a third of them of one host; delays of most hosts.
_HOST = "case when o_orderkey % 3 = 0 then 'h0' else concat('h', o_custkey % 60) end"


@register("fetch_schedule", f"""with u as (select {_HOST} as host, concat('/', o_orderkey) as url, o_orderkey % 100 as pos from orders),
h as (select host, count(*) as n from u group by host), d as (select host, n, greatest(case when cast(substr(host, 2) as int) % 4 = 0 then 0 else (cast(substr(host, 2) as int) % 7) * 0.5 end, 2.0, 1.0) as wait from h),
b as (select *, sum(n) over (order by wait, host) - n as before, sum(n) over () as total from d), f as (select *, cast(floor(before * 6 / total::double) as int) as fetcher from b),
p as (select *, row_number() over (partition by fetcher order by wait, host) - 1 as place, greatest(max(wait) over (partition by fetcher), count(*) over (partition by fetcher)) as round from f),
r as (select *, row_number() over (partition by host order by pos, url) - 1 as ronda from u)
select r.host, url, fetcher, cast(ronda as bigint) as ronda, cast(ronda * round + place * 1.0 as double) as inicio from r join p using (host)""")
def fetch_schedule(spark, d):
    """Six fetchers over sixty hosts, one of which has a third of all addresses."""
    u = table(spark, d, "orders").select(F.expr(_HOST).alias("host"), F.expr("concat('/', o_orderkey)").alias("url"), F.expr("o_orderkey % 100").alias("pos"))
    hosts = spark.range(60).select(F.concat(F.lit("h"), "id").alias("host"), F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 7 * 0.5).alias("delay"))
    return schedule.fetch_schedule(u.unionByName(u.withColumn("pos", F.col("pos") + 500)), hosts, 6)
