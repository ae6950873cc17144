"""Projections that a site shows: cards, slugs, structured data, sitemap, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.salary import salary_text
from ..functions.text import fold
from . import analytics, store
from .order import running
from .shared import kept

# Months of long dates.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "setiembre", "octubre", "noviembre", "diciembre")


def slug(title: Column, fingerprint: Column) -> Column:
    """Folded title with hyphens, at most 70 characters, and 8 of the fingerprint."""
    bare = F.btrim(F.regexp_replace(fold(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.btrim(F.substring(bare, 1, 70), F.lit("-")), F.lit("-"), F.substring(fingerprint, 1, 8))


def escape_html(text: Column) -> Column:
    """&, <, >, quotes as entities."""
    out = F.coalesce(text, F.lit(""))
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(c), F.lit(entity))
    return out


def _or(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default)).alias(name)


def web_projection(table: DataFrame, as_of: Column) -> DataFrame:
    """The columns of a card: defaults for missing ones, age and days left."""
    return table.select(
        "huella", "puesto", _or("empresa", "Empresa confidencial"), _or("ciudad", "Perú"), _or("departamento", ""), _or("modalidad", "Presencial"), _or("categoria", "Otros"),
        "sueldo_min", F.coalesce(F.nullif("sueldo_max", F.lit(0)), "sueldo_min").alias("sueldo_max"), "moneda",
        salary_text(F.col("sueldo_min"), F.col("sueldo_max"), F.col("moneda")).alias("sueldo"),
        "resumen", "funciones", "requisitos", "beneficios", "score", "fuente", "url",
        F.greatest(F.datediff(as_of, "publicado"), F.lit(0)).alias("dias"), F.datediff("vence", as_of).alias("restan"),
    )


def long_date(day: Column) -> Column:
    """'3 de setiembre de 2026' (X9)."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(day).cast("string"))


def completeness(table: DataFrame) -> DataFrame:
    """huella and the marks of what a posting tells."""
    has = lambda c: F.size(c) > 0
    marks = F.array_compact(F.array(F.when(F.col("sueldo_min") > 0, "sueldo"), F.when(has("funciones"), "funciones"), F.when(has("requisitos"), "requisitos"), F.when(has("beneficios"), "beneficios"), F.when(F.col("vence").isNotNull(), "plazo")))
    return table.select("huella", marks.alias("marcas"))


def job_posting(table: DataFrame) -> DataFrame:
    """huella and a JobPosting document; absent parts are left out."""
    place = lambda kind, **parts: F.struct(F.lit(kind).alias("@type"), *(v.alias(k) for k, v in parts.items()))
    known = lambda c: F.nullif(F.col(c), F.lit(""))
    paragraphs = F.concat(F.lit("<p>"), escape_html(F.col("resumen")), F.lit("</p><ul>"), F.array_join(F.transform("funciones", lambda x: F.concat(F.lit("<li>"), escape_html(x), F.lit("</li>"))), ""), F.lit("</ul>"))
    value = place("QuantitativeValue", minValue=F.col("sueldo_min"), maxValue=F.coalesce(F.nullif("sueldo_max", F.lit(0)), "sueldo_min"), unitText=F.lit("MONTH"))
    document = F.struct(
        F.lit("https://schema.org/").alias("@context"), F.lit("JobPosting").alias("@type"), F.col("puesto").alias("title"), paragraphs.alias("description"),
        place("PropertyValue", name=F.col("fuente"), value=F.col("huella")).alias("identifier"),
        place("Organization", name=F.coalesce(known("empresa"), F.lit("Confidencial"))).alias("hiringOrganization"),
        place("Place", address=place("PostalAddress", addressLocality=F.coalesce(known("ciudad"), F.lit("Lima")), addressRegion=known("departamento"), addressCountry=F.lit("PE"))).alias("jobLocation"),
        F.lit("FULL_TIME").alias("employmentType"), F.date_format("publicado", "yyyy-MM-dd").alias("datePosted"), F.date_format("vence", "yyyy-MM-dd").alias("validThrough"),
        F.when(F.col("modalidad") == "Remoto", "TELECOMMUTE").alias("jobLocationType"),
        F.when(F.col("sueldo_min") > 0, place("MonetaryAmount", currency=F.col("moneda"), value=value)).alias("baseSalary"),
    )
    return table.select("huella", F.to_json(document).alias("documento"))


def sitemap_entries(table: DataFrame, site: str) -> DataFrame:
    """One url element for each posting; a sink joins them, in parts of a sitemap's limit."""
    loc = F.concat(F.lit(site), F.lit("/oferta/"), slug(F.col("puesto"), F.col("huella")), F.lit("/"))
    return table.select(F.concat(F.lit("<url><loc>"), escape_html(loc), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format("publicado", "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>")).alias("entry"))


def stale_pages(published: DataFrame, current: DataFrame, key: str = "slug") -> DataFrame:
    """Pages on the site that no current posting has."""
    return published.join(current.select(key), key, "left_anti")


def pages_changed(changes: DataFrame) -> DataFrame:
    """slug, accion of the pages that differ between two versions of a table (W2): 'escribir' or 'quitar'.

    Only approved live postings have pages; a posting's page is named by its title and fingerprint."""
    shown = lambda side: F.when(F.col(side).isNotNull() & F.col(f"{side}.aprobada") & F.col(f"{side}.vigente"), slug(F.col(f"{side}.puesto"), F.col(f"{side}.huella")))
    both = changes.select(shown("antes").alias("a"), shown("despues").alias("b"))
    gone, new = F.when(F.col("a").isNotNull() & ~F.col("a").eqNullSafe(F.col("b")), F.struct(F.col("a").alias("slug"), F.lit("quitar").alias("accion"))), F.when(F.col("b").isNotNull(), F.struct(F.col("b").alias("slug"), F.lit("escribir").alias("accion")))
    return both.select(F.explode(F.array_compact(F.array(gone, new))).alias("x")).select("x.*")


#: Entries of a sitemap, and maps of an index, at most.
MOST_ENTRIES = 50_000
_SPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def _write_maps(entries: DataFrame, folder: str, name: str, tag: str, most: int) -> DataFrame:
    """Writes distinct entries (entry, lastmod) in order into files of at most ``most``; gives file, n, lastmod.

    Entries are placed by ranges: no task has more of them in order than a range or a file."""
    spark = entries.sparkSession
    placed = running(entries.groupBy("entry").agg(F.max("lastmod").alias("lastmod")), ["entry"], F.lit(1).cast("long"), "at")
    placed = placed.select(F.floor(F.col("at") / most).alias("file"), (F.col("at") % most).alias("pos"), "entry", "lastmod")
    files = kept(placed.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("lastmod").alias("lastmod")))
    frame = lambda pos, text: files.select("file", F.lit(pos).cast("long").alias("pos"), F.lit(text).alias("entry"))
    lines = placed.select("file", "pos", "entry").unionByName(frame(-1, f'<?xml version="1.0" encoding="UTF-8"?>\n<{tag} {_SPACE}>')).unionByName(frame(most, f"</{tag}>"))
    drafts = f"{folder}/.{name}"
    lines.repartition("file").sortWithinPartitions("file", "pos").select("file", "entry").write.mode("overwrite").partitionBy("file").text(drafts)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for x in fs.globStatus(path(f"{drafts}/file=*/part-*")) or ():  # a name for each file of ``most`` entries
        at = x.getPath()
        to = path(f"{folder}/{name}-{at.getParent().getName().split('=')[1]}.xml")
        fs.delete(to, False)
        fs.rename(at, to)
    fs.delete(path(drafts), True)
    return files


def write_sitemap(entries: DataFrame, folder: str, site: str, most: int = MOST_ENTRIES) -> DataFrame:
    """Writes sitemap-0.xml, ... with the entries (sitemap_entries), in order and each once, and index-0.xml, ... over them (X8). Gives file, n, lastmod."""
    day = F.nullif(F.regexp_extract("entry", r"<lastmod>([^<]*)</lastmod>", 1), F.lit(""))
    files = _write_maps(entries.select("entry", day.alias("lastmod")), folder, "sitemap", "urlset", most)
    loc = F.concat(F.lit(f"<sitemap><loc>{site}/sitemap-"), F.col("file").cast("string"), F.lit(".xml</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), "lastmod", F.lit("</lastmod>")), F.lit("")), F.lit("</sitemap>"))
    _write_maps(files.select(loc.alias("entry"), "lastmod"), folder, "index", "sitemapindex", most)
    return files


def export_payload(table: DataFrame, as_of: Column, limit: int = 500) -> DataFrame:
    """The document of a site in one row: day, number, statistics and the best ``limit`` postings that retention keeps."""
    swept = store.sweep(table, as_of)
    best = web_projection(store.live(swept, limit), as_of)
    order = F.struct("dias", (-F.col("score")).alias("low"), "huella")
    offers = best.agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*best.columns).alias("x")))), lambda e: e["x"]).alias("ofertas"))  # at most ``limit`` rows
    both = offers.withColumn("k", F.lit(1)).join(analytics.overview(swept).select(F.struct("*").alias("stats"), F.lit(1).alias("k")), "k")
    return both.select(F.to_json(F.struct(as_of.alias("generado"), F.size("ofertas").alias("total"), "stats", "ofertas")).alias("documento"))


def export_json(table: DataFrame, folder: str, as_of: Column) -> None:
    """Writes the document as text, one file."""
    export_payload(table, as_of).write.text(folder)


def site(table: DataFrame, published: DataFrame, as_of: Column, address: str, limit: int = 1000) -> dict[str, DataFrame]:
    """What a build of the site writes (W2): the export, a page for each of the best postings that retention keeps after
    their titles are cleaned and reviewed, their sitemap, and the published pages to take down.

    published: slug of the pages that are there."""
    kept = store.review_titles(store.clean_titles(store.sweep(table, as_of)).drop("cambio")).drop("titulo")
    best = store.live(kept, limit)
    pages = best.select("huella", slug(F.col("puesto"), F.col("huella")).alias("slug")).join(job_posting(best), "huella").select("slug", "documento")
    return {"export": export_payload(kept, as_of), "pages": pages, "sitemap": sitemap_entries(best, address), "gone": stale_pages(published, pages)}


def site_robots(site: str, leaving: str = "salida") -> str:
    """The robots text of a site: all is open but the pages that lead away, and where the sitemap is."""
    return f"User-agent: *\nAllow: /\nDisallow: /{leaving}/\n\nSitemap: {site}/sitemap.xml\n"
