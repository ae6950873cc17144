"""Operators of the main library against plain versions on random rows."""

import datetime
import html
import random
import statistics
import urllib.parse

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import analytics, publish, store
from gleaner.plans import postings
from gleaner.sources import crawl, documents, pages


def test_upper_median_equals_sorting(spark):
    r = random.Random(1)
    rows = [(g, round(r.lognormvariate(0, 3), 3)) for g in "abc" for _ in range({"a": 4000, "b": 2, "c": 501}[g])] + [("d", None), (None, 5.0), (None, 7.0)] + [("e", 1.0)] * 999 + [("e", 2.0)] * 3
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {x.g: x.mediana for x in analytics.upper_median(df, "v", "g", accuracy=100).collect()}
    want = {g: sorted(v for h, v in rows if h == g and v is not None) for g in (*"abce", None)}
    assert got == {g: v[len(v) // 2] for g, v in want.items()}
    assert got["a"] == statistics.median_high(want["a"])
    everything = sorted(v for _, v in rows if v is not None)
    assert analytics.upper_median(df, "v").first().mediana == everything[len(everything) // 2]


def test_stale_runs_over_stretches(spark):
    r = random.Random(2)
    for stretch in (1, 7, 50, 1000):
        rows = [(h, k, r.random() < p) for h, p in (("a", 0.7), ("b", 0.95), ("c", 0.3), ("d", 1.0)) for k in sorted(r.sample(range(300), 120))]
        want = set()
        for h in "abcd":
            run = 0
            for _, k, old in (x for x in rows if x[0] == h):
                want.add((h, k))
                run = run + 1 if old else 0
                if run == 9:
                    break
        df = spark.createDataFrame(rows, "fuente string, k long, old boolean").repartition(3)
        got = crawl.until_stale(df, "k", F.col("old"), 9, stretch=stretch)
        assert {(x.fuente, x.k) for x in got.collect()} == want and got.columns == df.columns


@pytest.mark.parametrize("base", ["https://x.pe/a/b/c.html", "https://x.pe/a/b/", "https://x.pe", "http://x.pe/a?q=1#z"])
def test_links_resolve_as_urljoin(spark, base):
    hrefs = ["", "x.pdf", "./x.pdf", "../x.pdf", "../../../x.pdf", "/x/../y.pdf", "/x/./y.pdf?a=../b", "//h.pe/x.pdf", "https://o.pe/z/../x.pdf", "?q=2", "x/y/../z.pdf#f", "..", "."]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", pages.resolve(F.lit(base), F.col("h")).alias("u"))
    assert {r.h: r.u for r in df.collect()} == {h: urllib.parse.urljoin(base, h) for h in hrefs}


def test_entities_equal_the_standard_library(spark):
    texts = ["&amp;lt; &eacute;&Eacute &notit; &#233;&#xe9;&#XE9 &#128;&#x9f;&#129; &#0; &#xD800; &#1114112; &#99999999999999999999999; &#1; &#xFFFE; &#13; &bogus; &; & a &ampx &hearts;", "", "plain", "&CounterClockwiseContourIntegral;&ngE;", "a&nbsp;b&#10;c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.unescape(F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == {t: html.unescape(t) for t in texts}


def test_folding_keeps_to_the_decomposition(spark):
    texts = ["ÁÉÍÓÚÜÑ áéíóúüñ çÇ åÅ ŵẃ ǭ ḥ ё й", "éä", "ø ł đ", "한글 ー ﬁ", None, ""]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.fold(F.col("t")).alias("f")).collect()]
    import unicodedata

    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()
    assert got[:3] == [bare(t) for t in texts[:3]] and got[4:] == ["", ""]


def test_upsert_overwrites_all_but_first_capture(spark):
    now, day = datetime.datetime(2026, 1, 12), datetime.datetime(2026, 1, 1)
    target = spark.createDataFrame([("a", "x", 1, day, day, False), ("b", "y", 2, day, day, True)], "k string, t string, n int, capturado timestamp, visto_ultima_vez timestamp, vigente boolean")
    batch = spark.createDataFrame([("a", None, 1), ("a", "newer", 2), ("a", "old", 0), ("c", "z", None)], "k string, t string, at int")
    got = {r.k: r.asDict() for r in store.upsert(target, batch, "k", F.lit(now), ("at",)).collect()}
    assert got["a"] == {"k": "a", "t": "newer", "n": None, "capturado": day, "visto_ultima_vez": now, "vigente": True, "at": 2}
    assert got["b"]["t"] == "y" and got["b"]["vigente"] and got["c"]["capturado"] == now and len(got) == 3


def test_first_of_each_key_keeps_all_columns(spark):
    rows = [("a", 2, "x", {"p": 1}), ("a", 1, "y", {"p": 2}), ("b", None, "z", None), ("b", 0, "w", None), (None, 1, "q", None)]
    df = spark.createDataFrame(rows, "k string, n int, t string, m map<string,int>")
    got = {r.k: (r.t, r.n_copies) for r in postings.dedupe_run(df, "k", "n", "t").collect()}
    assert got == {"a": ("y", 2), "b": ("z", 2), None: ("q", 1)}
    assert {r.k: r.t for r in store.newest(df.drop("m"), "k", ("n",)).collect()} == {"a": "x", "b": "w", None: "q"}


def test_damaged_sitemaps_are_null(spark):
    import gzip

    good = gzip.compress(b"<urlset><url><loc>https://x.pe/a</loc></url></urlset>")
    files = [(1, good), (2, good[:20]), (3, b"<url><loc>u</loc></url>"), (4, None), (5, b"\x1f\x8bnothing"), (6, good + good), (7, b"")]
    got = {r.id: r.xml for r in crawl.sitemap_text(spark.createDataFrame(files, "id long, content binary")).collect()}
    assert sorted(k for k, v in got.items() if v is None) == [2, 4, 5] and "a</loc>" in got[1] and got[6].count("a</loc>") == 2 and got[7] == ""


def test_sitemaps_of_any_size_give_all_urls(spark):
    import gzip

    n = 500_000
    xml = "<urlset>" + "".join(f"<url>\n<loc>https://x.pe/aviso/ñandú/{k:09d}</loc><lastmod>2026-01-{k % 28 + 1:02d}</lastmod></url>\n" for k in range(n)) + "</urlset>"
    assert len(xml.encode()) > 40 << 20
    bare = "".join(f"<loc>https://x.pe/{k}</loc>\n" for k in range(2000))
    files = [(1, gzip.compress(xml.encode(), 1)), (2, bare.encode()), (3, gzip.compress(xml.encode(), 1)[:-9])]
    table = spark.createDataFrame(files, "id long, content binary")
    urls = crawl.sitemap_urls(crawl.sitemap_text(table, size=1 << 20))
    got = urls.filter("id = 1").agg(F.count("loc"), F.countDistinct("loc"), F.min("lastmod").cast("string"), F.max("pos") > n).first()
    assert tuple(got) == (n, n, "2026-01-01", True)
    inorder = urls.filter("id = 1").orderBy("pos").select(F.substring_index("loc", "/", -1).cast("long").alias("k")).limit(60_000).agg(F.max("k"), F.countDistinct("k")).first()
    assert tuple(inorder) == (59_999, 60_000)
    small = crawl.sitemap_urls(crawl.sitemap_text(table.filter("id > 1"), size=500))
    assert [r.loc for r in small.orderBy("pos").collect()] == [f"https://x.pe/{k}" for k in range(2000)]


def test_discovery_follows_any_depth(spark):
    maps = [(f"m{k}", f"<sitemapindex><sitemap><loc>m{k + 1}</loc></sitemap><sitemap><loc>m{max(k - 1, 0)}</loc></sitemap></sitemapindex>") for k in range(10)]
    maps.append(("m10", "<urlset><url><loc>https://x.pe/1234</loc></url></urlset>"))
    roots = spark.createDataFrame([("s", "m0", 0), ("t", "m9", 0)], "fuente string, map_url string, pos int")
    got = crawl.discover(spark.createDataFrame(maps, "map_url string, xml string"), roots, 5).collect()
    assert {(r.fuente, r.url, r["rank"]) for r in got} == {("s", "https://x.pe/1234", 1), ("t", "https://x.pe/1234", 1)}


def test_discovery_stops_and_orders_by_date(spark):
    one = lambda urls: "<urlset>" + "".join(f"<url><loc>{u}</loc>{f'<lastmod>{d}</lastmod>' if d else ''}</url>" for u, d in urls) + "</urlset>"
    index = lambda maps: "<sitemapindex>" + "".join(f"<sitemap><loc>{m}</loc></sitemap>" for m in maps) + "</sitemapindex>"
    maps = [
        ("r", index(["r", "a", "b", "c", "a"])), ("a", one([(f"a{k}", f"2026-01-{k:02d}") for k in range(1, 5)])), ("b", index(["deep", "a"])), ("c", one([("c1", None), ("c2", "2025-01-01"), ("c3", "2026-01-09")])),
        ("deep", one([("d1", "2026-01-20")])),
    ]
    roots = spark.createDataFrame([("s", "r", 0), ("t", "deep", 0)], "fuente string, map_url string, pos int")
    table = spark.createDataFrame(maps, "map_url string, xml string")
    day = F.lit("2026-01-25").cast("date")
    rank = lambda df: {(r.fuente, r["rank"]): r.url for r in df.collect()}
    got = rank(crawl.discover(table, roots, 3, as_of=day))
    assert got == {("s", 1): "d1", ("s", 2): "c3", ("s", 3): "a4", ("t", 1): "d1"}
    assert rank(crawl.discover(table, roots, 2, as_of=day)) == {("s", 1): "c3", ("s", 2): "a4", ("t", 1): "d1"}  # six URLs are enough: the deep map is not read
    assert rank(crawl.discover(table, roots, 2, pattern="^c")) == {("s", 1): "c1", ("s", 2): "c2"}


def test_reasons_tell_the_first_of_several(spark):
    page = "<a href='/bases.pdf'>bases</a><a href='/perfil.pdf'>perfil</a><a href='/otro.pdf'>x</a>"
    posts = spark.createDataFrame([("https://x.pe/1", page, None), ("https://x.pe/2", None, ["a", "b", "c"])], "url string, descripcion_html string, funciones array<string>")
    files = spark.createDataFrame([("https://x.pe/bases.pdf", None, "corto", None), ("https://x.pe/perfil.pdf", "HTTP 403", None, None), ("https://x.pe/otro.pdf", "No se pudo leer robots.txt", None, None)], "url string, error string, text string, ocr_text string")
    none = spark.createDataFrame([], "url string, html string")
    got = {r.url: (r.por_que_no, r.funciones) for r in documents.enrich(posts, files, none).collect()}
    assert got == {"https://x.pe/1": ("sin_permiso", None), "https://x.pe/2": (None, ["a", "b", "c"])}  # the third link is not opened
    unread = documents.enrich(posts, files.filter("false"), none).filter("url like '%1'").first()
    assert unread.por_que_no == "sin_respuesta" and unread.descripcion_html == page


def test_export_of_an_empty_table(spark, tmp_path):
    columns = "huella string, puesto string, empresa string, ciudad string, departamento string, modalidad string, categoria string, sueldo_min int, sueldo_max int, moneda string, resumen string, funciones array<string>, requisitos array<string>, beneficios array<string>, score int, fuente string, url string, publicado date, vence date, aprobada boolean, vigente boolean, perfil string, motivos_rechazo array<string>"
    publish.export_json(spark.createDataFrame([], columns), str(tmp_path / "x"), F.lit("2026-01-01").cast("date"))
    assert spark.read.text(str(tmp_path / "x")).first().value.startswith('{"generado":"2026-01-01","total":0,"stats":{"total":0,"vigentes":0')
    assert publish.site_robots("https://x.pe").splitlines()[2] == "Disallow: /salida/"
