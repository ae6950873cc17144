"""Stored pages as a source, and the composed scan: filters, limits, loads, restarts, endings."""

import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, StringContains

from gleaner.sources import archive, scan
from gleaner.streaming import ingest

DAY = datetime.date(2026, 1, 1)
AS_OF = datetime.date(2026, 3, 1)


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(f"s/{k % 3}", DAY + datetime.timedelta(k % 5), k, f"u{k}", f"<p>{k}</p>") for k in range(60)] + [(None, None, 99, "u99", None)]
    pages = spark.createDataFrame(rows, "f string, d date, pos long, url string, html string")
    for load in (0, 1):
        archive.store_pages(pages.filter(F.col("pos") % 2 == load), str(tmp_path / "a"), load, F.col("f"), F.col("d"), F.col("pos"))
    return str(tmp_path / "a")


def test_filters_choose_files(spark, folder):
    reader = archive.PageReader({"path": folder})
    files = reader.chosen()
    assert len({(f.fuente, f.dia) for f in files}) == 16 and {f.carga for f in files} == {0, 1}
    left = list(reader.pushFilters([EqualTo(("fuente",), "s/1"), GreaterThanOrEqual(("dia",), DAY + datetime.timedelta(3)), IsNotNull(("dia",)), StringContains(("url",), "u")]))
    assert [type(f) for f in left] == [IsNotNull, StringContains]
    assert {(f.fuente, f.dia.day) for f in reader.chosen()} == {("s/1", 4), ("s/1", 5)} and len(reader.chosen()) < len(files) / 5
    inside = archive.PageReader({"path": folder})
    list(inside.pushFilters([In(("fuente",), ("s/0", "s/2"))]))
    assert {f.fuente for f in inside.chosen()} == {"s/0", "s/2"}
    got = archive.read_pages(spark, folder).filter((F.col("fuente") == "s/1") & (F.col("dia") >= "2026-01-04") & F.col("url").contains("3"))
    assert sorted(r.url for r in got.collect()) == sorted(f"u{k}" for k in range(60) if k % 3 == 1 and k % 5 >= 3 and "3" in str(k))
    everything = archive.read_pages(spark, folder)
    assert everything.count() == 61 and everything.filter("fuente is null").first().url == "u99"


def test_a_limit_reads_the_newest_of_each_source(spark, folder):
    got = {}
    for r in archive.read_pages(spark, folder, 5).collect():
        got.setdefault(r.fuente, []).append(r.pos)
    want = {f"s/{s}": sorted((k for k in range(60) if k % 3 == s), key=lambda k: (-(k % 5), k))[:5] for s in range(3)}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} | {None: [99]}
    opened = []
    system, _ = archive._system(folder)
    files = [f for f in archive._files(folder) if f.fuente == "s/0"]

    class Told:
        def open_input_file(self, path):
            opened.append(path)
            return system.open_input_file(path)

    assert sum(b.num_rows for b in archive._newest(Told(), files, 3)) == 3
    assert {p.split("dia=")[1][:10] for p in opened} == {"2026-01-05"}  # days behind the limit are not opened


def test_unfinished_loads_are_not_seen(spark, folder):
    os.remove(f"{folder}/carga=1/_SUCCESS")
    assert archive.read_pages(spark, folder).count() == 30
    stream = archive.PageStream({"path": folder})
    assert stream.latestOffset() == {"cargas": 1} and stream.initialOffset() == {"cargas": 0}
    os.rename(f"{folder}/carga=0", f"{folder}/carga=7")
    assert stream.latestOffset() == {"cargas": 0}  # loads come in order
    empty = archive.read_pages(spark, folder + "-none")
    assert empty.count() == 0


def test_a_restarted_stream_reads_nothing_twice(spark, folder, tmp_path):
    out, check = str(tmp_path / "o"), str(tmp_path / "c")
    run = lambda: ingest.drain(archive.stream_pages(spark, folder).select("url"), out, check).count()
    assert run() == 61 and run() == 61
    more = spark.createDataFrame([("s/9", DAY, 1, "u100", "x")], "f string, d date, pos long, url string, html string")
    archive.store_pages(more, folder, 2, F.col("f"), F.col("d"), F.col("pos"))
    assert run() == 62 and spark.read.parquet(out).distinct().count() == 62


def page(kind, k):
    old = "2025-12-01" if kind == "antigua" else "2026-02-20"
    end = "2026-02-25" if kind == "cerrada" else "2026-03-09"
    title = "" if kind == "sin_titulo" else f"Aviso {k}"
    return "<p>nada</p>" if kind == "ilegible" else f'<script type="application/ld+json">{{"@type": "JobPosting", "title": "{title}", "datePosted": "{old}", "validThrough": "{end}"}}</script>'


def plain_scan(kinds, limit, by_id):
    """What a scan gives, by going through the addresses one by one."""
    out, given, run, over = [], 0, 0, False
    for kind in kinds:
        if over or given >= limit:
            out.append("sin_revisar")
            continue
        out.append("ilegible" if kind == "sin_titulo" else kind)
        if kind == "antigua":
            run += 1
            over = by_id and run >= 40
        elif kind in ("cerrada", "entregada", "sin_titulo"):
            run = 0
        given += kind == "entregada"
    return out


@pytest.mark.parametrize("stretch", [7, 100_000])
def test_scans_end_as_one_by_one(spark, stretch):
    import random

    r = random.Random(11)
    kinds = ["entregada", "antigua", "cerrada", "ilegible", "sin_titulo", "vista", "sin_leer"]
    sources = {
        "limit": (5, True, ["antigua"] * 39 + ["vista", "ilegible", "cerrada"] + ["antigua"] * 30 + ["entregada"] * 9), "stale": (50, True, ["entregada"] * 2 + ["antigua"] * 20 + ["vista", "sin_leer", "ilegible"] * 5 + ["antigua"] * 25 + ["entregada"] * 3),
        "unordered": (50, False, ["antigua"] * 60 + ["entregada"]), "none": (0, True, ["entregada"] * 0), "all_old": (30, True, ["antigua"] * 41), "few": (3, False, ["entregada", "vista"]),
        **{f"random{n}": (r.choice([3, 10, 40]), n % 2 == 0, r.choices(kinds, [r.choice([1, 9]), 30, 1, 3, 1, 3, 3], k=150)) for n in range(6)},
    }
    settings = spark.createDataFrame([(s, limit, None, by_id, None, None, None) for s, (limit, by_id, _) in sources.items()], scan.SETTINGS)
    rows = [(s, f"https://{s}/{k}", k + 1, kind) for s, (_, _, own) in sources.items() for k, kind in enumerate(own)]
    addresses = spark.createDataFrame([x[:3] for x in rows], "fuente string, url string, pos int")
    seen = spark.createDataFrame([(u,) for _, u, _, kind in rows if kind == "vista"] * 2 + [("other",)], "url string")
    pages = spark.createDataFrame([(u, page(kind, k)) for _, u, k, kind in rows if kind != "sin_leer"], "url string, html string")
    got = scan.scan(settings, addresses, seen, pages, F.lit(AS_OF), stretch=stretch)
    found = {}
    for x in got.orderBy("pos").collect():
        found.setdefault(x.fuente, []).append(x.resultado)
        assert (x.puesto is not None) == (x.resultado == "entregada")
    assert found == {s: plain_scan(own, limit, by_id) for s, (limit, by_id, own) in sources.items() if own}
    ends = {x.fuente: x.fin for x in scan.endings(settings, got).collect()}
    assert (ends["limit"], ends["stale"], ends["unordered"], ends["none"], ends["few"]) == ("limite", "racha", "agotada", "limite", "agotada")


def test_candidates_follow_the_settings(spark):
    settings = spark.createDataFrame([("id", 2, "/a-", True, False, None, None), ("date", 1, None, None, True, 10, None), ("again", 2, "never", True, None, None, None), ("off", 0, "", None, None, None, None)], scan.SETTINGS)
    day = lambda n: datetime.date(2026, 3, 1) - datetime.timedelta(n)
    found = [("id", f"https://x/a-{1000 + k}", k, day(500)) for k in range(20)] + [("id", "https://x/b-9999", 0, None), ("id", "https://x/a-1019", 99, None)]
    found += [("date", "old", 0, day(11)), ("date", "undated", 1, None), ("date", "new", 2, day(1)), ("date", "newer", 3, day(0)), ("again", "z-5555", 0, None), ("off", "q", 0, None), ("unknown", "q", 0, None)]
    fixed = spark.createDataFrame([("again", "r2", 2), ("again", "r1", 1), ("again", "r3", 3)], "fuente string, url string, place long")
    got = scan.candidates(settings, spark.createDataFrame(found, "fuente string, url string, place long, lastmod date"), fixed, F.lit(AS_OF))
    by = {}
    for r in got.orderBy("pos").collect():
        by.setdefault(r.fuente, []).append(r.url)
    assert by == {"id": [f"https://x/a-{1019 - k}" for k in range(8)], "date": ["newer", "new"], "again": ["r1", "r2"]}
