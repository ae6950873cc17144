"""Permission by an index of patterns, filters before shuffles, retention by timers, sitemap files, pages that change."""

import datetime
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.operators import filters, order, publish, store
from gleaner.sources import crawl, schedule
from gleaner.streaming import ingest, retention


def plain_permission(path, rules):
    best = (-1, True)
    for pattern, ok in rules:
        body = pattern[:-1] if pattern.endswith("$") else pattern
        regex = "^" + ".*".join(map(re.escape, body.split("*"))) + ("$" if pattern.endswith("$") else "")
        if re.match(regex, path):
            best = max(best, (len(pattern), ok))
    return best[1]


def test_permission_under_thousands_of_rules(spark):
    r = random.Random(2)
    word = lambda: r.choice(["a", "b", "jobs", "x1", "?q=", ".", "%", "$c", "é"])
    rules = [("/" + "/".join(word() for _ in range(r.randint(1, 4))) + r.choice(["", "", "$", "*", "*/x", "*$"]), r.random() < 0.5) for _ in range(3000)]
    rules += [("/*", False), ("*.pdf$", True), ("/", True), ("/b$", False)]
    paths = ["/" + "/".join(word() for _ in range(r.randint(1, 5))) + r.choice(["", "/x", ".pdf"]) for _ in range(400)] + ["", "/", "/b", "/b/"]
    table = spark.createDataFrame([("h", p, ok) for p, ok in rules] + [("g", "/a", False)], "host string, pattern string, allowed boolean").withColumn("regex", crawl.pattern_regex(F.col("pattern")))
    urls = spark.createDataFrame([(k, "h", p) for k, p in enumerate(paths)] + [(1000, "g", "/b"), (1001, "g", "/ab"), (1002, "none", "/a"), (1003, None, None)], "k int, host string, path string")
    got = {x.k: x.permitted for x in crawl.allowed(urls, table, "k").collect()}
    from urllib.parse import unquote

    assert got == {k: plain_permission(unquote(p) or "/", rules) for k, p in enumerate(paths)} | {1000: True, 1001: False, 1002: True, 1003: True}
    # what is verified by an expression is a small part of paths times rules
    assert spark.createDataFrame([("/a*b",), ("/a$",), ("/a$b",), ("*",)], "p string").select(crawl.literal_prefix(F.col("p")).alias("x")).collect() == [("/a",), ("/a",), ("/a$b",), ("",)]


def test_filters_lose_no_key(spark):
    keys = spark.range(0, 40_000, 2).select(F.col("id").cast("string").alias("url"))
    found = filters.bloom(keys, "url", 20_000)
    asked = filters.marked(spark.range(40_000).select("id", F.col("id").cast("string").alias("url")), "url", found)
    assert asked.filter("id % 2 = 0 and not maybe").count() == 0
    assert asked.filter("id % 2 = 1 and maybe").count() < 20_000 * 0.02
    merged = filters.bloom(keys.repartition(7), "url", 20_000)[0]
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, found[0].collect()))


@pytest.mark.parametrize("most", [16_384, 0])
def test_not_in(spark, monkeypatch, most):
    monkeypatch.setattr(filters, "MOST_BLOCKS", most)
    df = spark.createDataFrame([(k, f"u{k}" if k % 10 else None) for k in range(1000)] * 2, "k int, url string")
    keys = spark.createDataFrame([(f"u{k}",) for k in range(0, 2000, 3)] + [(None,)], "url string")
    got = sorted(r.k for r in filters.not_in(df, "url", keys).collect())
    assert got == sorted([k for k in range(1000) if not k % 10 or k % 3] * 2)
    assert filters.not_in(df, "url", keys.filter("false")).count() == 2000


def test_absent_rows_pass_before_the_shuffle(spark):
    urls, keys = spark.range(10_000).select(F.concat(F.lit("u"), "id").alias("url")), spark.range(50).select(F.concat(F.lit("u"), "id").alias("url"))
    out = filters.not_in(urls, "url", keys)
    assert out.count() == 9950
    shuffled = filters.marked(urls, "url", filters.bloom(keys, "url", 50)).filter("maybe").count()
    assert shuffled < 200


def test_retirement_equals_the_sweep_of_every_day(spark):
    day = lambda n: datetime.date(2026, 1, 1) + datetime.timedelta(n)
    rows = [(f"{p}{v}{f}", day(p) if p is not None else None, day(v) if v is not None else None, f, True) for p in (None, 0, 7) for v in (None, -3, 5, 40, 90) for f in ("publico", "privado")]
    posts = spark.createDataFrame(rows, "huella string, publicado date, vence date, perfil string, vigente boolean")
    goes = {r.huella: (r.x.dia, r.x.motivo) if r.x else None for r in posts.select("huella", retention.retirement(F.col("publicado"), F.col("vence"), F.col("perfil")).alias("x")).collect()}
    first = {}
    for n in range(-5, 110):
        for r in store.sweep(posts, F.lit(day(n))).filter("not vigente").select("huella", "motivo_retiro").collect() if n in (-5, -2, -1, 5, 6, 21, 22, 28, 29, 41, 45, 46, 52, 53, 60, 61, 67, 68, 90, 91, 109) else ():
            first.setdefault(r.huella, (n, r.motivo_retiro))
    assert {k: v for k, v in goes.items() if v} .keys() == first.keys()
    for k, (n, why) in first.items():
        assert goes[k][0] <= day(n)
        if goes[k][0] == day(n):
            assert goes[k][1] == why


def test_timers_follow_the_last_version(spark, tmp_path):
    kinds = "huella string, publicado date, vence date, perfil string, visto timestamp"
    day = lambda n: datetime.date(2026, 1, n)
    at = lambda n: datetime.datetime(2026, 1, n)
    batches = [
        [("a", day(1), day(5), "privado", at(1)), ("b", day(1), day(5), "privado", at(1)), ("c", day(1), None, "publico", at(1))], [("a", day(1), day(20), "privado", at(3)), ("d", None, None, "x", at(3))],
        [("e", day(1), day(2), "privado", at(10)), ("b", day(1), day(30), "privado", at(10))], [("clock", None, None, "", at(28))],
    ]
    where, out, check = (str(tmp_path / x) for x in "ioc")
    run = lambda: {(r.clave, r.retirada.day, r.motivo) for r in ingest.drain(retention.retired(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(where), "huella", "visto", "0 seconds"), out, check).collect()}
    for rows in batches[:2]:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(where)
    assert run() == set()
    for rows in batches[2:]:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(where)
    # a's later deadline moved its timer; b goes on the 6th, as time stood there before it was seen again; c by its age
    got = run()
    assert {("a", 21, "plazo_vencido"), ("c", 23, "sin_plazo"), ("e", 3, "plazo_vencido")} <= got and {k for k, _, _ in got} <= {"a", "b", "c", "e"}
    assert spark.read.parquet(out).groupBy("clave").count().filter("count > 1").isEmpty()


class _Handle:
    """One group's state and timers, and how often they are called."""

    def __init__(self):
        self.held, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def _called(self):
        self.calls += 1

    def get(self):
        self._called()
        return self.held

    def exists(self):
        self._called()
        return self.held is not None

    def update(self, value):
        self._called()
        self.held = value

    def clear(self):
        self._called()
        self.held = None

    def registerTimer(self, at):  # noqa: N802
        self._called()
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self._called()
        self.timers.discard(at)


def test_postings_of_a_group_share_a_state_and_a_timer():
    class Clock:
        now = 0

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.now

    r, clock, handle, plain = random.Random(5), Clock(), _Handle(), {}
    retire = retention.Retire()
    retire.init(handle)
    for n in range(12):
        clock.now, handle.calls, got, want = 100 * n, 0, [], []
        batch = [(f"p{r.randrange(3000)}", pd.Timestamp(i, unit="ms"), r.choice([None, r.randrange(100 * n - 50, 100 * n + 900)]), r.choice(["plazo_vencido", "antiguedad"])) for i in r.sample(range(9000), 1000)]
        for posting, _, due, why in sorted(batch, key=lambda x: x[1]):
            plain[posting] = (due, why, True)
        frame = pd.DataFrame(batch, columns=["clave", "visto", "due", "motivo"])
        for out in retire.handleInputRows((1,), iter([frame[:400], frame[400:]]), clock):
            got += zip(out["clave"], out["retirada"], out["motivo"], strict=True)
        for timer in sorted(t for t in handle.timers if t <= clock.now):
            for out in retire.handleExpiredTimer((1,), clock, None):
                got += zip(out["clave"], out["retirada"], out["motivo"], strict=True)
            handle.timers.discard(timer)
        for posting, (due, why, _) in list(plain.items()):
            if due is None or due <= clock.now:
                del plain[posting]
                want += [] if due is None else [(posting, pd.Timestamp(due, unit="ms", tz="UTC"), why)]
        assert sorted(got) == sorted(want) and (n == 0 or want)
        assert handle.calls < 10 and handle.timers == {min(due for due, _, _ in plain.values())}


@pytest.mark.parametrize("groups", [1, 64])
def test_groups_retire_what_single_postings_would(spark, tmp_path, groups):
    kinds = "huella string, publicado date, vence date, perfil string, visto timestamp"
    day = lambda n: datetime.date(2026, 1, n)
    at = lambda n: datetime.datetime(2026, 1, n)
    batches = [
        [("a", day(1), day(5), "privado", at(1)), ("b", day(1), day(6), "privado", at(1)), (None, day(1), day(8), "privado", at(1)), ("c", None, None, "x", at(1))],
        [("e", day(1), day(12), "privado", at(10))],
        [("a", day(1), day(15), "privado", at(10)), ("f", day(1), day(3), "privado", at(10))],  # a's day had passed, but not yet been told
        [("clock", None, None, "", at(14)), ("g", day(1), day(20), "privado", at(14))], [("clock", None, None, "", at(28))],
    ]
    where, out, check = (str(tmp_path / x) for x in "ioc")
    for rows in batches:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(where)
        if rows is not batches[1]:  # the third batch is the first under the second's watermark
            got = [(r.clave, r.retirada.day) for r in ingest.drain(retention.retired(stream, "huella", "visto", "0 seconds", groups), out, check).collect()]
    assert sorted(got, key=str) == sorted([("a", 16), ("b", 7), (None, 9), ("e", 13), ("f", 4), ("g", 21)], key=str)


def test_sitemap_files(spark, tmp_path):
    entries = spark.createDataFrame([(f"<url><loc>https://x/{k:04d}</loc><lastmod>2026-01-{k % 28 + 1:02d}</lastmod></url>",) for k in range(1003)] + [("<url><loc>https://x/0005</loc><lastmod>2026-01-06</lastmod></url>",), ("<url><loc>https://x/z</loc></url>",)], "entry string").repartition(5)
    where = str(tmp_path / "s")
    files = {r.file: (r.n, r.lastmod) for r in publish.write_sitemap(entries, where, "https://x", 10).collect()}
    assert files == {k: (10, files[k][1]) for k in range(100)} | {100: (4, "2026-01-23")} and files[0][1] == "2026-01-10"
    text = (tmp_path / "s" / "sitemap-100.xml").read_text().splitlines()
    assert text[0].startswith("<?xml") and text[1].startswith("<urlset") and text[-1] == "</urlset>" and [re.search(r"x/(\w+)</loc>", x)[1] for x in text[2:-1]] == ["1000", "1001", "1002", "z"]
    index = [x for k in range(11) for x in (tmp_path / "s" / f"index-{k}.xml").read_text().splitlines() if "<loc>" in x]
    assert len(index) == 101 and len(set(index)) == 101 and "<sitemap><loc>https://x/sitemap-0.xml</loc><lastmod>2026-01-10</lastmod></sitemap>" in index
    assert sorted(x.name for x in (tmp_path / "s").iterdir() if not x.name.startswith(".")) == sorted([f"sitemap-{k}.xml" for k in range(101)] + [f"index-{k}.xml" for k in range(11)])
    assert publish.write_sitemap(entries.filter("false"), str(tmp_path / "none"), "https://x").count() == 0


def test_pages_that_change(spark):
    row = "struct<huella:string,puesto:string,aprobada:boolean,vigente:boolean>"
    changes = spark.createDataFrame([("a", ("a" * 8, "Mozo", True, True), ("a" * 8, "Mozo de barra", True, True)), ("b", None, ("b" * 8, "Chofer", True, True)), ("c", ("c" * 8, "Cajera", True, True), ("c" * 8, "Cajera", True, False)), ("d", ("d" * 8, "Guía", False, True), ("d" * 8, "Guía", False, True)), ("e", ("e" * 8, "Sastre", True, True), None), ("f", ("f" * 8, "Sastre", True, True), ("f" * 8, "Sastre", True, True))], f"k string, antes {row}, despues {row}")
    got = {(r.slug.rsplit("-", 1)[0], r.accion) for r in publish.pages_changed(changes).collect()}
    assert got == {("mozo", "quitar"), ("mozo-de-barra", "escribir"), ("chofer", "escribir"), ("cajera", "quitar"), ("sastre", "quitar"), ("sastre", "escribir")}


def test_slots_keep_delays_and_fetchers(spark):
    r = random.Random(1)
    urls = [(f"h{min(int(r.expovariate(0.2)), 19)}", f"/{k}", r.randint(0, 9)) for k in range(600)] + [(None, "/x", 1), ("h0", "/0", 99)]
    delays = {f"h{k}": k * 0.7 for k in range(15)}
    table = spark.createDataFrame(urls, "host string, url string, pos int").repartition(3)
    slots = schedule.fetch_schedule(table, spark.createDataFrame(list(delays.items()), "host string, delay double"), 4, 0.5).collect()
    assert len(slots) == len({(h, u) for h, u, _ in urls})
    by_host, by_fetcher = {}, {}
    first = {}
    for h, u, p in urls:
        first[h, u] = min(p, first.get((h, u), p))
    for s in slots:
        by_host.setdefault(s.host, []).append(s)
        by_fetcher.setdefault(s.fetcher, []).append(s.inicio)
    for host, own in by_host.items():
        own.sort(key=lambda s: s.inicio)
        assert len({s.fetcher for s in own}) == 1 and [(first[host, s.url], s.url) for s in own] == sorted((first[host, s.url], s.url) for s in own)
        assert all(b.inicio - a.inicio >= max(delays.get(host, 0), 2.0) - 1e-9 for a, b in zip(own, own[1:]))
    assert len(by_fetcher) > 1
    for at in by_fetcher.values():
        at.sort()
        assert all(b - a >= 0.5 - 1e-9 for a, b in zip(at, at[1:]))
    assert schedule.fetch_schedule(table.filter("false"), spark.createDataFrame([], "host string, delay double"), 4).count() == 0


def test_running_sums_by_ranges(spark):
    rows = [(k % 3 if k % 7 else None, k * 37 % 500, float(k)) for k in range(500)]
    got = {(r.g, r.k): r.before for r in order.running(spark.createDataFrame(rows, "g int, k int, v double").repartition(4), ["k"], F.col("v"), "before", ("g",)).collect()}
    for g, k, _ in rows:
        assert got[g, k] == sum(v for h, j, v in rows if h == g and j < k)
