"""Discovery and permission: sitemaps, listings, URL order, robots rules, problem logs. Fetching is left to the caller."""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.classify import detect_ats
from ..operators.shared import kept

#: Bytes of a sitemap that are unfolded and read at a time.
PIECE = 4 << 20
#: Numbers of the places of one piece's entries.
PLACES = 1 << 32
_ENTRY_END = re.compile(r"(?i)</(?:\w+:)?(?:url|sitemap)>|</(?:\w+:)?loc>(?=\s*<(?:\w+:)?loc>)")


def _unfolded(b: bytes, size: int) -> Iterator[bytes]:
    """The bytes that b stands for, some at a time; gzip is known by its first bytes. Damaged bytes raise zlib.error."""
    if b[:2] != b"\x1f\x8b":
        yield from (b[k : k + size] for k in range(0, len(b), size))
        return
    while b:  # members of a packed file follow each other
        out = zlib.decompressobj(wbits=31)
        yield out.decompress(b, size)
        while not out.eof:
            if not (more := out.decompress(out.unconsumed_tail, size)) and not out.unconsumed_tail:
                raise zlib.error("cut off")
            yield more
        b = out.unused_data if out.unused_data[:2] == b"\x1f\x8b" else b""


def _texts(b: bytes | None, size: int) -> Iterator[str | None]:
    """A sitemap as texts that end with an entry's end (the last one with the text's); a damaged one is a single null."""
    if b is None:
        yield None
        return
    try:  # once through, without keeping it: what is damaged gives nothing, not its start
        for _ in _unfolded(b, size):
            pass
    except zlib.error:
        yield None
        return
    decode, held = codecs.getincrementaldecoder("utf-8")("replace").decode, ""
    for part in _unfolded(b, size):
        held += decode(part)
        if len(held) >= size and (ends := [m.end() for m in _ENTRY_END.finditer(held)]):
            yield held[: ends[-1]]
            held = held[ends[-1] :]
    yield held + decode(b"", True)


def sitemap_text(files: DataFrame, content: str = "content", size: int = PIECE) -> DataFrame:
    """files (as of the binaryFile source) with ``xml`` and ``piece`` in place of the content.

    A file of more than ``size`` bytes, unfolded, has a row for each piece of about that size: whole
    entries, numbered in order. However far it unfolds, all of it is read, a piece at a time. One
    that is damaged has one row without ``xml``."""
    others = [c for c in files.columns if c != content]

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for k, text in enumerate(_texts(b[content][i].as_py(), size)):
                    yield pa.RecordBatch.from_arrays([*(b[c].slice(i, 1) for c in others), pa.array([text], pa.string()), pa.array([k], pa.int32())], [*others, "xml", "piece"])

    kinds = T.StructType([*(files.schema[c] for c in others), T.StructField("xml", T.StringType()), T.StructField("piece", T.IntegerType())])
    return files.select(*others, F.col(content).cast("binary").alias(content)).mapInArrow(unfold, kinds)


def sitemap_urls(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """loc, lastmod, is_map, pos of the entries of sitemaps: junk and broken nesting are passed over.

    Rows may be pieces of sitemaps, as sitemap_text gives them: then pos goes on from piece to piece, with gaps."""
    entry = r"(?is)<(?:\w+:)?(url|sitemap)>(.*?)</(?:\w+:)?\1>"
    kinds, bodies = (F.regexp_extract_all(xml, F.lit(entry), F.lit(k)) for k in (1, 2))
    bare = F.regexp_extract_all(xml, F.lit(r"(?is)(<(?:\w+:)?loc>.*?</(?:\w+:)?loc>)"), F.lit(1))
    rows = F.when(F.size(bodies) > 0, F.arrays_zip(kinds.alias("kind"), bodies.alias("body"))).otherwise(F.transform(bare, lambda x: F.struct(F.lit("url").alias("kind"), x.alias("body"))))
    pieces = "piece" in maps.columns
    each = maps.select(*(c for c in maps.columns if c != xml), F.posexplode(rows).alias("pos", "x"))
    each = each.withColumn("pos", F.col("piece") * F.lit(PLACES) + F.col("pos")).drop("piece") if pieces else each
    inside = lambda tag: F.regexp_extract("x.body", rf"(?is)<(?:\w+:)?{tag}>(.*?)</(?:\w+:)?{tag}>", 1)
    out = each.select(*(c for c in maps.columns if c not in (xml, "piece")), "pos", F.regexp_replace(inside("loc"), r"\s+", "").alias("loc"), F.try_to_date(F.substring(F.trim(inside("lastmod")), 1, 10), "yyyy-MM-dd").alias("lastmod"), (F.lower("x.kind") == "sitemap").alias("is_map"))
    return out.filter("loc <> ''")


def recent(urls: DataFrame, as_of: Column, days: int = 30, undated: bool = True) -> DataFrame:
    """URLs within the window, newest first, undated ones last or not at all."""
    fresh = F.col("lastmod") >= F.date_sub(as_of, days)
    return urls.filter(fresh | F.col("lastmod").isNull() if undated else fresh).orderBy(F.desc_nulls_last("lastmod"), "pos")


def clean_link(raw: Column, base: Column) -> Column:
    """A link without quotes and escapes, made absolute."""
    t = F.replace(F.replace(F.btrim(raw, F.lit(" \t\n\"'<>,;()\\")), F.lit("\\/"), F.lit("/")), F.lit("&amp;"), F.lit("&"))
    return F.when(t.startswith("http"), t).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(t, "^/+", "")))


def listing_urls(pages: DataFrame, pattern: str, base: Column, html: str = "html", rank: str = "pos") -> DataFrame:
    """url and its first place among the pages' matches, each once."""
    found = F.regexp_extract_all(F.replace(F.col(html), F.lit("\\/"), F.lit("/")), F.lit(pattern), F.lit(0))
    each = pages.select(F.col(rank).alias("page_pos"), base.alias("base"), F.posexplode(found).alias("at", "raw"))
    return each.select(clean_link(F.col("raw"), F.col("base")).alias("url"), "page_pos", "at").groupBy("url").agg(F.min(F.struct("page_pos", "at")).alias("first"))


def fill_up(first: DataFrame, then: DataFrame, limit: int) -> DataFrame:
    """url of the first source, then of the other up to a limit, each once (S6); both have url, pos."""
    both = first.select("url", "pos", F.lit(0).alias("source")).unionByName(then.select("url", "pos", F.lit(1).alias("source")))
    return both.groupBy("url").agg(F.min(F.struct("source", "pos")).alias("first")).orderBy("first", "url").limit(limit)


def correlative(url: Column) -> Column:
    """The largest number of four digits or more in a URL, else 0."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(url, F.lit(r"(\d{4,})"), F.lit(1)), lambda x: x.try_cast("bigint"))), F.lit(0).cast("bigint"))


#: Sitemaps that are followed from one, by their first entries.
CHILDREN = 8


def discover(maps: DataFrame, roots: DataFrame, limit: int, pattern: str = "", as_of: Column | None = None, days: int = 30) -> DataFrame:
    """fuente, url, rank of the postings that sources' sitemaps lead to.

    maps: map_url, xml of what was read; roots: fuente, map_url, pos. Maps are followed level by
    level, first come first, up to CHILDREN from each, until a level leads to no map that its source
    hasn't seen. Of a source's maps, in this order, those count that come before it has three times
    the limit of URLs. With ``as_of`` the recent ones come, newest first; else the highest numbers.
    Each level is a job, kept in the checkpoint folder: a join of what it leads to with the entries."""
    entries = sitemap_urls(maps)
    children = kept(entries.filter("is_map").select(F.col("map_url").alias("parent"), F.col("pos").alias("at"), F.col("loc").alias("child")))
    path = F.array(F.col("pos").cast("int"))
    once_each = lambda df: df.groupBy("fuente", "map_url").agg(F.min("order").alias("order"))
    frontier = once_each(roots.select("fuente", "map_url", F.struct(F.lit(0).alias("level"), path.alias("path")).alias("order")))
    seen, level = frontier, 0
    while True:
        level += 1
        led = frontier.join(children, F.col("map_url") == F.col("parent")).select("fuente", "order", F.col("child").alias("map_url"), "at")
        led = led.join(seen.select("fuente", "map_url"), ["fuente", "map_url"], "left_anti")
        nth = F.row_number().over(Window.partitionBy("fuente", "order").orderBy("at"))  # as many rows as a map has
        led = led.withColumn("nth", nth).filter(F.col("nth") <= CHILDREN)
        into = F.struct(F.lit(level).alias("level"), F.concat("order.path", F.array(F.col("nth"))).alias("path"))
        frontier = kept(once_each(led.select("fuente", "map_url", into.alias("order"))))
        if frontier.isEmpty():
            break
        seen = kept(seen.unionByName(frontier))
    first = seen.groupBy("fuente", "map_url").agg(F.min("order").alias("order"))
    found = entries.filter("not is_map").select(F.col("map_url").alias("of"), "pos", "loc", "lastmod")
    sizes = found.groupBy("of").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("fuente").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of a source's maps
    before = first.join(sizes, F.col("map_url") == F.col("of"), "left").withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(ordered), F.lit(0)))
    read = before.filter(F.col("before") < 3 * limit).select("fuente", "order", F.col("map_url").alias("map"))
    urls = found.join(read, F.col("of") == F.col("map")).select("fuente", F.col("loc").alias("url"), F.struct("order", "pos").alias("place"), "lastmod")
    if as_of is not None:
        urls = urls.filter((F.col("lastmod") >= F.date_sub(as_of, days)) | F.col("lastmod").isNull())
        better = F.struct(F.coalesce(-F.unix_date("lastmod"), F.lit(2**31 - 1)), "place")
    else:
        better = F.struct(-correlative(F.col("url")), "place")
    urls = urls.filter(F.col("url").rlike(pattern)) if pattern else urls
    # the best of each source, cut before they are gathered: by halves of a hash, then together
    keyed = urls.select("fuente", "url", better.alias("better"), F.pmod(F.xxhash64("url"), F.lit(64)).alias("part"))
    part = F.row_number().over(Window.partitionBy("fuente", "part").orderBy("better"))
    rank = F.row_number().over(Window.partitionBy("fuente").orderBy("better"))
    best = keyed.withColumn("nth", part).filter(F.col("nth") <= limit).withColumn("rank", rank)
    return best.filter(F.col("rank") <= limit).select("fuente", "url", "rank")


#: Numbers of a source's order that one task looks through.
STRETCH = 100_000


def until_stale(pages: DataFrame, order: str, old: Column, run: int = 40, by: str = "fuente", stretch: int = STRETCH) -> DataFrame:
    """Pages in order up to the end of the first ``run`` old ones in a row."""
    stops = stale_stops(pages, order, old, run, by, stretch)
    return pages.join(stops, F.col(by).eqNullSafe(F.col("_by")), "left").filter(F.col("stop").isNull() | (F.col(order) <= F.col("stop"))).drop("_by", "stop")


def stale_stops(pages: DataFrame, order: str, old: Column, run: int = 40, by: str = "fuente", stretch: int = STRETCH) -> DataFrame:
    """_by, stop: where the first ``run`` old pages in a row end, for each source that has them; ``order`` is a whole number.

    Each stretch of the order is looked through by itself: how many old ones it starts and ends
    with, and where the first long run inside it ends. Stretches, a row each, then carry what they
    end with into the next."""
    keyed = pages.select(F.col(by).alias("_by"), F.col(order).cast("long").alias("_order"), old.cast("int").alias("_is_old"), F.floor(F.col(order) / stretch).alias("_part"))
    w = Window.partitionBy("_by", "_part").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumn("_break", F.sum(1 - F.col("_is_old")).over(w))
    inside = Window.partitionBy("_by", "_part", "_break").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumn("_run", F.sum("_is_old").over(inside))
    ends = keyed.filter((F.col("_is_old") == 1) & (F.col("_run") <= run))
    # the places of a stretch's leading old ones, of which one may end a run that began before it
    parts = keyed.groupBy("_by", "_part").agg(
        F.count_if((F.col("_break") == 0) & (F.col("_is_old") == 1)).alias("lead"), F.count(F.lit(1)).alias("n"), F.max_by("_run", F.struct("_order", "_break", "_run")).alias("tail"),
        F.min(F.when(F.col("_run") == run, F.col("_order"))).alias("stop"),
    )
    upto = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    mixed = F.col("lead") < F.col("n")
    # what is carried in: the tail of the last stretch with a fresh page, and all of those that are old throughout after it
    parts = parts.withColumn("_all", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("_base", F.coalesce(F.max(F.when(mixed, F.struct("_part", (F.col("_all") + F.col("n") - F.col("tail")).alias("base")))).over(upto)["base"], F.lit(0)))
    parts = parts.withColumn("carried", F.col("_all") - F.col("_base"))
    asked = parts.filter("carried + lead >= " + str(run)).select(F.col("_by").alias("b"), F.col("_part").alias("p"), F.greatest(run - F.col("carried"), F.lit(1)).alias("r"))
    across = ends.filter("_break = 0").join(asked, F.col("_by").eqNullSafe(F.col("b")) & (F.col("_part") == F.col("p")) & (F.col("_run") == F.col("r"))).select("_by", F.col("_order").alias("stop"))
    return parts.filter("stop is not null").select("_by", "stop").unionByName(across).groupBy("_by").agg(F.min("stop").alias("stop"))


def vacancy_counts(urls: DataFrame, n: Column) -> DataFrame:
    """How many pages have several vacancies, and how many these are."""
    return urls.agg(F.count_if(n > 1).alias("de_varias_plazas"), F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("plazas_en_juego"))


def _robots_lines(files: DataFrame, host: str, text: str) -> DataFrame:
    """host, pos, field, value, group of the lines that count; consecutive agents open one group."""
    lines = files.select(host, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "raw"))
    plain = F.trim(F.regexp_replace("raw", "#.*$", ""))
    kept = lines.withColumn("line", plain).filter(F.col("line").contains(":")).select(host, "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    return kept.filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay", "sitemap"))


def _our_rules(kept: DataFrame, agent: str, host: str) -> DataFrame:
    """The lines of the groups of the agent that is us, else of '*': the first agent whose name is part of ours."""
    by = Window.partitionBy(host).orderBy("pos")
    rules = kept.filter("field <> 'sitemap'")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(by), F.lit("")) != "user-agent")
    rules = rules.withColumn("group", F.sum(opens.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    agents = rules.filter("field = 'user-agent'").select(F.col(host).alias("h"), F.col("group").alias("g"), F.lower("value").alias("agent"), F.col("pos").alias("at"))
    ours = (F.col("agent") != "") & (F.col("agent") != "*") & F.lit(agent.split("/")[0].strip().lower()).contains(F.col("agent"))
    ranked = agents.withColumn("kind", F.when(ours, 0).when(F.col("agent") == "*", 1)).filter("kind is not null")
    named = ranked.groupBy("h").agg(F.min(F.struct("kind", "at", "agent")).alias("m")).select("h", "m.agent")
    mine = agents.join(named, ["h", "agent"]).select("h", "g").distinct()
    return rules.filter("field <> 'user-agent'").join(mine, (F.col(host) == F.col("h")) & (F.col("group") == F.col("g"))).drop("h", "g", "group")


def robots_rules(files: DataFrame, agent: str, host: str = "host", text: str = "text") -> DataFrame:
    """host, allowed, pattern, regex of the group for our agent."""
    chosen = _our_rules(_robots_lines(files, host, text), agent, host)
    free = (F.col("field") == "disallow") & (F.col("value") == "")
    paths = chosen.filter("field in ('allow', 'disallow')").select(host, ((F.col("field") == "allow") | free).alias("allowed"), F.when(free, "/").otherwise(F.col("value")).alias("pattern"))
    return paths.filter("pattern <> ''").withColumn("regex", pattern_regex(F.col("pattern")))


def robots_policy(files: DataFrame, agent: str, host: str = "host", text: str = "text") -> DataFrame:
    """host, delay of the group for our agent (null without one), and the sitemaps that the file names, in order (R2)."""
    kept = _robots_lines(files, host, text)
    delay = F.col("value").try_cast("double")
    delays = _our_rules(kept, agent, host).filter("field = 'crawl-delay'").filter(delay.isNotNull()).groupBy(F.col(host).alias("dh")).agg(F.max_by(delay, F.col("pos")).alias("delay"))
    maps = kept.filter("field = 'sitemap'").groupBy(F.col(host).alias("mh")).agg(F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("value", r"\s+", "").alias("url")))).alias("m"))
    hosts = files.select(host).distinct().join(delays, F.col(host) == F.col("dh"), "left").join(maps, F.col(host) == F.col("mh"), "left")
    return hosts.select(host, "delay", F.coalesce(F.transform("m", lambda x: x["url"]), F.array().cast("array<string>")).alias("sitemaps"))


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern as an anchored regex: only * and a final $ are special."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.^$|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))


def literal_prefix(pattern: Column) -> Column:
    """What a path that a robots pattern matches begins with: the pattern up to its first star, or its end mark."""
    return F.regexp_extract(pattern, r"^((?:[^*$]|\$(?!$))*)", 1)


def allowed(urls: DataFrame, rules: DataFrame, key: str, host: str = "host", path: str = "path") -> DataFrame:
    """urls with ``permitted``: by the longest matching pattern, allow on ties, allowed if none matches.

    Rules are found by their literal beginnings: a path is cut to the lengths that its host's
    beginnings have, and each cut is joined by equality. What is found is then verified, most of it
    by its length alone. So work grows with the paths and the lengths of beginnings, not with paths times rules."""
    begin = literal_prefix(F.col("pattern"))
    each = rules.groupBy(F.col(host).alias("_host"), "pattern").agg(F.max("allowed").alias("allowed"), F.first("regex").alias("regex"))
    each = each.select("_host", "allowed", "pattern", "regex", begin.alias("_begin"), (begin == F.col("pattern")).alias("_plain"), (F.concat(begin, F.lit("$")) == F.col("pattern")).alias("_whole"))
    sizes = each.groupBy(F.col("_host").alias("_of")).agg(F.collect_set(F.char_length("_begin")).alias("_sizes"))  # as many as the longest pattern has characters
    decoded = F.coalesce(F.nullif(F.coalesce(F.try_url_decode(path), F.col(path)), F.lit("")), F.lit("/"))
    asked = urls.select(key, F.col(host).alias("_h"), decoded.alias("_path")).join(sizes, F.col("_h") == F.col("_of"))
    cuts = asked.select(key, "_h", "_path", F.explode(F.filter("_sizes", lambda n: n <= F.char_length("_path"))).alias("_size")).withColumn("_cut", F.substring("_path", F.lit(1), F.col("_size")))
    hits = cuts.join(each, (F.col("_h") == F.col("_host")) & (F.col("_cut") == F.col("_begin")))
    hits = hits.filter(F.when(F.col("_plain"), True).when(F.col("_whole"), F.char_length("_path") == F.col("_size")).otherwise(F.expr("_path rlike regex")))
    best = hits.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(F.length("pattern").alias("n"), "allowed")).alias("b"))
    return urls.join(best, F.col(key) == F.col("_key"), "left").withColumn("permitted", F.coalesce("b.allowed", F.lit(True))).drop("_key", "b")


def domain_policy(status: Column, body: Column) -> Column:
    """Whether a host may be read at all, by its robots answer."""
    return F.when(status == 404, True).when(status.isNull() | (status >= 500) | (F.coalesce(body, F.lit("")) == ""), False).otherwise(True)


def wait_seconds(crawl_delay: Column) -> Column:
    return F.greatest(F.coalesce(crawl_delay, F.lit(0.0)), F.lit(2.0))


def problem_log(messages: DataFrame, message: str = "message", order: str = "pos") -> DataFrame:
    """Messages that are equal but for their URLs: the first of them, cut, and their number."""
    masked = F.regexp_replace(message, r"https?://\S+", "<url>")
    return messages.groupBy(masked.alias("clave")).agg(F.min_by(F.substring(message, 1, 300), F.col(order)).alias("mensaje"), F.count(F.lit(1)).alias("n"))


def select_sources(sources: DataFrame, part: str) -> DataFrame:
    """Sources whose name holds the part, in either case."""
    return sources.filter(F.lower("name").contains(part.lower()))


def startup_sources(sources: DataFrame) -> DataFrame:
    """Sources once each, the first of a name."""
    return sources.groupBy("name").agg(F.min_by(F.struct(*sources.columns), F.col("rank")).alias("s")).select("s.*")


def cache_key(url: Column) -> Column:
    """The name under which a URL's document is kept."""
    return F.substring(F.sha1(url.cast("binary")), 1, 20)




def diagnose(sources: DataFrame, policies: DataFrame, urls: DataFrame, samples: DataFrame) -> DataFrame:
    """What a look at each source tells before it is left to itself: robots, URLs found, JSON-LD, details.

    sources: fuente, nota, sitemaps (its own); policies: fuente, legible, nota_robots, declarados;
    urls: fuente, url, rank; samples: url, puesto, empresa, sueldo_texto, con_jsonld, html."""
    of = lambda df, tag: df.withColumnRenamed("fuente", f"_{tag}")
    counts = urls.groupBy("fuente").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min_by("url", "rank").alias("first"))
    df = sources.join(of(policies, "p"), F.col("fuente") == F.col("_p"), "left").join(of(counts, "c"), F.col("fuente") == F.col("_c"), "left")
    df = df.join(samples.withColumnRenamed("url", "_url"), F.col("first") == F.col("_url"), "left")
    readable, n = F.coalesce("legible", F.lit(False)), F.coalesce("n", F.lit(0))
    asked = readable & (n > 0) & F.col("_url").isNotNull()
    sample = F.concat(F.lit("Muestra: "), "puesto", F.lit(" — "), "empresa", F.lit(" ["), F.coalesce(F.nullif("sueldo_texto", F.lit("")), F.lit("sin campo de sueldo")), F.lit("]"))
    empty_page = F.col("html").contains("enable JavaScript") | (F.char_length("html") < 2000)
    shown = F.when(F.col("con_jsonld"), sample).when(empty_page, "La página llega vacía: es una SPA, marcar necesita_render=True").otherwise("HTML completo pero sin JSON-LD: hay que escribir un parser propio")
    detail = F.array_compact(F.array(F.nullif("nota", F.lit("")), F.col("nota_robots"), F.when((F.col("declarados") > 0) & (F.col("sitemaps") == 0), F.concat(F.lit("Sitemaps declarados: "), F.col("declarados").cast("string"))), F.when(readable & (n == 0), "No se descubrieron avisos: revisar sitemap o patrón"), F.when(asked, shown)))
    return df.select("fuente", F.when(readable, "permite").otherwise("bloquea").alias("robots"), F.when(readable, n).otherwise(0).alias("urls"), F.when(asked, F.col("con_jsonld")).alias("con_jsonld"), detail.alias("detalle"))


def connector_advice(url: Column, html: Column, allowed: Column, note: Column, has_jsonld: Column) -> Column:
    """Which reader a company's job page needs, with the account's name where the page tells it."""
    page = F.coalesce(html, F.lit(""))
    ats = F.coalesce(F.nullif(detect_ats(url), F.lit("")), detect_ats(page))
    account = lambda text, pattern, default: F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(default))
    site = F.coalesce(F.nullif(F.regexp_extract(page, r"careersite/(\d+)", 1), F.lit("")), account(url, r"careersite/(\d+)", "<n>"))
    said = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    return (
        F.when(~allowed, said("No se puede leer: ", note))
        .when(html.isNull(), said("No respondió: ", note))
        .when(ats == "greenhouse", said("Usa Greenhouse. Agrega:  Greenhouse('", account(page, r"(?i)greenhouse\.io/(?:embed/job_board\?for=|boards/)?([a-z0-9_-]+)", "<cuenta>"), "', 'Nombre de la empresa')"))
        .when(ats == "lever", said("Usa Lever. Agrega:  Lever('", account(page, r"(?i)lever\.co/([a-z0-9_-]+)", "<cuenta>"), "', 'Nombre de la empresa')"))
        .when(ats == "cornerstone", said("Usa Cornerstone OnDemand (careersite ", site, "). Los avisos se piden por su API interna; revisá qué llama la página antes de raspar."))
        .when(ats == "gupy", said("Usa Gupy (", account(F.concat(url, page), r"(?i)https?://([a-z0-9-]+)\.gupy\.io", "<cuenta>"), ".gupy.io). Expone los avisos en JSON; vale la pena escribirle un lector, sirve para varias empresas."))
        .when(ats != "", said("Usa ", ats, ". No hay lector directo todavía; probá si la página del aviso trae JSON-LD (motor probar-url --parser jsonld <url del aviso>)."))
        .when(has_jsonld, "Web propia con JSON-LD. Usa portal_propio(...) y funcionará sin más.")
        .when(page.contains("enable JavaScript") | (F.char_length(page) < 2000), "Web propia hecha en JavaScript: necesita Playwright (necesita_render=True).")
        .otherwise("Web propia sin JSON-LD: hay que revisar el HTML a mano y escribirle un parser, o pedirle a la empresa un feed.")
    )


def catalogue(*parts: DataFrame) -> DataFrame:
    """The sources of several catalogues as one, the first of each name, by catalogue and rank."""
    ranked = [p.select("name", F.struct(F.lit(k).alias("part"), "rank").alias("rank")) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, ranked).groupBy("name").agg(F.min("rank").alias("first")).select("name", "first.part", "first.rank")
