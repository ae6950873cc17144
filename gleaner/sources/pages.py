"""Readers of structured pages: JSON-LD, meta tags, label/value sheets, tender cards, links, ATS JSON."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import salary
from ..functions.text import any_of, closed, fold, fold_python, html_to_lines, let, literal, once

# Months, in order, with their other spelling.
MONTHS = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "setiembre": 9, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}


def _month(name: Column, prefix: bool = False) -> Column:
    out = F
    for month, k in MONTHS.items():
        out = out.when(F.lit(month).startswith(name) if prefix else name == month, k)
    return out.otherwise(None)


def _day(text: Column, pattern: str, prefix: bool = False) -> Column:
    part = lambda k: F.regexp_extract(text, pattern, k)
    month = let(part(2), lambda name: _month(name, prefix))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.when(text.rlike(pattern), F.concat_ws("-", part(3), F.coalesce(two(month), F.lit("")), two(part(1).cast("int"))).try_cast("date"))


def spanish_date(text: Column) -> Column:
    """'21 de julio de 2026', '17 de Agosto del 2026' or '10 ago. 2026' as a date, else null (M3, C4)."""
    dates = lambda t: F.coalesce(_day(t, r"(\d{1,2})\s*de\s*([a-z]+)\s*del?\s*(\d{4})"), _day(t, r"(\d{1,2})\s+([a-z]{3})\.?\s*(\d{4})", True))
    return F.when(text.rlike(r"\d{4}"), let(fold(text), dates))  # most texts have no year


def flexible_date(value: Column) -> Column:
    """A date from milliseconds since 1970 or an ISO text."""
    return F.coalesce(F.to_date(F.timestamp_millis(value.try_cast("bigint"))), F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd"))


def _known(text: Column) -> Column:
    """The text, unless it is empty; made once."""
    return let(text, _some)


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by name or property, attributes in either order, else empty (M1)."""
    key, content = rf"""(?:name|property)=["']{literal(name)}["']""", r"""content=["']([^"']*)["']"""
    one = lambda p: _known(F.regexp_extract(html, p, 1))
    return F.coalesce(one(rf"(?i)<meta[^>]+{key}[^>]*{content}"), one(rf"(?i)<meta[^>]+{content}[^>]*{key}"), F.lit(""))


def heading_text(html: Column, tag: str = "h1") -> Column:
    """The text of the first such element."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", " "), r"\s+", " "))


def regime(text: Column) -> Column:
    """The labour regime that a text names (M4)."""
    return let(F.upper(text), _regime)


def _regime(t: Column) -> Column:
    return F.when(t.rlike(r"(?U)\bCAS\b|1057"), "CAS").when(t.contains("728"), "728").when(t.contains("276"), "276").otherwise("")


def value_beside(lines: Column, label: str, low: Column | None = None) -> Column:
    """The value of a label: the next line if the label stands alone, else the rest of its line; first hit (M2).

    low: the lines in lower case, if they are there already."""
    name = label.lower().rstrip(":")
    bare = literal(name)
    alone = lambda x: F.lower(F.regexp_replace(F.trim(x), ":+$", "")) == name
    beside = lambda x: F.regexp_replace(F.regexp_extract(F.trim(x), rf"(?iu)^{bare}\s*[:\-–—]?\s*(.+)$", 1), r"^[ :\-–—]+|[ :\-–—]+$", "")
    read = lambda x, i: F.when(alone(x), F.coalesce(F.trim(F.get(lines, i + 1)), F.lit(""))).otherwise(_known(beside(x)))
    has = lambda x, i: (F.lower(x) if low is None else F.get(low, i)).contains(name)
    found = F.transform(lines, lambda x, i: F.when(has(x, i), read(x, i)))  # few lines have the label at all
    return F.coalesce(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def bare_label(line: Column) -> Column:
    """A line without leading decoration."""
    return F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"(?U)^[^\w]+", ""))


def after_label(line: Column, *labels: str) -> Column:
    """What follows 'label:', with any of the labels, at the start of a line, '' for the bare label, else null."""
    return let(bare_label(line), lambda t: _after(t, fold(t), *labels))


def _after(bare: Column, folded: Column, *labels: str) -> Column:
    pattern = rf"^(?:{'|'.join(literal(fold_python(x)) for x in labels)})(?:\([^)]*\))?\s*\??\s*(?::(.*))?$"
    value = F.trim(F.regexp_extract(bare, r"^[^:]*:(.*)$", 1))
    return F.when(folded.rlike(pattern), F.when(bare.contains(":"), value).otherwise(""))


def field(lines: Column, label: str) -> Column:
    """The first value of a strict label; the next line if it is empty there."""
    found = F.transform(lines, lambda x, i: let(after_label(x, label), lambda v: F.when(v == "", F.coalesce(bare_label(F.get(lines, i + 1)), F.lit(""))).otherwise(v)))
    return F.coalesce(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def vacancies(url: Column) -> Column:
    """The number of vacancies that a URL tells, else 0."""
    return F.coalesce(F.regexp_extract(url, r"(?i)-(\d+)-plazas-\d+\.html$", 1).try_cast("int"), F.lit(0))


# Labels that end a card, and those that end its requirements.
CARD_END = ("plazo para postular", "como postular", "ver aqui bases", "descargar aqui", "cronograma", "documentos", "informes")
REQUIREMENTS_END = ("lugar de labores", "salario", "plazo para postular", "como postular", "remuneracion", "ver aqui bases", "descargar aqui")


def cards(lines: DataFrame, key: str = "page", pos: str = "pos", line: str = "line") -> DataFrame:
    """lines with ``card``: 1, 2, ... from each 'vacantes' line on, up to the footer after the last (C6). Others have none."""
    t = fold(bare_label(F.col(line)))
    page = Window.partitionBy(key)
    so_far = page.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("_start", t.startswith("vacantes").cast("int")).withColumn("card", F.sum("_start").over(so_far))
    ends = t.rlike(rf"^(?:{'|'.join(map(literal, CARD_END))})") & (F.col("card") == F.max("card").over(page)) & (F.col("_start") == 0)
    df = df.withColumn("_over", F.max(ends.cast("int")).over(so_far))
    return df.filter("card > 0 and _over = 0").drop("_start", "_over")


def card_requirements(block: Column) -> Column:
    """The requirements of a card's lines: from its first such label to the first ending one."""
    starts = ("Profesiones/Oficios", "Profesiones", "Oficios", "Experiencia", "Formación académica", "Requisitos")

    def read(t: Column) -> Column:
        """What a line holds of the labels, each once."""
        f = lambda *labels: _after(t["bare"], t["folded"], *labels)
        return F.struct(t["bare"].alias("bare"), f(*starts).alias("value"), f(*REQUIREMENTS_END).isNotNull().alias("ends"), f("Vacantes").isNotNull().alias("vacancies"))

    each = F.transform(block, lambda x: let(bare_label(x), lambda b: let(F.struct(b.alias("bare"), fold(b).alias("folded")), read)))
    state = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        over = s["over"] | x["ends"]
        item = F.when(x["value"].isNotNull(), F.when(F.char_length(x["value"]) > 10, x["value"])).when(s["inside"], F.nullif(x["bare"], F.lit("")))
        add = ~over & ~x["vacancies"] & item.isNotNull()
        return F.struct((s["inside"] | ~over & x["value"].isNotNull()).alias("inside"), over.alias("over"), F.when(add, F.concat(s["out"], F.array(item))).otherwise(s["out"]).alias("out"))

    return F.aggregate(each, state, step, lambda s: s["out"])


def card_salary(block: Column) -> Column:
    """The salary text of a card; empty if its two labels contradict."""
    told = F.transform(F.array(field(block, "Salario"), field(block, "Remuneración")), lambda x: F.struct(x.alias("text"), salary.extract_salary(x)["minimo"].alias("least")))

    def one(x: Column) -> Column:
        a, b = F.get(x, F.lit(0)), F.get(x, F.lit(1))
        return F.when(F.coalesce(a["least"] != b["least"], F.lit(False)), "").otherwise(F.coalesce(F.nullif(a["text"], F.lit("")), b["text"]))

    return let(told, one)


def tender_postings(pages: DataFrame, as_of: Column) -> DataFrame:
    """url, card, puesto, sueldo_texto, requisitos, vence of every job of tender pages (url, html) that are open."""
    df = once(pages.select("url", "html"), lines=html_to_lines(F.col("html")))
    df = once(df, vence=spanish_date(field(F.col("lines"), "Plazo para postular"))).filter(F.col("vence") >= as_of)
    each = df.select("url", "vence", F.posexplode("lines").alias("pos", "line"))
    each = each.withColumn("above", F.lag("line").over(Window.partitionBy("url").orderBy("pos")))
    blocks = cards(each, "url").groupBy("url", "vence", "card").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "above"))).alias("b"))
    blocks = blocks.select("url", "vence", "card", F.get("b", F.lit(0))["above"].alias("puesto"), F.transform("b", lambda x: x["line"]).alias("block"))
    blocks = once(blocks, sueldo_texto=card_salary(F.col("block")), requisitos=card_requirements(F.col("block"))).filter(F.char_length("puesto").between(4, 90))
    blocks = once(blocks, monto=F.coalesce(salary.extract_salary(F.col("sueldo_texto"))["minimo"], F.lit(0)), nombre=fold(F.col("puesto")))
    same = Window.partitionBy("url", "nombre")
    kept = blocks.withColumns({"_low": F.min("monto").over(same), "_high": F.max("monto").over(same), "_n": F.row_number().over(same.orderBy("card"))})
    return kept.filter("_low = _high and _n = 1").select("url", "card", "puesto", "sueldo_texto", "requisitos", "vence")


#: Levels of lists and graphs that are opened.
NESTED = 3


def _values(path: str, kind: str):
    return lambda v: F.try_variant_get(v, path, kind)


def _opened(values: Column) -> Column:
    """An array of variants with lists and graphs replaced by what they hold."""
    listed, graph = _values("$", "array<variant>"), _values("$['@graph']", "variant")
    inside = lambda v: F.coalesce(listed(v), let(graph(v), lambda g: F.when(g.isNotNull(), F.coalesce(listed(g), F.array(g)))), F.array(v))
    return F.flatten(F.transform(values, inside))


_TRAILING = r",\s*([}\]])"


def _parsed(script: Column) -> Column:
    """A script's variant, read again without trailing commas where it is no JSON as it stands, or null.

    A text that fails costs ten times one that doesn't, so one whose trailing commas all stand outside of strings
    is read without them at once: either it fails as it stands, or they come after its value and change nothing."""
    count = lambda t: F.regexp_count(t, F.lit(_TRAILING))
    mended = lambda t: F.try_parse_json(F.regexp_replace(t, _TRAILING, "$1"))
    no_escapes = lambda t: F.when(t.contains("\\"), F.regexp_replace(t, r"(?s)\\.", "__")).otherwise(t)
    no_strings = lambda t: F.regexp_replace(no_escapes(t), r'"[^"]*"', '""')
    read = lambda t, n: F.when(n == 0, F.try_parse_json(t)).when(n == count(no_strings(t)), mended(t)).otherwise(F.coalesce(F.try_parse_json(t), mended(t)))
    return let(F.trim(script), lambda t: let(count(t), lambda n: read(t, n)))


def job_posting_node(html: Column) -> Column:
    """The first JobPosting of a page's JSON-LD, as a variant, or null."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))

    def values(script: Column) -> Column:
        nested = script.contains("@graph") | script.contains("\\u") | F.ltrim(script, F.lit(" \t\r\n")).startswith("[")  # else there is one object, and nothing to open
        found = F.filter(F.array(_parsed(script)), lambda v: v.isNotNull())
        opened = lambda v: functools.reduce(lambda x, _: _opened(x), range(NESTED), v)
        return let(found, lambda v: F.when(nested, opened(v)).otherwise(v))

    kind = _values("$['@type']", "string")
    all_ = F.flatten(F.transform(scripts, values))
    return F.when(html.contains("ld+json"), F.get(F.filter(all_, lambda v: F.lower(kind(v)) == "jobposting"), F.lit(0)))


def _some(text: Column) -> Column:
    """The text, unless it is empty."""
    return F.when(text != "", text)


def _holds(text: Column, *begins: str) -> Column:
    """Whether a value's text is JSON of an object or a list, by what it begins with; a text that only begins so has nothing inside."""
    return F.coalesce(functools.reduce(lambda a, b: a | b, (text.startswith(x) for x in begins)), F.lit(False))


def _plain(text: Column) -> Column:
    """The text, unless it is empty or JSON of an object or a list."""
    return F.when((text != "") & ~_holds(text, "{", "["), text)


def _text(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


_NAMED = "struct<name: string, value: string>"


def _named(of: Column) -> Column:
    return F.coalesce(_some(of["name"]), _some(of["value"]))


def _inside(node: Column, path: str, text: Column) -> Column:
    """The name, value or first item of what stands at a path, whose text is this, or the text."""
    of = lambda p: let(F.try_variant_get(node, p, _NAMED), _named)
    item = lambda p: let(_text(node, p), lambda t: F.when(_holds(t, "{"), of(p)).otherwise(_plain(t)))
    return F.when(_holds(text, "{"), of(path)).when(_holds(text, "["), item(f"{path}[0]")).otherwise(_some(text))


# Units of pay and the words that tell them.
UNITS = {"HOUR": "por hora", "DAY": "diario", "WEEK": "semanal", "MONTH": "mensual", "YEAR": "anual"}


_AMOUNT = "struct<unitText: string, minValue: string, maxValue: string, value: string>"


def _amount(sign: Column, of: Column) -> Column:
    unit = F
    for k, word in UNITS.items():
        unit = unit.when(F.upper(of["unitText"]) == k, word)
    unit = unit.otherwise("mensual")
    known = lambda k: F.when((of[k] != "") & (of[k] != "0"), of[k])
    low, high = known("minValue"), known("maxValue")
    single = F.concat(sign, F.coalesce(known("value"), low, high), F.lit(" "), unit)
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(sign, low, F.lit(" a "), sign, high, F.lit(" "), unit)).otherwise(single)


def _pay(node: Column, pay: Column) -> Column:
    """The pay of a node as text: a range, one amount, or what it says."""
    base = "$.baseSalary"
    sign = F.when(F.coalesce(_some(pay["currency"]), _some(pay["currencyCode"]), F.lit("PEN")) == "PEN", "S/ ").otherwise("US$ ")
    told = F.when(pay["value"].isNotNull(), _amount(sign, pay["value"])).otherwise(F.concat(sign, let(_text(node, f"{base}.value"), _plain)))
    said = let(_text(node, base), lambda t: F.when(F.try_variant_get(node, base, "double").isNull() | ~t.rlike(r"^[0-9.eE+-]+$"), _plain(t)))
    return F.coalesce(F.when(pay.isNotNull(), told).otherwise(said), F.lit(""))


_ADDRESS = "struct<addressLocality: string, addressRegion: string>"


def _place(node: Column, place: Column) -> Column:
    """The place of a node: locality and region, or its street, or what it says."""
    parts = lambda a: _some(F.concat_ws(", ", _some(a["addressLocality"]), _some(a["addressRegion"])))
    address = lambda a, path: F.when(a.isNotNull(), parts(a)).otherwise(let(_text(node, path), _plain))
    listed = "$.jobLocation[0].address"
    of_list = let(F.try_variant_get(node, listed, _ADDRESS), lambda a: address(a, listed))
    other = let(_text(node, "$.jobLocation"), lambda t: F.when(_holds(t, "["), of_list).otherwise(_plain(t)))
    return F.coalesce(F.when(place.isNotNull(), address(place["address"], "$.jobLocation.address")).otherwise(other), F.lit(""))


#: What a node holds, as it mostly stands there; what has another form is null here, or a text of JSON. Texts of
#: objects take long to make, so they aren't asked for where an object is usual.
_POSTING = f"""struct<title: string, hiringOrganization: {_NAMED}, jobLocation: struct<address: {_ADDRESS}>, baseSalary: struct<currency: string, currencyCode: string, value: {_AMOUNT}>,
datePosted: string, validThrough: string, jobLocationType: string, description: string, identifier: struct<value: string>>"""


def job_posting_fields(node: Column) -> Column:
    """struct of a JobPosting node: title, employer, location, salary text, dates, mode, body, id.

    What a node holds is read once; other forms are looked for only where the usual one isn't there."""

    def fields(p: Column) -> Column:
        day = lambda k: F.try_to_date(F.substring(F.trim(p[k]), 1, 10), "yyyy-MM-dd")
        text = lambda k: F.coalesce(_inside(node, f"$.{k}", p[k]), F.lit(""))
        employer, id_ = p["hiringOrganization"], p["identifier"]
        employer = F.when(employer.isNotNull(), _named(employer)).otherwise(let(_text(node, "$.hiringOrganization"), lambda t: _inside(node, "$.hiringOrganization", t)))
        id_ = F.when(id_.isNotNull(), id_["value"]).otherwise(let(_text(node, "$.identifier"), _plain))
        return F.struct(
            F.trim(text("title")).alias("puesto"), F.trim(F.coalesce(employer, F.lit(""))).alias("empresa"), _place(node, p["jobLocation"]).alias("ubicacion"), _pay(node, p["baseSalary"]).alias("sueldo_texto"),
            day("datePosted").alias("publicado"), day("validThrough").alias("vence"),
            F.when(F.upper(text("jobLocationType")).contains("TELECOMMUTE"), "remoto").otherwise("").alias("modalidad"), F.coalesce(p["description"], F.lit("")).alias("cuerpo"), F.coalesce(id_, F.lit("")).alias("id_externo"),
        )

    return let(F.try_variant_get(node, "$", _POSTING), fields)


GREENHOUSE = "struct<jobs:array<struct<id:string,title:string,absolute_url:string,content:string,location:struct<name:string>,updated_at:string>>>"
LEVER = "array<struct<id:string,text:string,hostedUrl:string,descriptionPlain:string,lists:array<struct<text:string,content:string>>,categories:struct<location:string>,createdAt:bigint,salaryRange:struct<currency:string,min:double,max:double>>>"


def greenhouse(payload: DataFrame, json: str = "json") -> DataFrame:
    """A row for each job of a board's JSON."""
    from ..functions.text import unescape

    jobs = payload.select(*(c for c in payload.columns if c != json), F.explode(F.from_json(json, GREENHOUSE)["jobs"]).alias("j"))
    return jobs.select(*(c for c in payload.columns if c != json), F.col("j.id").alias("id_externo"), F.col("j.absolute_url").alias("url"), F.col("j.title").alias("puesto"), unescape(F.col("j.content")).alias("descripcion_html"), F.coalesce("j.location.name", F.lit("")).alias("ubicacion_texto"), flexible_date(F.col("j.updated_at")).alias("publicado"))


def lever(payload: DataFrame, json: str = "json") -> DataFrame:
    """A row for each job of a board's JSON; the lists are appended to the body."""
    jobs = payload.select(*(c for c in payload.columns if c != json), F.explode(F.from_json(json, LEVER)).alias("j"))
    lists = F.array_join(F.transform(F.coalesce("j.lists", F.array().cast("array<struct<text:string,content:string>>")), lambda x: F.concat(F.lit("<p>"), F.coalesce(x["text"], F.lit("")), F.lit("</p>"), F.coalesce(x["content"], F.lit("")))), "")
    pay = F.when(F.col("j.salaryRange").isNotNull(), F.format_string("%s %.0f a %.0f", "j.salaryRange.currency", "j.salaryRange.min", "j.salaryRange.max"))
    return jobs.select(*(c for c in payload.columns if c != json), F.col("j.id").alias("id_externo"), F.col("j.hostedUrl").alias("url"), F.col("j.text").alias("puesto"), F.concat(F.coalesce("j.descriptionPlain", F.lit("")), lists).alias("descripcion_html"), F.coalesce("j.categories.location", F.lit("")).alias("ubicacion_texto"), F.coalesce(pay, F.lit("")).alias("sueldo_texto"), flexible_date(F.col("j.createdAt").cast("string")).alias("publicado"))


# Hints of documents and official pages, with weights; hosts that are no official pages.
PDF_HINTS = ((("bases", "base del concurso", "base de concurso"), 10), (("perfil", "puesto"), 8), (("anuncio", "convocatoria"), 6), (("terminos de referencia", "tdr"), 6), (("cronograma", "resultados", "anexo", "formato", "declaracion"), -10))
OFFICIAL_HINTS = ("oficial", "anuncio", "postular", "bases", "convocatoria", "trabaja con nosotros", "ver mas")
SOCIAL_HOSTS = ("facebook", "twitter", "wa.me", "instagram", "linkedin", "google", "youtube")


def resolve(base: Column, href: Column) -> Column:
    """A link as a browser follows it from a page's address: absolute, of the host, or of the page's folder; dot segments are taken out."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    path = F.substring(bare, F.char_length(root) + 1, F.char_length(bare))
    folder = F.regexp_replace(path, r"[^/]*$", "")
    query = F.regexp_extract(href, r"([?#].*)$", 1)
    target = F.regexp_replace(href, r"[?#].*$", "")
    joined = F.when(target.startswith("/"), target).when(target == "", path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), target))
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(x == ".", kept).otherwise(F.array_append(kept, x))
    parts = F.split(joined, "/")
    clean = F.array_join(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.array(F.lit("")), step), "/")
    ending = F.when(joined.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", base)
        .otherwise(F.concat(root, clean, ending, query))
    )


def _links(pages: DataFrame, pattern: str, keep: list[str]) -> DataFrame:
    group = lambda k, name: F.regexp_extract_all("html", F.lit(pattern), F.lit(k)).alias(name)
    each = pages.select(*keep, F.posexplode(F.arrays_zip(group(1, "href"), group(2, "label"))).alias("pos", "x"))
    return each.select(*keep, "pos", F.trim("x.href").alias("href"), fold(F.concat_ws(" ", "x.href", F.regexp_replace("x.label", "<[^>]+>", " "))).alias("context"))


def _best(links: DataFrame, keep: list[str]) -> DataFrame:
    by_page = Window.partitionBy(*keep)
    first = links.groupBy(*keep, "href").agg(F.min(F.struct((-F.col("score")).alias("low"), "pos")).alias("m"))
    return first.select(*keep, "href", (-F.col("m.low")).alias("score"), F.row_number().over(by_page.orderBy("m.low", "m.pos")).alias("rank"))


def pdf_links(pages: DataFrame, keep: list[str], base: str | None = None) -> DataFrame:
    """keep, href, score, rank of a page's PDF links, most promising first; relative ones are resolved from column ``base``."""
    links = _links(pages, r"""(?is)<a[^>]+href=["']([^"']+\.pdf[^"']*)["'][^>]*>(.*?)</a>""", [*dict.fromkeys([*keep, *([base] if base else [])])])
    if base:
        from_page = F.when(F.col(base).endswith("/"), F.col(base)).otherwise(F.concat(base, F.lit("/")))
        links = links.withColumn("href", resolve(from_page, F.col("href")))
    score = sum((F.when(any_of(F.col("context"), words), weight).otherwise(0) for words, weight in PDF_HINTS), F.lit(0))
    return _best(links.withColumn("score", score), keep)


def official_links(pages: DataFrame, keep: list[str], host: str = "host") -> DataFrame:
    """keep, href, score, rank of links to other hosts that look official (E3); pages have their ``host``."""
    links = _links(pages, r"""(?is)<a[^>]+href=["'](https?://[^"']+)["'][^>]*>(.*?)</a>""", [*keep, host])
    links = links.withColumn("to", F.regexp_extract("href", r"^https?://([^/?#]+)", 1))
    score = F.when(F.col("to").contains(".gob.pe"), 6).otherwise(0) + sum((F.when(F.col("context").contains(h), 3).otherwise(0) for h in OFFICIAL_HINTS), F.lit(0))
    good = links.filter((F.col("to") != F.col(host)) & ~any_of(F.col("to"), SOCIAL_HOSTS)).withColumn("score", score).filter("score > 0")
    return _best(good, keep)


# What the law grants in each labour regime, under the heading that the reader of benefits knows.
REGIME_BENEFITS = {
    "CAS": (
        "Régimen CAS (D. Leg. 1057): afiliación a EsSalud a cargo de la entidad",
        "Afiliación a un régimen pensionario (ONP o AFP) a elección",
        "30 días calendario de vacaciones al año",
        "Aguinaldos por Fiestas Patrias y Navidad según la ley de presupuesto",
        "Jornada máxima de 48 horas semanales",
    ),
    "728": (
        "Régimen laboral privado (D. Leg. 728): planilla con todos los beneficios de ley",
        "Gratificaciones de julio y diciembre",
        "Compensación por Tiempo de Servicios (CTS)",
        "30 días calendario de vacaciones al año",
        "Seguro de salud EsSalud y afiliación pensionaria",
    ),
    "276": (
        "Régimen de carrera administrativa (D. Leg. 276): nombramiento o contrato en planilla",
        "Aguinaldos por Fiestas Patrias y Navidad",
        "30 días calendario de vacaciones al año",
        "Seguro de salud EsSalud y afiliación pensionaria",
        "Escala remunerativa y línea de carrera del sector público",
    ),
}


def statutory_benefits(name: Column) -> Column:
    """The regime's benefits as a block of HTML with its heading, else empty."""
    out = F
    for k, items in REGIME_BENEFITS.items():
        out = out.when(name == k, "<p>Beneficios</p><ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
    return out.otherwise("")


def _benefit_lines(name: Column) -> Column:
    """The lines of statutory_benefits, which are fixed."""
    out = F
    for k, items in REGIME_BENEFITS.items():
        out = out.when(name == k, F.array(F.lit("Beneficios"), *map(F.lit, items)))
    return out.otherwise(F.array().cast("array<string>"))


def public_postings(pages: DataFrame, source: Column, lines: bool = False) -> DataFrame:
    """A raw posting for each page (url, html) of a public tender that has a title (M5).

    The title is the heading's, the JSON-LD's or the site's; pay, place and dates are those of the
    sheet, then of the JSON-LD, then of the description. The body is the description, the JSON-LD's
    body, the whole page, and the benefits of the regime. With ``lines``, ``lineas`` are those of the body, put together
    from the page's where its parts are closed."""
    page = F.col("html")
    df = once(pages.select("url", F.coalesce("html", F.lit("")).alias("html")), node=job_posting_node(page), lines=html_to_lines(page), described=meta(page, "description"), named=meta(page, "og:title"))
    df = once(df, j=F.when(F.col("node").isNotNull(), job_posting_fields(F.col("node"))), low=F.lower(F.array_join("lines", "\n")), about=F.coalesce(_some(F.col("described")), meta(page, "og:description")))
    df = once(df, low_lines=F.split("low", "\n", -1))
    # a label that stands nowhere isn't looked for line by line
    value = lambda x: F.when(F.col("low").contains(x.lower()), value_beside(F.col("lines"), x, F.col("low_lines"))).otherwise("")
    beside = lambda *labels: F.coalesce(*(_known(value(x)) for x in labels), F.lit(""))
    date = lambda *labels: (let(value(x), spanish_date) for x in labels)
    title = F.coalesce(_known(heading_text(page)), _known(F.col("j.puesto")), _known(F.trim(F.substring_index("named", " - ", 1))))
    of_site = F.when(F.col("named").contains(" - "), F.trim(F.substring_index(F.regexp_replace("named", r"(?s)^.*? - ", ""), "|", 1)))
    told = F.regexp_extract("about", r"(?i)(?:sueldo|remuneraci[oó]n(?:\s+mensual)?)[:\s]*((?:S/|US\$)\s*[\d.,]+)", 1)
    df = once(
        df, puesto=title, empresa=F.coalesce(_known(F.col("j.empresa")), _known(of_site), beside("Entidad", "Institución")), sueldo_texto=F.coalesce(_known(beside("Sueldo", "Remuneración")), _known(F.col("j.sueldo_texto")), told),
        place=F.coalesce(_known(beside("Ubicación", "Lugar de trabajo")), F.trim(F.concat_ws(" ", "j.ubicacion", "j.modalidad"))), mode=value("Modalidad"), contract=beside("Contrato", "Régimen"),
        publicado=F.coalesce(*date("Publicación", "Fecha de publicación"), F.col("j.publicado")),
        vence=F.coalesce(*date("Fecha límite", "Cierre de postulación"), spanish_date(F.right(F.col("described"), F.lit(60)))),
    ).filter("puesto is not null")
    df = once(df, regimen=regime(F.concat_ws(" ", "contract", "named", "url")))
    benefits = statutory_benefits(F.col("regimen"))
    body = F.concat(F.lit("<p>"), "about", F.lit("</p>"), F.coalesce("j.cuerpo", F.lit("")), "html", benefits)
    parts = F.concat(html_to_lines(F.concat(F.lit("<p>"), "about", F.lit("</p>"))), F.col("lines"), _benefit_lines(F.col("regimen")))
    apart = ~F.col("about").contains("<") & (F.coalesce("j.cuerpo", F.lit("")) == "") & closed(page)
    more = [F.when(apart, parts).otherwise(html_to_lines(body)).alias("lineas")] if lines else []
    extra = {"perfil": F.lit("publico"), "regimen": F.col("regimen"), "contrato": F.col("contract"), "beneficios_de_ley": (benefits != "").cast("string"), "vence": F.coalesce(F.col("vence").cast("string"), F.lit(""))}
    return df.select(
        source.alias("fuente"), "url", "puesto", "empresa", body.alias("descripcion_html"), F.lit("").alias("texto_plano"), F.trim(F.concat_ws(" ", "place", "mode")).alias("ubicacion_texto"), "sueldo_texto", "publicado",
        F.coalesce("j.id_externo", F.lit("")).alias("id_externo"), F.create_map(*(x for k, v in extra.items() for x in (F.lit(k), v))).alias("extra"), *more,
    )
