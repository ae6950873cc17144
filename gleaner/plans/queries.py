"""Registered queries over the given tables, each with its oracle's SQL.

Operators on postings run on columns that are made from the tables by expressions that Spark and
DuckDB read alike, so both sides see the same texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, rules, salary, score, text, titles
from ..operators import analytics, publish, store
from ..sources import crawl, documents, pages
from . import postings, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "1998-08-01"


def register(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A table's rows, dealt evenly over all cores: for work that takes much longer than the rows' way.

    How many tasks its files make says nothing of it: of the pieces of a file only those with the middle
    of a block of rows have rows, so a small table is mostly one task's work."""
    s = df.sparkSession
    return df.repartition(max(4 * s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions()))


def as_of():
    return F.lit(AS_OF).cast("date")


# -- text ----------------------------------------------------------------------------------------


@register("fold_accents", f"select doc_id, md5({sql.fold('text')}) as folded from documents")
def fold_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@register("html_lines", f"select page_id, cast(len(l) as int) as n_lines, l[1] as first_line, md5(array_to_string(l, chr(10))) as lines from (select page_id, {sql.lines('html')} as l from pages)")
def html_lines(spark, d):
    p = text.once(table(spark, d, "pages"), l=text.html_to_lines(F.col("html")))
    return p.select("page_id", F.size("l").alias("n_lines"), F.get("l", F.lit(0)).alias("first_line"), F.md5(F.array_join("l", "\n")).alias("lines"))


#: A posting's page, made from an order: sections come and go with its key.
POSTING_HTML = (
    "concat('<html><body><p>Empresa del rubro ', lower(o_orderpriority), ' con amplia cartera de clientes a nivel nacional.</p>',"
    " case when o_orderkey % 5 = 0 then '' else '<h2>Funciones del puesto:</h2>' end,"
    " '<ul><li>Gestionar el pedido numero ', cast(o_orderkey as varchar(20)), ' del cliente asignado.</li><li>Elaborar reportes de ventas del cliente ', cast(o_custkey as varchar(20)), '</li><li>1) Coordinar despachos</li><li>Coordinar DESPACHOS</li></ul>',"
    " case when o_orderkey % 3 = 0 then '<h3>REQUISITOS</h3>' else '<div>Requisitos minimos</div>' end,"
    " '<p>- Experiencia de ', cast(o_orderkey % 4 + 1 as varchar(20)), ' a&ntilde;os en el cargo<br/>Manejo de Excel &amp; reportes<br>Disponibilidad inmediata</p>',"
    " case when o_orderkey % 2 = 0 then '<p>Beneficios: Planilla completa desde el primer d&iacute;a</p><p>Seguro EPS al 100%</p>' else '<p>Te ofrecemos</p><p>Grato ambiente</p>' end,"
    " '<p>Cronograma del proceso</p><p>Entrevistas virtuales durante la semana</p></body></html>')"
)
_SECTIONS = f"""
with l as (select o_orderkey, unnest(range(len(x))) as pos, unnest(x) as line from (select o_orderkey, {sql.lines(POSTING_HTML)} as x from orders)),
h as (select *, {sql.heading('line')} as opens from l),
s as (select *, coalesce(last_value(opens ignore nulls) over (partition by o_orderkey order by pos), 'intro') as section,
  case when opens is null then line when length(trim(regexp_extract(line, '^[^:]*:(.*)$', 1))) > 15 then trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) end as content from h)
"""


@register("sections", _SECTIONS + "select o_orderkey, " + ", ".join(f"cast(count(*) filter (section = '{s}' and content is not null) as int) as {s}" for s in ("intro", "funciones", "requisitos", "beneficios", "descartado")) + " from s group by o_orderkey")
def sections(spark, d):
    o = dealt(table(spark, d, "orders")).select("o_orderkey", F.expr(POSTING_HTML).alias("html"))
    o = text.once(o, lines=text.html_to_lines(F.col("html")))
    o = text.once(o, b=text.partition(F.col("lines")))
    return o.select("o_orderkey", *(F.size(f"b.{s}").alias(s) for s in ("intro", "funciones", "requisitos", "beneficios", "descartado")))


@register("items_clean", f"select doc_id, cast(len(i) as int) as n, md5(array_to_string(i, chr(10))) as items from (select doc_id, {sql.clean_items('string_split(text, chr(10))')} as i from documents)")
def items_clean(spark, d):
    i = text.once(table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l")), i=text.clean_items(F.col("l")))
    return i.select("doc_id", F.size("i").alias("n"), F.md5(F.array_join("i", "\n")).alias("items"))


_FIRST = f"rtrim(split_part({sql.fold('x')}, ' ', 1), ',.:')"
_VERBS = ", ".join(sql.lit(text.fold_python(v)) for v in rules.DUTY_VERBS)


@register("rescue_duties", f"select doc_id, cast(len(list_filter(string_split(text, chr(10)), lambda x: {_FIRST} in ({_VERBS}) or (ends_with({_FIRST}, 'ar') and length({_FIRST}) > 5))) as int) as n from documents")
def rescue_duties(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.rescue_duties(F.split("text", "\n"))).alias("n"))


_FILLER_TEXT = "case when p_partkey % 4 = 0 then concat('Excelente ambiente laboral: ', p_name) else p_name end"


@register("filler_flag", f"select p_partkey, {sql.has_any(sql.fold(_FILLER_TEXT), rules.FILLER)} and length({_FILLER_TEXT}) < 60 as filler from part")
def filler_flag(spark, d):
    return dealt(table(spark, d, "part")).select("p_partkey", text.is_filler(F.expr(_FILLER_TEXT)).alias("filler"))


@register("summaries", _SECTIONS + f"select o_orderkey, coalesce(min_by(content, pos) filter (section = 'intro' and length(content) between 40 and 240), '') as resumen from s where content is not null group by o_orderkey")
def summaries(spark, d):
    o = dealt(table(spark, d, "orders")).select("o_orderkey", F.expr(POSTING_HTML).alias("body"))
    return text.with_blocks(o, lists=()).select("o_orderkey", text.summary(F.col("intro"), F.col("funciones"), F.lit("Operario de produccion")).alias("resumen"))


# -- salary --------------------------------------------------------------------------------------

_A = "(700 + o_orderkey % 4000)"
PAY_TEXT = (
    f"case o_orderkey % 8 when 0 then concat('Sueldo: S/ ', cast({_A} as varchar(20)), ' mensuales') when 1 then concat('entre ', cast({_A} as varchar(20)), ' y ', cast({_A} + 500 as varchar(20)), ' soles')"
    " when 2 then concat('pago de S/ ', cast(30 + o_orderkey % 200 as varchar(20)), ' diarios') when 3 then concat('US$ ', cast(1000 + o_orderkey % 900 as varchar(20)))"
    f" when 4 then concat('S/ ', cast({_A} as varchar(20)), ' a convenir') when 5 then 'Sueldo base: S/ 1,130. Comisiones de hasta S/ 600.' when 6 then concat('Bono de S/ ', cast({_A} as varchar(20))) else 'Postula hoy mismo' end"
)
_DAILY = "cast(round_even((30 + o_orderkey % 200) * 26.0, 0) as int)"


@register(
    "salary_parse",
    f"""select o_orderkey, cast(case o_orderkey % 8 when 0 then {_A} when 1 then {_A} when 2 then case when {_DAILY} between 500 and 80000 then {_DAILY} end when 3 then 1000 + o_orderkey % 900 when 5 then 1130 end as int) as minimo,
    cast(case o_orderkey % 8 when 0 then {_A} when 1 then {_A} + 500 when 2 then case when {_DAILY} between 500 and 80000 then {_DAILY} end when 3 then 1000 + o_orderkey % 900 when 5 then 1130 end as int) as maximo,
    case when o_orderkey % 8 = 3 then 'USD' when o_orderkey % 8 in (0, 1, 2, 5) then 'PEN' end as moneda,
    cast(case o_orderkey % 8 when 0 then 100 when 1 then 100 when 2 then 70 when 3 then 90 when 5 then 100 end as int) as confianza from orders""",
)
def salary_parse(spark, d):
    o = text.once(dealt(table(spark, d, "orders")).select("o_orderkey", F.expr(PAY_TEXT).alias("t")), s=salary.extract_salary(F.col("t")))
    return o.select("o_orderkey", "s.minimo", "s.maximo", "s.moneda", "s.confianza")


_PERIOD = "case o_orderkey % 6 when 0 then 'anual' when 1 then 'quincenal' when 2 then 'semanal' when 3 then 'diario' when 4 then 'por hora' else 'mensual' end"
_FACTOR = "case o_orderkey % 6 when 0 then 1.0::double / 12.0 when 1 then 2.0 when 2 then 4.33::double when 3 then 26.0 when 4 then 208.0 else 1.0 end"


@register("salary_monthly", f"select o_orderkey, {_PERIOD} as periodo, cast(round_even(cast(o_custkey as double) * ({_FACTOR}), 0) as bigint) as mensual, o_custkey between case o_orderkey % 6 when 0 then 8000 when 1 then 400 when 2 then 200 when 3 then 30 when 4 then 6 else 500 end and case o_orderkey % 6 when 0 then 900000 when 1 then 10000 when 2 then 3000 when 3 then 700 when 4 then 150 else 80000 end as creible from orders")
def salary_monthly(spark, d):
    o = table(spark, d, "orders").withColumn("periodo", F.expr(_PERIOD))
    return o.select("o_orderkey", "periodo", salary.monthly(F.col("o_custkey"), F.col("periodo")).alias("mensual"), salary.credible(F.col("o_custkey"), F.col("periodo")).alias("creible"))


_TWO = "concat('Remuneración: S/ ', cast(1130 + o_orderkey % 3 as varchar(20)), '. Jornada parcial, Remuneración: S/ ', cast(1130 + o_custkey % 3 as varchar(20)), '.')"


@register("salary_ambiguous", "select o_orderkey, o_orderkey % 3 <> o_custkey % 3 as varios from orders")
def salary_ambiguous(spark, d):
    return dealt(table(spark, d, "orders")).select("o_orderkey", salary.declares_several(F.expr(_TWO)).alias("varios"))


_VAGUE = "concat(text, case when doc_id % 5 = 0 then ' Sueldo  A Convenir' else '' end)"


@register("vague_pay", f"select doc_id, {sql.has_any('lower(regexp_replace(' + _VAGUE + ', chr(92) || chr(115) || chr(43), chr(32), chr(103)))', rules.VAGUE_PAY)} as vago from documents")
def vague_pay(spark, d):
    return table(spark, d, "documents").select("doc_id", salary.declares_vague(F.expr(_VAGUE)).alias("vago"))


@register("salary_choice", "select o_orderkey, cast(case when o_orderkey % 7 = 0 then null else coalesce(case when o_orderkey % 3 = 0 then o_custkey end, case when o_orderkey % 2 = 0 then o_orderkey end, 1130) end as bigint) as elegido, cast(case when o_orderkey % 4 = 0 then floor(o_custkey * 3.75) else o_custkey end as int) as en_soles from orders")
def salary_choice(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = salary.choose(k % 7 == 0, F.when(k % 3 == 0, c), F.when(k % 2 == 0, k), F.lit(1130).cast("bigint"))
    return table(spark, d, "orders").select("o_orderkey", pick.alias("elegido"), salary.in_pen(c, F.when(k % 4 == 0, "USD").otherwise("PEN")).alias("en_soles"))


@register("salary_text", "select o_orderkey, case when o_custkey % 3 = 0 then 'Sin sueldo' when o_custkey % 3 = 1 then concat('S/ ', format('{:,}', o_custkey), ' – S/ ', format('{:,}', o_custkey + 1500)) else concat('US$ ', format('{:,}', o_custkey)) end as sueldo from orders")
def salary_text(spark, d):
    c = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", salary.salary_text(F.when(c % 3 == 0, F.lit(0).cast("bigint")).otherwise(c), F.when(c % 3 == 1, c + 1500).otherwise(F.lit(0).cast("bigint")), F.when(c % 3 == 1, "PEN").otherwise("USD")).alias("sueldo"))


# -- classification and titles -------------------------------------------------------------------

_WORDS = ("Asesor de Ventas", "Practicante de Auditoría", "Médico ocupacional", "Operario de almacén", "Ingeniero civil", "Abogada", "Cocinero", "Analista de datos", "Jefe de obra", "Recepcionista", "Papa Johns", "Atención al Cliente", "Docente de inglés")
_TITLE = f"concat(case p_partkey % {len(_WORDS)} " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(_WORDS)) + " end, ' ', p_name)"
_PLACES = ("Trujillo", "San Isidro", "Junín", "Breña, Lima Metropolitana", "Cerro de Pasco", "Madre de Dios", "Quito", "Ñaña", "Áncash")
_WHERE = f"concat(case p_partkey % {len(_PLACES)} " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(_PLACES)) + " end, ' ', p_type)"
_MODE = "concat(p_name, case p_partkey % 4 when 0 then ' trabajo Híbrido' when 1 then ' 100% remoto' when 2 then ' presencial' else '' end)"


@register("category", f"select p_partkey, {sql.category(_TITLE, 'p_type')} as categoria from part")
def category(spark, d):
    return dealt(table(spark, d, "part")).select("p_partkey", classify.category(F.expr(_TITLE), F.col("p_type")).alias("categoria"))


@register("place", f"select p_partkey, {sql.place(f'concat({_WHERE}, chr(32), p_name)', 'ciudad')} as ciudad, {sql.place(f'concat({_WHERE}, chr(32), p_name)', 'departamento')} as departamento from part")
def place(spark, d):
    p = text.once(dealt(table(spark, d, "part")), w=classify.place(F.expr(_WHERE), F.col("p_name")))
    return p.select("p_partkey", "w.ciudad", "w.departamento")


@register("work_mode", f"select p_partkey, {sql.work_mode(_MODE)} as modalidad from part")
def work_mode(spark, d):
    return dealt(table(spark, d, "part")).select("p_partkey", classify.work_mode(F.expr(_MODE)).alias("modalidad"))


@register("detect_ats", "select page_id, case page_id % 4 when 0 then 'greenhouse' when 1 then 'lever' when 2 then 'workday' else '' end as ats from pages")
def detect_ats(spark, d):
    mark = "concat(url, case page_id % 4 when 0 then ' https://Boards.Greenhouse.io/x' when 1 then ' https://jobs.lever.co/x' when 2 then ' https://x.myworkdayjobs.com' else '' end)"
    return table(spark, d, "pages").select("page_id", classify.detect_ats(F.expr(mark)).alias("ats"))


@register("names_job", f"select p_partkey, {sql.has_any(sql.fold(_TITLE), rules.COMPOUND_TITLES)} or {sql.has_word(sql.fold(_TITLE), rules.TRADES)} as nombra from part")
def names_job(spark, d):
    return dealt(table(spark, d, "part")).select("p_partkey", titles.names_job(F.expr(_TITLE)).alias("nombra"))


_TRADE = "case p_partkey % 3 when 0 then 'operario' when 1 then 'vendedora' else 'analista' end"
_HOOK = f"concat('¡GANA MÁS DE ', cast(1000 + p_partkey % 900 as varchar(20)), ' SOLES! ', upper({_TRADE}), ' DE ', upper(replace(lower(p_brand), '#', '')), ' (LIMA) / PLANILLA COMPLETA - INGRESO INMEDIATO')"


@register("clean_title", f"select p_partkey, concat(upper(left({_TRADE}, 1)), substr({_TRADE}, 2), ' de ', upper(left(lower(replace(p_brand, '#', '')), 1)), substr(lower(replace(p_brand, '#', '')), 2)) as puesto from part")
def clean_title(spark, d):
    return titles.with_clean_title(dealt(table(spark, d, "part")), F.expr(_HOOK), "puesto").select("p_partkey", "puesto")


@register("deduce_title", f"select p_partkey, case p_partkey % 4 when 0 then 'Atencion al cliente' when 3 then null else concat(upper(left({_TRADE}, 1)), substr({_TRADE}, 2), ' de planta') end as puesto from part")
def deduce_title(spark, d):
    summary = f"case p_partkey % 4 when 0 then concat('Buscamos {{}} de atencion al cliente', p_brand) when 3 then 'Trabaja cerca de casa' else concat('Se busca ', {_TRADE}, ' de planta para Lima') end"
    none = F.array().cast("array<string>")
    return dealt(table(spark, d, "part")).select("p_partkey", titles.deduce_title(F.expr(summary), none, none).alias("puesto"))


@register("fingerprint", f"select p_partkey, {sql.fingerprint(_TITLE, 'p_brand', 'p_type')} as huella from part")
def fingerprint(spark, d):
    return dealt(table(spark, d, "part")).select("p_partkey", titles.fingerprint(F.expr(_TITLE), F.col("p_brand"), F.col("p_type")).alias("huella"))


@register("run_dedupe", "select huella, p_partkey, n_copies from (select *, row_number() over (partition by huella order by p_size, p_partkey) as n, count(*) over (partition by huella) as n_copies from (select p_partkey, p_size, " + sql.fingerprint("p_brand", "p_type", "''") + " as huella from part)) where n = 1")
def run_dedupe(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", titles.fingerprint(F.col("p_brand"), F.col("p_type"), F.lit("")).alias("huella"))
    return postings.dedupe_run(p, "huella", "p_size", "p_partkey").select("huella", "p_partkey", "n_copies")


# -- scoring -------------------------------------------------------------------------------------

_N = {"funciones": "o_orderkey % 7", "requisitos": "o_custkey % 6", "beneficios": "(o_orderkey + o_custkey) % 5"}
_DAY = f"cast(o_orderdate as date)"
_AGE = f"datediff('day', cast(o_orderdate as date), date '{AS_OF}')"
_RUBRIC = f"""
with c as (select o_orderkey, {_N['funciones']} as f, {_N['requisitos']} as r, {_N['beneficios']} as b, case when o_orderkey % 4 = 0 then 'publico' else 'privado' end as perfil, {_AGE} as age, o_orderkey % 9 = 0 as sin, o_custkey % 10 = 0 as oculta from orders),
p as (select *, case when sin then 0 when o_orderkey % 2 = 0 then 30 else 27 end as sueldo,
 case when f < least then f * 4 when f = 0 then 0 else (case when f >= 3 then 14 else 9 end) + (case when f >= 5 then 5 when f = 4 then 3 else 0 end) + 3 end as funciones,
 case when r < 3 then r * 3 else 11 + (case when r >= 5 then 3 else 0 end) + 6 end as requisitos,
 case when b < 2 then b * 3 else 8 + (case when b >= 3 then 7 else 5 end) end as beneficios,
 (case when oculta then 0 else 4 end) + 3 + 1 + (case when age <= 3 then 2 when age <= 10 then 1 else 0 end) as metadata
 from (select *, case when perfil = 'publico' then 0 else 3 end as least, case when perfil = 'publico' then 21 else 45 end as days from c)),
m as (select *, sueldo + funciones + requisitos + beneficios + metadata as total, list_filter([case when sin then 'No declara sueldo' end, case when f < least then concat('Solo ', f, ' funciones detalladas (mínimo ', least, ')') end,
 case when r < 3 then concat('Solo ', r, ' requisitos (mínimo 3)') end, case when b < 2 then concat('Solo ', b, ' beneficios listados (mínimo 2)') end,
 case when age > days then concat('No dice hasta cuándo postular y se publicó hace ', age, ' días (máximo ', days, ' sin fecha de cierre)') end, case when age > 60 then concat('Publicado hace ', age, ' días (máximo 60)') end], lambda x: x is not null) as why from p),
e as (select *, case when len(why) = 0 and total < 70 then [concat('Score ', total, ' por debajo del umbral 70')] else why end as motivos from m)
"""


def _stored(spark, d) -> DataFrame:
    """Orders as stored postings, with as many duties, requirements and benefits as their keys say."""
    n = lambda k: F.expr(_N[k]).cast("int")
    # items of 46, 30 and 30 characters that name what makes them concrete
    items = lambda k, t: F.transform(F.when(n(k) > 0, F.sequence(F.lit(1), n(k))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit(t), i.cast("string"))).alias(k)
    k = F.col("o_orderkey")
    return dealt(table(spark, d, "orders")).select(
        "o_orderkey", "o_custkey", F.when(k % 9 != 0, 2000).otherwise(0).alias("sueldo_min"), F.when(k % 2 == 0, 2500).otherwise(2000).alias("sueldo_max"), F.lit("PEN").alias("moneda"), F.lit(95).alias("sueldo_confianza"),
        items("funciones", "Coordinar la atencion de pedidos de la zona n"), items("requisitos", "Experiencia en el cargo, nivel"), items("beneficios", "Planilla y seguro desde el mes"),
        F.when(F.col("o_custkey") % 10 == 0, "Importante Empresa del rubro").otherwise("Textiles Andinos").alias("empresa"), F.lit("Lima").alias("ciudad"), F.lit("Presencial").alias("modalidad"), F.to_date("o_orderdate").alias("publicado"),
        F.lit(None).cast("date").alias("vence"), F.lit("").alias("resumen"), F.when(k % 4 == 0, "publico").otherwise("privado").alias("perfil"),
    )


def _scored(spark, d) -> DataFrame:
    t = _stored(spark, d)
    pay = F.when(F.col("sueldo_min") > 0, F.struct(F.col("sueldo_min").alias("minimo"), F.col("sueldo_max").alias("maximo"), "moneda", F.lit("mensual").alias("periodo"), F.lit("").alias("literal"), F.col("sueldo_confianza").alias("confianza")))
    result = score.evaluate(pay, *(F.col(c) for c in ("funciones", "requisitos", "beneficios", "empresa", "ciudad", "modalidad", "publicado", "vence", "resumen", "perfil")), as_of())
    return text.once(t, r=result).select("o_orderkey", "r")


@register("score_rubric", _RUBRIC + "select o_orderkey, cast(sueldo as int) as sueldo, cast(funciones as int) as funciones, cast(requisitos as int) as requisitos, cast(beneficios as int) as beneficios, cast(metadata as int) as metadata, cast(total as int) as total, array_to_string(motivos, '; ') as motivos, len(motivos) = 0 and total >= 70 as aprobada from e")
def score_rubric(spark, d):
    return _scored(spark, d).select("o_orderkey", *(f"r.{p}" for p in ("sueldo", "funciones", "requisitos", "beneficios", "metadata", "total")), F.array_join("r.motivos", "; ").alias("motivos"), ((F.size("r.motivos") == 0) & (F.col("r.total") >= 70)).alias("aprobada"))


@register("reason_histogram", _RUBRIC + "select regexp_replace(unnest, '[0-9]+', 'N', 'g') as motivo, count(*) as n from (select unnest(motivos) as unnest from e) group by 1")
def reason_histogram(spark, d):
    return postings.reason_histogram(_scored(spark, d).select(F.col("r.motivos").alias("motivos_rechazo")))


@register("run_metrics", _RUBRIC + f"select count(*) as leidas, count(*) filter (ok) as aprobadas, count(*) filter (not ok) as rechazadas, count(distinct h) as distintas, count(*) - count(distinct h) as duplicadas, {sql.percent('count(*) filter (ok)', 'count(*)', 1)} as tasa from (select len(motivos) = 0 and total >= 70 as ok, md5(cast(o_orderkey % 1000 as varchar)) as h from e)")
def run_metrics(spark, d):
    s = _scored(spark, d).select(((F.size("r.motivos") == 0) & (F.col("r.total") >= 70)).alias("aprobada"), F.md5((F.col("o_orderkey") % 1000).cast("string")).alias("huella"))
    return postings.run_metrics(s)


#: The page of a posting whose sections, words and dates come and go with its key.
CHAIN_HTML = POSTING_HTML.replace("'<p>Beneficios: Planilla completa desde el primer d&iacute;a</p>", "'<h3>Beneficios</h3><p>Planilla completa desde el primer d&iacute;a</p>").replace("'<html><body><p>Empresa", "'<html><body><p>', case when o_orderkey % 12 = 5 then 'Se busca cocinero de planta para una empresa' else 'Empresa' end, '")
_PAID_CHAIN = f"""case o_orderkey % 8 when 0 then {_A} when 1 then {_A} when 2 then {_DAILY} when 3 then 1000 + o_orderkey % 900 when 5 then 1130 else 0 end"""
_CHAIN = f"""
with o as (select *, {_PAID_CHAIN} as low, {_PAID_CHAIN} + case when o_orderkey % 8 = 1 then 500 else 0 end as high, case o_orderkey % 8 when 2 then 70 when 3 then 90 else 100 end as trust, o_orderkey % 70 as age, case when o_orderkey % 4 = 0 then 21 else 45 end as days,
  case when o_orderkey % 3 = 0 then 'Operario de Produccion' when o_orderkey % 3 = 1 then 'Asesor de ventas' when o_orderkey % 12 = 5 then 'Cocinero de planta' else 'Papa Johns' end as title,
  (length(concat('Gestionar el pedido numero ', o_orderkey, ' del cliente asignado.')) + length(concat('Elaborar reportes de ventas del cliente ', o_custkey)) + length('Coordinar despachos')) / 3.0 as mean
  from orders join customer on o_custkey = c_custkey),
p as (select *, case when low = 0 then 0 else 20 + case when high > low then 6 else 3 end + case when trust >= 95 then 4 when trust >= 85 then 2 else 0 end end + 14 + case when mean >= 60 then 6 when mean >= 40 then 3 else 0 end + 17 + case when o_orderkey % 2 = 0 then 13 else 0 end + 8 + case when age <= 3 then 2 when age <= 10 then 1 else 0 end as total,
  list_filter([case when o_orderkey % 8 = 4 then 'Sueldo declarado como ''a convenir'' o similar' when low = 0 then 'No declara sueldo' end, case when o_orderkey % 2 = 1 then 'Solo 0 beneficios listados (mínimo 2)' end,
  case when age > days then concat('No dice hasta cuándo postular y se publicó hace ', age, ' días (máximo ', days, ' sin fecha de cierre)') end, case when age > 60 then concat('Publicado hace ', age, ' días (máximo 60)') end], lambda x: x is not null) as why from o),
r as (select *, list_concat(case when len(why) = 0 and total < 70 then [concat('Score ', total, ' por debajo del umbral 70')] else why end, case when title = 'Papa Johns' then ['El aviso no dice qué puesto es'] else [] end) as reasons from p)
select {sql.fingerprint('title', 'c_name', "'Trujillo'")} as huella, concat('https://x.pe/', o_orderkey) as url, title as puesto, 'Trujillo' as ciudad, case when o_orderkey % 3 = 0 then 'Ingeniería' else 'Ventas' end as categoria, 'Presencial' as modalidad, cast(low as int) as sueldo_min, cast(high as int) as sueldo_max,
  case when o_orderkey % 8 = 3 then 'USD' else 'PEN' end as moneda, cast(total as int) as score, cast(3 as int) as n_funciones, cast(3 as int) as n_requisitos, cast(case when o_orderkey % 2 = 0 then 2 else 1 end as int) as n_beneficios, array_to_string(reasons, '; ') as motivos, len(reasons) = 0 and total >= 70 as aprobada from r
"""


@register("process_postings", _CHAIN)
def process_postings(spark, d):
    """The whole chain from raw postings to scored ones."""
    o = dealt(table(spark, d, "orders")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    age = (F.col("o_orderkey") % 70).cast("int")
    raw = o.select(F.col("o_orderpriority").alias("fuente"), F.concat(F.lit("https://x.pe/"), "o_orderkey").alias("url"), F.expr("case o_orderkey % 3 when 0 then 'OPERARIO DE PRODUCCION / PLANILLA' when 1 then 'Asesor de ventas' else 'Papa Johns' end").alias("puesto"), F.col("c_name").alias("empresa"), F.expr(CHAIN_HTML).alias("descripcion_html"), F.lit("").alias("texto_plano"), F.lit("Trujillo").alias("ubicacion_texto"), F.expr(PAY_TEXT).alias("sueldo_texto"), F.date_sub(as_of(), age).alias("publicado"), F.lit("").alias("id_externo"), F.create_map(F.lit("perfil"), F.when(F.col("o_orderkey") % 4 == 0, "publico").otherwise("privado")).alias("extra"))
    p = postings.process(raw, as_of())
    return p.select("huella", "url", "puesto", "ciudad", "categoria", "modalidad", "sueldo_min", "sueldo_max", "moneda", "score", F.size("funciones").alias("n_funciones"), F.size("requisitos").alias("n_requisitos"), F.size("beneficios").alias("n_beneficios"), F.array_join("motivos_rechazo", "; ").alias("motivos"), "aprobada")


@register("open_postings", f"select o_orderkey from orders where (o_orderkey % 3 = 0 or cast(o_orderdate as date) + 20 >= date '{AS_OF}') and {_AGE} <= 60")
def open_postings(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("publicado"), F.create_map(F.lit("vence"), F.when(F.col("o_orderkey") % 3 != 0, F.date_add(F.to_date("o_orderdate"), 20).cast("string"))).alias("extra"))
    return postings.still_open(o, as_of()).select("o_orderkey")


# -- storage -------------------------------------------------------------------------------------

_KEPT = "select event_id, user_id, event_type, value, cast(ts as date) as publicado, case when event_id % 3 = 0 then cast(ts as date) + 10 end as vence, case when user_id % 2 = 0 then 'publico' else 'privado' end as perfil, event_id % 11 <> 0 as vigente from events"
_SWEEP_AT = "2024-03-01"
_REASON = f"case when vence < date '{_SWEEP_AT}' then 'plazo_vencido' when vence is null and datediff('day', publicado, date '{_SWEEP_AT}') > case when perfil = 'publico' then 21 else 45 end then 'sin_plazo' when datediff('day', publicado, date '{_SWEEP_AT}') > 60 then 'antiguedad' end"


def _kept(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("publicado", F.to_date("ts"))
    return e.select("event_id", "user_id", "event_type", "value", "publicado", F.when(F.col("event_id") % 3 == 0, F.date_add("publicado", 10)).alias("vence"), F.when(F.col("user_id") % 2 == 0, "publico").otherwise("privado").alias("perfil"), (F.col("event_id") % 11 != 0).alias("vigente"))


@register("retention_sweep", f"with k as ({_KEPT}) select motivo_retiro, count(*) as n from (select {_REASON} as motivo_retiro from k where vigente) where motivo_retiro is not null group by 1")
def retention_sweep(spark, d):
    return store.sweep_counts(store.sweep(_kept(spark, d), F.lit(_SWEEP_AT).cast("date")))


@register("skip_set", "select distinct cast(user_id as varchar) as url from events where case when event_type = 'purchase' then epoch(timestamp '2024-03-01' - ts) / 86400.0 < 7 else epoch(timestamp '2024-03-01' - ts) / 86400.0 < 30 end")
def skip_set(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("visto_ultima_vez"), (F.col("event_type") == "purchase").alias("aprobada"))
    return store.skip_set(e, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))


@register("seen_within", "select distinct cast(user_id as varchar) as url from events where epoch(timestamp '2024-01-02' - ts) < 20 * 3600")
def seen_within(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("visto_ultima_vez"))
    return store.seen_within(e, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))


_UPSERT = """with s as (select user_id, event_id, value, ts, event_id % 3 = 0 as old from events),
t as (select * from s where old qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1),
b as (select * from s where not old qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
"""


@register("upsert_latest", _UPSERT + "select coalesce(b.user_id, t.user_id) as user_id, coalesce(b.event_id, t.event_id) as event_id, coalesce(t.ts, timestamp '2030-01-01') as capturado, case when b.user_id is not null then timestamp '2030-01-01' else t.ts end as visto from b full join t on b.user_id = t.user_id")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    held = store.newest(e.filter("event_id % 3 = 0"), "user_id", ("ts", "event_id")).select("user_id", "event_id", F.col("ts").alias("capturado"), F.col("ts").alias("visto_ultima_vez"), F.lit(True).alias("vigente"))
    batch = e.filter("event_id % 3 <> 0")
    new = store.upsert(held, batch.withColumnRenamed("ts", "at"), "user_id", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"), ("at", "event_id"))
    return new.select("user_id", "event_id", "capturado", F.col("visto_ultima_vez").alias("visto"))


@register("upsert_status", "select estado, count(*) as n from (select case when b.user_id in (select user_id from events where event_id % 3 = 0) then 'updated' else 'new' end as estado from events b where event_id % 3 <> 0) group by 1")
def upsert_status(spark, d):
    e = table(spark, d, "events")
    return store.statuses(e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0"), "user_id").groupBy("estado").agg(F.count(F.lit(1)).alias("n"))


@register("live_top", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderkey % 2 = 0 order by cast(o_orderdate as date) desc, cast(floor(o_totalprice / 5000) as int) desc, cast(o_orderkey as varchar) limit 500")
def live_top(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("aprobada"), (F.col("o_orderkey") % 2 == 0).alias("vigente"), F.to_date("o_orderdate").alias("publicado"), F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"), F.col("o_orderkey").cast("string").alias("huella"))
    return store.live(o).select("o_orderkey", "o_totalprice")


@register("rejected_top", "select o_orderkey from orders where o_orderstatus <> 'F' order by o_orderdate desc, cast(o_orderkey as varchar) limit 200")
def rejected_top(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("aprobada"), F.col("o_orderdate").alias("capturado"), F.col("o_orderkey").cast("string").alias("huella"))
    return store.rejected(o).select("o_orderkey")


@register("urls_by_source", "select distinct regexp_extract(url, '^https?://([^/?#]+)', 1) as fuente, url from pages where page_id % 3 <> 0")
def urls_by_source(spark, d):
    return store.published_urls(_published(spark, d))


def _published(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("fuente"), (F.col("page_id") % 3 != 0).alias("aprobada"), F.lit(True).alias("vigente"))


@register("repair_urls", "select distinct regexp_extract(url, '^https?://([^/?#]+)', 1) as fuente, url from pages where page_id % 3 <> 0 and url in (select url from pages where page_id % 2 = 0)")
def repair_urls(spark, d):
    """The published URLs of a list to be read again."""
    return store.repair_urls(_published(spark, d), table(spark, d, "pages").filter("page_id % 2 = 0"))


_THEN = "1998-06-10"
_OK = "(" + _RUBRIC + "select o_orderkey, len(motivos) = 0 and total >= 70 as ok, total from e)"


@register("rescore_flips", f"select case when b.ok and not (a.ok and b.o_orderkey % 7 <> 0) then 'entra' when not b.ok and a.ok and b.o_orderkey % 7 <> 0 then 'sale' else 'igual' end as cambio, count(*) as n, cast(sum(b.total) as bigint) as puntos from {_OK.replace(AS_OF, _THEN)} a join {_OK} b on a.o_orderkey = b.o_orderkey group by 1")
def rescore_flips(spark, d):
    """Stored postings, approved as of an earlier day (a seventh of them not), scored anew."""
    before = F.lit(_THEN).cast("date")
    t = _stored(spark, d).withColumns({"motivos_rechazo": F.array().cast("array<string>"), "aprobada": F.lit(True)})
    t = store.rescore(t, before).drop("cambio").withColumn("aprobada", F.col("aprobada") & (F.col("o_orderkey") % 7 != 0))
    return store.rescore(t, as_of()).groupBy("cambio").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("puntos"))


# -- analytics -----------------------------------------------------------------------------------


def _sales(spark, d) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows


_SALES = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
_PAID = "o_totalprice > 150000"
_MEASURES = f"count(*) as total, count(*) filter ({_PAID}) as con_sueldo, count(*) filter (not ({_PAID})) as sin_sueldo, cast({sql.percent(f'count(*) filter ({_PAID})', 'count(*)')} as int) as pct"


@register("transparency_by_nation", f"select lower(trim(n_name)) as clave, min_by(trim(n_name), o_orderkey) as nombre, {_MEASURES} from {_SALES} group by 1 having count(*) >= 3")
def transparency_by_nation(spark, d):
    return analytics.transparency(_sales(spark, d), "n_name", F.expr(_PAID), 3, "o_orderkey")


@register("transparency_overall", f"select {_MEASURES}, min(cast(o_orderdate as date)) as desde, max(cast(o_orderdate as date)) as hasta from orders")
def transparency_overall(spark, d):
    return analytics.transparency_overall(table(spark, d, "orders"), F.expr(_PAID), "o_orderdate")


@register("transparency_sets", " union all ".join(f"select '{f}' as campo, lower(trim({f})) as valor, {_MEASURES} from {_SALES} group by 2" for f in ("c_mktsegment", "n_name", "o_orderpriority", "o_orderstatus")))
def transparency_sets(spark, d):
    return analytics.transparency_sets(_sales(spark, d), ["c_mktsegment", "n_name", "o_orderpriority", "o_orderstatus"], F.expr(_PAID))


_RANKED = "select lower(trim(c_name)) as clave, count(*) as total, cast(" + sql.percent("count(*) filter (o_totalprice > 100000)", "count(*)") + " as int) as pct from orders join customer on o_custkey = c_custkey group by 1 having count(*) >= 3"


@register("rankings", f"with g as ({_RANKED}) select * from (select 'transparente' as lista, clave, total, pct from g where pct >= 80 order by pct desc, total desc, clave limit 20) union all select * from (select 'opaca' as lista, clave, total, pct from g where pct = 0 order by total desc, clave limit 20)")
def rankings(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    clear, opaque = analytics.rankings(analytics.transparency(o, "c_name", F.expr("o_totalprice > 100000"), 3, "o_orderkey"))
    pick = lambda df, name: df.select(F.lit(name).alias("lista"), "clave", "total", "pct")
    return pick(clear, "transparente").unionByName(pick(opaque, "opaca"))


@register("upper_median", "select c_mktsegment, o_totalprice as mediana from (select c_mktsegment, o_totalprice, row_number() over (partition by c_mktsegment order by o_totalprice) as n, count(*) over (partition by c_mktsegment) as c from orders join customer on o_custkey = c_custkey) where n = floor(c / 2) + 1")
def upper_median(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return analytics.upper_median(o, "o_totalprice", "c_mktsegment")


@register("overview", _RUBRIC + f"select count(*) as total, count(*) filter (ok) as vigentes, {sql.percent('count(*) filter (ok)', 'count(*)', 1)} as tasa, count(*) filter (sin) as sin_sueldo, cast({sql.percent('count(*) filter (sin)', 'count(*)')} as int) as pct_sin_sueldo from (select len(motivos) = 0 and total >= 70 as ok, sin from e)")
def overview(spark, d):
    s = _scored(spark, d).select(((F.size("r.motivos") == 0) & (F.col("r.total") >= 70)).alias("aprobada"), F.lit(True).alias("vigente"), F.col("r.motivos").alias("motivos_rechazo"))
    return analytics.overview(s)


@register("count_by_region", "select coalesce(nullif(case when c_custkey % 6 = 0 then '' else n_name end, ''), '(sin ubicación)') as region, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1")
def count_by_region(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return analytics.count_by(c.select(F.when(F.col("c_custkey") % 6 == 0, "").otherwise(F.col("n_name")).alias("region")), "region", "(sin ubicación)")


@register("regions_with_page", "select n_name, count(*) as n from supplier join nation on s_nationkey = n_nationkey group by 1 having count(*) >= 5")
def regions_with_page(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return analytics.regions_with_page(s, "n_name")


# -- publishing ----------------------------------------------------------------------------------


@register("slugs", f"select p_partkey, {sql.slug(_TITLE, 'md5(p_name)')} as slug from part")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", publish.slug(F.expr(_TITLE), F.md5("p_name")).alias("slug"))


@register("escape_html", "select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) as escapado from pages")
def escape_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(publish.escape_html(F.col("html"))).alias("escapado"))


@register("long_date", "select o_orderkey, concat(day(o_orderdate), ' de ', [" + ", ".join(map(sql.lit, publish.MONTHS)) + "][month(o_orderdate)], ' de ', year(o_orderdate)) as fecha, case when o_orderkey % 100 >= 80 then 'alta' when o_orderkey % 100 >= 30 then 'media' else 'baja' end as nivel from orders")
def long_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", publish.long_date(F.to_date("o_orderdate")).alias("fecha"), analytics.level(F.col("o_orderkey") % 100).alias("nivel"))


def _cards(spark, d, *more: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(*more, F.md5(k.cast("string")).alias("huella"), F.lit("Operario").alias("puesto"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("empresa"), F.lit("").alias("ciudad"), F.lit("Lima").alias("departamento"), F.when(k % 2 == 0, "Remoto").alias("modalidad"), F.lit(None).cast("string").alias("categoria"), F.when(k % 5 == 0, 0).otherwise(1500).alias("sueldo_min"), F.lit(0).alias("sueldo_max"), F.lit("PEN").alias("moneda"), F.lit("a < b").alias("resumen"), F.array(F.lit("Gestionar")).alias("funciones"), F.array().cast("array<string>").alias("requisitos"), F.array(F.lit("EPS")).alias("beneficios"), F.lit(80).alias("score"), F.lit("portal").alias("fuente"), F.lit("u").alias("url"), F.to_date("o_orderdate").alias("publicado"), F.when(k % 4 == 0, F.date_add(F.to_date("o_orderdate"), 30)).alias("vence"))


_HASH = "md5(cast(o_orderkey as varchar))"


@register("web_projection", f"select {_HASH} as huella, coalesce(nullif(case when o_orderkey % 3 = 0 then '' else o_orderpriority end, ''), 'Empresa confidencial') as empresa, 'Perú' as ciudad, case when o_orderkey % 2 = 0 then 'Remoto' else 'Presencial' end as modalidad, 'Otros' as categoria, cast(case when o_orderkey % 5 = 0 then 0 else 1500 end as int) as sueldo_max, cast(greatest({_AGE}, 0) as int) as dias, cast(case when o_orderkey % 4 = 0 then 30 - {_AGE} end as int) as restan from orders")
def web_projection(spark, d):
    return publish.web_projection(_cards(spark, d), as_of()).select("huella", "empresa", "ciudad", "modalidad", "categoria", "sueldo_max", "dias", "restan")


@register("completeness", f"select {_HASH} as huella, array_to_string(list_filter([case when o_orderkey % 5 <> 0 then 'sueldo' end, 'funciones', 'beneficios', case when o_orderkey % 4 = 0 then 'plazo' end], lambda x: x is not null), ',') as marcas from orders")
def completeness(spark, d):
    return publish.completeness(_cards(spark, d)).select("huella", F.array_join("marcas", ",").alias("marcas"))


@register("job_posting_json", f"select {_HASH} as huella, 'Operario' as title, coalesce(nullif(case when o_orderkey % 3 = 0 then '' else o_orderpriority end, ''), 'Confidencial') as organization, case when o_orderkey % 5 <> 0 then '1500' end as low, case when o_orderkey % 2 = 0 then 'TELECOMMUTE' end as place, cast(cast(o_orderdate as date) as varchar) as posted from orders")
def job_posting_json(spark, d):
    j = publish.job_posting(_cards(spark, d))
    get = lambda p: F.get_json_object("documento", p)
    return j.select("huella", get("$.title").alias("title"), get("$.hiringOrganization.name").alias("organization"), get("$.baseSalary.value.minValue").alias("low"), get("$.jobLocationType").alias("place"), get("$.datePosted").alias("posted"))


@register("sitemap_entries", f"select concat('<url><loc>https://x.pe/oferta/operario-', left({_HASH}, 8), '/</loc><lastmod>', cast(cast(o_orderdate as date) as varchar), '</lastmod></url>') as entry from orders")
def sitemap_entries(spark, d):
    return publish.sitemap_entries(_cards(spark, d), "https://x.pe")


@register("stale_pages", f"select {sql.slug('p_name', 'md5(p_name)')} as slug from part except select {sql.slug('p_name', 'md5(p_name)')} from part where p_partkey % 3 = 0")
def stale_pages(spark, d):
    p = table(spark, d, "part").select("p_partkey", publish.slug(F.col("p_name"), F.md5("p_name")).alias("slug"))
    return publish.stale_pages(p.select("slug").distinct(), p.filter("p_partkey % 3 = 0"))


from . import case_queries, chain_queries, delta_queries, keep_queries, scan_queries, source_queries  # noqa: E402,F401  register their own
