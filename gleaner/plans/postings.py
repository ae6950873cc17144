"""Raw postings to scored postings, run-level deduplication and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, salary, score, titles
from ..functions.rules import THRESHOLD
from ..functions.text import collapse, fold, let, once, summary, with_blocks


def lenient_date(text: Column) -> Column:
    """The date of an ISO text's first ten characters, or null (A10)."""
    return F.try_to_date(F.substring(text.cast("string"), 1, 10), "yyyy-MM-dd")


def still_open(raw: DataFrame, as_of: Column, max_age: int = 60) -> DataFrame:
    """raw without postings whose deadline has passed or that are too old; missing dates pass.

    Filters of the raw columns alone: they are pushed below any enrichment join."""
    deadline = lenient_date(F.col("extra")["vence"])
    return raw.filter((deadline.isNull() | (deadline >= as_of)) & (F.col("publicado").isNull() | (F.datediff(as_of, F.col("publicado")) <= max_age)))


def process(raw: DataFrame, as_of: Column) -> DataFrame:
    """Postings of raw ones: blocks, salary, place, mode, category, score, title, fingerprint."""
    body = F.coalesce(F.nullif("descripcion_html", F.lit("")), F.nullif("texto_plano", F.lit("")), F.lit(""))
    df = once(with_blocks(raw.withColumn("body", body)), plain=F.array_join("lines", " "))
    # what reads the whole text in one spelling shares it
    df = once(df, plain_low=collapse(F.col("plain")), folded=fold(F.col("plain")), placed=fold(F.col("ubicacion_texto")))
    df = once(df, texts=F.array(collapse(F.col("sueldo_texto")), F.col("plain_low")))
    # the large expression is built once: all readings of the field and the body
    df = once(df, rated=F.transform("texts", salary.rated))
    field, whole = (F.get("rated", F.lit(k)) for k in (0, 1))
    df = once(df, labelled=salary.chosen(whole, True), any_pay=F.array(salary.salary_of(F.get("texts", F.lit(0)), salary.chosen(field, False)), salary.salary_of(F.get("texts", F.lit(1)), salary.chosen(whole, False))))
    df = once(df, ambiguous=salary.several_of(F.col("labelled")), by_label=salary.salary_of(F.col("plain_low"), F.col("labelled")), by_field=F.get("any_pay", F.lit(0)), anywhere=F.get("any_pay", F.lit(1)))
    # the beginning of the folded text is that of the text, unless signs have gone from it
    same = F.char_length("folded") == F.char_length("plain")
    start = lambda n: F.when(same, F.substring("folded", 1, n)).otherwise(fold(F.substring("plain", 1, n)))
    df = once(df, role=fold(F.col("puesto")))
    df = once(
        df,
        pay=salary.choose(F.col("ambiguous"), F.col("by_label"), F.col("by_field"), F.col("anywhere")),
        where=let(F.concat("placed", F.lit(" "), start(classify.PLACE_CHARS)), classify.place_of),
        modalidad=let(F.concat("placed", F.lit(" "), "folded"), classify.mode_of),
        categoria=classify.category_of(F.col("role"), lambda: F.concat("role", F.lit(" "), start(classify.CATEGORY_CHARS))),
        resumen=summary(F.col("intro"), F.col("funciones"), F.col("puesto")),
        perfil=F.coalesce(F.col("extra")["perfil"], F.lit("privado")),
        vence=lenient_date(F.col("extra")["vence"]),
    )
    df = titles.with_clean_title(df, F.col("puesto"), "clean")
    df = once(df, named=titles.names_job(F.col("clean")))
    text = F.concat_ws(" ", F.coalesce("sueldo_texto", F.lit("")), "plain")
    df = once(
        df,
        result=score.evaluate(F.col("pay"), F.col("funciones"), F.col("requisitos"), F.col("beneficios"), F.col("empresa"), F.col("where.ciudad"), F.col("modalidad"), F.col("publicado"), F.col("vence"), text, F.col("perfil"), as_of),
        deduced=F.when(~F.col("named"), titles.deduce_title(F.col("resumen"), F.col("funciones"), F.col("requisitos"))),
    )
    unnamed = ~F.col("named") & F.col("deduced").isNull()
    vetoes = F.array_compact(F.array(F.when(unnamed, "El aviso no dice qué puesto es"), F.when(F.col("ambiguous"), "El aviso declara dos sueldos distintos (varias modalidades)")))
    df = once(df, title=F.coalesce("deduced", "clean"), reasons=F.concat("result.motivos", vetoes))
    parts = ("sueldo", "funciones", "requisitos", "beneficios", "metadata")
    return df.select(
        titles.fingerprint(F.col("title"), F.col("empresa"), F.col("where.ciudad")).alias("huella"),
        "fuente", "url", F.col("title").alias("puesto"), F.trim("empresa").alias("empresa"), "where.ciudad", "where.departamento", "modalidad", "categoria",
        F.coalesce("pay.minimo", F.lit(0)).alias("sueldo_min"), F.coalesce("pay.maximo", F.lit(0)).alias("sueldo_max"), F.coalesce("pay.moneda", F.lit("PEN")).alias("moneda"), F.lit("mensual").alias("sueldo_periodo"),
        "resumen", "funciones", "requisitos", "beneficios", "publicado", "vence",
        F.col("result.total").alias("score"),
        F.create_map(*(x for k in parts for x in (F.lit(k), F.col(f"result.{k}")))).alias("detalle_score"),
        F.col("reasons").alias("motivos_rechazo"),
        ((F.size("reasons") == 0) & (F.col("result.total") >= THRESHOLD)).alias("aprobada"),
        "perfil", F.col("pay.confianza").alias("sueldo_confianza"),
    )


def dedupe_run(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order (nulls first), with n_copies of it (P2); counted up before the shuffle."""
    one = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("n_copies"))
    return one.select("_row.*", "n_copies")


def run_metrics(postings: DataFrame) -> DataFrame:
    """read, approved, rejected, distinct, duplicates and rate of approval."""
    n, good, distinct = F.count(F.lit(1)), F.count_if("aprobada"), F.count_distinct("huella")
    rate = F.coalesce(F.bround(F.try_divide(100.0 * good, n), 1), F.lit(0.0))
    return postings.agg(n.alias("leidas"), good.alias("aprobadas"), (n - good).alias("rechazadas"), distinct.alias("distintas"), (n - distinct).alias("duplicadas"), rate.alias("tasa"))


def run_summary(postings: DataFrame, stored: DataFrame, swept: DataFrame) -> DataFrame:
    """A run in one row: read, approved and rejected (of the first of each fingerprint), new, duplicates, expired, rate.

    stored: the fingerprints known before; swept: the table after retention, with ``motivo_retiro``."""
    first = postings.groupBy("huella").agg(F.count(F.lit(1)).alias("n"), F.max("aprobada").alias("ok"))
    known = stored.select(F.col("huella").alias("_known")).distinct()
    each = first.join(known, F.col("huella") == F.col("_known"), "left").select("n", "ok", F.col("_known").isNull().alias("new"), F.lit(0).alias("gone"))
    gone = swept.filter("motivo_retiro is not null").select(F.lit(0).cast("long").alias("n"), F.lit(None).cast("boolean").alias("ok"), F.lit(False).alias("new"), F.lit(1).alias("gone"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    good, judged = F.count_if("ok"), F.count("ok")
    rate = F.coalesce(F.bround(F.try_divide(100.0 * good, judged), 1), F.lit(0.0))
    return each.unionByName(gone).agg(total("n").alias("leidas"), good.alias("aprobadas"), F.count_if(~F.col("ok")).alias("rechazadas"), F.count_if("new").alias("nuevas"), (total("n") - judged).alias("duplicadas"), total("gone").alias("vencidas"), rate.alias("tasa"))


def reason_histogram(postings: DataFrame, reasons: str = "motivos_rechazo") -> DataFrame:
    """Reasons with their numbers masked, by count."""
    each = postings.select(F.explode(reasons).alias("m")).select(F.regexp_replace("m", r"\d+", "N").alias("motivo"))
    return each.groupBy("motivo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "motivo")
