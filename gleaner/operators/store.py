"""Keyed storage of postings: upsert, retention, skip sets, rewrites. Tables are versioned Parquet folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import score, titles
from .filters import not_in

#: Days after which rejected and approved postings are read again.
SKIP_DAYS = {"rejected": 30, "approved": 7}
#: Days that a posting without a deadline stays, by profile, and the most for all.
NO_DEADLINE_DAYS = {"publico": 21, "privado": 45}
MOST_DAYS = 60


def profile_from_source(source: Column) -> Column:
    """The profile that older rows imply by their source's name."""
    return F.when(F.lower(source).contains("estado"), "publico").otherwise("privado")


def newest(batch: DataFrame, key: str, order: tuple) -> DataFrame:
    """The row of each key that comes last by ``order`` (nulls first); counted up before the shuffle."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("_row")).select("_row.*")


def upsert(target: DataFrame, batch: DataFrame, key: str, now: Column, order: tuple = ()) -> DataFrame:
    """target with the rows of batch put in by key: all columns are overwritten but the key and
    ``capturado``; ``visto_ultima_vez`` is now and ``vigente`` true (P3). Of rows of one key the last by ``order`` counts.

    One outer join by key; a side that is already partitioned by it is not shuffled again."""
    batch = newest(batch, key, order) if order else batch
    held = target.select(F.col(key).alias("_key"), F.struct(*target.columns).alias("_old"))
    new = batch.select(F.col(key).alias("_new_key"), F.struct(*batch.columns).alias("_new"))
    both = held.join(new, F.col("_key") == F.col("_new_key"), "full")
    came = F.col("_new_key").isNotNull()

    def value(c: str) -> Column:
        old = F.col("_old")[c] if c in target.columns else F.lit(None)
        mine = F.col("_new")[c] if c in batch.columns else F.lit(None)
        mine = {"capturado": F.coalesce(F.col("_old.capturado"), now), "visto_ultima_vez": now, "vigente": F.lit(True)}.get(c, mine)
        return F.when(came, mine).otherwise(old).alias(c)

    return both.select(*map(value, dict.fromkeys([*target.columns, *batch.columns, "capturado", "visto_ultima_vez", "vigente"])))


def statuses(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """key and whether a row of batch is 'new' or 'updated' (A11)."""
    known = target.select(F.col(key).alias("_key")).distinct()
    return batch.join(known, F.col(key) == F.col("_key"), "left").select(key, F.when(F.col("_key").isNull(), "new").otherwise("updated").alias("estado"))


def retention_reason(as_of: Column, published: Column, deadline: Column, profile: Column) -> Column:
    """Why a live posting goes: its deadline, its age without one, or its age; null if it stays."""
    age = F.datediff(as_of, published)
    limit = F.when(profile == "publico", NO_DEADLINE_DAYS["publico"]).otherwise(NO_DEADLINE_DAYS["privado"])
    return F.when(deadline < as_of, "plazo_vencido").when(deadline.isNull() & (age > limit), "sin_plazo").when(age > MOST_DAYS, "antiguedad")


def sweep(table: DataFrame, as_of: Column) -> DataFrame:
    """table with ``motivo_retiro`` and ``vigente`` after retention; retired rows aren't touched again."""
    reason = F.when(F.col("vigente"), retention_reason(as_of, F.col("publicado"), F.col("vence"), F.col("perfil")))
    return table.withColumn("motivo_retiro", reason).withColumn("vigente", F.col("vigente") & F.col("motivo_retiro").isNull())


def sweep_counts(swept: DataFrame) -> DataFrame:
    return swept.filter("motivo_retiro is not null").groupBy("motivo_retiro").agg(F.count(F.lit(1)).alias("n"))


def to_skip(now: Column, seen: Column, approved: Column) -> Column:
    """Whether a page was read too recently to be read again (P5)."""
    days = (now.cast("timestamp").cast("double") - seen.cast("timestamp").cast("double")) / 86400
    return F.when(approved, days < SKIP_DAYS["approved"]).otherwise(days < SKIP_DAYS["rejected"])


def skip_set(table: DataFrame, now: Column) -> DataFrame:
    return table.filter(to_skip(now, F.col("visto_ultima_vez"), F.col("aprobada"))).select("url").distinct()


def unread(urls: DataFrame, table: DataFrame, now: Column) -> DataFrame:
    """The URLs that were not read too recently (P5): most are known to be new by a filter, before any shuffle."""
    return not_in(urls, "url", skip_set(table, now))


def seen_within(table: DataFrame, now: Column, hours: float = 20) -> DataFrame:
    """URLs seen in the last hours."""
    seconds = now.cast("timestamp").cast("double") - F.col("visto_ultima_vez").cast("timestamp").cast("double")
    return table.filter(seconds < hours * 3600).select("url").distinct()


def live(table: DataFrame, limit: int = 500) -> DataFrame:
    """Approved live postings, newest and best first."""
    return table.filter("aprobada and vigente").orderBy(F.desc_nulls_last("publicado"), F.desc("score"), "huella").limit(limit)


def rejected(table: DataFrame, limit: int = 200) -> DataFrame:
    """Rejected postings, last captured first."""
    return table.filter("not aprobada").orderBy(F.desc_nulls_last("capturado"), "huella").limit(limit)


def published_urls(table: DataFrame) -> DataFrame:
    """fuente and url of what is approved and live, each once: a row for each URL, however many a source has."""
    return table.filter("aprobada and vigente").select("fuente", "url").distinct()


def repair_urls(table: DataFrame, urls: DataFrame) -> DataFrame:
    """fuente and url of the given URLs that a source has published: these are read again instead of discovered ones."""
    return published_urls(table).join(urls.select("url").distinct(), "url", "left_semi").select("fuente", "url")


def run_rows(postings: DataFrame, began: Column, ended: Column, detail: Column) -> DataFrame:
    """A row of the run log for each source: when, how many were read, approved and rejected (P10).

    Copies of a fingerprint are read, but judged once."""
    first = postings.groupBy("fuente", "huella").agg(F.count(F.lit(1)).alias("n"), F.max("aprobada").alias("ok"))
    counts = first.groupBy("fuente").agg(F.sum("n").cast("int").alias("leidas"), F.count_if("ok").cast("int").alias("aprobadas"), F.count_if(~F.col("ok")).cast("int").alias("rechazadas"))
    return counts.select(began.alias("inicio"), ended.alias("fin"), "fuente", "leidas", "aprobadas", "rechazadas", detail.alias("detalle"))


def append_runs(runs: DataFrame, folder: str) -> None:
    """Appends to the run log; what is there stays."""
    runs.write.mode("append").parquet(folder)


def clean_titles(table: DataFrame) -> DataFrame:
    """table with cleaned titles and ``cambio``; keys stay."""
    return titles.with_clean_title(table, F.col("puesto"), "_new").withColumn("cambio", F.col("_new") != F.col("puesto")).withColumn("puesto", F.col("_new")).drop("_new")


def review_titles(table: DataFrame) -> DataFrame:
    """Approved rows with a vague title get one from their text, or lose approval with a reason."""
    vague = F.col("aprobada") & ~titles.names_job(F.col("puesto"))
    found = F.when(vague, titles.deduce_title(F.col("resumen"), F.col("funciones"), F.col("requisitos")))
    lost = vague & F.col("_found").isNull()
    table = table.withColumn("_found", found)
    reasons = F.when(lost, F.array_append("motivos_rechazo", F.lit("El aviso no dice qué puesto es"))).otherwise(F.col("motivos_rechazo"))
    return table.withColumns({"motivos_rechazo": reasons, "aprobada": F.col("aprobada") & ~lost, "puesto": F.coalesce("_found", "puesto"), "titulo": F.when(lost, "retirado").when(vague, "deducido").otherwise("igual")}).drop("_found")


def rescore(table: DataFrame, as_of: Column) -> DataFrame:
    """table scored by the rules of as_of, with ``cambio``: entra, sale or igual."""
    pay = F.when(F.col("sueldo_min") > 0, F.struct(F.col("sueldo_min").alias("minimo"), F.col("sueldo_max").alias("maximo"), "moneda", F.lit("mensual").alias("periodo"), F.lit("").alias("literal"), F.coalesce("sueldo_confianza", F.lit(100)).alias("confianza")))
    result = score.evaluate(pay, F.col("funciones"), F.col("requisitos"), F.col("beneficios"), F.col("empresa"), F.col("ciudad"), F.col("modalidad"), F.col("publicado"), F.col("vence"), F.coalesce("resumen", F.lit("")), F.col("perfil"), as_of)
    reasons = F.concat("_r.motivos", F.filter("motivos_rechazo", lambda m: m.startswith("El aviso")))
    table = table.withColumn("_r", result).withColumn("_reasons", reasons).withColumn("_ok", (F.size("_reasons") == 0) & (F.col("_r.total") >= 70))
    flip = F.when(F.col("_ok") & ~F.col("aprobada"), "entra").when(~F.col("_ok") & F.col("aprobada"), "sale").otherwise("igual")
    return table.withColumns({"cambio": flip, "score": F.col("_r.total"), "motivos_rechazo": F.col("_reasons"), "aprobada": F.col("_ok")}).drop("_r", "_reasons", "_ok")


def rescored_changes(changes: DataFrame, as_of: Column) -> DataFrame:
    """The rows that two versions of a table differ in, as they are now, scored by the rules of as_of (P13): rows that
    haven't changed keep their verdict on that day."""
    return rescore(changes.filter("despues is not null").select("despues.*"), as_of)


def cleaned_changes(changes: DataFrame) -> DataFrame:
    """The same with cleaned titles: rows whose ``cambio`` is true are written back."""
    return clean_titles(changes.filter("despues is not null").select("despues.*"))


def decode_list(json: Column) -> Column:
    """A JSON list of texts; anything else is empty."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def write_version(table: DataFrame, folder: str, version: int) -> str:
    """Writes a table's version beside the others: never over what is being read."""
    where = f"{folder}/v={version}"
    table.write.parquet(where)
    return where


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{folder}/v={version}")


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
