"""Rules on small tables of cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.functions import classify, salary, text, titles
from gleaner.operators import store
from gleaner.plans import postings
from gleaner.schema import RAW

PAY = [
    ("S/ 3,500", 3500, 3500), ("S/. 2500.00 mensuales", 2500, 2500), ("4500 soles mensuales", 4500, 4500), ("S/7000 - S/9500", 7000, 9500),
    ("entre 4000 y 5500 soles", 4000, 5500), ("S/ 3.800,00 - S/ 4.500,00 al mes", 3800, 4500), ("S/ 50 diarios", 1300, 1300), ("S/ 15 por hora", 3120, 3120),
    ("Remuneración quincenal de S/ 900", 1800, 1800), ("S/ 54,000 anuales", 4500, 4500), ("S/ 12", None, None), ("S/ 950000 mensuales", None, None),
    ("S/ 1,300 diarios", None, None), ("S/ 9,000 por hora", None, None), ("S/ 2000 a convenir", None, None), ("", None, None), (None, None, None),
    ("Sueldo básico: S/ 1,130. Comisiones de hasta S/ 600.", 1130, 1130), ("Sueldo base: S/ 1200 y comisiones de S/ 500 - S/ 1000", 1200, 1200),
    ("Subvención económica de S/ 1,200", 1200, 1200), ("US$ 1,500", 1500, 1500), ("sueldo mínimo vital", 1130, 1130),
]


def test_salaries(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(PAY)], "i int, t string, low int, high int")
    got = {r.i: (r.s.minimo, r.s.maximo) if r.s else (None, None) for r in df.select("i", salary.extract_salary(F.col("t")).alias("s")).collect()}
    assert got == {i: c[1:] for i, c in enumerate(PAY)}


def test_titles_and_classes(spark):
    df = spark.createDataFrame([("¡GANA MÁS DE 1800 SOLES! OPERARIO DE PRODUCCIÓN — ATE / PLANILLA",), ("Papa Johns",), (None,)], "t string")
    rows = titles.with_clean_title(df, F.col("t"), "c").select("c", titles.names_job(F.col("t")).alias("n"), classify.category(F.col("t"), F.lit("")).alias("k")).collect()
    assert [r.c for r in rows] == ["Operario de Producción", "Papa Johns", ""]
    assert [r.n for r in rows] == [True, False, False]
    assert rows[2].k == "Otros"
    same = spark.range(1).select(titles.fingerprint(F.lit("Ingeniero Civil (urgente)"), F.lit("ÁCME"), F.lit("Lima")).alias("a"), titles.fingerprint(F.lit("CIVIL, ingeniero"), F.lit("acme"), F.lit("LIMA")).alias("b")).first()
    assert same.a == same.b and len(same.a) == 16


@pytest.mark.parametrize("html", [None, "", "<p></p>"])
def test_empty_pages_have_no_lines(spark, html):
    assert spark.createDataFrame([(html,)], "h string").select(F.size(text.html_to_lines(F.col("h"))).alias("n")).first().n == 0


GOOD = "<p>Empresa textil con presencia nacional busca personal comprometido.</p><h2>Funciones</h2><ul>" + "".join(f"<li>Operar la maquina numero {i} de la linea de tejido y registrar su produccion diaria</li>" for i in range(5)) + "</ul><h2>Requisitos</h2><ul><li>Secundaria completa y experiencia de un año</li><li>Disponibilidad para rotar turnos</li><li>Manejo de maquinas de tejido</li></ul><h2>Beneficios</h2><ul><li>Planilla desde el primer dia</li><li>Seguro EPS para la familia</li><li>Bono por puntualidad</li></ul>"


def test_postings_end_to_end(spark):
    day = datetime.date(2026, 1, 10)
    raw = lambda title, html, pay, published: ("portal", f"u/{title}", title, "Textiles Andinos", html, "", "Ate", pay, published, "", {"perfil": "privado"})
    rows = [
        raw("Operario de tejido", GOOD, "S/ 1,500", day), raw("OPERARIO DE TEJIDO", GOOD, "S/ 1,500", day), raw("Operario de corte", GOOD, "a convenir", day),
        raw("Operario de teñido", GOOD, "S/ 1,500", datetime.date(2025, 9, 1)), raw("Operario vago", "<p>Postula ya</p>", "S/ 1,500", day),
    ]
    p = postings.process(spark.createDataFrame(rows, RAW), F.lit("2026-01-12").cast("date")).cache()
    got = {r.puesto: r for r in p.collect()}
    assert got["Operario de tejido"].aprobada and got["Operario de tejido"].score >= 70 and got["Operario de tejido"].ciudad == "Lima"
    assert [m for m in got["Operario de corte"].motivos_rechazo] == ["Sueldo declarado como 'a convenir' o similar"]
    assert any("Publicado hace 133 días" in m for m in got["Operario de teñido"].motivos_rechazo)
    for r in p.collect():
        assert not r.aprobada or not r.motivos_rechazo and r.score >= 70 and r.sueldo_min > 0
        assert r.score == sum(r.detalle_score.values())
    once = postings.dedupe_run(p, "huella", "url")
    assert once.count() == 4 and postings.run_metrics(p).first().duplicadas == 1
    p.unpersist()


def test_store_is_idempotent(spark):
    now = F.lit("2026-01-12 00:00:00").cast("timestamp")
    start = spark.createDataFrame([("a", "1")], "huella string, url string").withColumns({"capturado": F.lit("2026-01-01 00:00:00").cast("timestamp"), "visto_ultima_vez": F.lit("2026-01-01 00:00:00").cast("timestamp"), "vigente": F.lit(True)})
    batch = spark.createDataFrame([("a", "2"), ("b", "3")], "huella string, url string")
    one = store.upsert(start, batch, "huella", now)
    two = store.upsert(one, batch, "huella", now)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert {(r.huella, r.url, r.capturado.day) for r in two.collect()} == {("a", "2", 1), ("b", "3", 12)}
    posts = spark.createDataFrame([("p", datetime.date(2025, 12, 13), None, "publico", True), ("q", datetime.date(2025, 12, 13), None, "privado", True)], "huella string, publicado date, vence date, perfil string, vigente boolean")
    swept = store.sweep(posts, F.lit("2026-01-12").cast("date"))
    assert {r.huella: r.vigente for r in swept.collect()} == {"p": False, "q": True}
    assert store.sweep_counts(store.sweep(swept.drop("motivo_retiro"), F.lit("2026-01-12").cast("date"))).count() == 0
