"""Work that grows with the rows: dealt over all cores, and each value made once."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner import registry
from gleaner.functions import classify, salary, text, titles
from gleaner.plans import postings
from gleaner.sources import pages

SF = "/root/testdata/sf0.001"
# whose work on a row is long; their tables are files of one block of rows
DEALT = ("salary_ambiguous", "salary_parse", "salary_cases", "tender_pages", "jsonld_fields", "jsonld_shapes", "sections", "summaries", "clean_stored_titles", "clean_title", "document_duties", "card_cases", "html_entities", "title_cases", "deduce_cases", "class_cases", "score_rubric", "label_values", "category", "place", "process_postings")


@pytest.mark.parametrize("name", DEALT)
def test_rows_of_one_file_are_dealt_over_all_cores(spark, name):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # pieces of a file, of which one has the rows
    try:
        df = registry.queries()[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _plan(spark, column) -> str:
    return spark.createDataFrame([("x", ["y"])], "t string, l array<string>").select(column.alias("v"))._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize(("made", "of", "most"), [
    (lambda: pages.spanish_date(F.col("t")), "lower(", 2), (lambda: pages.card_requirements(F.col("l")), "lower(", 2), (lambda: pages.card_salary(F.col("l")), "lower(", 6),
])
def test_a_line_is_folded_once(spark, made, of, most):
    assert _plan(spark, made()).count(of) <= most


def test_tables_of_entities_are_short():
    table = json.loads(text._named()[0])
    assert len(table) < 60 and max(map(len, table.values())) < 300


def test_no_pay_is_found_by_looking_behind(spark):
    assert "(?<=(" not in _plan(spark, salary.rated(F.col("t")))


def test_pay_is_read_with_what_stands_around_it(spark):
    far = "x" * 80
    cases = [
        (f"bono {far} S/ 1500", [1500]), ("bono S/ 1500", []), (f"S/ 1500 {far} a convenir", [1500]), ("S/ 1500 a convenir", []),
        (f"Sueldo: S/ 1,500. {far} ñandú S/ 2000", [1500, 2000]), ("S/ 1500 S/ 2500 S/ 3500", [1500, 2500, 3500]), (far + " 12 34 " + far, []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", F.transform(salary.candidates(F.lower("t"), False), lambda x: x["minimo"]).alias("v")).collect()}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, (_, v) in enumerate(cases)}


def test_words_begin_after_any_other_sign(spark):
    texts = ["en lima", "(lima", "xlima", "_lima", "9lima", "ßlima", "жlima", "—lima", "lima"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in df.orderBy("i").select(classify.place(F.col("t"), F.lit(""))["ciudad"].alias("c")).collect()]
    assert got == ["Lima", "Lima", "", "", "", "", "", "Lima", "Lima"]


def test_what_a_posting_node_holds_is_read_once(spark):
    node = F.parse_json(F.col("t"))
    assert _plan(spark, pages.job_posting_fields(node)).count("try_variant_get") <= 20


def test_trailing_commas_go_outside_of_strings_only(spark):
    job = '{"@type":"JobPosting","title":"%s"%s}%s'
    cases = [
        (job % ("Mozo", ",", ""), "Mozo"), (job % ("a, }b", "", ""), "a, }b"), (job % ("a, }b", ",", ""), "a}b"), (job % (r"q\",}z", "", ""), 'q",}z'), (job % (r"q\\", " ,\n", ""), "q\\"),
        ("[" + job % ("En lista", ",", ",") + "]", "En lista"), ('{"\\u0040graph":[' + job % ("Anidado", "", "") + "],}", "Anidado"), (" \n[[" + job % ("Dos", "", "") + "]]", "Dos"),
        (job % ("x,}", "", ',"y"}'), "x,}"), (job % ("x,}", "", ",}"), "x,}"), (job % ("x", "", r",\,}"), "x"), ('{"@type":"JobPosting","title":}', None),
    ]
    df = spark.createDataFrame([(i, f"<script type='application/ld+json'>{t}</script>") for i, (t, _) in enumerate(cases)], "i int, html string")
    df = text.once(df, node=pages.job_posting_node(F.col("html")))
    got = {r.i: r.t for r in df.select("i", F.when(F.col("node").isNotNull(), pages.job_posting_fields(F.col("node"))["puesto"]).alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)}


@pytest.mark.parametrize(("held", "empresa", "ubicacion", "sueldo_texto", "id_externo"), [
    ({"hiringOrganization": {"value": "V"}, "jobLocation": {"address": {"addressRegion": "LIM"}}, "baseSalary": {"currency": "USD", "value": {"minValue": 5, "maxValue": 9, "unitText": "hour"}}, "identifier": {"value": 7}}, "V", "LIM", "US$ 5 a US$ 9 por hora", "7"),
    ({"hiringOrganization": [{"name": "N"}], "jobLocation": [{"address": "Av. 1"}], "baseSalary": {"value": "de 1 a 2"}, "identifier": "i"}, "N", "Av. 1", "S/ de 1 a 2", "i"),
    ({"hiringOrganization": ["{x", "y"], "jobLocation": {"address": ["z"]}, "baseSalary": 1500, "identifier": {"name": "n"}}, "", "", "", ""),
    ({"hiringOrganization": {"name": "", "value": {"a": 1}}, "jobLocation": "Puno", "baseSalary": {"value": {"minValue": 0, "value": ""}}, "identifier": ["i"]}, '{"a":1}', "Puno", "", ""),
    ({"hiringOrganization": None, "jobLocation": [[]], "baseSalary": "[A tratar]", "identifier": None}, "", "", "", ""),
])
def test_all_forms_of_a_posting_are_read(spark, held, empresa, ubicacion, sueldo_texto, id_externo):
    df = spark.createDataFrame([(json.dumps(held),)], "t string").select(pages.job_posting_fields(F.parse_json("t")).alias("j"))
    assert tuple(df.select("j.empresa", "j.ubicacion", "j.sueldo_texto", "j.id_externo").first()) == (empresa, ubicacion, sueldo_texto, id_externo)


def test_a_search_for_a_job_looks_for_each_trade_once_a_text(spark):
    """Before, the search for a trade stood five times in the plan for each of three texts, and all texts were searched."""
    none = F.array().cast("array<string>")
    assert _plan(spark, titles.deduce_title(F.col("t"), none, none)).count("regexp_instr(") <= 3
    duties = F.when(F.raise_error(F.lit("looked at")).isNull(), none).otherwise(none)
    assert spark.createDataFrame([("Se busca operario de planta",)], "t string").select(titles.deduce_title(F.col("t"), duties, none).alias("v")).first().v == "Operario de planta"


def test_a_chain_folds_a_body_once(spark):
    """Place, mode and category share one folded text, which holds where signs go from it when it is folded."""
    marks = "é" * 700
    page = lambda body: ("f", "u", "Papa Johns", "e", f"<p>{body}</p>", "", "", "", None, "", {})
    kind = "fuente string, url string, puesto string, empresa string, descripcion_html string, texto_plano string, ubicacion_texto string, sueldo_texto string, publicado date, id_externo string, extra map<string,string>"
    bodies = ["TRUJILLO híbrido cocinero", marks + " trujillo remoto cocinero", "x" * 1194 + " lima", "x" * 1190 + " limati", "x" * 1300 + " lima home office"]
    df = spark.createDataFrame([page(b) for b in bodies], kind)
    got = [(r.ciudad, r.modalidad, r.categoria) for r in postings.process(df, F.lit("2026-01-01").cast("date")).select("ciudad", "modalidad", "categoria").collect()]
    alone = [tuple(r) for r in df.select(F.regexp_replace("descripcion_html", "</?p>", "").alias("b")).select(classify.place(F.lit(""), F.col("b"))["ciudad"], classify.work_mode("b"), classify.category(F.lit("Papa Johns"), F.col("b"))).collect()]
    assert got == alone and got[0] == ("Trujillo", "Híbrido", "Gastronomía") and got[3][0] == got[4][0] == ""


@pytest.mark.parametrize(("html", "lines"), [
    ("aa</\n<br> <BR/>p\n>bb", ["aa", "bb"]), ("ab</<br>p>cd", ["ab", "cd"]), ("ab</<br>x>cd", ["ab cd"]), ("<li>- 1) uno<li>2. dos", ["- 1) uno", "dos"]), ("•\n- 1) x y", ["x y"]), ("12)\n3) o\n●   \n ab \x85 ", ["ab"]),
    ("ab &#9; &nbsp;cd​ef\tg", ["ab cdef g"]), ("&am<li>p;", ["&am", "p;"]), ("1) 2) tres\r\n\r\ncuatro", ["2) tres", "cuatro"]),
])
def test_lines_of_odd_pages_are_parted_alike(spark, html, lines):
    got = spark.createDataFrame([(html,)], "t string").select(text.html_to_lines(F.col("t")).alias("l")).first().l
    assert got == lines


def test_sections_of_lines_with_odd_signs(spark):
    lines = ["antes", "\x01requisitos", "Funciones del puesto : coordinar las entregas", "uno", "¿QUÉ OFRECEMOS?", "dos\ntres", "Contacto - x", "fin"]
    got = spark.createDataFrame([(lines,), (lines[:5],)], "l array<string>").select(text.partition(F.col("l")).alias("p")).select("p.*").collect()
    assert got[0].asDict() == {"intro": ["antes", "\x01requisitos"], "funciones": ["coordinar las entregas", "uno"], "requisitos": [], "beneficios": ["dos\ntres"], "descartado": ["fin"]}
    assert got[1].beneficios == [] and got[1].funciones == ["coordinar las entregas", "uno"]


@pytest.mark.parametrize("page", [
    "<h1>Uno</h1><p>Contrato: CAS</p></body></html>", "<h1>Uno</h1><p>Contrato: CAS</p>cola", "<h1>Uno</h1><p>Contrato: CAS</p><b title='</p>", "<h1>Uno</h1><p>Contrato: 728</p><script>a</p>", "<h1>Uno</h1><p>Contrato: ley 276</p>&nbsp;</HTML>\n",
    "<h1>Uno</h1><p>Contrato: CAS</P > \n", "<meta name='description' content='a <b'><h1>Uno</h1><p>Contrato: CAS</p>", "<h1>Uno</h1><p>Contrato: CAS</<br>p>", "<meta name='description' content='dos &amp'><h1>Uno</h1><p>1) Sin contrato</p><", "<h1>Uno</h1><script type='application/ld+json'>{\"@type\":\"JobPosting\",\"description\":\"<p>cuerpo\"}</script><p>fin</p>",
])
def test_lines_of_a_public_posting_are_those_of_its_body(spark, page):
    """They are put together from those of the page, which before was parted again as a part of the body."""
    df = pages.public_postings(spark.createDataFrame([("u", page)], "url string, html string"), F.lit("e"), lines=True)
    got = df.select("lineas", text.html_to_lines(F.col("descripcion_html")).alias("all")).first()
    assert got.lineas == got.all and len(got.all) > 0
