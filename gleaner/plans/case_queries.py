"""Queries that put many shapes of pay, titles and cards through the rules, dealt over a table's keys; what they must give is told as values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, salary, text, titles
from ..sources import pages
from . import sql
from .queries import dealt, register, table

#: Text, least and most by month, currency and confidence.
PAY = (
    ("Sueldo: S/ 3,400", 3400, 3400, "PEN", 100), ("S/. 2300.00 mensuales", 2300, 2300, "PEN", 95), ("4100 soles mensuales", 4100, 4100, "PEN", 95), ("S/6000 - S/8500", 6000, 8500, "PEN", 100),
    ("entre 3900 y 5200 soles", 3900, 5200, "PEN", 100), ("S/ 3.700,00 - S/ 4.400,00 al mes", 3700, 4400, "PEN", 100), ("S/ 60 diarios", 1560, 1560, "PEN", 70), ("S/ 12 por hora", 2496, 2496, "PEN", 70),
    ("S/ 800 quincenal", 1600, 1600, "PEN", 70), ("S/ 48,000 anuales", 4000, 4000, "PEN", 70), ("S/ 15", None, None, None, None), ("S/ 940000 mensuales", None, None, None, None),
    ("S/ 1,200 diarios", None, None, None, None), ("S/ 8,000 por hora", None, None, None, None), ("S/ 2100 a convenir", None, None, None, None), ("", None, None, None, None),
    ("Sueldo base: S/ 1300 y comisiones de S/ 400 - S/ 900", 1300, 1300, "PEN", 100), ("US$ 1,600", 1600, 1600, "USD", 90), ("Remuneración mínima vital", 1130, 1130, "PEN", 85),
)


def _deal(values, show=lambda v: "null" if v is None else str(v) if isinstance(v, int) else sql.lit(v)) -> str:
    return f"case c_custkey % {len(values)} " + " ".join(f"when {k} then {show(v)}" for k, v in enumerate(values)) + " end"


def _column(rows, k: int, kind: str = "varchar") -> str:
    return f"cast({_deal([r[k] for r in rows])} as {kind})"


@register("salary_cases", f"select c_custkey, {_column(PAY, 1, 'int')} as minimo, {_column(PAY, 2, 'int')} as maximo, {_column(PAY, 3)} as moneda, {_column(PAY, 4, 'int')} as confianza from customer")
def salary_cases(spark, d):
    c = text.once(dealt(table(spark, d, "customer")).select("c_custkey", F.expr(_deal([p[0] for p in PAY])).alias("t")), s=salary.extract_salary(F.col("t")))
    return c.select("c_custkey", "s.minimo", "s.maximo", "s.moneda", "s.confianza")


#: Title as posted, as shown, and whether that names a job.
TITLES = (
    ("¡GANA HASTA 2000 SOLES! MOZO DE SALÓN — LINCE / PLANILLA", "Mozo de Salón", True), ("AUXILIAR DE ALMACÉN/ SUELDO FIJO + BONO MENSUAL", "Auxiliar de Almacén", True),
    ("ASISTENTE CONTABLE/TURNO TARDE/SURCO - SURCO (LIMA)", "Asistente Contable", True), ("¡ÚNETE A NOSOTROS! EJECUTIVO COMERCIAL", "Ejecutivo Comercial", True),
    ("Programadora Frontend React.js", "Programadora Frontend React.js", False), ("INGENIERO DE SEGURIDAD SSOMA", "Ingeniero de Seguridad SSOMA", True), ("¡POSTULA HOY!", "¡POSTULA HOY!", False), ("", "", False),
    ("SE REQUIERE PANADERO CON EXPERIENCIA PARA TIENDA", "Panadero", True), ("Buscamos una Analista de Riesgos", "Analista de Riesgos", True), ("GANA S/1800 - PROMOTOR DE VENTAS", "Promotor de Ventas", True),
    ("Analista de Costos para Proyectos en Minería", "Analista de Costos para Proyectos en Minería", True), ("Back Office", "Back Office", True), ("Planta Primax", "Planta Primax", False),
)


@register("title_cases", f"select c_custkey, {_column(TITLES, 1)} as puesto, {_deal([t[2] for t in TITLES], lambda v: str(v).lower())} as nombra from customer")
def title_cases(spark, d):
    c = titles.with_clean_title(dealt(table(spark, d, "customer")), F.expr(_deal([t[0] for t in TITLES])), "puesto")
    return c.select("c_custkey", "puesto", titles.names_job(F.col("puesto")).alias("nombra"))


#: Summary, duty, requirement, and the title that they give.
DEDUCED = (
    ("", "Despachador de combustible en estación de servicio", "", "Despachador de combustible"), ("Impulsa tu carrera", "Preparar la masa según las indicaciones", "Experiencia en plantas de alimentos", None),
    ("", "", "", None), ("Se necesita cajera para tienda", "Vendedor de zapatos", "", "Cajera"), ("", "Responder correos del back office", "", "Back office"), ("ASESOR DE CRÉDITOS CON METAS", "", "", "Asesor de Créditos"),
)


@register("deduce_cases", f"select c_custkey, {_column(DEDUCED, 3)} as puesto from customer")
def deduce_cases(spark, d):
    of = lambda k: F.expr(_deal([x[k] for x in DEDUCED]))
    return dealt(table(spark, d, "customer")).select("c_custkey", titles.deduce_title(of(0), F.array(of(1)), F.array(of(2))).alias("puesto"))


#: Lines of a card and its pay; the second contradicts itself.
CARD_PAY = (
    ("Salario: S/ 1,350|Remuneración: S/ 1,350", "S/ 1,350"), ("Salario: S/ 1,350|Remuneración: S/ 1,500", ""), ("► Remuneración: S/ 2,000", "S/ 2,000"), ("Vacantes: 2", ""), ("Salario|S/ 1,800 mensuales", "S/ 1,800 mensuales"), ("► Salario:|S/ 1,800 mensuales", "S/ 1,800 mensuales"),
)


@register("card_cases", f"select c_custkey, {_column(CARD_PAY, 1)} as sueldo from customer")
def card_cases(spark, d):
    c = text.once(dealt(table(spark, d, "customer")).select("c_custkey", F.split(F.expr(_deal([x[0] for x in CARD_PAY])), r"\|").alias("l")), s=pages.card_salary(F.col("l")))
    return c.select("c_custkey", F.col("s").alias("sueldo"))


#: Title, body, and category: internships only by title, titles before bodies, ties by the list's order.
CATEGORIES = (
    ("Practicante de Contabilidad", "", "Prácticas"), ("Internista", "", "Otros"), ("Intern de Marketing", "", "Prácticas"), ("Médico de planta", "", "Salud"), ("Papa Johns", "Se busca cocinero y mozo con experiencia", "Gastronomía"),
    ("Operario de almacén", "ventas ventas", "Logística"), ("Jefe de obra civil", "", "Ingeniería"), ("Asesor legal", "practicante", "Legal"), ("Gerente", "apoyo a practicantes", "Otros"), ("Asesora de Ventas de seguros", "", "Ventas"),
)
#: Location, body, city and region: cities before districts before regions, each in its list's order.
PLACES = (
    ("Cusco y Arequipa", "", "Arequipa", "Arequipa"), ("Ate", "", "Lima", "Lima"), ("San Martín de Porres", "", "Lima", "Lima"), ("San Martín", "", "San Martín", "San Martín"), ("", "Obra en Cerro de Pasco", "Cerro De Pasco", "Pasco"),
    ("Madre de Dios", "", "Madre de Dios", "Madre de Dios"), ("Icaro", "Limatambo", "", ""), ("ÁNCASH", "", "Áncash", "Áncash"), ("Surco, Trujillo", "", "Trujillo", "La Libertad"),
)


@register("class_cases", f"select c_custkey, {_column(CATEGORIES, 2)} as categoria, {_column(PLACES, 2)} as ciudad, {_column(PLACES, 3)} as departamento from customer")
def class_cases(spark, d):
    c = dealt(table(spark, d, "customer"))
    of = lambda rows, k: F.expr(_deal([r[k] for r in rows]))
    c = text.once(c, k=classify.category(of(CATEGORIES, 0), of(CATEGORIES, 1)), w=classify.place(of(PLACES, 0), of(PLACES, 1)))
    return c.select("c_custkey", F.col("k").alias("categoria"), "w.ciudad", "w.departamento")
