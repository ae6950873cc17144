"""The completeness rubric: points, reject reasons and notes, 0 to 100. Dates are held against ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .classify import is_hidden_employer
from .salary import declares_vague
from .text import any_of, fold, is_filler, let

RESULT = "struct<total:int,sueldo:int,funciones:int,requisitos:int,beneficios:int,metadata:int,motivos:array<string>,notas:array<string>>"


def _profile(profile: Column, k: int) -> Column:
    out = F
    for name, values in rules.PROFILES.items():
        out = out.when(profile == name, F.lit(values[k]))
    return out.otherwise(rules.PROFILES["privado"][k])


def useful(items: Column) -> Column:
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: ~is_filler(x))


def _some(condition: Column, text) -> Column:
    return F.when(condition, text if isinstance(text, Column) else F.lit(text))


def score_salary(salary: Column, text: Column) -> tuple[Column, list[Column], list[Column]]:
    """Up to 30 points (A1)."""
    trust = salary["confianza"]
    points = F.when(salary.isNull(), 0).otherwise(
        F.least(F.lit(30), 20 + F.when(salary["maximo"] > salary["minimo"], 6).otherwise(3) + F.when(trust >= 95, 4).when(trust >= 85, 2).otherwise(0))
    )
    reason = F.when(salary.isNull(), F.when(declares_vague(text), "Sueldo declarado como 'a convenir' o similar").otherwise("No declara sueldo"))
    note = _some((salary["moneda"] == "PEN") & (salary["minimo"] < rules.MINIMUM_WAGE), "Sueldo por debajo de la RMV: revisar si es part-time o práctica")
    return points, [reason], [note]


def score_duties(items: Column, least: Column):
    """Up to 25 points (A2)."""
    n = F.size(items)
    mean = F.aggregate(items, F.lit(0), lambda a, x: a + F.char_length(x)) / F.greatest(n, F.lit(1))
    full = F.when(n >= 3, 14).otherwise(9) + F.when(n >= 5, 5).when(n >= 4, 3).otherwise(0) + F.when(mean >= 60, 6).when(mean >= 40, 3).otherwise(0)
    points = F.when(n < least, n * 4).when(n == 0, 0).otherwise(F.least(full, F.lit(25)))
    reason = _some(n < least, F.format_string("Solo %d funciones detalladas (mínimo %d)", n, least))
    return points, [reason], [_some((n == 0) & (least <= 0), "Las funciones están en las bases del concurso")]


def _concrete(items: Column, cues) -> Column:
    return F.size(F.filter(items, lambda x: any_of(fold(x), cues)))


def score_requirements(items: Column, concrete: Column, least: Column):
    """Up to 20 points (A3)."""
    n = F.size(items)
    share = concrete / F.greatest(n, F.lit(1))
    points = F.when(n < least, n * 3).otherwise(F.least(F.lit(20), 11 + F.when(n >= 5, 3).otherwise(0) + F.when(share >= 0.6, 6).when(share >= 0.35, 3).otherwise(0)))
    reason = _some(n < least, F.format_string("Solo %d requisitos (mínimo %d)", n, least))
    return points, [reason], [_some((n >= least) & (share < 0.35), "Requisitos poco verificables (sin años, estudios ni herramientas)")]


def score_benefits(items: Column, concrete: Column, least: Column):
    """Up to 15 points (A4)."""
    n = F.size(items)
    points = F.when(n < least, n * 3).when(concrete == 0, 4).otherwise(8 + F.when(concrete >= 3, 7).when(concrete == 2, 5).otherwise(2))
    few = _some(n < least, F.format_string("Solo %d beneficios listados (mínimo %d)", n, least))
    return points, [few, _some((n >= least) & (concrete == 0), "Beneficios genéricos: ninguno menciona planilla, seguro, bono ni similar")], []


def score_metadata(employer: Column, city: Column, mode: Column, published: Column, deadline: Column, days: Column, as_of: Column):
    """Up to 10 points (A5)."""
    left, age = F.datediff(deadline, as_of), F.datediff(as_of, published)
    known, placed = ~is_hidden_employer(employer), F.coalesce(city, F.lit("")) != ""
    points = (
        F.when(left >= 2, 2).when(left >= 0, 1).otherwise(0)
        + F.when(known, 4).otherwise(0)
        + F.when(placed, 3).otherwise(0)
        + F.when(F.coalesce(mode, F.lit("")) != "", 1).otherwise(0)
        + F.when(age <= 3, 2).when(age <= 10, 1).otherwise(0)
    )
    reasons = [
        _some(left < 0, F.concat(F.lit("El plazo cerró el "), F.date_format(deadline, "dd/MM/yyyy"))),
        _some(deadline.isNull() & (age > days), F.format_string("No dice hasta cuándo postular y se publicó hace %d días (máximo %d sin fecha de cierre)", age, days)),
        _some(age > rules.MAX_AGE_DAYS, F.format_string(f"Publicado hace %d días (máximo {rules.MAX_AGE_DAYS})", age)),
    ]
    return F.least(points, F.lit(10)), reasons, [_some(~known, "Empresa no identificada"), _some(~placed, "Sin ubicación clara"), _some(published.isNull(), "Sin fecha de publicación")]


def evaluate(salary, duties, requirements, benefits, employer, city, mode, published, deadline, text, profile, as_of) -> Column:
    """RESULT of a posting: parts, total, reasons in order, and notes (A6); all arguments are columns."""
    lists = F.struct(useful(duties).alias("d"), useful(requirements).alias("r"), useful(benefits).alias("b"))
    counted = lambda x: F.struct(*(x[k].alias(k) for k in "drb"), _concrete(x["r"], rules.CONCRETE_REQUIREMENTS).alias("nr"), _concrete(x["b"], rules.CONCRETE_BENEFITS).alias("nb"))
    return let(let(lists, counted), lambda x: _evaluate(salary, x, employer, city, mode, published, deadline, text, profile, as_of))


def _evaluate(salary, lists, employer, city, mode, published, deadline, text, profile, as_of) -> Column:
    parts = {
        "sueldo": score_salary(salary, text),
        "funciones": score_duties(lists["d"], _profile(profile, 0)),
        "requisitos": score_requirements(lists["r"], lists["nr"], _profile(profile, 1)),
        "beneficios": score_benefits(lists["b"], lists["nb"], _profile(profile, 2)),
        "metadata": score_metadata(employer, city, mode, published, deadline, _profile(profile, 3), as_of),
    }
    points = F.struct(*(p[0].alias(k) for k, p in parts.items()))
    gather = lambda k: F.array_compact(F.array(*(x.cast("string") for p in parts.values() for x in p[k])))

    def result(x: Column) -> Column:
        total = sum((x["p"][k] for k in parts), F.lit(0))
        low = F.when((F.size(x["m"]) == 0) & (total < rules.THRESHOLD), F.array(F.format_string(f"Score %d por debajo del umbral {rules.THRESHOLD}", total)))
        return F.struct(total.alias("total"), *(x["p"][k].alias(k) for k in parts), F.coalesce(low, x["m"]).alias("motivos"), x["n"].alias("notas")).cast(RESULT)

    return let(F.struct(points.alias("p"), gather(1).alias("m"), gather(2).alias("n")), result)


def explain(result: Column) -> Column:
    """The result as text, a line for each part, reason and note."""
    ok = (F.size(result["motivos"]) == 0) & (result["total"] >= rules.THRESHOLD)
    head = F.format_string("Score: %d/100  ->  %s", result["total"], F.when(ok, "APROBADA").otherwise("RECHAZADA"))
    parts = [F.format_string(f"  {k:<12} %3d", result[k]) for k in ("sueldo", "funciones", "requisitos", "beneficios", "metadata")]
    lines = F.concat(F.array(head, *parts), F.transform(result["motivos"], lambda m: F.concat(F.lit("  ✗ "), m)), F.transform(result["notas"], lambda m: F.concat(F.lit("  · "), m)))
    return F.array_join(lines, "\n")
