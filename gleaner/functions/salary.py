"""Salary operators: amounts with their period and currency, found in free text by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import WORD_START, any_of, collapse, let

SALARY = "struct<minimo:int,maximo:int,moneda:string,periodo:string,literal:string,confianza:int>"
# How an amount, a currency and a range are written.
AMOUNT = r"(?<!\d)(?:\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d{2,6}(?:[.,]\d{1,2})?)(?!\d)"
_CURRENCY = {"PEN": r"(?:s/\.?|soles?|pen\b|nuevos soles)", "USD": r"(?:us\$|usd\b|d[oó]lares?|\$)"}
#: What each way of writing a currency has in it.
_SOME_CURRENCY = r"(?=[spud$])(?:s(?:/|ole)|pen\b|usd\b|d[oó]lare|\$)"
_TO = r"\s*(?:a|-|–|hasta|y)\s*"
#: Text that is kept before and after a match.
_BEFORE, _AFTER = 70, 60


def amount(raw: Column) -> Column:
    """'3,500.00', '3.500' or '3500,50' as a whole number; null if none or not positive (L1)."""
    return let(F.trim(raw), _amount)


def _amount(t: Column) -> Column:
    both = t.contains(",") & t.contains(".")
    point_last = t.rlike(r"\.[^,]*$")
    one_comma = t.rlike(r"^[^,]*,[^,]{0,2}$")
    plain = (
        F.when(~t.contains(",") & ~t.contains("."), t)
        .when(both & point_last, F.replace(t, F.lit(","), F.lit("")))
        .when(both, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(one_comma, F.replace(t, F.lit(","), F.lit(".")))
        .when(t.rlike(r"[.,]\d{3}\b"), F.translate(t, ",.", ""))
        .otherwise(F.replace(t, F.lit(","), F.lit("")))
    )
    return let(F.floor(plain.try_cast("double")), lambda value: F.when(value > 0, value))


def period(after: Column, before: Column) -> Column:
    """The pay period next to an amount: right after it, else right before it, else monthly (L2)."""
    return let(F.struct(F.substring(after, 1, 28).alias("near"), F.right(before, F.lit(30)).alias("ahead")), lambda x: _period(x["near"], x["ahead"]))


def _period(near: Column, ahead: Column) -> Column:
    # most amounts have no other period around them
    some = "|".join(rf"(?:{marks})" for name, (marks, _, _) in rules.PERIODS.items() if name != "mensual")
    out = F.when(~F.concat(ahead, F.lit("\n"), near).rlike(f"(?U){some}"), "mensual")
    for name, (marks, _, _) in rules.PERIODS.items():
        hit = near.rlike(rf"(?U)^[\s,.:;)\-–—]*(?:{marks})\b")
        out = out.when(hit, name)
    for name, (marks, _, _) in rules.PERIODS.items():
        out = out.when(ahead.rlike(rf"(?U)\b(?:{marks})\b[\s\w]{{0,12}}$"), name)
    return out.otherwise("mensual")


def _by_period(name: Column, pick) -> Column:
    out = F
    for key, rule in rules.PERIODS.items():
        out = out.when(name == key, F.lit(pick(rule)))
    return out


def monthly(value: Column, name: Column) -> Column:
    """A period's amount for a month, rounded half to even (L3)."""
    return F.bround(value.cast("double") * F.coalesce(_by_period(name, lambda r: r[1]), F.lit(1.0))).cast("long")


def credible(value: Column, name: Column) -> Column:
    """Whether an amount is sane for its period (L4)."""
    return value.between(_by_period(name, lambda r: r[2][0]), _by_period(name, lambda r: r[2][1]))


def label_window(before: Column) -> Column:
    """What stands before an amount and belongs to it: the last 40 characters after the last stop or currency."""
    return F.right(F.regexp_replace(before, r"(?s)^.*(?:\.|;|s/|us\$)", ""), F.lit(40))


def _patterns():
    for lead in (True, False):
        for currency, sign in _CURRENCY.items():
            yield currency, 2, (rf"{sign}\s*({AMOUNT}){_TO}(?:{sign}\s*)?({AMOUNT})" if lead else rf"({AMOUNT}){_TO}({AMOUNT})\s*{sign}")
    for lead in (True, False):
        for currency, sign in _CURRENCY.items():
            yield currency, 1, (rf"{sign}\s*({AMOUNT})" if lead else rf"({AMOUNT})\s*{sign}")


def _found(text: Column, pattern: str, amounts: int) -> Column:
    """array<struct<before, all, a, b, after>> of the matches of one pattern.

    Each match is read with the stretch before it, so that what stands around it follows from lengths; a
    look behind would try all its lengths at every character."""
    placed = rf"(?sU)\G(.*?)({pattern})"
    group = lambda k, name: F.regexp_extract_all(text, F.lit(placed), F.lit(k)).alias(name)
    each = F.arrays_zip(group(1, "gap"), group(2, "whole"), group(3, "a"), group(3 + amounts - 1, "b"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(_MATCH).alias("found"))

    def step(state: Column, x: Column) -> Column:
        at = state["end"] + F.char_length(x["gap"])
        end = at + F.char_length(x["whole"])
        before = F.substring(text, F.greatest(at - _BEFORE, F.lit(0)) + 1, F.least(at, F.lit(_BEFORE)))
        match = F.struct(before.alias("before"), x["whole"].alias("whole"), x["a"].alias("a"), x["b"].alias("b"), F.substring(text, end + 1, F.lit(_AFTER)).alias("after"))
        return F.struct(end.alias("end"), F.array_append(state["found"], match).alias("found"))

    return F.aggregate(each, start, step, lambda s: s["found"])


_MATCH = "array<struct<before:string,whole:string,a:string,b:string,after:string>>"


def rated(text: Column) -> Column:
    """array<struct> of all credible readings of a collapsed text: how little they are trusted, amounts by month, the
    number ``k`` of the pattern that gave them, and whether a label tells that they are pay (L6).

    What the patterns find is one array that goes through each step once: period and values, monthly values, trust."""
    patterns = list(_patterns())
    numbered = lambda found: F.flatten(F.transform(found, lambda f, k: F.transform(f, lambda x, i: x.withField("k", k).withField("i", i))))
    found = F.array(*(F.when(text.rlike(p), _found(text, p, n)).otherwise(F.array().cast(_MATCH)) for _, n, p in patterns))
    dollars = lambda x: x["k"].isin([k for k, (currency, _, _) in enumerate(patterns) if currency == "USD"])
    single = lambda x: x["k"].isin([k for k, (_, n, _) in enumerate(patterns) if n == 1])

    def read(x: Column) -> Column:
        near = F.concat(x["before"], x["whole"], x["after"])
        return F.struct(x["k"].alias("k"), x["i"].alias("i"), period(x["after"], x["before"]).alias("p"), amount(x["a"]).alias("va"), amount(x["b"]).alias("vb"), label_window(x["before"]).alias("w"), (any_of(near, rules.VAGUE_PAY) | any_of(near, rules.PAY_NOISE)).alias("noisy"), F.trim(x["whole"]).alias("literal"))

    def convert(x: Column) -> Column:
        sane = dollars(x) | credible(x["va"], x["p"]) & credible(x["vb"], x["p"])
        return F.struct(x["k"].alias("k"), x["i"].alias("i"), x["p"].alias("p"), x["w"].alias("w"), x["literal"].alias("literal"), (sane & ~x["noisy"]).alias("sane"), monthly(x["va"], x["p"]).alias("ma"), monthly(x["vb"], x["p"]).alias("mb"))

    def keep(x: Column) -> Column:
        low, high = (F.when(dollars(x), rules.MONTHLY_RANGE["USD"][k]).otherwise(rules.MONTHLY_RANGE["PEN"][k]) for k in (0, 1))
        least, most = F.least(x["ma"], x["mb"]), F.greatest(x["ma"], x["mb"])
        return x["sane"] & x["ma"].isNotNull() & x["mb"].isNotNull() & (least >= low) & (most <= high) & ~any_of(x["w"], rules.NOT_PAY) & (single(x) | (most <= 6 * least))

    def rate(x: Column) -> Column:
        trust = F.lit(100) - F.when(dollars(x), 5).otherwise(0) - F.when(single(x), 5).otherwise(0) - F.when(x["p"] != "mensual", 25).otherwise(0) + F.when(any_of(x["w"], rules.PAY_LABELS), 5).otherwise(0)
        money = F.when(dollars(x), "USD").otherwise("PEN")
        return F.struct((-F.least(trust, F.lit(100))).alias("distrust"), F.least(x["ma"], x["mb"]).cast("int").alias("minimo"), x["i"].alias("i"), F.greatest(x["ma"], x["mb"]).cast("int").alias("maximo"), money.alias("moneda"), x["literal"].alias("literal"), x["k"].alias("k"), any_of(x["w"], rules.EXPLICIT_LABELS).alias("labelled"))

    can = text.rlike(r"\d") & text.rlike(_SOME_CURRENCY)
    rows = F.transform(F.filter(F.transform(F.transform(numbered(found), read), convert), keep), rate)
    return F.when(can, rows).otherwise(F.array().cast(_RATED))


_RATED = "array<struct<distrust:int,minimo:int,i:int,maximo:int,moneda:string,literal:string,k:int,labelled:boolean>>"


def chosen(readings: Column, labelled: bool) -> Column:
    """Of rated readings those of the first pattern that has any, or any with a label."""
    fits = lambda x: x["labelled"] if labelled else F.lit(True)
    least = F.array_min(F.transform(readings, lambda x: F.when(fits(x), x["k"])))
    return let(least, lambda k: F.filter(readings, lambda x: fits(x) & (x["k"] == k)))


def candidates(text: Column, labelled: bool) -> Column:
    """array<struct> of credible readings of a collapsed text, by the first pattern that has any."""
    return let(rated(text), lambda r: chosen(r, labelled))


def salary_of(plain: Column, readings: Column) -> Column:
    """The salary of a collapsed text with its candidates: the legal minimum if it is named, else the best one."""
    wage = F.struct(F.lit(rules.MINIMUM_WAGE).alias("minimo"), F.lit(rules.MINIMUM_WAGE).alias("maximo"), F.lit("PEN").alias("moneda"), F.lit("mensual").alias("periodo"), F.lit("RMV").alias("literal"), F.lit(85).alias("confianza")).cast(SALARY)

    def found(best: Column) -> Column:
        pay = F.struct(best["minimo"].alias("minimo"), best["maximo"].alias("maximo"), best["moneda"].alias("moneda"), F.lit("mensual").alias("periodo"), best["literal"].alias("literal"), (-best["distrust"]).alias("confianza"))
        return F.when(best.isNotNull(), pay.cast(SALARY))

    return F.when(names_minimum(plain), wage).otherwise(let(F.array_min(readings), found))


def names_minimum(plain: Column) -> Column:
    return plain.rlike(rf"(?=[rs]){WORD_START}(?:rmv|remuneraci[oó]n m[ií]nima vital|sueldo m[ií]nimo)\b")


def several_of(readings: Column) -> Column:
    return F.size(F.array_distinct(F.transform(readings, lambda x: F.struct(x["minimo"].alias("a"), x["maximo"].alias("b"))))) > 1


def extract_salary(text: Column, labelled: bool = False) -> Column:
    """The salary that a text declares, as SALARY, or null: the most trusted reading, the lowest of equals."""
    return let(collapse(text), lambda t: salary_of(t, candidates(t, labelled)))


def declares_several(text: Column) -> Column:
    """Whether a text labels more than one distinct salary."""
    return let(collapse(text), lambda t: several_of(candidates(t, True)))


def declares_vague(text: Column) -> Column:
    """Whether a text hides its pay behind stock wording."""
    return any_of(collapse(text), rules.VAGUE_PAY)


def in_pen(low: Column, currency: Column) -> Column:
    """Amount for comparison, by the reference rate, cut to a whole number."""
    return F.when(currency == "USD", F.floor(low * rules.REFERENCE_RATE)).otherwise(low).cast("int")


def choose(ambiguous: Column, labelled: Column, field: Column, anywhere: Column) -> Column:
    """None if two salaries are declared; else the labelled one, the field's, or any."""
    return F.when(~ambiguous, F.coalesce(labelled, field, anywhere))


def salary_text(low: Column, high: Column, currency: Column) -> Column:
    """'S/ 1,200 – S/ 1,500', one amount, or 'Sin sueldo' (L12)."""
    sign = F.when(currency == "PEN", "S/ ").otherwise("US$ ")
    one = lambda x: F.concat(sign, F.format_number(x, 0))
    return F.when(F.coalesce(low, F.lit(0)) == 0, "Sin sueldo").when((F.coalesce(high, F.lit(0)) != 0) & (high != low), F.concat(one(low), F.lit(" – "), one(high))).otherwise(one(low))
