"""Classification operators: work mode, place, category, hidden employers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import WORD_START, any_of, by_first_letter, constant, fold, fold_python, let, words_pattern


def work_mode(text: Column) -> Column:
    """Hybrid before remote before on-site, which is also the default (K1)."""
    return let(fold(text), mode_of)


def mode_of(folded: Column) -> Column:
    hybrid = ("hibrido", "semipresencial", "mixto", "3 dias en oficina", "2 dias remoto")
    remote = ("remoto", "teletrabajo", "home office", "100% remoto", "desde casa", "work from home")
    words = lambda x: folded.rlike(words_pattern(x))
    # most texts name none of them
    return F.when(~any_of(folded, hybrid + remote), "Presencial").when(words(hybrid), "Híbrido").when(words(remote), "Remoto").otherwise("Presencial")


#: Characters of a body that its place and its category are looked for in.
PLACE_CHARS, CATEGORY_CHARS = 1200, 500


def place(location: Column, body: Column) -> Column:
    """struct<ciudad, departamento>: the first known city, else district, else region, in list order (K2)."""
    return let(fold(F.concat(F.coalesce(location, F.lit("")), F.lit(" "), F.substring(F.coalesce(body, F.lit("")), 1, PLACE_CHARS))), place_of)


def _named(t: Column, words) -> Column:
    """The words of a list that stand in a folded text, as far as they come first in the list where several start."""
    return F.regexp_extract_all(t, F.lit(rf"{WORD_START}(?=({by_first_letter(words)})\b)"), F.lit(1))


def place_of(t: Column) -> Column:
    """One search for all cities and regions, in list order by their rank, and one for districts between them."""
    pair = lambda a, b: {"ciudad": a, "departamento": b}
    ranked = {city: {"rank": k, **pair(city.title(), region)} for k, (city, region) in enumerate(rules.CITIES.items())}
    regions = {fold_python(r): {"rank": k, **pair(r, r)} for k, r in enumerate(rules.REGIONS)}
    kind = "map<string,struct<rank:int,ciudad:string,departamento:string>>"
    first = lambda table: F.array_min(F.transform(_named(t, list(table)), lambda x: F.try_element_at(constant(table, kind), x)))
    of = lambda x: F.struct(x["ciudad"].alias("ciudad"), x["departamento"].alias("departamento"))
    lima, none = (F.struct(F.lit(x).alias("ciudad"), F.lit(x).alias("departamento")) for x in ("Lima", ""))
    later = lambda: F.when(t.rlike(words_pattern(rules.DISTRICTS)), lima).otherwise(let(first(regions), lambda x: F.when(x.isNotNull(), of(x)).otherwise(none)))
    return let(first(ranked), lambda x: F.when(x.isNotNull(), of(x)).otherwise(later()))


def _cues() -> tuple[str, dict[str, list[int]]]:
    """A pattern of the longest cue at a place, and for each cue the numbers of those that stand there with it: category * 1000 + cue."""
    numbers: dict[str, list[int]] = {}
    for rank, cues in enumerate(rules.CATEGORY_CUES.values()):
        for k, cue in enumerate(sorted({fold_python(c) for c in cues})):
            numbers.setdefault(cue, []).append(1000 * rank + k)
    longest = sorted(numbers, key=lambda c: (-len(c), c))
    # a cue's beginnings that are cues stand there too, but the one that must be a whole word
    closed = {c: sorted(n for b, each in numbers.items() if c.startswith(b) and (b != "intern" or b == c) for n in each) for c in longest}
    return rf"{WORD_START}(?=({by_first_letter([c + chr(92) + 'b' if c == 'intern' else c for c in longest])}))", closed


def _scores(text: Column, with_title_only: bool) -> Column:
    """array<struct<score, -rank, name>> of the categories that have a cue in a folded text."""
    pattern, closed = _cues()
    stand = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.try_element_at(constant(closed, "map<string,array<int>>"), x))))

    def rows(hits: Column) -> Column:
        score = lambda rank: F.size(F.filter(hits, lambda h: F.floor(h / 1000) == rank))
        named = [(k, name) for k, name in enumerate(rules.CATEGORY_CUES) if name != "Prácticas" or with_title_only]
        return F.filter(F.array(*(F.struct(score(k).alias("score"), F.lit(-k).alias("rank"), F.lit(name).alias("name")) for k, name in named)), lambda x: x["score"] > 0)

    return let(stand, lambda hits: F.when(F.size(hits) > 0, rows(hits)).otherwise(F.array().cast("array<struct<score:int,rank:int,name:string>>")))


def category(title: Column, body: Column) -> Column:
    """The category with most cues in the title, else in title and start of the body; internships only by title, and first (K3)."""
    whole = lambda: fold(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(body, F.lit("")), 1, CATEGORY_CHARS)))
    return let(fold(title), lambda t: category_of(t, whole))


def category_of(title: Column, whole) -> Column:
    """The category of a folded title, and of a folded text where the title tells none; ``whole()`` makes that text."""
    by_text = lambda: let(whole(), lambda t: F.array_max(_scores(t, False))["name"])
    intern = lambda rows: F.exists(rows, lambda x: x["name"] == "Prácticas")
    return let(_scores(title, True), lambda rows: F.when(intern(rows), "Prácticas").otherwise(F.coalesce(F.array_max(rows)["name"], by_text(), F.lit("Otros"))))


def is_hidden_employer(name: Column) -> Column:
    """Whether the employer is missing or a stock phrase (K4)."""
    return (F.coalesce(name, F.lit("")) == "") | any_of(fold(name), rules.HIDDEN_EMPLOYER)


#: Applicant-tracking systems and their marks, in order.
ATS = (
    ("greenhouse", ("boards.greenhouse.io", "greenhouse.io/embed", "grnhse")),
    ("lever", ("jobs.lever.co", "lever.co/postings")),
    ("workday", ("myworkdayjobs.com", "wd1.myworkday", "wd3.myworkday", "wd5.myworkday")),
    ("successfactors", ("successfactors.com", "career_ns=job_listing", "sfcareer")),
    ("cornerstone", (".csod.com", "cornerstoneondemand")),
    ("gupy", (".gupy.io",)),
    ("avature", ("avature.net",)),
    ("smartrecruiters", ("smartrecruiters.com",)),
    ("icims", ("icims.com",)),
    ("taleo", ("taleo.net",)),
)


def detect_ats(text: Column) -> Column:
    """The first applicant-tracking system whose mark is in a page or URL, else empty."""
    t, out = F.lower(F.coalesce(text, F.lit(""))), F
    for name, marks in ATS:
        out = out.when(any_of(t, marks), name)
    return out.otherwise("")
