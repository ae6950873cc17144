"""SQL expressions for the oracles: the same rules, told in DuckDB's SQL."""

from __future__ import annotations

import re

from ..functions import rules
from ..functions.text import fold_python


#: The entities that the given pages and the made ones hold, ``&amp;`` last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó", "&uacute;": "ú", "&ntilde;": "ñ", "&amp;": "&"}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def alternatives(words) -> str:
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def has_any(x: str, words) -> str:
    return f"regexp_matches({x}, {lit(alternatives(words))})"


def has_word(x: str, words, end: bool = True) -> str:
    """Whether a word stands in a folded text, between characters that aren't a-z, 0-9, _."""
    return f"regexp_matches({x}, {lit('(^|[^a-z0-9_])(' + alternatives(words) + ')' + ('($|[^a-z0-9_])' if end else ''))})"


def lines(html: str) -> str:
    t = html
    for pattern, by in ((r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "' '"), (r"(?i)<\s*br\s*/?\s*>", "chr(10)"), (r"(?i)</\s*(?:p|div|li|tr|h[1-6]|section|ul|ol)\s*>", "chr(10)"), (r"(?i)<\s*li[^>]*>", "chr(10) || '• '"), (r"<[^>]+>", "' '")):
        t = f"regexp_replace({t}, {lit(pattern)}, {by}, 'g')"
    for entity, c in ENTITIES.items():
        t = f"replace({t}, {lit(entity)}, {lit(c)})"
    t = f"replace(replace({t}, chr(160), ' '), chr(8203), '')"
    clean = r"regexp_replace(regexp_replace(trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(13)), '^[•\-*●▪·o]\s*', ''), '^\d{1,2}[.)]\s*', '')"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {clean}), lambda x: length(x) > 1)"


def heading(line: str) -> str:
    bare = f"trim({fold(line)}, ' :.-–—¿?¡!*')"
    out = [f"when length({bare}) > 60 then null", f"when regexp_matches({bare}, {lit('^(' + alternatives(rules.CLOSING) + ')( .*)?$')}) then 'descartado'"]
    for section, titles in rules.HEADINGS.items():
        singular = [t.rstrip("s") for t in titles]
        out.append(f"when regexp_matches({bare}, {lit('^((' + alternatives(titles) + ')( .*)?|(' + alternatives(singular) + ')s*)$')}) then {lit(section)}")
    return f"case {' '.join(out)} end"


def clean_items(items: str, least: int = 12, most: int = 320, limit: int = 12) -> str:
    trimmed = f"list_transform({items}, lambda x: trim(x, ' -–—•*:;'))"
    good = f"list_filter({trimmed}, lambda x: length(x) between {least} and {most} and contains(x, ' ') and not regexp_matches(x, {lit('(?i)^(av\\.|jr\\.|calle|telf|tel[eé]fono|correo|email|enviar cv|postula)')}) and not regexp_matches(x, {lit('(?i)no\\s+(se\\s+)?especificad')}))"
    key = lambda x: f"left({fold(x)}, 70)"
    first = f"list_filter({good}, lambda x, i: list_position(list_transform({good}, lambda y: {key('y')}), {key('x')}) = i)"
    return f"list_transform({first}, lambda x: upper(x[1]) || x[2:])[1:{limit}]"


def fingerprint(title: str, employer: str, city: str) -> str:
    stops = ", ".join(map(lit, rules.FINGERPRINT_STOPS))
    words = f"list_sort(list_filter(regexp_extract_all({fold(title)}, '[a-z0-9+#]+'), lambda w: w not in ({stops})))"
    return f"left(sha1(concat(array_to_string({words}, ' '), '|', {fold(employer)}, '|', {fold(city)})), 16)"


def slug(title: str, key: str) -> str:
    bare = f"trim(regexp_replace({fold(title)}, '[^a-z0-9]+', '-', 'g'), '-')"
    return f"concat(trim(left({bare}, 70), '-'), '-', left({key}, 8))"


def category(title: str, body: str) -> str:
    """Struct comparison of (score, -rank, name), by title and then by text."""

    def scores(x: str, all_: bool) -> str:
        rows = []
        for rank, (name, cues) in enumerate(rules.CATEGORY_CUES.items()):
            if name != "Prácticas" or all_:
                hits = " + ".join(f"cast({has_word(x, [c], c == 'intern')} as int)" for c in sorted({fold_python(c) for c in cues}))
                rows.append(f"{{'score': {hits}, 'rank': -{rank}, 'name': {lit(name)}}}")
        return f"list_max(list_filter([{', '.join(rows)}], lambda r: r.score > 0)).name"

    intern = " or ".join(has_word(fold(title), [c], c == "intern") for c in sorted({fold_python(c) for c in rules.CATEGORY_CUES["Prácticas"]}))
    return f"case when {intern} then 'Prácticas' else coalesce({scores(fold(title), True)}, {scores(fold(f'concat({title}, chr(32), left({body}, 500))'), False)}, 'Otros') end"


def place(text: str, which: str) -> str:
    t = fold(text)
    out = [f"when {has_word(t, [city])} then {lit(city.title() if which == 'ciudad' else region)}" for city, region in rules.CITIES.items()]
    out.append(f"when {has_word(t, [fold_python(d) for d in rules.DISTRICTS])} then 'Lima'")
    out += [f"when {has_word(t, [fold_python(r)])} then {lit(r)}" for r in rules.REGIONS]
    return f"case {' '.join(out)} else '' end"


def work_mode(text: str) -> str:
    t = fold(text)
    return f"case when {has_word(t, ('hibrido', 'semipresencial', 'mixto', '3 dias en oficina', '2 dias remoto'))} then 'Híbrido' when {has_word(t, ('remoto', 'teletrabajo', 'home office', '100% remoto', 'desde casa', 'work from home'))} then 'Remoto' else 'Presencial' end"


def percent(part: str, whole: str, digits: int = 0) -> str:
    return f"coalesce(round_even(100.0 * {part} / nullif({whole}, 0), {digits}), 0.0)"
