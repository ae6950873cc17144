"""Text operators as Column functions: folding, lines, sections, items."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from html import entities

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

SECTIONS = ("funciones", "requisitos", "beneficios")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often later expressions use them."""
    packed = F.struct(*(v.alias(k) for k, v in columns.items()))
    return df.select("*", F.inline(F.array(packed)))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Where a word can begin that starts with a letter or digit: most places are told by the ASCII character before them, which is quicker.
WORD_START = r"(?<![A-Za-z0-9_])(?U)\b"


def words_pattern(words, start: str = WORD_START, end: str = r"\b") -> str:
    """One alternation, in order, of literal words between word boundaries."""
    return f"{start}(?:{'|'.join(map(literal, words))}){end}"


def by_first_letter(words) -> str:
    """A pattern of one of the words, of several that match at a place the first; those of a letter are tried together."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(literal(w[1:]) if not w.endswith(r"\b") else literal(w[1:-2]) + r"\b")
    return "(?:" + "|".join(f"{literal(c)}(?:{'|'.join(rest)})" for c, rest in groups.items()) + ")"


def constant(table: dict, kind: str) -> Column:
    """A map of fixed values, made once for a query."""
    return F.from_json(F.lit(json.dumps(table)), kind)


def literal(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def any_of(text: Column, phrases) -> Column:
    """Whether one of the phrases is a part of the text; only where a letter stands that one begins with, they are tried."""
    first = "".join(sorted({re.sub(r"([^\w])", r"\\\1", p[0]) for p in phrases}))
    return text.rlike(f"(?=[{first}]){by_first_letter(phrases)}")


@functools.cache
def _accents() -> tuple[str, str]:
    """Characters that decompose to one base character and marks, and these bases."""
    source, base = [], []
    for c in map(chr, [*range(0xC0, 0xD800), *range(0xF900, 0x10000)]):
        plain = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(plain) == 1 and plain[0] != c:
            source.append(c)
            base.append(plain[0])
    return "".join(source), "".join(base)


# The accented letters of Spanish, and of the languages that postings are in, with their bases.
_USUAL = {"á": "a", "é": "e", "í": "i", "ó": "o", "ú": "u", "ü": "u", "ñ": "n"}
_COMMON = ("áéíóúüñÁÉÍÓÚÜÑàâçèêëîïôùûÀÂÇÈÊËÎÏÔÙÛäöÄÖ", "aeiouunAEIOUUNaaceeeiiouuAACEEEIIOUUaoAO")


# Where other accents can be: not among signs, punctuation and letters that have no base.
_ACCENTED = r"[\u00C0-\u00D6\u00D8-\u00DE\u00E0-\u00F6\u00F8-\u1FFF\u2100-\uFFFF]"


def fold(text: Column) -> Column:
    """Lower case without accents; null is empty.

    The usual accents are replaced one by one, as a translation looks up every character; the whole table of
    accents is only gone through where a text has others than the common ones."""
    usual = lambda t: functools.reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(_USUAL[c])), _USUAL, t)
    common = lambda t: F.translate(t, *_COMMON)
    rest = lambda t: F.when(t.rlike(_ACCENTED), F.regexp_replace(F.translate(t, *_accents()), r"\p{Mn}", "")).otherwise(t)
    other = lambda t: F.octet_length(t) != F.char_length(t)
    plain = lambda t: let(usual(t), lambda u: F.when(other(u), let(common(u), rest)).otherwise(u))
    return F.lower(let(F.coalesce(text, F.lit("")), lambda t: F.when(other(t), plain(t)).otherwise(t)))


def fold_python(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


@functools.cache
def _named() -> tuple[str, str]:
    """Names of entities and their characters as a JSON map of maps by first letter, as a map is gone through key by key, and a pattern of those that need no semicolon, longest first."""
    open_ = sorted((k for k in entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    by_letter: dict[str, dict[str, str]] = {}
    for name, char in entities.html5.items():
        by_letter.setdefault(name[0], {})[name] = char
    return json.dumps(by_letter), f"^({'|'.join(open_)})"


@functools.cache
def _numbered() -> str:
    """Numbers that stand for other characters, as browsers read them, as a JSON map: those of Windows-1252, and 13 as itself."""
    return json.dumps({str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)})


# Names that are looked up first, as a map is gone through key by key.
_FREQUENT = {k: entities.html5[k] for k in ("amp;", "nbsp;", "aacute;", "eacute;", "iacute;", "oacute;", "uacute;", "ntilde;", "lt;", "gt;", "quot;")}
_ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _number(name: Column) -> Column:
    """The character of '#233;' or '#xE9;'; none for numbers that are no characters of a text."""
    digits = F.rtrim(F.regexp_replace(name, "^#[xX]?", ""), F.lit(";"))
    n = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("decimal(38,0)")
    known = F.try_element_at(F.from_json(F.lit(_numbered()), "map<string,string>"), n.cast("string"))
    char = F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")
    bad = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    dropped = n.between(1, 8) | n.between(0xE, 0x1F) | (n == 0x7F) | (n == 0xB) | n.between(0xFDD0, 0xFDEF) | ((n % 65536) >= 65534)
    return F.when(bad, "\ufffd").otherwise(F.coalesce(known, F.when(dropped, "").otherwise(char)))


def _entity(name: Column) -> Column:
    """What '&' and this name stand for: a character, one with a rest, or themselves."""
    table, open_ = _named()
    known = lambda x: F.try_element_at(constant(_FREQUENT, "map<string,string>"), x)
    of = lambda x: F.coalesce(known(x), F.try_element_at(F.try_element_at(F.from_json(F.lit(table), "map<string,map<string,string>>"), F.substring(x, 1, 1)), x))
    start = F.regexp_extract(name, open_, 1)
    rest = F.when(start != "", F.concat(of(start), F.substring(name, F.char_length(start) + 1, F.char_length(name))))
    return F.when(name.startswith("#"), _number(name)).otherwise(F.coalesce(of(name), rest, F.concat(F.lit("&"), name)))


def unescape(text: Column) -> Column:
    """Decodes all entities, named and numeric, with and without their semicolon."""

    def decode(t: Column) -> Column:
        names = F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(1))
        pieces = F.transform(F.split(t, _ENTITY, -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return let(names, lambda n: F.array_join(F.transform(pieces, lambda p: F.concat(p["x"], F.coalesce(let(F.get(n, p["i"]), _entity), F.lit("")))), ""))

    return let(text, lambda t: F.when(t.contains("&"), decode(t)).otherwise(t))


# What goes, what breaks a line, and what opens an item. Within a closing tag, a break counts as the white space that it becomes.
DROPPED = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
_BR = r"<\s*br\s*/?\s*>"
_GAP = rf"\s*(?:{_BR}\s*)*+"
BREAKS = rf"(?i)<(?:{_BR[1:]}|/{_GAP}(?:p|div|li|tr|h[1-6]|section|ul|ol){_GAP}>)"
ITEM = r"(?i)<\s*li[^>]*>"
#: All white space of Unicode, which is what (?U)\s stands for.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Blanks that are not one space, and tags with the blanks around them.
_BLANKS = r" [ \t]+|\t[ \t]*"
_TAGS = rf"(?=[< \t])(?:[ \t]*+(?:<[^>]+>[ \t]*+)++|{_BLANKS})"
#: What parts the lines of a text: white space around a break, and what opens an item after it, with its number.
_PARTS = r"(?U)\s*?\n\s*+(?:[•\-*●▪·o](?:(?!\n)\s)*+)?(?:\d{1,2}[.)](?:(?!\n)\s)*+)?"


#: A page without scripts, styles and tags within tags that ends with a break, but for white space and its own end.
_CLOSED = r"(?is)^(?!.*<s[ct])(?!.*<[^<>]*<).*</\s*(?:p|div|li|tr|h[1-6]|section|ul|ol)\s*>\s*(?:</(?:body|html)>\s*)*$"


def closed(html: Column) -> Column:
    """Whether nothing of a page reaches into what is put behind it: the lines of both are those of each."""
    return html.rlike(_CLOSED)


def html_to_lines(html: Column) -> Column:
    """Array of clean lines; breaks follow block tags.

    All lines are cleaned at once, as one text, before they are parted."""
    t = let(F.coalesce(html, F.lit("")), lambda t: F.when(t.rlike("<[sS]"), F.regexp_replace(t, DROPPED, " ")).otherwise(t))
    # any of the signs that open an item does for one
    t = F.regexp_replace(F.regexp_replace(t, BREAKS, "\n"), ITEM, "\n* ")
    t = F.regexp_replace(t, _TAGS, " ")
    signs = lambda t: F.replace(F.replace(t, F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    t = let(t, lambda t: F.when(t.rlike("[&\u00a0\u200b]"), F.regexp_replace(let(unescape(t), signs), _BLANKS, " ")).otherwise(t))
    t = F.regexp_replace(F.concat(F.lit("\n"), t, F.lit("\n")), _PARTS, "\n")
    return F.filter(F.split(t, "\n"), lambda x: F.char_length(x) > 1)


_TRIM = " :.-–—¿?¡!*"
#: Stands before a line that can be a heading.
_MARK = "\x01"


def _can_open() -> str:
    """A pattern of where a line begins as a heading may, before it is folded: by three letters, of which any may be another sign."""
    tree: dict[str, dict[str, set[str]]] = {}
    for t in [*rules.CLOSING, *(t.rstrip("s") for titles in rules.HEADINGS.values() for t in titles)]:
        tree.setdefault(fold_python(t)[0], {}).setdefault(fold_python(t)[1], set()).add(fold_python(t)[2])
    other = r"[^\x00-\x7F]"
    one = lambda letters: "[" + "".join(x + x.upper() for x in sorted(letters)).replace("  ", " ") + "]"
    begins = "|".join(f"{one(a)}(?:{other}|{'|'.join(f'{one(b)}(?:{one(c)}|{other})' for b, c in two.items())})" for a, two in tree.items())
    return rf"(?dm)^(?={_MARK}|[ :.\-–—¿?¡!*]*+(?:{begins}|{other}))"


_CAN_OPEN = _can_open()


def heading(line: Column) -> Column:
    """The section that a line opens: ``descartado`` or one of SECTIONS, else null."""
    return let(fold(line), _opens)


def _opens(folded: Column) -> Column:
    return let(F.btrim(folded, F.lit(_TRIM)), _section)


def _section(bare: Column) -> Column:
    out = F.when(F.char_length(bare) > 60, F.lit(None).cast("string"))
    begins = lambda words: F.substring(bare, 1, 1).isin(*sorted({w[0] for w in words}))
    out = out.when(begins(rules.CLOSING) & bare.rlike(rf"^{by_first_letter(rules.CLOSING)}(?: .*)?$"), "descartado")
    for section, titles in rules.HEADINGS.items():
        out = out.when(begins(titles) & bare.rlike(rf"^(?:{by_first_letter(titles)}(?: .*)?|{by_first_letter(t.rstrip('s') for t in titles)}s*)$"), section)
    return out


def partition(lines: Column) -> Column:
    """struct<intro, funciones, requisitos, beneficios, descartado>: lines by the last heading before them (T4).

    Few lines begin as a heading does: these get a mark, in one search, and only they are looked at. A section's
    lines are the slices between the headings."""
    opens = lambda x: F.when(x.startswith(_MARK), heading(F.substr(x, F.lit(2))))
    opened = lambda f: F.filter(F.transform(f, lambda x, i: F.struct(opens(x).alias("opens"), i.alias("i"))), lambda x: x["opens"].isNotNull())
    marked = lambda l: F.split(F.regexp_replace(F.array_join(l, "\n", ""), _CAN_OPEN, _MARK), "\n", -1)
    each = lambda l: let(marked(l), lambda m: F.when(F.size(m) == F.size(l), m).otherwise(F.transform(l, lambda x: F.concat(F.lit(_MARK), F.coalesce(x, F.lit(""))))))
    return let(lines, lambda l: let(let(each(l), opened), lambda heads: _parts(l, heads)))


def _parts(lines: Column, heads: Column) -> Column:
    rest = lambda x: F.regexp_replace(F.regexp_extract(x, r"(?s)^[^:：]*[:：](.*)$", 1), r"(?U)^\s+|\s+$", "")
    own = lambda x: let(rest(x), lambda r: F.when(F.char_length(r) > 15, F.array(r)).otherwise(F.array().cast("array<string>")))
    end = lambda k: F.coalesce(F.get(heads, k)["i"], F.size(lines))

    def part(x: Column, k: Column) -> Column:
        after = F.slice(lines, x["i"] + 2, end(k + 1) - x["i"] - 1)
        return F.struct(x["opens"].alias("opens"), F.concat(own(F.get(lines, x["i"])), after).alias("lines"))

    def named(parts: Column) -> Column:
        of = lambda n: F.flatten(F.transform(F.filter(parts, lambda x: x["opens"] == n), lambda x: x["lines"]))
        return F.struct(F.slice(lines, 1, end(F.lit(0))).alias("intro"), *(of(n).alias(n) for n in (*SECTIONS, "descartado")))

    return let(F.transform(heads, part), named)


def firsts(items: Column, key) -> Column:
    """The items whose key no earlier one has; keys are made once an item."""
    named = F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("x")))
    with_keys = lambda s: F.struct(s.alias("s"), F.transform(s, lambda x: x["k"]).alias("k"))
    pick = lambda p: F.transform(F.filter(p["s"], lambda x, i: F.array_position(p["k"], x["k"]) == i + 1), lambda x: x["x"])
    return let(let(named, with_keys), pick)


def clean_items(items: Column, least: int = 12, most: int = 320, limit: int = 12) -> Column:
    """The lines that look like items of a list, first of equal ones, capitalised."""
    trimmed = F.transform(items, lambda x: F.regexp_replace(x, r"^[ \-–—•*:;]+|[ \-–—•*:;]+$", ""))
    good = F.filter(
        trimmed,
        lambda x: F.char_length(x).between(least, most)
        & x.contains(" ")
        & ~x.rlike(r"(?iu)^(?:av\.|jr\.|calle|telf|tel[eé]fono|correo|email|enviar cv|postula)")
        & ~x.rlike(r"(?iuU)no\s+(?:se\s+)?especificad"),
    )
    first = firsts(good, lambda x: F.substring(fold(x), 1, 70))
    return F.slice(F.transform(first, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), 1, limit)


def rescue_duties(lines: Column) -> Column:
    """Lines whose first word is a duty verb, or looks like one (T5)."""
    verbs = [fold_python(v) for v in rules.DUTY_VERBS]

    def is_duty(line: Column) -> Column:
        first = F.regexp_replace(F.substring_index(fold(line), " ", 1), "[,.:]+$", "")
        return let(first, lambda w: w.isin(verbs) | w.endswith("ar") & (F.char_length(w) > 5))

    return F.filter(lines, is_duty)


def with_blocks(df: DataFrame, body: str = "body", lists: tuple[str, ...] = ("requisitos", "beneficios")) -> DataFrame:
    """df with lines, intro, funciones, requisitos, beneficios of the HTML in ``body`` (T7); of the last two, those in ``lists``."""
    df = once(df, lines=html_to_lines(F.col(body)))
    df = once(df, blocks=partition(F.col("lines")))
    df = once(df, intro=F.col("blocks.intro"), duties=clean_items(F.col("blocks.funciones")), **{n: clean_items(F.col(f"blocks.{n}")) for n in lists})
    duties = F.when(F.size("duties") > 0, F.col("duties")).otherwise(clean_items(rescue_duties(F.col("intro"))))
    return once(df, funciones=duties).drop("blocks", "duties")


def summary(intro: Column, duties: Column, title: Column) -> Column:
    """The first telling line of the introduction, else the first duty, else empty."""
    start = F.substring(fold(title), 1, 12)
    telling = F.filter(intro, lambda x: F.char_length(x).between(40, 240) & ~fold(x).startswith(start))
    return F.coalesce(F.get(telling, F.lit(0)), F.get(duties, F.lit(0)), F.lit(""))


def is_filler(text: Column) -> Column:
    """Whether a line is a stock phrase without content."""
    return (F.char_length(text) < 60) & any_of(fold(text), rules.FILLER)


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s{2,}|[^\S ]", " ")
