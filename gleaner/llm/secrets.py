"""Operator 7: secret scans with a battery of randomness tests, in DataFrame functions only.

Base patterns name three kinds of secrets. Beyond them, every long token of mixed characters is
tested: its encoding is inferred from its characters; a chi-squared test holds its characters
against a uniform alphabet, a runs test and a lag-1 serial correlation hold their order against
chance; the least of the three p-values, times three, is how likely the token is if it is random.
The chi-squared statistic itself (as the number of equal character pairs), and the likelihood of
its letters and of its changes between lower case, upper case and digits, are also held against
ordinary text: the less of both, doubled, is the p-value of being ordinary (the inverse of a
likelihood ratio is one, by Markov's inequality). The quotient of both, being ordinary over being
random, goes into the discovery control: it is no less than a p-value of being ordinary, and a
token that fails a test of randomness is held to that much more evidence. Discoveries are
controlled at a false discovery rate per encoding, with weights in proportion to length up to
``WEIGHED`` characters. The counts for that come from a histogram of p-values, which has a bounded
number of rows.

Finds are located natively: a text is split at the pattern and the lengths of the pieces and of
the matches are added up.

Defined cases: null text counts as empty; no spans give empty strings and the digest of the empty
string; a random span that overlaps a base span is dropped; rows that repeat a doc_id are each
returned; a very long text or token is scanned whole; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut, free, pick

# The base patterns, by kind, in order of rank; the least length is that of the last group.
PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Tokens that are tested: maximal runs of these characters, of LEAST characters or more.
TOKEN = r"[A-Za-z0-9+/_=-]"
LEAST = 20
#: Longer tokens weigh as much as those of this length, so that one very long token takes no weight from all others.
WEIGHED = 64
#: The false discovery rate, and the p-value of being random below which nothing else makes a token a find.
RATE, LEAST_P = 0.001, 1e-5
#: Share of equal pairs of characters in ordinary text of an encoding.
ORDINARY = {"hex": 0.12, "base32": 0.07, "base32hex": 0.07, "base36": 0.07, "base62": 0.06, "base64": 0.06}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE64 = _LETTERS + _LETTERS.lower() + "0123456789+/"
ALPHABETS = {"hex": "0123456789ABCDEF", "base32": _LETTERS + "234567", "base32hex": "0123456789" + _LETTERS[:22], "base36": _LETTERS + "0123456789", "base62": _BASE64, "base64": _BASE64}
_SIZES = {"hex": 16, "base32": 32, "base32hex": 32, "base36": 36, "base62": 62, "base64": 64}
#: Per mille of A to Z in ordinary text of the four languages, and the share that is taken as even.
_PER_MILLE = (80, 14, 32, 43, 145, 14, 16, 34, 74, 4, 6, 44, 28, 79, 56, 21, 7, 67, 73, 72, 43, 13, 11, 3, 9, 7)
_EVEN = 0.1
_USUAL = [(1 - _EVEN) * x / sum(_PER_MILLE) + _EVEN / 26 for x in _PER_MILLE]
#: Share of changes between neighbours that are lower case, upper case or digits: in ordinary tokens, and at random.
ORDINARY_CHANGES = {"hex": 0.12, "base32": 0.12, "base32hex": 0.12, "base36": 0.12, "base62": 0.25, "base64": 0.25}
_CHANGES = {k: 1 - sum((sum(map(c, v[:62])) / min(len(v), 62)) ** 2 for c in (str.islower, str.isupper, str.isdigit)) for k, v in ALPHABETS.items()}
#: Log of the mean share that a letter of an encoding has in ordinary text.
_LETTER_MEAN = {k: math.log(sum(u for u, x in zip(_USUAL, _LETTERS) if x in v) / sum(x in v for x in _LETTERS)) for k, v in ALPHABETS.items()}


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the rational approximation of its error function."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def finds(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """All matches of all patterns, in one pass, kept: row (a number of its own for each row), the
    kept columns, text_hash, kind, rank, start, end, value; each row also has one line without kind."""
    text = F.coalesce("text", F.lit(""))
    parts = [F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(-1).alias("rank"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit("").alias("value")))]
    token = rf"(?<!{TOKEN}){TOKEN}{{{LEAST},}}"
    for rank, (kind, pattern, group, least) in enumerate((*PATTERNS, ("random", token, 0, LEAST))):
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
        each = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), i.alias("i"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["found"]).alias("size"), x["value"].alias("value")))  # noqa: B023
        parts.append(F.when(text.rlike(pattern), each).otherwise(F.array().cast("array<struct<kind:string,rank:int,i:int,gap:int,size:int,value:string>>")))
    rows = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", *keep, F.xxhash64(text).alias("text_hash"), F.inline(F.concat(*parts)))
    upto = Window.partitionBy("row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(upto)).withColumn("start", F.col("end") - F.col("size"))
    enough = F.lit(False)
    for rank, (_, _, _, least) in enumerate(PATTERNS):
        enough |= (F.col("rank") == rank) & (F.char_length("value") >= least)
    random = F.col("rank") == len(PATTERNS)
    return cut(placed.filter(F.col("kind").isNull() | F.col("size").isNotNull() & (enough | random)).drop("i", "gap", "size"))


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (value and more) of a known encoding, with encoding, size, the p-values uniform, run and serial of the three tests of
    randomness, and p, by which a token is found: that of being ordinary over that of being random."""
    value = F.col("value")
    some, upper = value.rlike("[0-9].*[0-9]"), F.upper("value")
    one_case = (value.rlike("^[A-Z0-9]+=*$") & value.rlike("[A-Z]") | value.rlike("^[a-z0-9]+=*$") & value.rlike("[a-z]")) & some
    encoding = (
        F.when(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$") & value.rlike("[0-9]") & value.rlike("[A-Fa-f]"), "hex")
        .when(one_case & upper.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(one_case & upper.rlike("^[0-9A-V]+=*$"), "base32hex")
        .when(one_case, "base36")
        .when(some & value.rlike("[A-Z].*[A-Z]") & value.rlike("[a-z].*[a-z]"), F.when(value.rlike("[+/_-]"), "base64").otherwise("base62"))
    )
    wide = F.col("encoding").isin("base62", "base64")
    bare = F.regexp_replace(F.when(wide, F.translate("value", "-_", "+/")).otherwise(upper), "=+$", "")
    df = tokens.withColumn("encoding", encoding).filter("encoding is not null").withColumn("bare", bare)
    named = lambda of: F.element_at(F.create_map(*(x for k, v in of.items() for x in (F.lit(k), F.lit(v)))), F.col("encoding"))
    df = df.withColumn("alphabet", named(ALPHABETS)).withColumn("k", named(_SIZES).cast("double")).withColumn("usual", named(ORDINARY))
    df = df.withColumns({"random_changes": named(_CHANGES), "usual_changes": named(ORDINARY_CHANGES), "letter_mean": named(_LETTER_MEAN)})
    df = df.filter(F.char_length("bare") >= LEAST).select("*", F.explode(F.array(F.filter(F.split("bare", ""), lambda x: x != ""))).alias("chars"))
    codes = F.transform("chars", lambda x: F.position(x, F.col("alphabet")).cast("double"))
    df = df.select("*", F.explode(F.array(codes)).alias("codes"))
    n = F.size("codes").cast("double")
    total = lambda column, f: F.aggregate(column, F.lit(0.0), lambda a, x: a + f(x))
    squares = F.aggregate(F.array_distinct("codes"), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter("codes", lambda x: x == c)).cast("double"), F.lit(2.0)))
    df = df.select("*", F.explode(F.array(F.struct(n.alias("n"), squares.alias("squares"), (total("codes", lambda x: x) / n).alias("mean")))).alias("s"))
    df = df.select("*", "s.*")
    middle = (F.col("k") + 1) / 2
    highs = total("codes", lambda x: F.when(x > middle, 1.0).otherwise(0.0))
    turns = F.aggregate(F.sequence(F.lit(1), F.size("codes") - 1), F.lit(1.0), lambda a, i: a + F.when((F.get("codes", i) > middle) != (F.get("codes", i - 1) > middle), 1.0).otherwise(0.0))
    # log of the likelihood at random over that in ordinary text, of letters and of changes
    rare = F.array(*(F.lit(-math.log(u)) for u in _USUAL))
    letters = total("chars", lambda x: F.coalesce(F.get(rare, F.position(F.upper(x), F.lit(_LETTERS)) - 1) + F.col("letter_mean"), F.lit(0.0)))
    kind = lambda x: F.when(x.between("a", "z"), 1).when(x.between("A", "Z"), 2).when(x.between("0", "9"), 3)
    change, stay = F.log(F.col("random_changes") / F.col("usual_changes")), F.log((1 - F.col("random_changes")) / (1 - F.col("usual_changes")))
    step = lambda i: F.coalesce(F.when(kind(F.get("chars", i)) != kind(F.get("chars", i - 1)), change).when(kind(F.get("chars", i)) == kind(F.get("chars", i - 1)), stay), F.lit(0.0))
    changes = F.aggregate(F.sequence(F.lit(1), F.size("chars") - 1), F.lit(0.0), lambda a, i: a + step(i))
    spread = total("codes", lambda x: (x - F.col("mean")) * (x - F.col("mean")))
    lagged = F.aggregate(F.sequence(F.lit(1), F.size("codes") - 1), F.lit(0.0), lambda a, i: a + (F.get("codes", i) - F.col("mean")) * (F.get("codes", i - 1) - F.col("mean")))
    df = df.select("*", F.explode(F.array(F.struct(highs.alias("highs"), turns.alias("runs"), spread.alias("spread"), lagged.alias("lagged"), (letters + changes).alias("ratio")))).alias("t"))
    df = df.select("*", "t.*")
    n, k = F.col("n"), F.col("k")
    chi = k * F.col("squares") / n - n
    uniform = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1))))
    h, l = F.col("highs"), n - F.col("highs")
    expected = 2 * h * l / n + 1
    deviation = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.01)))
    runs = 2 * _upper_tail(F.abs(F.col("runs") - expected) / deviation)
    serial = 2 * _upper_tail(F.abs(F.coalesce(F.try_divide(F.col("lagged"), F.col("spread")), F.lit(1.0))) * F.sqrt(n))
    pairs, equal = n * (n - 1) / 2, (F.col("squares") - n) / 2
    usual = F.col("usual")
    ordinary = _upper_tail((pairs * usual - equal) / F.sqrt(pairs * usual * (1 - usual)))
    ordinary = F.least(2 * F.least(ordinary, F.exp(-F.col("ratio"))), F.lit(1.0))
    df = df.withColumns({"ordinary": ordinary, "uniform": uniform, "run": runs, "serial": serial, "size": n})
    random = F.least(3 * F.least("uniform", "run", "serial"), F.lit(1.0))
    p = F.when(random < LEAST_P, 1.0).otherwise(F.least(F.col("ordinary") / random, F.lit(1.0)))
    return df.select(*tokens.columns, "encoding", "size", "uniform", "run", "serial", p.alias("p"))


def discoveries(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """The tested tokens that are found at the false discovery rate, by weights in proportion to length."""
    weight = F.least("size", F.lit(float(WEIGHED)))
    means = tested.groupBy("encoding").agg(F.avg(weight).alias("usual_size"), F.count(F.lit(1)).alias("tests"))
    weighed = tested.join(F.broadcast(means), "encoding")  # one row an encoding
    level = F.floor(-10 * F.log10(F.greatest(F.col("p") * F.col("usual_size") / weight, F.lit(1e-30))))
    weighed = weighed.withColumn("level", F.greatest(level, F.lit(0)))
    counts = weighed.groupBy("encoding", "tests", "level").agg(F.count(F.lit(1)).alias("n"))  # at most 301 rows an encoding
    upto = Window.partitionBy("encoding").orderBy(F.desc("level"))
    ranked = counts.withColumn("rank", F.sum("n").over(upto))
    passes = F.pow(F.lit(10.0), -F.col("level") / 10) <= rate * F.col("rank") / F.col("tests")
    bounds = ranked.filter(passes).groupBy("encoding").agg(F.min("level").alias("bound")).withColumnRenamed("encoding", "e")
    return weighed.join(F.broadcast(bounds), F.col("encoding") == F.col("e")).filter(F.col("level") >= F.col("bound")).select(*tested.columns)


def spans(found: DataFrame, rate: float = RATE) -> DataFrame:
    """row, start, end, kind, rank: the base and random spans among what finds() gives."""
    columns = ["row", "start", "end", "kind", "rank"]
    base = found.filter(F.col("rank").between(0, len(PATTERNS) - 1)).select(*columns)
    tokens = found.filter(F.col("rank") == len(PATTERNS)).select(*columns, "value")
    found = base.unionByName(discoveries(battery(tokens), rate).select(*columns))
    is_base = F.col("rank") < len(PATTERNS)
    # a random span goes where a base span overlaps it: spans of a text are few, and compared in order
    ahead = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max(F.when(is_base, F.col("end"))).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(is_base, F.col("start"))).over(ahead.rowsBetween(1, Window.unboundedFollowing))
    same = F.max(F.when(is_base, F.lit(1))).over(Window.partitionBy("row", "start"))
    marked = found.withColumns({"reach": reach, "following": following, "same": same})
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("following", F.col("end")) >= F.col("end")) & F.col("same").isNull()
    return marked.filter(is_base | clear).select("row", "start", "end", "kind", "rank")


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = finds(pick(docs, doc_id="long", text="string"), ("doc_id",))
    every = found.filter("kind is null").select("row", "doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("start", "long"), ("end", "long"), ("kind", "string"), ("rank", "int"))))
    both = every.unionByName(spans(found, rate), allowMissingColumns=True)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "rank", "kind", "end"))
    df = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.collect_list(span).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(F.filter("found", lambda s: s["rank"] < len(PATTERNS)))
    return df.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, rate: float = RATE, mark: str = "[SECRET]") -> DataFrame:
    """docs (with doc_id, text) with every span of ``text`` replaced by a mark; overlapping spans are one; other rows stay as they are."""
    found = finds(docs, ("doc_id",))
    by_row = Window.partitionBy("row").orderBy("start", "end")
    earlier = F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    secret = spans(found, rate).withColumn("earlier", earlier)
    parts = secret.withColumn("part", F.sum(F.when(F.coalesce("earlier", F.lit(-1)) < F.col("start"), 1).otherwise(0)).over(by_row))
    merged = parts.groupBy("row", "part").agg(F.min("start").alias("a"), F.max("end").alias("z"))
    gone = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("gone"))
    named = found.filter("kind is null").select("row", "doc_id", "text_hash").join(gone, "row")
    # equal rows have equal spans: one of them tells all
    of, of_text, spans_of = free(docs, "of", "of_text", "gone")
    told = named.groupBy(F.col("doc_id").alias(of), F.col("text_hash").alias(of_text)).agg(F.max("gone").alias(spans_of))
    joined = docs.join(told, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(of_text)), "left")
    after = lambda i: F.coalesce(F.when(i > 0, F.get(spans_of, i - 1)["z"]), F.lit(0))
    before = lambda s, i: F.substring(F.col("text"), (after(i) + 1).cast("int"), (s["a"] - after(i)).cast("int"))
    pieces = F.array_join(F.transform(spans_of, lambda s, i: F.concat(before(s, i), F.lit(mark))), "")
    rest = F.substring(F.col("text"), (F.element_at(spans_of, -1)["z"] + 1).cast("int"), F.lit(2**31 - 1))
    return joined.withColumn("text", F.when(F.col(spans_of).isNull(), F.col("text")).otherwise(F.concat(pieces, rest))).select(*docs.columns)
