"""What the operators' methods do, against plain versions of their own: chains, updates, fences, discoveries, plans."""

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import licenses, packing, quality, quality_rules, secrets, token_counts
from gleaner.llm._words import Words
from tests.llm import brute


def plain_licenses(text, templates, phrases):
    """Every field of a licence scan, by trying all pairs of places."""
    w = brute.PLAIN.findall((text or "").translate(brute.LOW))
    places = sorted((i, label) for phrase, label in phrases.items() for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)
    found, score = set(), 0.0
    for label, template in templates:
        t = template.split()
        whole = []
        for b, a in itertools.product(range(len(t)), range(len(w))):
            n = 0
            while b + n < len(t) and a + n < len(w) and t[b + n] == w[a + n]:
                n += 1
            if n >= licenses.MATCH and not (b and a and t[b - 1] == w[a - 1]):
                whole.append((b, a, n))

        def best(last, words):
            b, a, n = last
            more = [best(x, words + x[2] - max(0, b + n - x[0], a + n - x[1])) for x in whole if b < x[0] and a < x[1] and x[1] - (a + n) <= licenses.GAP]
            return max([words, *more])

        share = max((best(x, x[2]) for x in whole), default=0) / len(t)
        score = max(score, share)
        if share >= licenses.COVERED:
            found.add(label)
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), pytest.approx(min(score, 1.0))


def test_licenses_equal_the_plain_version():
    r = random.Random(11)
    templates = (("a", "a b c d e f a b c g h i"), ("b", "c d e f"), ("c", "x y z a b c"), ("a", "f a b c"))
    phrases = {"a b": "ab", "g h i": "ghi"}
    texts = ["a b c zz d e f", "a b c zz d e f zz a b c g h i", "", None, "A-B c"]
    for _ in range(120):
        t = []
        while len(t) < r.randint(0, 24):
            t += r.choice([["z"], ["a", "b", "c"], ["d", "e", "f"], ["x", "y", "z"], ["g", "h", "i"], [r.choice("abcdefghixyz")], ["q"] * r.choice([1, 45])])
        texts.append(" ".join(t))
    got = licenses.scan_texts(pa.array(texts, pa.string()), templates, phrases)
    assert got == [plain_licenses(t, templates, phrases) for t in texts]
    assert [g[6] for g in licenses.scan_texts(pa.array(texts[:2]), templates[:1], phrases)] == [0.5, 1.0]


def test_licenses_of_whole_notices_and_without_templates(spark):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 900)
    texts = [mit, mit.upper().replace(" SOFTWARE ", " program "), "all rights reserved", None]
    got = licenses.scan_texts(pa.array(texts, pa.string()))
    assert got[0][5:] == ("mit", 1.0) and got[1][5] == "mit" and got[1][6] > 0.6
    assert [g[5] for g in licenses.scan_texts(pa.array(texts, pa.string()), templates=())] == ["", "", "reserved", ""]


def test_updates_equal_a_plain_loop():
    r = random.Random(2)
    texts = [" ".join(r.choice("uno dos tres cuatro cinco".split() if k % 2 else "six seven eight nine".split()) for _ in range(20)) for k in range(12)]
    labels = np.array([k % 2 for k in range(12)], float)
    rows = [(a.astype(np.int64), v) for a, v in quality.vectors(Words(pa.array(texts)))]
    z, n = collections.Counter(), collections.Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(rows)):
            x = [*zip(rows[k][0].tolist(), rows[k][1].tolist()), (1 << quality.BITS, 1.0)]
            assert len({i for i, _ in x}) == len(x)
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - labels[k]) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = quality.train(rows, labels)
    assert got[[*z]] == pytest.approx([weight(i) for i in z], rel=1e-4, abs=1e-6)
    # scores are sparse dot products with these weights
    want = [1 / (1 + math.exp(-(sum(weight(i) * v for i, v in zip(a.tolist(), x.tolist())) + weight(1 << quality.BITS)))) for a, x in rows]
    assert quality.scores(Words(pa.array(texts)), got).tolist() == pytest.approx(want, rel=1e-3)


def test_learned_rows_are_bounded(spark):
    docs = spark.createDataFrame([(2, f"texto {k}") for k in range(50)] + [(3, "y" * 500), (4, None), (None, "z"), (5, "w" * 700)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, of int")
    got = {r.doc_id: (r.text, r.quality) for r in quality.sample(docs, labels.filter("doc_id != 0"), sample_bytes=600).collect()}
    known = {i for i in (2, 3, 4, 5) if __import__("zlib").crc32(str(i).encode()) % 3 != 1}
    assert set(got) <= known and sum(len(t or "") for t, _ in got.values()) <= 600
    everything = {r.doc_id: (r.text, r.quality) for r in quality.sample(docs, labels).collect()}
    assert set(everything) == known and all(q == 0 for i, (_, q) in everything.items() if i in (2, 4))


@pytest.mark.parametrize(("rows", "size"), [(8000, 10), (1, 1 << 20), (3, 200)])
def test_something_of_each_label_is_learned(spark, rows, size):
    docs = spark.createDataFrame([(k, f"{'bueno' if k % 2 else 'malo'} ñandú " * 40) for k in range(50)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(k, 1) for k in range(1000, 6000)], "doc_id long, quality int")  # most labels have no document
    got = quality.sample(docs, labels, rows, size).collect()
    assert {r.quality for r in got} == {0, 1} and all(r.text for r in got)
    assert len(got) <= rows + 2 and sum(len(r.text.encode()) for r in got) <= max(size, 2)
    assert quality.fit(docs, labels, rows, size).any()


def _group(n, spread, r):
    """Texts of about 100 words, whose words' mean length differs by about so much."""
    out = []
    for _ in range(n):
        mean = 5 + spread * r.uniform(-1, 1)
        out.append(" ".join("".join(r.choice("bcdfgaeiou") for _ in range(max(1, round(mean + r.uniform(-0.5, 0.5) * 2)))) for _ in range(100)))
    return out


def test_fences_follow_the_spread_of_their_group(spark):
    r = random.Random(6)
    rows = [(k, t, "es", s) for s, spread in (("narrow", 0.3), ("wide", 1.5)) for k, t in enumerate(_group(150, spread, r))]
    rows += [(k, t, "es", "few") for k, t in enumerate(_group(5, 0.3, r))] + [(0, " ".join(["w"] * 60 + ["q#"] * 3), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = quality_rules.measures(docs, ("doc_id", "lang", "source"))
    limits = {(x.key_1, x.key_2): x for x in quality_rules.thresholds(measured).collect()}
    narrow, wide, few = (limits["es", s] for s in ("narrow", "wide", "few"))
    width = lambda x: x.high_word_length - x.low_word_length
    assert width(narrow) * 2 < width(wide) and width(narrow) < width(few) < width(wide)  # few takes the language's
    assert narrow.by_spread_word_length and wide.by_spread_word_length
    again = quality_rules.thresholds(measured.repartition(5)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, limits.values()), key=repr)  # sketches are deterministic


def test_quantile_distances_set_fences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    limits = quality_rules.thresholds(quality_rules.measures(docs, ("doc_id", "lang", "source"))).collect()
    for m in ("upper_share", "word_length", "mark_share"):
        assert sum(x[f"by_spread_{m}"] for x in limits) > 0.9 * len(limits)


def test_fences_of_sparse_measures_follow_their_group(spark):
    """A tenth and more of a group with symbols, repeated lines or repeated words gets it other fences."""
    r = random.Random(8)
    words = lambda n: ["".join(r.choice("bcdfgaeiou") for _ in range(r.randint(3, 7))) for _ in range(n)]
    plain = lambda: "\n".join(" ".join(words(6)) for _ in range(30))
    marked = lambda: " ".join(w + "#" * (k % 3 == 0) for k, w in enumerate(words(100)))
    again = lambda: "\n".join(x for x in (" ".join(words(6)) for _ in range(30)) for _ in range(1 + (r.random() < 0.2)))
    groups = {"plain": [plain() for _ in range(150)], "code": [marked() if k % 4 == 0 else plain() for k in range(150)], "lists": [again() if k % 3 == 0 else plain() for k in range(150)]}
    rows = [(k, t, "es", s) for s, texts in groups.items() for k, t in enumerate(texts)] + [(900, marked(), "es", "plain"), (900, marked(), "es", "code")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {x.key_2: x for x in quality_rules.thresholds(quality_rules.measures(docs, ("doc_id", "lang", "source"))).collect()}
    assert limits["code"].high_symbol_share > 3 * limits["plain"].high_symbol_share and limits["code"].by_spread_symbol_share
    for m in ("dup_line_share", "repeat_share"):
        assert limits["lists"][f"high_{m}"] > limits["plain"][f"high_{m}"] and limits["lists"][f"by_spread_{m}"], m
    kept = {(x.source, x.doc_id): x.kept for x in docs.join(quality_rules.apply_rules(docs.withColumn("doc_id", F.xxhash64("doc_id", "source"))).select("doc_id", "kept").withColumnRenamed("doc_id", "h"), F.xxhash64(docs.doc_id, docs.source) == F.col("h")).select("source", docs.doc_id, "kept").collect()}
    assert kept["code", 900] and not kept["plain", 900]


def test_verdicts_of_every_document(spark):
    """kept of every row, recomputed plainly from the values of all documents, rounded as the sketch rounds them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    exact = quality_rules._with_ratios(quality_rules.measures(docs, ("doc_id", "lang", "source"))).collect()
    found = {x.doc_id: x.kept for x in quality_rules.apply_rules(docs, group_rows=40).collect()}
    good = [x for x in exact if not x.base_failed]
    rounded = lambda v: math.exp(round(math.log(v) / math.log(1.01)) * math.log(1.01)) if v > 0 else 0.0
    quantile = lambda v, n: rounded(sorted(v)[max(math.ceil(len(v) * n / 20) - 1, 0)])
    rejected = 0
    for x in exact:
        own = [y for y in good if (y.lang, y.source) == (x.lang, x.source)]
        own = own if len(own) >= 40 else [y for y in good if y.lang == x.lang]
        verdict = not x.base_failed
        for m, (side, of, step) in quality_rules.RATIOS.items():
            t0, q1, q2, q3, t4 = (quantile([y[m] for y in own], n) for n in (2, 5, 10, 15, 18))
            least = step / max(quantile([y[of] for y in own], 10), 1)
            high = q2 + 8 * max(q3 - q2, (t4 - q2) * 0.6744897501960817 / 1.2815515655446004, least)
            low = q2 - 8 * max(q2 - q1, (q2 - t0) * 0.6744897501960817 / 1.2815515655446004, least) if side == "both" else -math.inf
            verdict &= low <= x[m] <= high
        rejected += not verdict and not x.base_failed
        assert verdict == found[x.doc_id], x
    assert 20 < rejected < len(exact) / 4


def test_sketches_tell_quartiles(spark):
    r = random.Random(9)
    values = [r.lognormvariate(0, 2) for _ in range(500)] + [0.0] * 100
    one = [F.lit(1).cast("long").alias(c) for c in {of for _, of, _ in quality_rules.RATIOS.values()} | set(quality_rules.RATIOS) - {"symbol_share"}]
    df = spark.createDataFrame([(v,) for v in values], "symbol_share double").select("*", F.lit("es").alias("lang"), F.lit("a").alias("source"), *one)
    got = quality_rules.quartiles(quality_rules.sketches(df, ("lang", "source"))).first()
    for k in (1, 2, 3):
        assert got[f"symbol_share_{k}"] == pytest.approx(sorted(values)[math.ceil(len(values) * k / 4) - 1], rel=0.006)


def test_three_tests_weigh_in_discoveries(spark):
    r = random.Random(4)
    letters = secrets._BASE64[:62]
    table = {k: "".join(r.choice(letters) for _ in range(64)) for k in range(40)}
    table[100] = "".join(sorted(table[0]))  # the same characters in order: no runs, full serial correlation
    table[101] = "".join(r.choice("aZ9bY8") for _ in range(64))  # few characters: not uniform
    tokens = spark.createDataFrame(list(table.items()), "id long, value string")
    tested = {x.id: x for x in secrets.battery(tokens).collect()}
    assert tested[100].run < 1e-3 and tested[100].serial < 1e-3 and tested[100].uniform == pytest.approx(tested[0].uniform)
    assert tested[101].uniform < 1e-3
    for x in tested.values():
        worst = min(1.0, 3 * min(x.uniform, x.run, x.serial))
        assert x.p == 1.0 or worst >= secrets.LEAST_P
    found = {x.id for x in secrets.discoveries(secrets.battery(tokens)).collect()}
    assert 100 not in found and 101 not in found and len(found) > 30
    # discoveries are what weighted Benjamini-Hochberg over the quotients finds, but for the width of a level
    mean = sum(x.size for x in tested.values()) / len(tested)
    weighed = sorted((x.p * mean / min(x.size, secrets.WEIGHED), x.id) for x in tested.values())
    last = max((k for k, (p, _) in enumerate(weighed, 1) if p <= secrets.RATE * k / len(weighed)), default=0)
    assert {i for _, i in weighed[:last]} >= found and len(found) >= last - 2


def test_exact_plans_are_least():
    r = random.Random(3)

    def least(pieces, capacity):
        best = [len(pieces)]

        def put(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(pieces):
                best[0] = len(rooms)
                return
            for i in range(len(rooms)):
                if rooms[i] >= pieces[k] and rooms[i] not in rooms[:i]:
                    put(k + 1, [*rooms[:i], rooms[i] - pieces[k], *rooms[i + 1 :]])
            put(k + 1, [*rooms, capacity - pieces[k]])

        put(0, [])
        return best[0]

    for _ in range(40):
        pieces = sorted((r.randint(3, 20) for _ in range(r.randint(1, 10))), reverse=True)
        counts = collections.Counter(pieces)
        plan = packing.packing_plan(counts, 20, exact=True)
        assert sum(n for _, n in plan) == least(pieces, 20)
        assert packing.gap(plan, counts, 20) >= 0
        assert sum((collections.Counter(held * n) for held, n in plan), collections.Counter()) == counts


def test_dominance():
    assert packing._dominates((5, 4), (3, 2, 4)) and not packing._dominates((3, 2, 4), (5, 4)) and not packing._dominates((4, 4), (5,))


def test_added_tokens_are_one_id(spark):
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(token_counts.vocabulary_path("byte_bpe_50k.json"))
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext", None, "", "é <|endoftext|>"]
    want = [untouched.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0]
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        encode = token_counts.encoder(token_counts.vocabulary_path(name))
        assert [encode(t or "").tolist() for t in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.encoded_lengths(docs).collect()} == {k: len(x) for k, x in enumerate(want)}
    assert {r.doc_id: r.length for r in packing.pack(docs).collect()} == {k: len(x) + 1 for k, x in enumerate(want)}


def plain_battery(value):
    """Encoding and the p-values of the three tests of randomness, by the book."""
    import re

    some, has = len(re.findall("[0-9]", value)) >= 2, lambda p: re.search(p, value) is not None
    one_case = some and (re.fullmatch("[A-Z0-9]+=*", value) and has("[A-Z]") or re.fullmatch("[a-z0-9]+=*", value) and has("[a-z]"))
    if (re.fullmatch("[0-9a-f]+", value) or re.fullmatch("[0-9A-F]+", value)) and has("[0-9]") and has("[A-Fa-f]"):
        kind, k = "hex", 16
    elif one_case and re.fullmatch("[A-Z2-7]+=*", value.upper()):
        kind, k = "base32", 32
    elif one_case and re.fullmatch("[0-9A-V]+=*", value.upper()):
        kind, k = "base32hex", 32
    elif one_case:
        kind, k = "base36", 36
    elif some and len(re.findall("[A-Z]", value)) >= 2 and len(re.findall("[a-z]", value)) >= 2:
        kind, k = ("base64", 64) if has("[+/_-]") else ("base62", 62)
    else:
        return None
    bare = value.translate(str.maketrans("-_", "+/")) if kind in ("base62", "base64") else value.upper()
    codes = [secrets.ALPHABETS[kind].index(c) + 1 for c in re.sub("=+$", "", bare)]
    n, tail = len(codes), lambda z: math.erfc(z / math.sqrt(2)) / 2
    if n < secrets.LEAST:
        return None
    chi = k * sum(c * c for c in collections.Counter(codes).values()) / n - n
    uniform = tail(((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
    high = [c > (k + 1) / 2 for c in codes]
    h = sum(high)
    runs, expected = 1 + sum(a != b for a, b in itertools.pairwise(high)), 2 * h * (n - h) / n + 1
    run = 2 * tail(abs(runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 0.01)))
    mean = sum(codes) / n
    spread = sum((c - mean) ** 2 for c in codes)
    lag = sum((a - mean) * (b - mean) for a, b in itertools.pairwise(codes)) / spread if spread else 1.0
    return kind, uniform, run, 2 * tail(abs(lag) * math.sqrt(n))


def test_battery_equals_the_plain_one(spark):
    r = random.Random(12)
    kinds = [v[: secrets._SIZES[k]] for k, v in secrets.ALPHABETS.items()] + ["abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "ab", "aB1"]
    values = ["".join(r.choice(a) for _ in range(r.choice([20, 21, 33, 64, 200]))) + "=" * r.choice([0, 0, 1, 2]) for a in kinds for _ in range(12)] + ["a1" * 10, "=" * 30, "1" * 25]
    got = {x.id: x for x in secrets.battery(spark.createDataFrame(list(enumerate(values)), "id long, value string")).collect()}
    want = {k: p for k, v in enumerate(values) if (p := plain_battery(v))}
    assert set(got) == set(want) and len(want) > 70
    for k, (kind, *ps) in want.items():
        assert got[k].encoding == kind and [got[k].uniform, got[k].run, got[k].serial] == pytest.approx(ps, rel=1e-3, abs=1e-6)
