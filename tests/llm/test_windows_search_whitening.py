"""Operators 11 to 13 against plain versions, with nulls, ties, repeated rows, very long texts, empty tables and clashing columns."""

import collections
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import ranked_search, whitening, window_packing
from gleaner.llm.token_counts import encoder, vocabulary_path
from tests.llm.test_operators import DOCS

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")



def clashing(df):
    further = {"row": F.lit(1), "score": F.lit("a"), "item": F.array(F.lit(2)), "part": F.create_map(F.lit("a"), F.lit(1)), "terms": F.struct(F.lit(1).alias("b")), "start": F.lit(None)}
    return df.select("*", *(v.alias(k) for k, v in further.items()))


# operator 12


def pieces_hold(rows, docs, capacity, end=0):
    """Every id lies in one piece, sequences have no gaps, and pieces keep the documents' order; the padding."""
    ids = encoder(vocabulary_path())
    want = collections.Counter()
    for d, t in docs:
        x = struct.pack
        own = [*map(int, ids(t or "")), end]
        want[d, b"".join(x("<I", i) for i in own)] += 1
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, own in by_doc.items():
        texts = [k for k, n in want.items() if k[0] == d for _ in range(n)]
        assert sum(r.length for r in own) == sum(len(k[1]) // 4 for k in texts)
        for _, raw in texts:  # a chain of pieces spells each text
            at = 0
            while at < len(raw) // 4:
                fit = [r for r in own if r.start == at and r.doc_tokens == len(raw) // 4 and r.ids_crc32 == zlib.crc32(raw[4 * at : 4 * (at + r.length)])]
                assert fit
                own.remove(fit[0])
                at += fit[0].length
        assert not own
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("parts", [1, 5])
def test_windows_hold_every_id_once(spark, parts):
    docs = [*DOCS, (500, "Una frase corta. " * 4000), (501, "palabra " * 3000), (None, "sin id"), (None, None)]
    table = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts, "text"))
    rows = window_packing.pack(table, horizon=4096, again=2048).collect()
    padding = pieces_hold(rows, docs, 1024)
    assert padding <= 0.01 * sum(r.length for r in rows)


def test_windows_keep_the_order_of_the_table(spark):
    docs = [(k, f"texto {k} " * (k % 37)) for k in range(300)]
    rows = window_packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_no_windows_of_an_empty_table(spark):
    assert window_packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (row,) = window_packing.pack(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert (row.start, row.length, row.doc_tokens, row.offset) == (0, 1, 1, 0)


def padding_of(size, capacity, last, shortest):
    return 0 if size & (size - 1) == 0 and (last or size >= shortest) else capacity - size


def plain_plan(price, capacity, stretch, chain, shortest):
    """The least cost over the same cuts, by trying every window."""
    places, _ = window_packing.offered(price, capacity, stretch)
    marks, n = set(places), len(price)
    cost = {(0, 0): 0}
    for i in range(1, n + 1):
        for row in range(chain + 1):
            best = math.inf
            if row == 0 and i in marks:
                for j in range(max(0, i - capacity), i):
                    pad = padding_of(i - j, capacity, i == n, shortest)
                    best = min([best, *(cost[j, r] + pad for r in range(chain + 1) if (j, r) in cost)])
                best += 16 + (int(price[i - 1]) if i < n else 0)
            elif row and i not in marks and (i - capacity, row - 1) in cost:
                best = cost[i - capacity, row - 1] + 16 + 8
            if best < math.inf:
                cost[i, row] = best
    return cost[n, 0]


def test_plan_is_the_cheapest():
    r = random.Random(3)
    for case in range(60):
        n, capacity = r.randint(1, 400), r.choice([16, 24, 32, 64])
        price = np.array([r.choices([0, 2, 8], [1, 3, 40 if case % 2 else 8])[0] for _ in range(n)], np.uint8)
        places, cost = window_packing.offered(price, capacity, 16)
        for chain, shortest in ((0, 1), (1, 1), (3, 1), (1, 8), (3, 16)):
            ends, found = window_packing.plan(places, cost, capacity, chain, shortest)
            sizes = np.diff([0, *ends])
            assert ends[-1] == n and sizes.min() > 0 and sizes.max() <= capacity
            paid = sum(16 + padding_of(s, capacity, e == n, shortest) for s, e in zip(sizes.tolist(), ends)) + sum(int(price[e - 1]) for e in ends[:-1])
            assert paid == found
            assert found == plain_plan(price, capacity, 16, chain, shortest)


def test_cuts_lie_at_sentence_ends():
    text = 'Uno dos. "Tres?" 3.14 fin!\nOtra línea\n\nmás'
    ends = [text.encode()[:k].decode() for k in np.flatnonzero(window_packing.sentence_ends(text.encode()))]
    assert ends == ["Uno dos.", 'Uno dos. "Tres?"', 'Uno dos. "Tres?" 3.14 fin!', 'Uno dos. "Tres?" 3.14 fin!\nOtra línea']


def test_token_sizes_of_both_vocabulary_files():
    tables = [window_packing.token_bytes(vocabulary_path(f"byte_bpe_50k.{x}")) for x in ("tiktoken", "json")]
    assert (tables[0] == tables[1]).all()


# operator 13


def plain_rank(docs, items, k=10):
    held = [(d, c) for d, t in docs if (c := collections.Counter(TERM.findall((t or "").translate(LOW))))]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(LOW)))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, n, x[3], -x[0]) for n, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("parts", "shard", "at_once"), [(1, 4096, 32), (6, 8, 2)])
def test_ranked_search(spark, monkeypatch, parts, shard, at_once):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked_search, "AT_ONCE", at_once)
    docs = [*DOCS, (600, "a b c " * 30_000), (None, "abc de"), (None, "abc de"), (7, "abc de"), (8, "ABC-de")]
    r = random.Random(9)
    items = [(k, " ".join(r.sample((t or "x").split() or ["x"], k=min(12, len((t or "x").split() or ["x"]))))) for k, (_, t) in enumerate(DOCS)]
    items += [(900, None), (901, "nadie lo dice"), (902, "abc"), (902, "DE de"), (None, "uno"), (None, "DOS"), (903, " ".join((DOCS[0][1] or "").split()) * 3)]
    table, asked = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)), clashing(spark.createDataFrame(items, "item_id long, text string"))
    found = ranked_search.rank(table, asked)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, found.collect()), key=repr) == plain_rank(docs, items)


def test_ranked_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 7)
    items = [(k, t) for k, (_, t) in enumerate(DOCS)]
    found = ranked_search.rank(spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_rank(DOCS, items, 3)


def test_ranked_search_of_empty_tables(spark):
    none, some = (spark.createDataFrame(x, "doc_id long, text string") for x in ([], [(1, "a"), (2, None)]))
    asked, nobody = (spark.createDataFrame(x, "item_id long, text string") for x in ([(1, "a")], []))
    for docs, items in ((none, asked), (some, nobody), (none, nobody), (some.filter("doc_id = 2"), asked)):
        assert ranked_search.rank(docs, items).collect() == []


def test_search_looks_at_few_documents():
    """Documents that can't be among the best are not scored: their intervals' bounds are too low."""
    r = np.random.default_rng(1)
    n = 4000
    docs, times = np.arange(n), np.ones(n, np.int64)
    times[::400] = 50
    row = {"doc_ids": ranked_search._packed(np.stack([docs, docs * 0], 1)), "sizes": ranked_search._packed(np.full(n, 100)), "terms": ranked_search._packed(np.array([5, 9], np.uint64)), "ends": ranked_search._packed(np.array([n, 2 * n])), "docs": ranked_search._packed(np.tile(docs, 2).astype(np.uint32)), "times": ranked_search._packed(np.concatenate([times, r.permutation(times)]).astype(np.uint32))}
    lists = ranked_search.Lists(row, np.array([5, 9], np.uint64), n, 100 * n)
    looked, place = [], lists.place
    lists.place = lambda terms, docs: looked.append(len(docs)) or place(terms, docs)
    best = lists.search(np.array([0, 1]), np.array([1000, 900]), 10, [])
    score = 1000 * lists.impact[:n] + 900 * lists.impact[n:]
    assert best == sorted((-int(s), int(d), 0) for d, s in enumerate(score))[:10]
    assert sum(looked) < n / 4


# operator 11


def plain_whitening(vectors, components=32):
    good = [(i, [float(c) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    away = [[n * c - s for c, s in zip(v, sums)] for v in x]
    a = np.array(away, float) / n
    values, basis = np.linalg.eigh(a.T @ a / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return [i for i, _ in good], [sum(c * c for c in v) for v in away], a @ basis / np.sqrt(values), values / np.trace(a.T @ a / n)


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening(spark, parts):
    r = np.random.default_rng(2)
    base = r.normal(size=(400, 40)) * np.linspace(0.2, 9, 40) + r.normal(size=40)
    vectors = [(int(k), [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    vectors += [(1000 + k, vectors[3][1]) for k in range(100)] + [(5, vectors[5][1]), (None, vectors[6][1])]
    bad = [(2000, None), (2001, [1.0] * 39 + [None]), (2002, [math.nan] * 40), (2003, [math.inf] + [0.0] * 39), (2004, []), (2005, [1.0, 2.0])]
    table = clashing(spark.createDataFrame([*vectors, *bad], "vec_id long, embedding array<float>").repartition(parts))
    rows = whitening.whitened(table).toPandas()
    ids, deviation, white, share = plain_whitening(vectors)
    assert len(rows) == 32 * len(vectors) and set(rows.n) == {len(vectors)}
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9
    of = collections.defaultdict(list)
    for i, d, w in zip(ids, deviation, white):
        of[-1 if i is None else i].append((d, w))
    rows["vec_id"] = rows.vec_id.fillna(-1).astype(int)
    sign = {}
    for i, own in rows.groupby("vec_id"):
        assert sorted(own.deviation) == sorted(d for d, _ in of[i] for _ in range(32))
        if len(of[i]) == 1:
            for c, w in zip(own.component, own.whitened):
                want = of[i][0][1][c - 1]
                sign.setdefault(c, math.copysign(1, w * want)) if abs(want) > 1e-3 else None
                assert abs(sign.get(c, 1) * w - want) < 1e-6
    assert np.allclose(rows.groupby("component").explained.first(), share, rtol=1e-9)


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(9)], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(vectors, kind)).collect() == []
    flat = [(k, [float(k), 3.0, 2.0 * k]) for k in range(20)]  # one direction has variance
    rows = whitening.whitened(spark.createDataFrame(flat, kind)).collect()
    assert {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-12 and rows[0].identity_error < 1e-9


def test_rank_one_changes_keep_the_spectrum():
    r = np.random.default_rng(4)
    for d, kind in ((1, "free"), (6, "free"), (30, "free"), (12, "equal"), (12, "whole"), (9, "twice")):
        x = r.normal(size=(150, d)) * 10.0 ** r.uniform(-3, 3, d)
        x = {"free": x, "equal": np.repeat(x[:1], 150, 0) + (np.arange(150) % 2)[:, None], "whole": np.floor(x), "twice": np.concatenate([x[:, : d // 2 + 1]] * 2, 1)[:, :d]}[kind]
        a, b = whitening.Spectrum.empty(d), whitening.Spectrum.empty(d)
        for k, v in enumerate(x):
            (a if k < 40 else b).add(v)
        a.combine(b)
        want = (x - x.mean(0)).T @ (x - x.mean(0))
        top = max(np.abs(want).max(), 1e-12)
        assert np.abs(a.vectors @ np.diag(a.values) @ a.vectors.T - want).max() < 1e-11 * top
        assert np.abs(a.vectors.T @ a.vectors - np.eye(d)).max() < 1e-11


def test_secular_roots():
    r = np.random.default_rng(6)
    for k in (2, 5, 20):
        poles, z = np.sort(r.uniform(0, 10, k)), r.uniform(1e-4, 3, k)
        near = whitening.secular_roots(poles, z * z)
        assert np.allclose((poles[None] - near)[:, 0], np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z)), rtol=1e-12)


def test_registered_queries_take_whole_tables(spark):
    from gleaner.llm import queries

    own = queries.queries()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    assert sorted(map(tuple, own["op13_ranked_search"](spark, SF).collect()), key=repr) == plain_rank(docs, items)
    rows = own["op12_window_packing"](spark, SF).collect()
    assert pieces_hold(rows, docs, 1024) < 0.005 * sum(r.length for r in rows)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    white = own["op11_whitening"](spark, SF)
    assert dict(white.dtypes)["component"] == "int" and isinstance(white.schema["whitened"].dataType, T.DoubleType)
    ids, deviation, _, share = plain_whitening([tuple(r) for r in vectors])
    found = white.groupBy("vec_id").agg(F.first("deviation"), F.count(F.lit(1)), F.max("identity_error")).collect()
    assert sorted((r[0], r[1], r[2]) for r in found) == sorted((i, d, 32) for i, d in zip(ids, deviation)) and max(r[3] for r in found) < 1e-6
