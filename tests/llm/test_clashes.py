"""Further columns with the operators' own names, null and repeated ids, over all operators and stages."""

import collections

import pytest
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, jaccard_join, licenses, packing, quality, quality_rules, secrets, substring_dedup, token_counts, window_packing
from tests.llm import brute

SF = "/root/testdata/sf0.001"
NAMES = "gone gone_id gone_text of of_text key_1 key_2 text_hash a b u v w row rows label bucket batch word item window hits n one least stays".split()
WORDS = [f"w{k}" for k in range(400)]
LONG = " ".join(WORDS[:60])
TABLE = [(1, LONG + " " + " ".join(WORDS[100:130])), (1, " ".join(WORDS[100:130]) + " x"), (None, LONG), (None, LONG), (2, LONG), (3, None), (None, None), (4, ""), (5, "password = abcdefghijkl1"), (5, " ".join(WORDS[200:260]))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TABLE, "doc_id long, text string").select("*", F.lit("es").alias("lang"), F.lit(None).cast("string").alias("source"), *(F.lit(k).alias(n) for k, n in enumerate(NAMES)), F.create_map(F.lit("a"), F.lit(1)).alias("m"), F.array(F.lit(1), F.lit(None)).alias("l"), F.struct(F.lit(1).alias("a"), F.create_map(F.lit("b"), F.lit(2)).alias("text")).alias("st"))
    return rows.repartition(3).cache()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_operators(spark, docs):
    ids = collections.Counter(i for i, _ in TABLE)
    bench = docs.select(F.col("doc_id").alias("item_id"), "text", *NAMES)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), *NAMES)
    for df in (substring_dedup.kept_digests(docs), decontaminate.decontaminate(docs, bench), quality_rules.apply_rules(docs), quality.classify(docs, labels), secrets.scan(docs), licenses.scan(docs), jaccard_join.components(docs), packing.pack(docs), window_packing.pack(docs), token_counts.encoded_lengths(docs)):
        assert collections.Counter(r.doc_id for r in df.collect()) == ids


def test_decontamination_of_null_and_repeated_ids(spark, docs):
    items = [(1, LONG), (None, " ".join(WORDS[105:118])), (2, "x"), (3, "w100 w101")]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, hits int")
    want = [(None if i == -1 else i, *more) for i, *more in brute.contaminated([(-1 if i is None else i, t) for i, t in TABLE], [("" if i is None else i, t) for i, t in items])]
    assert rows(decontaminate.decontaminate(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)


def test_stages(spark, docs):
    import corpus_pipeline as c

    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
    near = c.near_duplicates_stage(spark, docs, SF)
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=repr) == sorted([TABLE[0], TABLE[1], TABLE[4], TABLE[5], TABLE[6], TABLE[7], TABLE[8], TABLE[9]], key=repr)
    assert sorted(r.text for r in c.secrets_stage(spark, docs, SF).filter("doc_id = 5").collect()) == sorted(["[SECRET]", TABLE[9][1]])
    assert c.packing_stage(spark, docs, SF).count() == len(TABLE)


def test_stages_of_an_empty_table(spark, docs):
    import corpus_pipeline as c

    for _, stage in c.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0


def test_windows_shared_by_rows_without_an_id(spark):
    table = [(None, LONG), (None, " ".join(WORDS[10:45])), (None, " ".join(WORDS[5:35]) + " y"), (0, LONG)] * 2
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    want = [(None if i == -1 else i, *more) for i, *more in brute.kept([(-1 if i is None else i, t) for i, t in table])]
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(substring_dedup.kept_digests(docs), *columns) == sorted(want, key=repr)
    assert rows(substring_dedup.kept_digests(docs, batch_bytes=100, range_bytes=100), *columns) == sorted(want, key=repr)


def test_decontamination_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "small", lambda df: df)
    items = [(1, LONG), (2, " ".join(WORDS[105:118])), (3, "w100 w101"), (4, " ".join(WORDS[50:60]) + " nowhere")]
    table = [(i, t) for i, t in TABLE if i is not None]
    docs, bench = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (2, 10):
        got = rows(decontaminate.decontaminate(docs, bench, window), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == sorted(brute.contaminated(table, items, window), key=repr)
