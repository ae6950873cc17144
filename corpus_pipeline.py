"""The corpus pipeline over ``documents``: documents that the quality classifier rejects go, one
document of each group of near duplicates stays, documents with benchmark passages go, secrets
are masked, and what is left is packed into sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the rows that
the next one reads, written as Parquet in between. All but the last return the columns of docs.
Rows are told apart by doc_id and text (of rows that repeat both and have words, the near-duplicate
stage keeps one); null texts have no words, so they are judged by their
size alone, are nobody's copy, and are packed as an end token. Of documents that tie in a group the
one with the least doc_id stays, null counting last, then the least text hash. An empty table stays
empty in every stage; further columns are carried along, whatever their names, up to packing.
Stage outputs lie in the shared folder under a name of their own for each run. One goes when the next
is written; the last is the caller's to clear, as the result is read from it lazily.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, jaccard_join, packing, quality, secrets
from gleaner.llm._spark import cut, free, remove, shared_dir, without

#: Words of a shingle and least similarity in per cent of the near-duplicate stage (operator 9's query has its own).
STAGE_N, STAGE_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score 0.5 or more."""
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.withColumn("text_hash", F.xxhash64("text")), weights, ("doc_id", "text_hash"))
    return without(docs, scored.filter("score < 0.5"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near duplicates one document: the least by doc_id (null last), text hash and columns (as JSON)."""
    known = jaccard_join.labelled(docs, n=STAGE_N, percent=STAGE_PERCENT).filter("label is not null")
    each = cut(known.groupBy("label", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")))
    least = each.groupBy(F.col("label").alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("least"))
    each = each.join(least, F.col("label") == F.col("of")).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("least.id")) & (F.col("text_hash") == F.col("least.hash")))
    kept, again = without(docs, each.filter("not stays")), cut(each.filter("stays and rows > 1").select("doc_id", "text_hash"))
    if again.isEmpty():
        return kept
    # rows that repeat both doc_id and text, one of each
    of, of_text = free(docs, "of", "of_text")
    named = again.select(F.col("doc_id").alias(of), F.col("text_hash").alias(of_text))
    repeated = kept.join(named, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(of_text)), "left_semi")
    whole = F.struct(*docs.columns)  # told apart as JSON: columns of map type have no order
    one = repeated.groupBy("doc_id", F.xxhash64("text").alias(of_text)).agg(F.min_by(whole, F.to_json(whole)).alias(of)).select(f"{of}.*")
    return without(kept, again).unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs.withColumn("text_hash", F.xxhash64("text")), benchmark, keep=("doc_id", "text_hash"))
    return without(docs, found.filter("contaminated"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; secrets in its text are masked, and n_chars follows."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier and the encoder can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    where = posixpath.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        at = posixpath.join(where, str(k))
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if k:
            remove(spark, posixpath.join(where, str(k - 1)))
    return docs
