"""What several operators of this subpackage need of a session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local session without one gets its own (as in tests), a cluster must tell one."""
    sc = spark.sparkContext
    told = sc._jsc.sc().getCheckpointDir()
    if told.isDefined():
        return told.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = where or tempfile.mkdtemp(prefix="spark-shared-")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, where: str) -> None:
    """Deletes a folder that was written under the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder, so that lost executors don't undo it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_key(df: DataFrame, key: str, groups: int, each: int = 4) -> DataFrame:
    """df dealt by a key that has so many groups, ``each`` of them a task: tasks grow in number with the groups, not in size."""
    return df.repartition(max(partitions(df.sparkSession), -(-groups // each)), key)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first().n or 0


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """Only these columns of docs, cast: a further column never clashes with an operator's own."""
    return docs.select(*(F.col(k).cast(kind).alias(k) for k, kind in columns.items()))


#: Rows, and bytes of them as JSON, that may be broadcast, once counted; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it has no more than so many rows and bytes; both are counted, so df should be cut before."""
    if df.count() > rows:
        return df
    found = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first().n or 0
    return F.broadcast(df) if found <= size else df


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of docs has it."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, xxhash64 of text) is among ``gone`` (doc_id, text_hash)."""
    of, of_text = free(docs, "gone_id", "gone_text")
    gone = small(cut(gone.select(F.col("doc_id").alias(of), F.col("text_hash").alias(of_text)).distinct()))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(of_text)), "left_anti")
