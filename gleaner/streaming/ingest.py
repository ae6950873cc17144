"""Streams of postings: deduplication under a watermark, and upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import deltas


def first_seen(stream: DataFrame, key: list[str], time: str, ttl: str = "30 days") -> DataFrame:
    """The first row of each key within ``ttl``; state is dropped behind the watermark."""
    at = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, ttl)
    return at.dropDuplicatesWithinWatermark(key)


def counts_by_window(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows by event-time window and fields; late rows count until the watermark passes."""
    at = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return at.groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("desde"), *by, "n")


#: Deltas of a bucket from which on a stream merges it.
MERGED_AT = 16


def upsert_stream(stream: DataFrame, folder: str, key: str, order: tuple, now: str, checkpoint: str, merge_at: int = MERGED_AT) -> StreamingQuery:
    """Puts every micro-batch into a table of deltas: what is written grows with the batch, not with the table.

    The table's manifest tells the last batch of this stream (named by its checkpoint) that is in,
    so a batch that is run again is put in once. Buckets with many deltas are merged in passing."""

    def put(batch: DataFrame, n: int) -> None:
        spark: SparkSession = batch.sparkSession
        if not batch.isEmpty():
            deltas.put(spark, folder, batch, F.lit(now).cast("timestamp"), order, stream=(checkpoint, n))
            deltas.compact(spark, folder, merge_at)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, appends its rows to a Parquet folder, and returns them."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


def totals(counts: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs a stream of counts over what is there and returns the last count of each group: every micro-batch writes those it changed."""
    spark, keys = counts.sparkSession, [c for c in counts.columns if c != "n"]

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/k={k}")

    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder).groupBy(*keys).agg(F.max_by("n", "k").alias("n"))
