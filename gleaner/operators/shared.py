"""The folder that driver and executors share, and tables kept in it."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own (as in tests), a cluster must tell one."""
    sc = spark.sparkContext
    told = sc._jsc.sc().getCheckpointDir()
    if told.isDefined():
        return told.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-scratch-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return posixpath.join(shared_folder(spark), uuid.uuid4().hex)


def kept(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder: lineage is cut, and lost executors don't undo it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
