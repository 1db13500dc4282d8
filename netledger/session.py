"""Session helpers: shared folder, written cut points, table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can read; the cluster names it in ``spark.checkpoint.dir``.

    Only where all runs in this one process (tests, a laptop) a folder of this machine will do; elsewhere
    an absent setting is an error, for executors would write each to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"netledger-{spark.sparkContext.applicationId}")
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/netledger-cuts/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Later stages start from the written table, so a lost executor costs one file read and
    not the whole lineage, and a table used twice is computed once. The folder is removed
    when the JVM ends.
    """
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col) -> F.Column:
    """Timestamp (with or without zone) as microseconds since the epoch, UTC session."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def micros_text(col) -> F.Column:
    """Microseconds since the epoch as ``yyyy-MM-dd HH:mm:ss``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")
