"""Intermediate tables in the folder that the cluster shares.

``spark.checkpoint.dir`` names it; a folder of our own is used only where that
is unset, as in tests. A written table cuts lineage like ``checkpoint()`` but
computes its input once and stays columnar; losing an executor loses nothing.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder, from the session's settings."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="tidewrack-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table, read again with the same columns."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tidewrack/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear() -> None:
    """Delete this driver's scratch tables; called when the driver ends."""
    while _written:
        spark, path = _written.pop()
        jvm = spark.sparkContext._jvm
        if jvm is None or spark.sparkContext._jsc is None:
            continue
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; the cluster's own cleaning remains
            return
