"""Folders for intermediate tables where every executor can reach them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; below one of our own only where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewrack-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/tidewrack/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table, read again: what follows is planned without what came before, and an executor that is lost loses nothing."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
