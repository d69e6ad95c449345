"""Findings of files as they come: a file-source stream, evaluated batch by batch.

The stream's checkpoint remembers what was read, so a run that stops is
resumed; a file that comes again with another size or time is evaluated again,
an unchanged one isn't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """Tables of files that appear below ``path``; the first row of each (host, share, path, size, time)."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.dropDuplicates(["host", "share", "file_path", "size", "modified_at"])


def run(rows: DataFrame, evaluate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Append the findings of each batch to ``out``, a folder for each batch, until all that is there was read.

    A batch that is repeated after a failure overwrites its own folder.
    """

    def batch(part: DataFrame, number: int) -> None:
        evaluate(part).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
