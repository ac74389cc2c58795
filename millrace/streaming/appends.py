"""Appends that can be repeated: each batch of a stream is in the table once, whatever was killed in between.

A batch is a folder of its own, which a repeated run of the batch overwrites, and counts only when the ledger has
its entry, written last and renamed into place. Readers take the batches of the ledger and no other, so what an
interrupted run has left is never seen; and as a batch has the same rows whenever it is repeated (the stream's
checkpoint says which files are its own), a batch written twice is the same batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import file_system, hadoop_path
from ..sources.writers import atomic_json


def committed(path: str, written: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls. ``written`` is told of a batch between its rows and its entry in the ledger."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        entry = f"{path}/_ledger/{number}.json"
        if file_system(spark, entry).exists(hadoop_path(spark, entry)):
            return  # the batch was done when the run was stopped before its checkpoint
        batch.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/batch={number}")
        if written:
            written(number)
        atomic_json({"batch": number}, entry, spark)

    return write


def append(stream: DataFrame, path: str, checkpoint: str, written: Callable[[int], None] | None = None) -> StreamingQuery:
    """Starts the append of all that a stream has now; start it again on the same checkpoint after a failure."""
    return stream.writeStream.foreachBatch(committed(path, written)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of committed batches, with their ``batch``; other folders are not read (the ledger is a row a batch)."""
    batches = spark.read.schema("batch long").json(f"{path}/_ledger/*.json", multiLine=True)
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", path).json(f"{path}/batch=*")
    return rows.join(F.broadcast(batches.distinct()), "batch", "left_semi")
