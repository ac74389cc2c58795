"""Running counts over a folder to which graded records are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVAL_RECORD


def records(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """New JSONL files of the folder as a stream; ``written_at`` is when a record's file was written."""
    stream = spark.readStream.schema(EVAL_RECORD).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return stream.withColumn("written_at", F.col("_metadata.file_modification_time"))


def status_counts(stream: DataFrame, time: str | None = "written_at", late: str = "1 day") -> DataFrame:
    """(dataset, status, n), each record id counted once; for ``complete`` output.

    Ids are kept as state, so a record that a resumed run writes again changes nothing. They are kept until the
    stream's ``time`` is ``late`` past their own, so the state is bounded by the records of that span; a record
    repeated after it counts again. Without ``time`` no id is forgotten and the state grows with the records.
    """
    keys = ["id", "dataset"]
    once = stream.dropDuplicates(keys) if time is None else stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return once.groupBy("dataset", "status").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, status, n) with bounded state: rows later than the watermark no longer count."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, "status").agg(F.count("*").alias("n"))
