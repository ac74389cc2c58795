"""A folder for tables that a run writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset a folder of this machine will do only if everything runs in one process.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared and not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='millrace-scratch-')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written once under the shared folder and read from there: what several parts of a plan need again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def named_file(lines: DataFrame, path: str) -> None:
    """A small table of one text column as one file of that very name."""
    spark = lines.sparkSession
    lines.coalesce(1).write.text(f"{path}.parts")
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(Path(f"{path}.parts")) if x.getPath().getName().startswith("part-"))
    if not fs.rename(part, Path(path)):
        raise FileExistsError(path)
    fs.delete(Path(f"{path}.parts"), True)
