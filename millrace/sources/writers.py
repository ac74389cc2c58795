"""Sinks, manifests and reports."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import set_fingerprint
from .readers import file_digests, file_system, hadoop_path


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Null fields are written as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def sorted_parquet(df: DataFrame, path: str, key: str) -> None:
    """Sorted by key over range partitions, and the sorted list of keys beside it."""
    ordered = df.orderBy(key)
    parquet(ordered, path)
    ordered.select(F.col(key).cast("string")).write.mode("errorifexists").text(f"{path}.ids")


def by_category(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    """One folder a category. The column stays in the files too, since a partition column leaves them."""
    df.withColumn(f"__{column}", F.col(column)).write.mode(mode).option("ignoreNullFields", False).partitionBy(f"__{column}").json(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_pending(df: DataFrame, path: str, done_ids: DataFrame | None, key: str = "id") -> None:
    """Appends the rows that an earlier, interrupted run has not written."""
    pending = df if done_ids is None else df.join(done_ids.select(key).distinct(), key, "left_anti")
    pending.write.mode("append").option("ignoreNullFields", False).json(path)


def atomic_json(value: object, path: str, spark: SparkSession | None = None) -> None:
    """Written beside the target, then renamed: readers see the old or the new file.

    With a session the path may lie in any store that it writes, else on this machine.
    """
    text = json.dumps(value, ensure_ascii=False, indent=2)
    if spark is None:
        target = Path(path)
        handle, temp = tempfile.mkstemp(dir=target.parent)
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temp, target)
        return
    fs, temp = file_system(spark, path), f"{path}.{uuid.uuid4().hex}"
    _put(spark, temp, text)
    jvm = spark.sparkContext._jvm
    option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    several = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    several[0] = option
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(hadoop_path(spark, temp), hadoop_path(spark, path), several)


def exclusive_json(value: object, path: str, spark: SparkSession | None = None) -> None:
    """Refuses to overwrite."""
    text = json.dumps(value, ensure_ascii=False, indent=2)
    if spark is None:
        with open(path, "x", encoding="utf-8") as f:
            f.write(text)
        return
    if file_system(spark, path).exists(hadoop_path(spark, path)):
        raise FileExistsError(path)
    _put(spark, path, text)


def _put(spark: SparkSession, path: str, text: str) -> None:
    out = file_system(spark, path).create(hadoop_path(spark, path), False)
    out.write(bytearray(text.encode()))
    out.close()


def manifest(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys and a digest of the key set that no file layout changes."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), set_fingerprint(key).alias("key_digest"))


def file_manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, rows, bytes, sha256) of text files of any size: what a receipt lists of an artifact."""
    return file_digests(spark, pattern)


def relative_or_whole(path: str, base: str) -> str:
    if "://" in path or path.startswith("file:"):  # in a store: no links are followed
        return path.removeprefix(f"{base.rstrip('/')}/")
    p = Path(path).resolve()
    return str(p.relative_to(Path(base).resolve())) if p.is_relative_to(Path(base).resolve()) else str(p)
