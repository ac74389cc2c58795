"""What the operators of this subpackage share: table access, lineage cuts, text batches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that a Python worker holds as arrays at one time; a single text may exceed it.
CHUNK_BYTES = 1 << 21


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset a folder of this machine will do only if everything runs in one process, as in
    tests; elsewhere it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="millrace-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder all executors share, so a lost executor costs no recomputation.

    Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have Spark remove it after use.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def plain_names(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1 and so on, so that names inside an operator can't meet the table's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other letter stays. A text of ASCII alone has no other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(word, mask): the bits that the hashes of the keys set, in at most bits / 64 rows whatever the table's size."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    placed = keys.select(at.alias("at")).select(F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(at % 64 AS int))").alias("bit"))
    return placed.groupBy("word").agg(F.bit_or("bit").alias("mask"))


def marked(df: DataFrame, key: str, marks: DataFrame, bits: int, name: str) -> DataFrame:
    """The rows with a boolean column ``name``: false only if the key is not among those of the bitmap.

    The bitmap is broadcast; its size has the bound that ``bitmap`` gives.
    """
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    given = df.columns
    placed = df.withColumns({"__word": F.floor(at / 64), "__bit": (at % 64).cast("int")})
    found = placed.join(F.broadcast(marks.select(F.col("word").alias("__word"), F.col("mask").alias("__mask"))), "__word", "left")
    return found.select(*given, F.coalesce(F.getbit("__mask", "__bit") == 1, F.lit(False)).alias(name))


def crc_bucket(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
