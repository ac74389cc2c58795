"""Hash ranks, row keys and set digests: the deterministic randomness of every sample."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, collapse


def rank(seed: int | Column, purpose: str | Column, category: str | Column, row_id: Column | str) -> Column:
    """SHA-256 of ``seed|purpose|category|id`` in hex; smaller goes first."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(str(x))
    text = F.concat(lit(seed).cast("string"), F.lit("|"), lit(purpose), F.lit("|"), lit(category), F.lit("|"), col(row_id).cast("string"))
    return F.sha2(text.cast("binary"), 256)


def rank_of(seed: int, purpose: str, category: str, row_id: str) -> str:
    """The same on the driver, for a handful of categories."""
    return hashlib.sha256(f"{seed}|{purpose}|{category}|{row_id}".encode()).hexdigest()


def arm_seed(seed: int, arm: str) -> int:
    """64-bit seed of an arm: the first 16 hex digits of SHA-256 of ``seed:arm``."""
    return int(hashlib.sha256(f"{seed}:{arm}".encode()).hexdigest()[:16], 16)


def arm_seed_column(seed: int, arm: Column | str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), col(arm)).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def pair_key(prompt: Column | str, answer: Column | str) -> Column:
    """Names a pair by its texts up to white space, with a NUL between."""
    return F.sha2(F.concat(collapse(prompt), F.lit("\0"), collapse(answer)).cast("binary"), 256)


def set_digests(df: DataFrame, ids: str, by: str) -> DataFrame:
    """(by, digest): SHA-256 of each group's sorted ids, every one closed by a line feed, for sets of any size.

    Ids come to a task sorted by group (a sort that spills) and pass through one running hash; nothing is gathered.
    A hash is made from front to back, so a group is one task's; ``set_fingerprint`` has no such limit.
    """
    named = df.select(F.col(by), F.col(ids).cast("string").alias("__id")).filter("__id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            for group, pairs in groupby(zip(batch.column(0), batch.column(1).to_pylist()), key=lambda x: x[0]):
                if running is None or group != now:
                    if running is not None:
                        yield closed(now, running)
                    now, running = group, hashlib.sha256()
                running.update("".join([f"{i}\n" for _, i in pairs]).encode())
        if running is not None:
            yield closed(now, running)

    def closed(group: pa.Scalar, running) -> pa.RecordBatch:  # noqa: ANN001
        return pa.RecordBatch.from_arrays([pa.array([group.as_py()], group.type), pa.array([running.hexdigest()])], [by, "digest"])

    kind = df.schema[by].dataType.simpleString()
    return named.repartition(by).sortWithinPartitions(by, "__id").mapInArrow(run, f"`{by}` {kind}, digest string")


def set_fingerprint(ids: Column | str) -> Column:
    """Aggregate for sets of any size in any number of tasks: order-free sum of 60-bit hashes as a decimal."""
    digest = F.sha2(col(ids).cast("string").cast("binary"), 256)
    return F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)"))
