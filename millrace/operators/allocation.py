"""Largest-remainder allocation over categories, on a small table of (arm,) category and weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import rank


def largest_remainder(counts: DataFrame, category: str, weight: str, n: int | Column, tie: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """``counts`` with ``take``: integer floors of n * w / W, leftovers by remainder descending, then ``tie``.

    Integer remainders order exactly where floats could tie. ``counts`` has a row a category, so its
    windows see few rows. n must not exceed W where weights are capacities.
    """
    want = n if isinstance(n, Column) else F.lit(n)
    arm = Window.partitionBy(*(by or (F.lit(0),)))
    w, total = F.col(weight).cast("long"), F.sum(F.col(weight).cast("long")).over(arm)
    some = F.when(total > 0, total)
    floor = counts.withColumn("__floor", F.coalesce((want * w - F.pmod(want * w, some)) / some, F.lit(0)).cast("long")).withColumn(
        "__rest", F.coalesce(F.pmod(want * w, some), F.lit(0))
    )
    spread = floor.withColumn("__left", want - F.sum("__floor").over(arm)).withColumn("__tie", tie)
    # the name closes ties of the tie-break itself
    order = arm.orderBy(F.desc("__rest"), F.col("__tie"), F.col(category))
    placed = spread.withColumn("__nth", F.row_number().over(order))
    take = (F.col("__floor") + F.when(F.col("__nth") <= F.col("__left"), 1).otherwise(0)).cast("long")
    return placed.withColumn("take", take).drop("__floor", "__rest", "__left", "__tie", "__nth")


def hash_tie(seed: int, category: str) -> Column:
    """Ties by the hash of ``seed|allocation|category|``."""
    return rank(seed, "allocation", F.col(category).cast("string"), F.lit(""))


def allocate(pools: DataFrame, category: str, n: int, seed: int, balanced: bool) -> DataFrame:
    """(category, size, take) for pools (category, size); a floor above a pool's size is an error."""
    weighted = pools.withColumn("__w", F.lit(1) if balanced else F.col("size"))
    out = largest_remainder(weighted, category, "__w", n, hash_tie(seed, category)).drop("__w")
    over = F.raise_error(F.concat(F.lit("more rows wanted than there are in "), F.col(category).cast("string"))).cast("long")
    return out.withColumn("take", F.when(F.col("take") > F.col("size"), over).otherwise(F.col("take")))
