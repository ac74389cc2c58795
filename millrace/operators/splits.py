"""Holdouts: stratified, with forced members, of exact size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import rank
from .allocation import largest_remainder
from .sampling import placed


def holdout(df: DataFrame, row_id: str, strata: list[str], n: int, seed: int, forced: DataFrame | None = None) -> DataFrame:
    """(id, strata, split): ``validation`` for min(n, rows div 10) rows, ``train`` for the others.

    Forced ids (a column named as the id) go to validation first and may exceed n; they count for nothing
    when the size is 0. The rest of n is dealt over the strata by largest remainder, ties by stratum name.
    """
    rows = df.select(row_id, *strata)
    total = rows.count()
    n = min(n, total // 10)
    if n == 0:
        return rows.withColumn("split", F.lit("train"))
    flagged = rows.withColumn("__forced", F.lit(False))
    if forced is not None:
        ids = forced.select(F.col(row_id).alias("__id")).distinct()
        flagged = rows.join(ids, rows[row_id] == F.col("__id"), "left").withColumn("__forced", F.col("__id").isNotNull()).drop("__id")
    left = max(0, n - (flagged.filter("__forced").count() if forced is not None else 0))
    name = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in strata])
    open_ = flagged.filter(~F.col("__forced")).withColumn("__stratum", name)
    sizes = open_.groupBy("__stratum").agg(F.count("*").alias("size"))
    takes = largest_remainder(sizes, "__stratum", "size", left, F.col("__stratum")).select(F.col("__stratum").alias("__s"), "take")
    r = rank(seed, "holdout", F.col("__stratum"), row_id)
    dealt = placed(open_.withColumn("__rank", r).join(F.broadcast(takes), F.col("__stratum") == F.col("__s")), ["__stratum"], "__rank", row_id)
    split = F.when(F.col("nth") <= F.col("take"), "validation").otherwise("train")
    out = dealt.select(row_id, *strata, split.alias("split"))
    return out.union(flagged.filter("__forced").select(row_id, *strata, F.lit("validation").alias("split")))


def reindexed(df: DataFrame, split: str, row_id: str, seed: int) -> DataFrame:
    """``index`` from 0 within each split, in hash order."""
    rows = df.withColumn("__rank", rank(seed, "index", F.col(split), row_id))
    return placed(rows, [split], "__rank", row_id).withColumn("index", F.col("nth") - 1).drop("nth", "__rank")
