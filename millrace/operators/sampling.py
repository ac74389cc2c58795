"""Samples by hash rank: the same rows for the same seed, whatever the order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import rank
from .allocation import largest_remainder


def first_by_rank(df: DataFrame, row_id: str, n: int, seed: int, purpose: str, label: str) -> DataFrame:
    """Ids of the n rows with the smallest rank. Only ids are ranked; join texts to the result.

    Each partition keeps its n smallest, so n rows a task reach the last one.
    """
    r = rank(seed, purpose, label, row_id)
    return df.select(row_id, r.alias("__rank")).orderBy("__rank", F.col(row_id).cast("string")).limit(n).select(row_id)


#: Leading hex digits of a rank that deal a group's rows to windows of their own.
BUCKET_DIGITS = 3


def _up_to(bucketed: DataFrame, group: list[str], most: Column) -> DataFrame:
    """Rows of the buckets that have the first ``most`` places of each group; all rows of a bucket or none."""
    counts = bucketed.groupBy(*group, "__digits").agg(F.count("*").alias("__n"), F.max(most).alias("__most"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__digits")) - F.col("__n")
    needed = counts.withColumn("__before", before).filter("__before < __most")
    last = needed.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]).agg(F.max("__digits").alias("__last"))
    same = F.col("__digits") <= F.col("__last")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return bucketed.join(F.broadcast(last), same).drop("__last", *[f"__g{i}" for i in range(len(group))])


def placed(df: DataFrame, group: list[str], rank_column: str, row_id: str, most: Column | None = None) -> DataFrame:
    """``df`` with ``nth``, the place of each row in its group by rank; rows beyond ``most`` may be left out.

    A group may hold a third of all rows, so no task gets a whole group. Ranks are uniform hashes: their
    leading digits split a group into 4,096 even buckets, whose counts (a row for each group and bucket)
    give every bucket the places before it, and a window numbers the rows within a bucket alone. With ``most``,
    which is the same for all rows of a group, counting also tells the last bucket that has a place up to it: a row
    a group, sent to all tasks, so that rows beyond it go before anything is shuffled.
    """
    bucketed = df.withColumn("__digits", F.substring(rank_column, 1, BUCKET_DIGITS))
    if most is not None:
        bucketed = _up_to(bucketed, group, most)
    counts = bucketed.groupBy(*group, "__digits").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__digits")) - F.col("__n")
    start = counts.withColumn("__before", before).drop("__n")
    right = start.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__digits").alias("__b"), "__before")
    same = F.col("__digits") == F.col("__b")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    met = bucketed.join(right, same)
    within = Window.partitionBy(*group, "__digits").orderBy(rank_column, F.col(row_id).cast("string"))
    out = met.withColumn("nth", (F.col("__before") + F.row_number().over(within)).cast("long"))
    return out.drop("__digits", "__b", "__before", *[f"__g{i}" for i in range(len(group))])


def ranked(df: DataFrame, row_id: str, category: str, seed: int, purpose: str = "single_pool", most: Column | None = None) -> DataFrame:
    """(id, category, nth): the place of every id in its category's ranking, shared by all arms.

    With ``most`` rows beyond it may be left out, most of them before they are shuffled.
    """
    r = rank(seed, purpose, F.col(category).cast("string"), row_id)
    return placed(df.select(row_id, category, r.alias("__rank")), [category], "__rank", row_id, most).drop("__rank")


def first_by_category(df: DataFrame, row_id: str, category: str, n: int, seed: int, purpose: str = "single_pool") -> DataFrame:
    """Ids of the first n rows of each category with their place; every task keeps at most n rows a category."""
    r = rank(seed, purpose, F.col(category).cast("string"), row_id)
    nth = F.row_number().over(Window.partitionBy(category).orderBy("__rank", F.col(row_id).cast("string")))
    return df.select(row_id, category, r.alias("__rank")).withColumn("nth", nth).filter(F.col("nth") <= n).drop("__rank")


def stratified(df: DataFrame, row_id: str, stratum: str, n: int, seed: int, label: str, name_descending: bool = True) -> DataFrame:
    """(id, stratum) of a proportional sample of n rows; equal remainders go to the later (or earlier) name."""
    one = df.select(row_id, stratum, F.lit(label).alias("__label"), F.lit(seed).alias("__seed"))
    return stratified_by(one, row_id, stratum, n, name_descending).select(row_id, stratum)


def stratified_by(df: DataFrame, row_id: str, stratum: str, n: int, name_descending: bool = True) -> DataFrame:
    """(__label, id, stratum): a proportional sample of n rows for every label of (id, stratum, __label, __seed).

    One plan for all labels: their strata are counted together, and a row is ranked once for each label that it
    is open to. A label and a stratum name a group, which no task gets whole: the rows to take, a line a group, go to all.
    """
    sizes = df.groupBy("__label", stratum).agg(F.count("*").alias("size"))
    # names in order: a stratum's place among the others of its label is its tie-break
    nth = F.row_number().over(Window.partitionBy("__label").orderBy(F.desc(stratum) if name_descending else F.asc(stratum)))
    takes = largest_remainder(sizes.withColumn("__place", nth), stratum, "size", n, F.col("__place"), ("__label",))
    takes = takes.select(F.col(stratum).alias("__s"), F.col("__label").alias("__l"), "take")
    r = rank(F.col("__seed"), F.col("__label"), F.col(stratum).cast("string"), row_id)
    met = (F.col("__label") == F.col("__l")) & F.col(stratum).eqNullSafe(F.col("__s"))
    rows = df.select(row_id, stratum, "__label", r.alias("__rank")).join(F.broadcast(takes), met).drop("__s", "__l")
    return placed(rows, ["__label", stratum], "__rank", row_id, F.col("take")).filter("nth <= take").select("__label", row_id, stratum)


def shuffled(df: DataFrame, row_id: str, seed: int, purpose: str = "shuffle") -> DataFrame:
    """All rows in hash order."""
    return df.orderBy(rank(seed, purpose, "all", row_id), F.col(row_id).cast("string"))
