"""Keyed joins with completeness reports. Sides are joined by key, never by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enriched_or_raise(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Inner join in which every left row must match; up to five missing keys are named."""
    missing = left.join(right.select(key), key, "left_anti").select(key).limit(5).collect()
    if missing:
        raise ValueError(f"{name}: no row for {[r[0] for r in missing]}")
    return left.join(right, key)


def with_missing(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(left join, keys without a match)."""
    return left.join(right, key, "left"), left.join(right.select(key), key, "left_anti").select(key)


def missing_summary(left: DataFrame, right: DataFrame, key: str, shown: int = 20) -> DataFrame:
    """One row: matched, missing, and the smallest missing keys."""
    flagged = left.select(key).join(right.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    first = flagged.filter("__k IS NULL").orderBy(key).limit(shown).agg(F.array_sort(F.collect_list(key)).alias("first_missing"))
    return flagged.agg(F.count("__k").alias("matched"), F.count_if(F.col("__k").isNull()).alias("missing")).crossJoin(first)  # a row each


def transitions(baseline: DataFrame, candidate: DataFrame, key: str, verdict: str = "passed") -> DataFrame:
    """One row: pass to fail, fail to pass and unchanged rows over the keys that both have."""
    a = baseline.select(key, F.col(verdict).alias("b"))
    both = a.join(candidate.select(key, F.col(verdict).alias("c")), key)
    return both.agg(
        F.count("*").alias("compared"),
        F.count_if(F.col("b") & ~F.col("c")).alias("pass_to_fail"),
        F.count_if(~F.col("b") & F.col("c")).alias("fail_to_pass"),
    )


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys on both sides."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def label_sets(rows: DataFrame, group: str, target: str, order: str) -> DataFrame:
    """(group, labels): the distinct targets of each group by first appearance."""
    first = rows.groupBy(group, target).agg(F.min(order).alias("__at"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", target))), lambda x: x[target]).alias("labels"))


def order_differences(a: DataFrame, b: DataFrame, order: str, key: str) -> DataFrame:
    """(order, left, right) where two ordered lists of keys differ; empty if they are equal."""
    left, right = a.select(order, F.col(key).alias("left")), b.select(order, F.col(key).alias("right"))
    return left.join(right, order, "full").filter(~F.col("left").eqNullSafe(F.col("right")))


def jobs(models: DataFrame, seeds: DataFrame, arms: DataFrame) -> DataFrame:
    """Every model with its base job and every seed of every arm; all three are short lists of a study."""
    trained = models.crossJoin(seeds).crossJoin(arms)
    base = models.withColumn("seed", F.lit(None).cast("long")).withColumn("arm", F.lit("base"))
    return trained.unionByName(base.select(*trained.columns))


def fused(first: DataFrame, second: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """All rows of both with the columns of either; absent values take their default."""
    both = first.unionByName(second, allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def united_by(first: DataFrame, second: DataFrame, category: str) -> DataFrame:
    """All rows of both, those of one category together, ready for a write by category; each side may lack columns."""
    return first.unionByName(second, allowMissingColumns=True).repartition(category, F.pmod(F.xxhash64(*second.columns), F.lit(16)))


def group_normalised(df: DataFrame, group: str, score: str, epsilon: float = 1e-6) -> DataFrame:
    """Scores less the group's mean over its deviation; groups of one score are dropped.

    A group is summed up by every task that has rows of it and joined back, so a hot one is no task's alone.
    """
    s = F.col(score)
    of = df.groupBy(F.col(group).alias("__group")).agg(F.min(s).alias("__min"), F.max(s).alias("__max"), F.avg(s).alias("__mean"), F.stddev(s).alias("__std"))
    met = df.join(of.filter("__min < __max"), F.col(group).eqNullSafe(F.col("__group")))
    return met.withColumn("advantage", (s - F.col("__mean")) / (F.col("__std") + epsilon)).select(*df.columns, "advantage")
