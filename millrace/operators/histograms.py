"""Counts, distributions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import filled
from ..sources.scratch import kept

MISSING = "MISSING"


def named(c: str) -> Column:
    """Null and empty values are counted under one name."""
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(MISSING))


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(named(column).alias("name")).agg(F.count("*").alias("n"))


def exploded_frequency(df: DataFrame, array: str, lower: bool = True) -> DataFrame:
    each = F.explode(filled(array))
    rows = df.select(each.alias("name"))
    return rows.groupBy((F.lower("name") if lower else F.col("name")).alias("name")).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, column: str, order: str, top: int = 80) -> DataFrame:
    """Largest first, ties by first appearance."""
    counts = df.groupBy(named(column).alias("name")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(top)


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n) of several columns from one scan and one shuffle of partial counts."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), named(c).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def zero_filled(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """A row for every name of a fixed domain."""
    spark = df.sparkSession
    names = spark.createDataFrame([(x,) for x in domain], "name string")
    counts = df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return names.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_count(df: DataFrame, column: str) -> DataFrame:
    """(name, n), the largest first, equal counts by name."""
    return frequency(df, column).orderBy(F.desc("n"), "name")


def report(df: DataFrame, column: str, title: str, top: int = 80) -> DataFrame:
    """(line, text): a Markdown table of the most frequent names with their share of all rows, made where the rows are."""
    counts = frequency(df, column)
    total = counts.agg(F.sum("n").alias("total"))
    first = counts.orderBy(F.desc("n"), "name").limit(top)
    line = F.row_number().over(Window.orderBy(F.desc("n"), "name")) + 1  # over ``top`` rows
    text = F.format_string("| %s | %d | %s |", "name", "n", percent(F.col("n"), F.col("total")))
    head = df.sparkSession.createDataFrame([(0, f"| {title} | rows | share |"), (1, "| --- | ---: | ---: |")], "line long, text string")
    return head.union(first.crossJoin(total).select(line.cast("long"), text))  # a row of totals


def folder_totals(df: DataFrame) -> DataFrame:
    """(folder, n): rows of a scan by the folder of their file."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/[^/]*$", 1)
    return df.select(folder.alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))


def supervised_lengths(df: DataFrame, labels: Column, ignored: int, *by: str) -> DataFrame:
    """Rows, mean and largest number of labels that count, and the longest sequence."""
    counted = F.size(F.filter(labels, lambda x: x != ignored))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(counted).alias("mean"), F.max(counted).cast("long").alias("most"), F.max(F.size(labels)).cast("long").alias("longest"))


def composite(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.concat(named(a), F.lit("::"), named(b)).alias("name")).agg(F.count("*").alias("n"))


def summary(df: DataFrame, column: str, *by: str) -> DataFrame:
    """n, total, mean, median, least and most of a group's values; nulls don't count. No group is held by one task."""
    c = F.col(column)
    rest = df.groupBy(*by).agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"))
    middle = medians(df, column, *by).toDF(*[f"__g{i}" for i in range(len(by))], "median")
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__g{i}"))
    return rest.join(middle, same, "left").select(*by, "n", "total", "mean", "median", "least", "most")


#: Ranges into which a group's distinct values are dealt at a time, and distinct values that one window may hold.
SPLITS, WINDOW_VALUES = 64, 1 << 16


def medians(df: DataFrame, column: str, *by: str, most: int = WINDOW_VALUES) -> DataFrame:
    """(by, median): the exact median of each group's values, the mean of the two middle ones of an even number.

    Values are counted first. While a group has more than ``most`` distinct ones, they are dealt to SPLITS ranges by
    approximate quantiles; the ranges' counts, a bounded number of rows a group, say which of them hold the middle,
    and only those go on. So a group of any size is counted by many tasks, and its last few values by a window.
    """
    groups = [F.col(b).alias(f"g{i}") for i, b in enumerate(by)]
    keys = [f"g{i}" for i in range(len(by))] or ["g"]
    named = df.filter(F.col(column).isNotNull()).select(*(groups or [F.lit(0).alias("g")]), F.col(column).cast("double").alias("v"))
    left = named.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    total = left.groupBy(*keys).agg(F.sum("n").alias("rows"))
    left = _met(left, total, keys).withColumn("before", F.lit(0).cast("long"))
    own = Window.partitionBy(*keys)
    while (left.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0) > most:
        cuts = left.groupBy(*keys).agg(F.percentile_approx("v", [i / SPLITS for i in range(1, SPLITS)], 100 * SPLITS).alias("cuts"))
        dealt = _met(left, cuts, keys).withColumn("range", F.size(F.filter("cuts", lambda p: p < F.col("v"))))
        counts = dealt.groupBy(*keys, "range", "rows", "before").agg(F.sum("n").alias("in_range"))
        upto = F.col("before") + F.sum("in_range").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        placed = counts.withColumn("upto", upto).withColumn("ahead", F.col("upto") - F.col("in_range"))
        holding = placed.filter((F.col("upto") > _middles()[0]) & (F.col("ahead") <= _middles()[1]))
        first = holding.groupBy(*keys).agg(F.min("ahead").alias("ahead"), F.min("range").alias("low"), F.max("range").alias("high"))
        left = kept(_met(dealt, first, keys).filter(F.col("range").between(F.col("low"), F.col("high"))).select(*keys, "v", "n", "rows", F.col("ahead").alias("before")), "medians")
    upto = F.col("before") + F.sum("n").over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    low, high = (F.min(F.when(F.col("upto") > k, F.col("v"))) for k in _middles())
    out = left.withColumn("upto", upto).groupBy(*keys).agg(((low + high) / 2).alias("median"))
    return out.select(*keys[: len(by)], "median").toDF(*by, "median")


def _middles() -> tuple[Column, Column]:
    """Zero-based places of the two middle ones of ``rows`` values."""
    return F.floor((F.col("rows") - 1) / 2), F.floor(F.col("rows") / 2)


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with what a table of groups says of its group; null groups meet too."""
    other = right.toDF(*[f"__{c}" if c in keys else c for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, same).drop(*[f"__{k}" for k in keys])


def percentile_places(n: Column, q: float) -> dict[str, Column]:
    """Zero-based places of three percentile definitions in a sorted list of n values."""
    clamp = lambda k: F.least(F.greatest(k, F.lit(0)), n - 1).cast("long")
    return {
        "lower": clamp(F.floor(F.lit(q) * (n - 1))),
        "upper": clamp(F.floor(F.lit(q) * n)),
        "nearest": clamp(F.bround((n - 1) * F.lit(q))),
    }


#: Ranges into which the distinct values of a percentile are dealt.
RANGES = 256


def percentiles(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row with the three definitions.

    Values are counted first. Their distinct values are dealt to ranges by approximate quantiles, whose counts,
    a row a range, say how many values lie before each; cumulative counts within a range find the places. So no
    task sees all distinct values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    cuts = sorted(set(counts.select(F.col("v").cast("double").alias("v")).approxQuantile("v", [i / RANGES for i in range(1, RANGES)], 0.002)))
    points = F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>")
    dealt = counts.withColumn("range", F.size(F.filter(points, lambda p: p < F.col("v").cast("double"))))
    sizes = dealt.groupBy("range").agg(F.sum("n").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    starts = sizes.select("range", before.alias("before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    within = F.sum("n").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.join(F.broadcast(starts), "range").withColumn("upto", F.col("before") + within)  # RANGES rows
    at = percentile_places(F.col("total"), q)
    return placed.agg(*[F.min(F.when(F.col("upto") > k, F.col("v"))).alias(name) for name, k in at.items()])


def examples(df: DataFrame, group: str, row_id: str, most: int = 20) -> DataFrame:
    """Up to ``most`` ids of each group, the smallest first."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(row_id))
    kept = df.select(group, row_id).withColumn("nth", nth).filter(F.col("nth") <= most)
    return kept.groupBy(group).agg(F.array_sort(F.collect_list(row_id)).alias("examples"))


def multiplicity(df: DataFrame, *keys: str) -> DataFrame:
    """One row: distinct keys, keys that occur more than once, rows beyond the first of their key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.sum(F.col("n") - 1).alias("extra_rows")
    )


def loss_summary(df: DataFrame, step: str = "step", loss: str = "loss", last: int = 20) -> DataFrame:
    """count, first, last, least, mean of the last rows and population deviation of a series.

    The last rows come from a top-k, not from a window over the whole series.
    """
    rows = df.select(F.col(step).alias("step"), F.col(loss).alias("loss")).filter("loss IS NOT NULL")
    whole = rows.agg(
        F.count("*").alias("n"),
        F.min_by("loss", "step").alias("first_loss"),
        F.max_by("loss", "step").alias("last_loss"),
        F.min("loss").alias("min_loss"),
        F.stddev_pop("loss").alias("std_loss"),
    )
    tail = rows.orderBy(F.desc("step")).limit(last).agg(F.avg("loss").alias("tail_mean"))
    return whole.crossJoin(tail)  # a row each


def percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.2f%%", F.when(whole > 0, part * 100.0 / whole).otherwise(0.0))
