"""Selection of steps and candidates with their tie-breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import step_means


def best_step(records: DataFrame, metric: str = "pass_frac") -> DataFrame:
    """The step with the largest mean metric, then passed, then step. A missing number is an error."""
    means = step_means(_required(records, metric, "passed"))
    return means.orderBy(F.desc(metric), F.desc("passed"), F.desc("step")).limit(1)


def _required(records: DataFrame, *columns: str) -> DataFrame:
    check = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing")).cast("double")).otherwise(F.col(c))
    return records.withColumns({c: check(c) for c in columns})


def best_complete_step(records: DataFrame, expected_rows: int, latest_if_none: bool = False) -> DataFrame:
    """The best step by passed, score, pass_frac, step among those with all rows; missing numbers count 0.

    Without a complete step the latest one, where that is allowed, else none.
    """
    filled = records.fillna(0.0, ["pass_frac", "passed", "score"])
    means = step_means(filled).withColumn("complete", F.col("rows") == expected_rows)
    order = [F.desc("complete")] + [F.when(F.col("complete"), F.col(c)).desc() for c in ("passed", "score", "pass_frac")] + [F.desc("step")]
    best = means.orderBy(*order).limit(1)
    return best if latest_if_none else best.filter("complete")


RANKING = (
    ("code_macro", True), ("mixed_macro", True), ("pass_to_fail", False), ("fail_to_pass", True),
    ("mean_test_fraction", True), ("truncation", False),
)


def ranked_candidates(candidates: DataFrame, *tie: str) -> DataFrame:
    """Candidates with ``place``: six criteria, some of them better when small, then the given order."""
    order = [F.desc(c) if up else F.asc(c) for c, up in RANKING] + [F.asc(t) for t in tie]
    return candidates.orderBy(*order)


def beats(candidate: dict[str, str] | None = None, prefix: str = "base_") -> Column:
    """Whether a candidate's criteria are strictly above the baseline's, whose transitions count 0."""
    name = candidate or {}
    sign = lambda c, up: c if up else -c
    own = F.struct(*[sign(F.col(name.get(c, c)).cast("double"), up).alias(c) for c, up in RANKING])
    base = F.struct(
        *[sign(F.lit(0.0) if c in ("pass_to_fail", "fail_to_pass") else F.col(prefix + c).cast("double"), up).alias(c) for c, up in RANKING]
    )
    return own > base
