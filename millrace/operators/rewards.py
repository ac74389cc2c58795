"""Rewards and statuses of recorded test outcomes. Running code is not part of this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Status codes of the two rewards, which number them unequally.
PARTIAL_STATUS = {
    "passed": 0, "syntax_error": 1, "missing_entry_point": 2, "entry_point_not_callable": 3, "wrong_answer": 4,
    "runtime_error": 5, "timeout": 6, "harness_error": 7, "no_tests": 8, "eval_error": 9,
}
STRICT_STATUS = {"passed": 0, "wrong_answer": 1, "syntax_error": 2, "runtime_error": 3, "timeout": 4, "sandbox_error": 5}
PARTIAL_WEIGHT = 0.8
TIMEOUTS_ALLOWED = 3


def pass_fraction(passed: Column, total: Column) -> Column:
    return passed.cast("double") / F.greatest(total, F.lit(1)).cast("double")


def partial_reward(passed: Column, total: Column) -> Column:
    """1 if every test passed, else 0.8 times the share that did; 0 without tests."""
    return F.when((total > 0) & (passed == total), 1.0).otherwise(pass_fraction(passed, total) * PARTIAL_WEIGHT)


def strict_reward(passed: Column, total: Column) -> Column:
    return F.when((total > 0) & (passed == total), 1.0).otherwise(0.0)


def status(passed: Column, total: Column, timeouts: Column, runtime_errors: Column) -> Column:
    """no_tests, passed, then the worst of what happened."""
    return (
        F.when(total == 0, "no_tests")
        .when(passed == total, "passed")
        .when(timeouts > 0, "timeout")
        .when(runtime_errors > 0, "runtime_error")
        .otherwise("wrong_answer")
    )


def code_of(name: Column, table: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name)


def stopped_early(tests: DataFrame, row_id: str, order: str, outcome: str) -> DataFrame:
    """Per-test outcomes as a runner that stops after three timeouts sees them: the rest count as timeouts."""
    before = Window.partitionBy(row_id).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    timeouts = F.coalesce(F.sum(F.when(F.col(outcome) == "timeout", 1).otherwise(0)).over(before), F.lit(0))
    return tests.withColumn(outcome, F.when(timeouts >= TIMEOUTS_ALLOWED, "timeout").otherwise(F.col(outcome)))


def verdicts(tests: DataFrame, row_id: str, outcome: str) -> DataFrame:
    """One row of counts, rewards and status for each graded row, from outcomes by test."""
    is_ = lambda name: F.count_if(F.col(outcome) == name)
    counted = tests.groupBy(row_id).agg(
        is_("passed").alias("passed_tests"),
        F.count("*").alias("total_tests"),
        is_("wrong_answer").alias("wrong_answers"),
        is_("runtime_error").alias("runtime_errors"),
        is_("timeout").alias("timeouts"),
    )
    p, t = F.col("passed_tests"), F.col("total_tests")
    return counted.withColumns(
        {
            "pass_frac": pass_fraction(p, t),
            "score": partial_reward(p, t),
            "strict_score": strict_reward(p, t),
            "status": status(p, t, F.col("timeouts"), F.col("runtime_errors")),
        }
    )


def fallback_fraction() -> Column:
    """Pass fraction of a record whose graders name it differently; each name is taken where it is present."""
    return F.coalesce("pass_frac", "test_pass_fraction", "pass_ratio", "score", F.col("passed").cast("double"))


def fallback_status(*names: str, default: str = "unknown") -> Column:
    """The first status that says something: empty texts fall through."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(default))
