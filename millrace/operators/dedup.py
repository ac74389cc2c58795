"""Exact duplicates and the audit of an admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import pair_key
from ..functions.text import collapse


#: Tasks that share the rows of one key.
SALTS = 16


def keep_first(df: DataFrame, row_id: str, key: Column) -> DataFrame:
    """(id, kept_id): for every row the smallest id with the same key.

    Keys that several rows share are aggregated, dealt to SALTS copies and joined back by key and salt, so
    that even a key of a third of all rows is spread; the other rows keep themselves. Texts stay behind: ids and
    keys are shuffled once, and both the counts and the join read that shuffle.
    """
    # a key that may be null would be filtered on one side alone, and the shuffle read twice; a null key is a row's own
    own = F.concat(F.lit("\0"), F.coalesce(F.col(row_id).cast("string"), F.lit("")))
    keyed = df.select(F.col(row_id).alias("id"), F.coalesce(key.cast("string"), own).alias("key")).withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).repartition("key", "salt")
    parts = keyed.groupBy("key", "salt").agg(F.min("id").alias("kept_id"), F.count("*").alias("n"))
    shared = parts.groupBy("key").agg(F.min("kept_id").alias("kept_id"), F.sum("n").alias("n")).filter("n > 1")
    dealt = shared.select("key", "kept_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return keyed.join(dealt, ["key", "salt"], "left").select("id", F.coalesce("kept_id", "id").alias("kept_id"))


def duplicate_pairs(df: DataFrame, row_id: str, prompt: str, answer: str) -> DataFrame:
    return keep_first(df, row_id, pair_key(prompt, answer))


def text_key(text: str) -> Column:
    return F.sha2(collapse(text).cast("binary"), 256)


# The reasons that an audit may give, in order of precedence.
AUDIT = (
    "not_in_rl_dedup_source", "kept_verified", "repaired_verified", "all_simple_repairs_failed",
    "canonical_failed_no_safe_mechanical_repair", "canonical_not_execution_verified", "exact_prompt_answer_duplicate",
)


def audit_status(
    in_source: Column, structural_reason: Column, verified: Column, repaired: Column, has_repairs: Column, duplicate: Column, repairs_on: bool
) -> Column:
    """Status of one legacy row; a duplicate overrides what went before."""
    tried = F.when(repaired, "repaired_verified").when(has_repairs, "all_simple_repairs_failed").otherwise("canonical_failed_no_safe_mechanical_repair")
    unverified = tried if repairs_on else F.lit("canonical_not_execution_verified")
    status = (
        F.when(~in_source, "not_in_rl_dedup_source")
        .when(structural_reason.isNotNull(), structural_reason)
        .when(verified, "kept_verified")
        .otherwise(unverified)
    )
    admitted = status.isin("kept_verified", "repaired_verified")
    return F.when(admitted & F.coalesce(duplicate, F.lit(False)), "exact_prompt_answer_duplicate").otherwise(status)


def rejected_rows(audited: DataFrame) -> DataFrame:
    """Rows that an audit has not kept, with the reason, for export."""
    return audited.filter(~F.col("status").isin("kept_verified", "repaired_verified"))


def first_repair(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, kind, code) of the first candidate (id, pos, kind, code) whose recorded verdict passed."""
    passed = candidates.join(verdicts.filter("passed").select("id", "pos"), ["id", "pos"])
    return passed.groupBy("id").agg(F.min_by(F.struct("kind", "code"), "pos").alias("x")).select("id", "x.*")


def preflight(solution: Column, passed: Column, status_code: Column) -> Column:
    """Reason of a canonical check on recorded verdicts."""
    return (
        F.when(F.coalesce(F.trim(solution), F.lit("")) == "", "no_canonical_structural_only")
        .when(passed, "canonical_full_pass")
        .otherwise(F.concat(F.lit("canonical_failed_status_"), status_code.cast("int").cast("string")))
    )
