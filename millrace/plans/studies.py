"""Longer studies: verified training rows, ablation arms, graded suites. Each is one plan over its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import pair_key
from ..functions.text import strip
from ..operators import arms, classify, dedup, evaluate, joins, prompts, sampling, splits
from ..sources.scratch import kept


def verified_rows(legacy: DataFrame, source: DataFrame, trusted: DataFrame, repairs: DataFrame | None = None, repairs_on: bool = False) -> DataFrame:
    """Every legacy row (id, prompt, answer) with its audit ``status``.

    ``source`` (id, reject_reason, ...) holds admitted problems, of which only legacy ids are read;
    ``trusted`` (id, is_val) those whose solution was verified; ``repairs`` (id, kind, code) the first
    candidate that passed. The last copy of a repeated legacy id counts, the smallest id of equal pairs stays.
    """
    wanted = source.join(legacy.select("id"), "id", "left_semi").select("id", "reject_reason", F.lit(True).alias("in_source"))
    fixed = None if repairs is None else repairs.select("id", F.col("kind").isNotNull().alias("repaired"), F.lit(True).alias("has_repairs"), "code")
    rows = legacy.join(wanted, "id", "left").join(trusted.select("id", "is_val", F.lit(True).alias("verified")), "id", "left")
    if fixed is None:
        rows = rows.withColumns({"repaired": F.lit(False), "has_repairs": F.lit(False), "code": F.lit(None).cast("string")})
    else:
        rows = rows.join(fixed, "id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    answer = F.coalesce("code", "answer")
    status = dedup.audit_status(
        flag(F.col("in_source")), F.col("reject_reason"), flag(F.col("verified")), flag(F.col("repaired")), flag(F.col("has_repairs")), F.lit(False), repairs_on
    )
    audited = rows.select("id", "prompt", answer.alias("answer"), flag(F.col("is_val")).alias("was_validation"), status.alias("status"))
    kept = audited.filter(F.col("status").isin("kept_verified", "repaired_verified"))
    first = dedup.keep_first(kept, "id", pair_key("prompt", "answer"))
    marked = audited.join(first, "id", "left")
    double = F.col("kept_id").isNotNull() & (F.col("kept_id") != F.col("id"))
    return marked.withColumn("status", F.when(double, "exact_prompt_answer_duplicate").otherwise(F.col("status"))).drop("kept_id")


def with_categories(rows: DataFrame, index: DataFrame, key: str = "id") -> DataFrame:
    """Rows with their formal category and overlap; a row without an index entry stops the study."""
    known = index.select(
        F.col("id").alias(key), classify.formal("primary_category").alias("category"), classify.formal_overlap("overlap_categories", "primary_category").alias("overlap")
    )
    return joins.enriched_or_raise(rows, known, key, "category index")


def ablation(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """(arm, id): ``full``, and for every formal category an arm of n rows without it in their overlap.

    One pass: a row is exploded over the arms that don't remove it, and each arm keeps its n smallest
    hashes. A pool smaller than n stops the study.
    """
    rows = kept(rows.select(key, "category", "overlap"), "pool")
    names = list(arms.pool_sizes(rows, "category"))
    every = F.array(*[F.lit(x) for x in sorted(names)])
    open_ = rows.select(F.col(key), F.explode(F.filter(every, lambda c: ~F.array_contains("overlap", c))).alias("gone"))
    sizes = {r["gone"]: r["n"] for r in open_.groupBy("gone").agg(F.count("*").alias("n")).collect()}
    short = [c for c in names if sizes.get(c, 0) < n]
    if short:
        raise ValueError(f"fewer than {n} rows without {short}")
    taken = sampling.ranked(open_, key, "gone", seed, "ablation", F.lit(n)).filter(F.col("nth") <= n)
    return rows.select(F.lit("full").alias("arm"), key).union(taken.select(F.concat(F.lit("no_"), F.col("gone")), key))


def sft_arms(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Training rows of the full arm, a balanced control of n rows, and an arm of n rows without each bucket.

    Ids and categories of the usable rows are written once. Each is exploded over the arms that don't remove it,
    all arms are sampled by one plan, and texts meet the chosen ids at the end.
    """
    usable = prompts.usable(rows).filter("usable")
    shown = F.array_compact(classify.overlap_or_primary("overlap_categories", "primary_category"))
    pool = kept(usable.select("id", classify.bucket(F.coalesce("primary_category", F.lit("other_algorithm"))).alias("bucket"), shown.alias("shown")), "pool")
    arm = lambda name, own, gone: F.struct(F.lit(name).alias("label"), F.lit(own).alias("seed"), F.array(*map(F.lit, gone)).cast("array<string>").alias("gone"))
    every = F.array(arm("balanced", seed, ()), *[arm(f"no_{b}", seed + 100 + i, classify.removed_by(b)) for i, b in enumerate((*classify.CORE_BUCKETS, "other_algorithm"))])
    open_ = pool.select("id", "bucket", F.explode(F.filter(every, lambda a: ~F.arrays_overlap("shown", a["gone"]))).alias("a"))
    sampled = sampling.stratified_by(open_.select("id", "bucket", F.col("a.label").alias("__label"), F.col("a.seed").alias("__seed")), "id", "bucket", n)
    takes = pool.select(F.lit("full").alias("arm"), "id").union(sampled.select(F.col("__label").alias("arm"), "id"))
    removed = F.when(F.startswith("arm", F.lit("no_")), F.substring("arm", 4, 100))
    return prompts.sft_records(takes.join(usable, "id"), F.col("arm"), classify.bucket("primary_category"), removed)


def rl_split(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """RL rows (problem_id, interface_kind) with split and index within it."""
    arms.unique_or_raise(rows, "problem_id")
    return splits.reindexed(splits.holdout(rows, "problem_id", ["interface_kind"], n, seed), "split", "problem_id", seed)


#: What grades a task, over (reply, target, lower, upper, passed); replies to other tasks have no grade.
GRADERS = {
    "choice": lambda: F.col("reply") == F.col("target"),
    "number": lambda: evaluate.grade_number("reply", "target"),
    "formula": lambda: evaluate.grade_math("reply", "target"),
    "interval": lambda: evaluate.grade_interval("reply", "target", "lower", "upper"),
    "number_or_text": lambda: evaluate.grade_numeric_or_text("reply", "target"),
    "label": lambda: evaluate.grade_label("reply", "target"),
    "recorded": lambda: F.col("passed"),
}
GRADED_BY = {
    "arc_challenge": "choice", "scienceqa": "choice", "gsm8k": "number", "math500_medium": "formula", "math500_high_level": "formula", "medcalc": "interval",
    "finqa": "number_or_text", "legalbench": "label", "humaneval": "recorded", "mbpp_plus": "recorded", "mbpp_simple": "recorded", "apps_hard": "recorded",
}


def verdict(task: Column, graded_by: dict[str, str] = GRADED_BY) -> Column:
    """The verdict of a row of any task; the grader is looked up by the task's name."""
    out = F.lit(None).cast("boolean")
    for name, grade in GRADERS.items():
        if of := [t for t, g in graded_by.items() if g == name]:
            out = F.when(task.isin(*of), grade()).otherwise(out)
    return out


def graded(records: DataFrame, graded_by: dict[str, str] = GRADED_BY) -> DataFrame:
    """Replies of many tasks (task, reply, target, lower, upper, passed) with their verdicts, in one pass."""
    return records.withColumn("passed", verdict(F.col("task"), graded_by))


def suite(records: DataFrame, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((task, suite, n, correct, accuracy, raw_n), one row of means) of the tasks' recorded replies, from one scan."""
    rows = records if only is None else records.filter(F.col("task").isin(*only))
    metrics = evaluate.accuracy(graded(rows).select("task", "passed"), "task").withColumn("suite", evaluate.suite_of(F.col("task")))
    scored = metrics.filter(~F.col("task").isin(*evaluate.UNSCORED))
    return metrics, evaluate.suite_means(scored.select("task", F.col("accuracy").alias("value")))


def legal_choices(rows: DataFrame) -> DataFrame:
    """Rows (ord, task_type, target) with the label set of their type."""
    sets = joins.label_sets(rows, "task_type", "target", "ord")
    return rows.join(sets, "task_type")


def internal_mix(records: DataFrame) -> DataFrame:
    """(component, macro, micro, n) of a mixed set, its subjects weighted alike, and ``mixed`` as the mean of components."""
    parts = evaluate.macro(records, "component", "subject")
    mean = parts.agg(F.lit("mixed").alias("component"), F.avg("macro").alias("macro"), (F.sum(F.col("micro") * F.col("n")) / F.sum("n")).alias("micro"), F.sum("n").alias("n"))
    return parts.union(mean)


def answer_present(c: str) -> Column:
    """Whether an answer has text; count the others with ``observe`` where rows are skipped."""
    return strip(F.coalesce(F.col(c), F.lit(""))) != ""
