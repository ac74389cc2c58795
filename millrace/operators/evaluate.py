"""Grading of recorded replies and the means over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas
from ..functions import numbers as num
from ..functions.text import cut_at_next_question, strip

# Tasks by suite, and those in the overall mean.
MAIN = ("arc_challenge", "finqa", "healthbench", "healthbench_professional", "humaneval", "legalbench", "math500_medium", "mbpp_plus", "medcalc")
HARD = ("apps_hard", "math500_high_level")
DIAGNOSTIC = ("gsm8k", "mbpp_simple", "scienceqa")
OVERALL = (
    "arc_challenge", "finqa", "humaneval", "legalbench", "math500_medium", "mbpp_plus", "medcalc", "math500_high_level",
    "gsm8k", "mbpp_simple", "scienceqa",
)
UNSCORED = ("healthbench", "healthbench_professional")
ALIASES = {
    "main": MAIN, "main_test": MAIN, "hard": HARD, "hard_test": HARD, "diagnostic": DIAGNOSTIC, "diagnostic_test": DIAGNOSTIC,
    "diag": DIAGNOSTIC, "scoreable": OVERALL, "all_scoreable": OVERALL, "no_healthbench": OVERALL,
}
DROPPED = "planbench_hard_all_tasks"
#: What the numeric tasks expect.
GSM8K_ROWS = 1319


def tasks(text: str) -> list[str]:
    """Names and aliases to distinct tasks in order."""
    if text.strip().lower() == "all":
        return [*MAIN, *HARD, *DIAGNOSTIC]
    out: dict[str, None] = {}
    for name in filter(None, (x.strip().lower() for x in text.split(","))):
        if name == DROPPED:
            continue
        if name not in ALIASES and name not in MAIN + HARD + DIAGNOSTIC:
            raise ValueError(f"unknown task: {name}")
        out.update(dict.fromkeys(ALIASES.get(name, (name,))))
    return list(out)


def suite_of(task: Column) -> Column:
    return F.when(task.isin(*MAIN), "main").when(task.isin(*HARD), "hard").when(task.isin(*DIAGNOSTIC), "diagnostic")


def accuracy(records: DataFrame, *by: str, verdict: str = "passed") -> DataFrame:
    """n, correct and accuracy; a null verdict is not scored and leaves the denominator."""
    n, ok = F.count(verdict), F.count_if(F.col(verdict))
    return records.groupBy(*by).agg(n.alias("n"), ok.alias("correct"), (ok / F.greatest(n, F.lit(1))).alias("accuracy"), F.count("*").alias("raw_n"))


def macro(records: DataFrame, component: str, group: str, verdict: str = "passed") -> DataFrame:
    """(component, macro, micro): mean over the component's groups, and over its rows."""
    by_group = accuracy(records, component, group, verdict=verdict)
    return by_group.groupBy(component).agg(
        F.avg("accuracy").alias("macro"), (F.sum("correct") / F.greatest(F.sum("n"), F.lit(1))).alias("micro"), F.sum("n").alias("n")
    )


def suite_means(metrics: DataFrame) -> DataFrame:
    """One row from (task, value): the main mean over tasks present, hard and diagnostic only if complete, overall over its list."""
    t, v = F.col("task"), F.col("value")
    mean = lambda names: F.avg(F.when(t.isin(*names), v))
    whole = lambda names: F.when(F.count_distinct(F.when(t.isin(*names) & v.isNotNull(), t)) == len(names), mean(names))
    return metrics.agg(
        mean([x for x in MAIN if x not in UNSCORED]).alias("main_scoreable_mean"),
        whole(HARD).alias("hard_mean"),
        whole(DIAGNOSTIC).alias("diagnostic_mean"),
        mean(OVERALL).alias("scoreable_overall_mean"),
        F.count(F.when(t.isin(*OVERALL), v)).alias("scoreable_dataset_count"),
    )


def metric_value() -> Column:
    return F.coalesce("accuracy", "pass_at_1", "score")


def grade_choice(predicted: str, answer: str) -> Column:
    return F.col(predicted) == F.col(answer)


def best_choice(scores: Column | str) -> Column:
    """Zero-based place of the largest score, the first of equals."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return F.array_position(s, F.array_max(s)) - 1


def mean_log_probs(choices: Column | str) -> Column:
    """Mean log-probability of each choice's tokens (an array for each choice); a choice without tokens has the least."""
    c = F.col(choices) if isinstance(choices, str) else choices
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return F.transform(c, lambda xs: F.when(F.size(xs) > 0, total(xs) / F.size(xs)).otherwise(F.lit(float("-inf"))))


def target_type(target: Column | str, bodies: Column | None = None) -> Column:
    """``numeric`` for a target with a number, else ``text``."""
    return F.when(num.first_number(target, bodies).isNotNull(), "numeric").otherwise("text")


def grade_number(reply: str, target: str, bodies: tuple[Column, Column] | None = None) -> Column:
    """Numeric answer of a reply cut at the next question."""
    a, b = bodies or (None, None)
    return num.numbers_match(num.first_number(cut_at_next_question(reply), a), num.first_number(target, b))


def grade_interval(reply: str, target: str, lower: str, upper: str) -> Column:
    return num.interval_match(num.first_number(reply), F.col(reply), F.col(target), F.col(lower), F.col(upper))


def grade_numeric_or_text(reply: str, target: str) -> Column:
    """Null for an empty target; a target with a number is compared as one, any other as text."""

    def compare(spans: Column) -> Column:
        said, wanted = spans["said"], spans["wanted"]
        text = num.text_answer_matches(num.normalise_text_answer(said, reply), num.normalise_text_answer(wanted, target))
        as_number = lambda n: F.when(n.isNotNull(), num.numbers_match(num.candidate(said), n)).otherwise(text)
        return num.once(num.candidate(wanted), as_number)

    spans = F.struct(num.answer_spans(reply).alias("said"), num.answer_spans(target).alias("wanted"))
    return F.when(strip(target) == "", F.lit(None).cast("boolean")).otherwise(num.once(spans, compare))


def grade_math(reply: str, target: str) -> Column:
    """Formulas of equal spelling; else equal numbers if the target is one, and equal values of formulas if not."""

    def compare(span: Column) -> Column:
        wanted, got = num.normalise_math(target), num.normalise_math(span)
        as_number = num.numbers_match(num.first_number(span), num.first_number(target))
        return F.when((wanted != "") & (wanted == got), True).when(num.is_numeric_math(target), as_number).otherwise(formulas.equal(target, span))

    filled = F.filter(num.answer_spans(reply), lambda s: strip(s) != "")
    return num.once(F.coalesce(strip(F.try_element_at(filled, F.lit(1))), F.lit("")), compare)


def grade_label(predicted: str, target: str) -> Column:
    return F.lower(strip(predicted)) == F.lower(strip(target))


def step_means(records: DataFrame, step: str = "step") -> DataFrame:
    return records.groupBy(step).agg(F.avg("pass_frac").alias("pass_frac"), F.avg("passed").alias("passed"), F.avg("score").alias("score"), F.count("*").alias("rows"))


def last_rows(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each series."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return df.withColumn("__n", nth).filter(F.col("__n") <= n).drop("__n")
