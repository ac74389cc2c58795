"""Queries over rewards, grading, means and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, code
from ..functions import text as tx
from ..operators import admission, evaluate, rewards, select
from ..session import table

_OUTCOME = "CASE WHEN l_quantity > 45 THEN 'timeout' WHEN l_quantity > 40 THEN 'runtime_error' WHEN l_quantity > 34 THEN 'wrong_answer' ELSE 'passed' END"


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for the tests of an order; the quantity tells their outcome."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_OUTCOME).alias("outcome"))


_VERDICT_SQL = f"""
t AS (SELECT l_orderkey, l_linenumber, {_OUTCOME} AS outcome FROM lineitem),
v AS (SELECT l_orderkey, count(*) FILTER (outcome = 'passed') AS passed_tests, count(*) AS total_tests, count(*) FILTER (outcome = 'wrong_answer') AS wrong_answers,
      count(*) FILTER (outcome = 'runtime_error') AS runtime_errors, count(*) FILTER (outcome = 'timeout') AS timeouts FROM t GROUP BY l_orderkey),
w AS (SELECT *, passed_tests / total_tests::DOUBLE AS pass_frac, CASE WHEN passed_tests = total_tests THEN 1.0 ELSE 0.0 END::DOUBLE AS strict_score,
      CASE WHEN passed_tests = total_tests THEN 'passed' WHEN timeouts > 0 THEN 'timeout' WHEN runtime_errors > 0 THEN 'runtime_error' ELSE 'wrong_answer' END AS status FROM v)
"""


def reward_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewards.verdicts(_tests(spark, sf_dir), "l_orderkey", "outcome")
    return out.select("l_orderkey", "passed_tests", "total_tests", F.round("score", 9).alias("score"))


PARTIAL_SQL = f"WITH {_VERDICT_SQL} SELECT l_orderkey, passed_tests, total_tests, round(CASE WHEN strict_score = 1 THEN 1.0 ELSE pass_frac * 0.8 END, 9) AS score FROM w"


def reward_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewards.verdicts(_tests(spark, sf_dir), "l_orderkey", "outcome")
    return out.select("l_orderkey", F.col("strict_score").alias("score"), "wrong_answers", "runtime_errors", "timeouts")


STRICT_SQL = f"WITH {_VERDICT_SQL} SELECT l_orderkey, strict_score AS score, wrong_answers, runtime_errors, timeouts FROM w"


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses with their two unequal codes."""
    out = rewards.verdicts(_tests(spark, sf_dir), "l_orderkey", "outcome").groupBy("status").agg(F.count("*").alias("n"))
    partial, strict = (rewards.code_of(F.col("status"), t) for t in (rewards.PARTIAL_STATUS, rewards.STRICT_STATUS))
    return out.select("status", "n", partial.alias("partial_code"), strict.alias("strict_code"))


STATUS_SQL = f"""
WITH {_VERDICT_SQL}, c(s, p, q) AS (VALUES ('passed', 0, 0), ('wrong_answer', 4, 1), ('runtime_error', 5, 3), ('timeout', 6, 4))
SELECT status, count(*) AS n, any_value(p) AS partial_code, any_value(q) AS strict_code FROM w JOIN c ON s = status GROUP BY status
"""


def stopped_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes when a runner stops after three timeouts: supplier's line items in order."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.expr(_OUTCOME).alias("outcome")
    )
    return rewards.stopped_early(lines, "l_suppkey", "pos", "outcome").groupBy("l_suppkey", "outcome").agg(F.count("*").alias("n"))


STOPPED_SQL = f"""
WITH t AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS pos, {_OUTCOME} AS outcome FROM lineitem),
s AS (SELECT l_suppkey, CASE WHEN coalesce(sum((outcome = 'timeout')::INT) OVER (PARTITION BY l_suppkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3
      THEN 'timeout' ELSE outcome END AS outcome FROM t)
SELECT l_suppkey, outcome, count(*) AS n FROM s GROUP BY ALL
"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts by language and source; toxic rows of low quality are unscored."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels")
    verdict = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit(None)).otherwise(F.col("quality") == 1)
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", verdict.alias("passed"))


_GRADED_SQL = """
g AS (SELECT d.doc_id, lang, source, CASE WHEN toxic = 1 AND quality = 0 THEN NULL ELSE quality = 1 END AS passed FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
a AS (SELECT lang, source, count(passed) AS n, count(*) FILTER (passed) AS correct, count(*) AS raw_n FROM g GROUP BY ALL)
"""


def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_graded(spark, sf_dir), "lang", "source")


ACCURACY_SQL = f"WITH {_GRADED_SQL} SELECT lang, source, n, correct, correct / greatest(n, 1)::DOUBLE AS accuracy, raw_n FROM a"


def accuracy_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.macro(_graded(spark, sf_dir), "lang", "source")
    return out.select("lang", F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"), "n")


MACRO_SQL = f"""
WITH {_GRADED_SQL} SELECT lang, round(avg(correct / greatest(n, 1)::DOUBLE), 9) AS macro, round(sum(correct) / greatest(sum(n), 1)::DOUBLE, 9) AS micro, sum(n)::BIGINT AS n FROM a GROUP BY lang
"""


def suite_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over tasks; sources stand for tasks, and one hard task is missing."""
    names = F.array(*[F.lit(t) for t in (*evaluate.MAIN, "math500_high_level", *evaluate.DIAGNOSTIC)])
    rows = _graded(spark, sf_dir).withColumn("task", F.get(names, F.regexp_extract("source", r"(\d+)", 1).cast("int") % F.size(names)))
    out = evaluate.suite_means(evaluate.accuracy(rows, "task").select("task", F.col("accuracy").alias("value")))
    return out.select(*[F.round(c, 9).alias(c) if c.endswith("mean") else F.col(c) for c in out.columns])


_NAMES = (*evaluate.MAIN, "math500_high_level", *evaluate.DIAGNOSTIC)
_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
SUITE_SQL = f"""
WITH {_GRADED_SQL},
t AS (SELECT [{_quoted(_NAMES)}][regexp_extract(source, '(\\d+)', 1)::INT % {len(_NAMES)} + 1] AS task, passed FROM g),
m AS (SELECT task, count(*) FILTER (passed) / greatest(count(passed), 1)::DOUBLE AS v FROM t GROUP BY task)
SELECT round(avg(v) FILTER (task IN ({_quoted([x for x in evaluate.MAIN if x not in evaluate.UNSCORED])})), 9) AS main_scoreable_mean,
       NULL::DOUBLE AS hard_mean,
       CASE WHEN count(*) FILTER (task IN ({_quoted(evaluate.DIAGNOSTIC)})) = 3 THEN round(avg(v) FILTER (task IN ({_quoted(evaluate.DIAGNOSTIC)})), 9) END AS diagnostic_mean,
       round(avg(v) FILTER (task IN ({_quoted(evaluate.OVERALL)})), 9) AS scoreable_overall_mean,
       count(*) FILTER (task IN ({_quoted(evaluate.OVERALL)})) AS scoreable_dataset_count FROM m
"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    frac = F.least(F.floor(F.col("value")) / 16, F.lit(1.0))
    return e.select(
        (F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1).alias("step"), frac.alias("pass_frac"), (frac >= 1).cast("double").alias("passed"), (frac * 0.5).alias("score")
    )


_STEP_SQL = """
s AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) + 1 AS step, least(floor(value) / 16, 1.0) AS f FROM events),
m AS (SELECT step, avg(f) AS pass_frac, avg((f >= 1)::INT) AS passed, avg(f * 0.5) AS score, count(*) AS "rows" FROM s GROUP BY step)
"""


def best_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = select.best_step(_steps(spark, sf_dir))
    return out.select(F.col("step").cast("long"), *[F.round(c, 9).alias(c) for c in ("pass_frac", "passed", "score")], "rows")


BEST_SQL = f'WITH {_STEP_SQL} SELECT step, round(pass_frac, 9) AS pass_frac, round(passed, 9) AS passed, round(score, 9) AS score, "rows" FROM m ORDER BY m.pass_frac DESC, m.passed DESC, step DESC LIMIT 1'


def best_complete_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best among days with as many events as the median day."""
    steps = _steps(spark, sf_dir)
    most = steps.groupBy("step").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("days")).orderBy(F.desc("days"), F.desc("n")).first()
    out = select.best_complete_step(steps, most["n"] if most else 0)
    return out.select(F.col("step").cast("long"), *[F.round(c, 9).alias(c) for c in ("pass_frac", "passed", "score")], "rows")


COMPLETE_SQL = f"""
WITH {_STEP_SQL}, k AS (SELECT "rows" AS n FROM m GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)
SELECT step, round(pass_frac, 9) AS pass_frac, round(passed, 9) AS passed, round(score, 9) AS score, "rows" FROM m, k WHERE "rows" = k.n
ORDER BY m.passed DESC, m.score DESC, m.pass_frac DESC, step DESC LIMIT 1
"""


def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates on whole-number criteria, with whether each beats a baseline."""
    lines = table(spark, sf_dir, "lineitem")
    made = lines.groupBy("l_suppkey").agg(
        (F.count_if(F.col("l_returnflag") == "R") % 5).cast("double").alias("code_macro"),
        (F.count_if(F.col("l_linestatus") == "O") % 5).cast("double").alias("mixed_macro"),
        (F.count("*") % 4).cast("double").alias("pass_to_fail"),
        (F.sum("l_linenumber") % 4).cast("double").alias("fail_to_pass"),
        F.max("l_quantity").alias("mean_test_fraction"),
        F.min("l_quantity").alias("truncation"),
    )
    base = made.withColumns({f"base_{c}": F.lit(v) for c, v in (("code_macro", 3.0), ("mixed_macro", 2.0), ("mean_test_fraction", 50.0), ("truncation", 1.0))})
    return select.ranked_candidates(base, "l_suppkey").select("l_suppkey", "code_macro", "mixed_macro", "pass_to_fail", "fail_to_pass", select.beats().alias("beats"))


RANK_SQL = """
WITH m AS (SELECT l_suppkey, (count(*) FILTER (l_returnflag = 'R') % 5)::DOUBLE AS code_macro, (count(*) FILTER (l_linestatus = 'O') % 5)::DOUBLE AS mixed_macro,
  (count(*) % 4)::DOUBLE AS pass_to_fail, (sum(l_linenumber) % 4)::DOUBLE AS fail_to_pass, max(l_quantity) AS f, min(l_quantity) AS t FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, code_macro, mixed_macro, pass_to_fail, fail_to_pass,
  (code_macro, mixed_macro, -pass_to_fail, fail_to_pass, f, -t) > (3.0, 2.0, 0.0, 0.0, 50.0, -1.0) AS beats
FROM m ORDER BY code_macro DESC, mixed_macro DESC, pass_to_fail, fail_to_pass DESC, f DESC, t, l_suppkey
"""

def choice_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the largest scores among a line item's four figures."""
    lines = table(spark, sf_dir, "lineitem")
    scores = F.array(*[F.col(c) for c in ("l_discount", "l_tax", "l_discount", "l_tax")])
    return lines.select("l_orderkey", "l_linenumber", evaluate.best_choice(scores).cast("long").alias("choice"))


CHOICE_SQL = "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= l_tax THEN 0 ELSE 1 END::BIGINT AS choice FROM lineitem"


def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of prompts and answers after the budgeted cut to 512 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sequence(F.lit(1), F.col("n_chars").cast("int")).alias("p"), F.sequence(F.lit(1), (F.col("doc_id") % 900 + 1).cast("int")).alias("a"))
    cut = arrays.truncated("p", "a", 512)
    mask = arrays.label_mask(cut["prompt"], cut["answer"])
    return docs.select("doc_id", F.size(cut["prompt"]).cast("long").alias("n_prompt"), F.size(cut["answer"]).cast("long").alias("n_answer"), F.size(F.filter(mask, lambda x: x == -100)).cast("long").alias("n_masked"))


TRUNCATION_SQL = """
WITH l AS (SELECT doc_id, n_chars AS p, doc_id % 900 + 1 AS a FROM documents), b AS (SELECT *, greatest(256, least(a, 256)) AS budget FROM l),
c AS (SELECT doc_id, p, a, CASE WHEN p + a <= 512 THEN p ELSE least(p, 512 - budget) END AS n_prompt FROM b)
SELECT doc_id, n_prompt, CASE WHEN p + a <= 512 THEN a ELSE least(a, 512 - n_prompt) END AS n_answer, n_prompt AS n_masked FROM c
"""


def format_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.get(F.array(*[F.lit(x) for x in ("", "Here is the code: ", "```python\n", "x = ", "  ")]), (F.col("p_partkey") % 5).cast("int")), F.when(F.col("p_partkey") % 5 == 4, "").otherwise(F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", tx.format_ok(reply).alias("ok"))


FORMAT_SQL = "SELECT p_partkey, p_partkey % 5 IN (0, 3) AS ok FROM part"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' titles wrapped in replies with fences."""
    page = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"))
    first = F.concat(F.lit("Some prose\n```python\ndef "), name, F.lit("(x):\n    return x\n```\n"))
    second = F.concat(F.lit("```\ndef g(x):\n    return '"), F.regexp_replace("t", "['\\\\]", ""), F.lit("'\nthis is no code\n```\n"))
    reply = F.when(F.col("page_id") % 3 == 0, first).when(F.col("page_id") % 3 == 1, F.concat(first, second)).otherwise(F.concat(F.col("t"), F.lit("\nimport os\nprint(1)\n")))
    return page.select("page_id", name.alias("name"), reply.alias("reply"))


def fence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("page_id", F.size(tx.fences("reply")).cast("long").alias("n"))


FENCES_SQL = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS n FROM pages"


def code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reward's and the suite's reading of the same replies."""
    rows = _replies(spark, sf_dir)
    return rows.select("page_id", code.reward_code("reply").alias("reward_code"), code.suite_code("reply", name="name").alias("suite_code"))


#: The first fence's function is the one asked for; prose before code without a fence goes.
EXTRACT_SQL = """
WITH c AS (SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'def f' || page_id || '(x):' || chr(10) || '    return x' ELSE 'import os' || chr(10) || 'print(1)' END AS code FROM pages)
SELECT page_id, code AS reward_code, code AS suite_code FROM c
"""


def repair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of programs made of pages' titles, each with another fault."""
    page = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "['\\\\]", "").alias("t"))
    text = F.concat(F.lit("'"), F.col("t"), F.lit("'"))
    kinds = [
        F.concat(F.lit("```python\nprint("), text, F.lit(")\n```")),
        F.concat(F.lit("def main(n=0):\n    print("), text, F.lit(")")),
        F.concat(F.lit("for i in xrange(2):\n    print "), text),
        F.concat(F.lit("print("), text, F.lit(")")),
    ]
    program = F.get(F.array(*kinds), (F.col("page_id") % 4).cast("int"))
    rows = page.select("page_id", F.explode(code.repairs_udf(program)).alias("x"))
    return rows.select("page_id", "x.kind", "x.code")


REPAIR_SQL = """
WITH p AS (SELECT page_id, '''' || regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[''\\\\]', '', 'g') || '''' AS t FROM pages),
c AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'print(' || t || ')' WHEN 1 THEN 'def main(n=0):' || chr(10) || '    print(' || t || ')' || chr(10) || chr(10) || 'if __name__ == "__main__":' || chr(10) || '    main()' || chr(10)
  ELSE 'for i in range(2):' || chr(10) || '    print(' || t || ')' END AS code FROM p)
SELECT page_id, ['strip_markdown_fence', 'append_main', 'python2_to_python3'][page_id % 4 + 1] AS kind, code FROM c WHERE page_id % 4 < 3
"""


_IO = """CASE event_id % 6 WHEN 0 THEN '{"inputs": ["1"], "outputs": ["2"]}' WHEN 1 THEN '{"inputs": [[1]], "outputs": [[2]], "fn_name": "f"}' WHEN 2 THEN 'broken {'
 WHEN 3 THEN '{"inputs": ["1"], "outputs": []}' WHEN 4 THEN '[{"input": "a = 1", "output": "2"}]' ELSE '[]' END"""
_MODE = "CASE event_id % 6 WHEN 0 THEN 'stdin' WHEN 3 THEN 'stdin' ELSE 'function' END"
_STARTER = "CASE WHEN event_type = 'error' AND event_id % 6 = 0 THEN 'def f' ELSE ' ' END"


def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons against rows of every kind, the first one that holds."""
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 6 >= 4, "leetcode2k").otherwise("taco").alias("dataset"), F.expr(_MODE).alias("mode"), F.lit("f").alias("entry_point"),
        F.expr(_STARTER).alias("starter_code"), F.expr(_IO).alias("input_output"),
    )
    return rows.groupBy(F.coalesce(admission.structural_reason(), F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


ADMISSION_SQL = """
SELECT CASE event_id % 6 WHEN 0 THEN CASE WHEN event_type = 'error' THEN 'taco_pseudo_stdin_nonempty_starter' ELSE 'admitted' END WHEN 2 THEN 'invalid_input_output_json'
  WHEN 3 THEN 'taco_stdin_unaligned_io' WHEN 5 THEN 'no_normalized_tests' ELSE 'admitted' END AS reason, count(*) AS n FROM events GROUP BY 1
"""

QUERIES = {
    "reward_partial": reward_partial,
    "reward_strict": reward_strict,
    "status_rollup": status_rollup,
    "stopped_early": stopped_early,
    "accuracy_by_group": accuracy_by_group,
    "accuracy_macro": accuracy_macro,
    "suite_means": suite_means,
    "best_step": best_step,
    "best_complete_step": best_complete_step,
    "rank_candidates": rank_candidates,
    "choice_argmax": choice_argmax,
    "truncation": truncation,
    "format_checks": format_checks,
    "fence_counts": fence_counts,
    "code_extract": code_extract,
    "repair_candidates": repair_candidates,
    "admission_reasons": admission_reasons,
}
ORACLE_SQL = {
    "code_extract": EXTRACT_SQL,
    "reward_partial": PARTIAL_SQL,
    "reward_strict": STRICT_SQL,
    "status_rollup": STATUS_SQL,
    "stopped_early": STOPPED_SQL,
    "accuracy_by_group": ACCURACY_SQL,
    "accuracy_macro": MACRO_SQL,
    "suite_means": SUITE_SQL,
    "best_step": BEST_SQL,
    "best_complete_step": COMPLETE_SQL,
    "rank_candidates": RANK_SQL,
    "choice_argmax": CHOICE_SQL,
    "truncation": TRUNCATION_SQL,
    "format_checks": FORMAT_SQL,
    "fence_counts": FENCES_SQL,
    "repair_candidates": REPAIR_SQL,
    "admission_reasons": ADMISSION_SQL,
}
