"""Queries over projections: problems, prompts, training and RL rows, benchmark rows.

Parts, pages and conversations stand for the raw rows; texts are made of their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission, classify, joins, prompts
from ..session import table

_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_null = lambda kind="string": F.lit(None).cast(kind)
_NL = "chr(10)"


def _cycle(key: str, *values: Column | str) -> Column:
    """One of the values by key."""
    return F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in values]), (F.col(key) % len(values)).cast("int"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw problems: lists are Python or JSON texts, solutions may be missing."""
    q = F.lit("'")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("Find "), F.col("p_name"), F.lit(".")).alias("question"), "p_size",
        _cycle("p_partkey", F.concat(F.lit("["), q, F.lit("print("), F.col("p_size"), F.lit(")"), q, F.lit(", "), q, F.lit("x"), q, F.lit("]")), F.concat(F.lit('["'), F.col("p_brand"), F.lit('"]')), "[]", "no list").alias("solutions"),
        _cycle("p_partkey", "", "def f(x):", " ").alias("starter_code"),
        _cycle("p_partkey", "{}", '{"fn_name": "solve", "inputs": [], "outputs": []}').alias("input_output"),
        _cycle("p_size", "EASY", "HARD").alias("difficulty"), _cycle("p_size", "['DP ', 'graphs']", "[]", "['geometry']").alias("raw_tags"), F.col("p_name").alias("name"),
        F.lit("src").alias("source"), _cycle("p_partkey", "['math']", "[]").alias("tags"), F.lit("[]").alias("skill_types"), F.lit("u").alias("url"), _null().alias("time_limit"), _null().alias("memory_limit"),
    )


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.problems(_raw(spark, sf_dir), "ord")


#: The same problems in SQL: solution lists by kind, tags by priority.
_PROBLEM_SQL = """
p AS (SELECT p_partkey AS ord, 'taco_train_' || lpad(p_partkey::VARCHAR, greatest(5, length(p_partkey::VARCHAR))::INT, '0') AS id, 'Find ' || p_name || '.' AS question, p_name AS name,
  ['print(' || p_size || ')', p_brand, '', ''][p_partkey % 4 + 1] AS canonical_solution, [2, 1, 0, 0][p_partkey % 4 + 1]::BIGINT AS num_solutions,
  ['', 'def f(x):', ' '][p_partkey % 3 + 1] AS starter_code, p_partkey % 2 = 1 AS named, ['EASY', 'HARD'][p_size % 2 + 1] AS difficulty,
  list_concat([['graph', 'dynamic_programming'], [], ['geometry']][p_size % 3 + 1], []) AS a, CASE WHEN p_partkey % 2 = 0 THEN ['math_number_theory'] ELSE [] END AS b FROM part),
o AS (SELECT *, list_filter(['graph', 'dynamic_programming', 'math_number_theory', 'geometry'], lambda c: list_contains(list_concat(a, b), c)) AS overlap FROM p),
problems AS (SELECT *, coalesce(overlap[1], 'no_tags') AS primary_category FROM o)
"""


def problem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows as problems: ids, first solutions, classified tags."""
    return _problems(spark, sf_dir).select(
        "id", "question", "difficulty", "canonical_solution", "num_solutions", F.array_join("overlap_categories", ",").alias("overlap"), "primary_category", F.size("all_normalized_tags").cast("long").alias("n_tags")
    )


PROBLEM_ROWS_SQL = f"""
WITH {_PROBLEM_SQL} SELECT id, question, difficulty, canonical_solution, num_solutions, array_to_string(overlap, ',') AS overlap, primary_category, (len(a) + len(b))::BIGINT AS n_tags FROM problems
"""


def second_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the second source and their index, tags in exact case."""
    tags = F.array(_cycle("p_size", "Array", "array", "Trie"), _cycle("p_partkey", "Dynamic Programming", "Graph"))
    meta = F.struct(tags.alias("tags"), _cycle("p_size", "Easy", "").alias("difficulty"), F.col("p_name").alias("question_title"), F.lit("1").alias("question_id"), _null().alias("estimated_date"), F.lit("x").alias("lang_code"))
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), _cycle("p_partkey", F.concat(F.lit("t"), F.col("p_partkey")), "", _null()).alias("task_id"), F.col("p_name").alias("query"), F.col("p_brand").alias("prompt"),
        _cycle("p_size", F.col("p_type"), "").alias("completion"), F.lit("[]").alias("input_output"), F.lit("f").alias("entry_point"), F.lit("t").alias("test"), F.lit("r").alias("response"), meta.alias("meta"),
    )
    rows = prompts.leetcode_problems(raw, "ord", "test")
    index = prompts.index_of(rows)
    return rows.select("id", "difficulty", "url", "num_solutions", F.array_join("overlap_categories", ",").alias("overlap"), "metadata.question_id").join(index.select("id", "name", "task_id", "dataset", "primary_category"), "id")


SECOND_SQL = """
WITH p AS (SELECT *, ['t' || p_partkey, 'row-' || p_partkey, 'row-' || p_partkey][p_partkey % 3 + 1] AS task,
  list_filter(['graph', 'dynamic_programming', 'data_structure'], lambda c: c = CASE p_partkey % 2 WHEN 0 THEN 'dynamic_programming' ELSE 'graph' END OR c = 'data_structure' AND p_size % 3 <> 1) AS o FROM part)
SELECT 'leetcode_test_' || lpad(p_partkey::VARCHAR, greatest(5, length(p_partkey::VARCHAR))::INT, '0') AS id, ['EASY', 'UNKNOWN'][p_size % 2 + 1] AS difficulty, 'https://leetcode.com/problems/' || task || '/' AS url,
  CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS num_solutions, array_to_string(o, ',') AS overlap, '1' AS question_id, p_name AS name, task AS task_id, 'leetcode2k' AS dataset, o[1] AS primary_category FROM p
"""


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _problems(spark, sf_dir).withColumns({"dataset": F.lit("taco"), "task_id": _null()})


_HEAD = f"CASE WHEN named THEN {_quoted(prompts.FUNCTION_TASK % 'solve')} ELSE {_quoted(prompts.STDIN_TASK)} END"
_START = f"CASE WHEN trim(starter_code) <> '' THEN {_NL} || {_NL} || 'Starter code:' || {_NL} || starter_code ELSE '' END"
_SFT_SQL = f"{_HEAD} || {_NL} || {_NL} || 'Problem:' || {_NL} || question || {_START} || {_NL} || {_NL} || 'Python code:'"
_BUCKET_SQL = f"CASE WHEN primary_category IN ({', '.join(map(_quoted, (*classify.CORE_BUCKETS, 'no_tags')))}) THEN primary_category ELSE 'other_algorithm' END"


def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable problems as training rows: prompt, answer between line feeds, two messages."""
    rows = prompts.usable(_sourced(spark, sf_dir)).filter("usable")
    out = prompts.sft_records(rows, F.lit("full"), classify.bucket("primary_category"), _null())
    return out.select("id", "arm", "source_bucket", "prompt", "answer", F.size("messages").cast("long").alias("n_messages"), F.get("messages", F.lit(1))["content"].alias("said"))


SFT_ROWS_SQL = f"""
WITH {_PROBLEM_SQL} SELECT id, 'full' AS arm, {_BUCKET_SQL} AS source_bucket, {_SFT_SQL} AS prompt, {_NL} || canonical_solution || {_NL} AS answer, 2::BIGINT AS n_messages, {_NL} || canonical_solution || {_NL} AS said
FROM problems WHERE canonical_solution <> ''
"""


def second_source_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _problems(spark, sf_dir).withColumns({"dataset": F.lit("leetcode2k"), "question": F.when(F.col("num_solutions") > 0, F.col("question"))})
    return rows.select("id", prompts.sft_prompt().alias("prompt"))


SECOND_PROMPT_SQL = f"""
WITH {_PROBLEM_SQL} SELECT id, {_quoted(prompts.PLAIN_TASK)} || {_NL} || {_NL} || 'Problem:' || {_NL} || CASE WHEN num_solutions > 0 THEN question ELSE name END
  || CASE WHEN trim(starter_code) <> '' THEN {_NL} || {_NL} || 'Starter code and helper definitions:' || {_NL} || starter_code ELSE '' END || {_NL} || {_NL} || 'Python code:' AS prompt FROM problems
"""


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted problems of every interface, with their token counts."""
    tests = F.array(F.concat(F.lit('{"input":"'), F.col("p_size"), F.lit('","output":"1"}')))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), _cycle("p_partkey", "taco", "leetcode2k").alias("dataset"), _cycle("p_partkey", "EASY", _null()).alias("difficulty"), F.lit("function").alias("mode"),
        _cycle("p_partkey", "taco_stdin", "leetcode_function", "taco_function").alias("interface_kind"), F.lit("solve").alias("entry_point"), _cycle("p_size", "", " import os ").alias("starter_code"),
        F.concat(F.lit("Find "), F.col("p_name")).alias("question"), F.col("p_name").alias("name"), _cycle("p_partkey", "class Solution:", "x = 1", "y").alias("canonical_solution"), tests.alias("tests"),
        _cycle("p_partkey", "canonical_full_pass", "other").alias("preflight"), F.col("p_size").alias("t1"), (F.col("p_size") * 2 % 31).alias("t2"),
    )


_KIND_SQL = "['taco_stdin', 'leetcode_function', 'taco_function'][p_partkey % 3 + 1]"
_CONTRACT_SQL = "CASE p_partkey % 3 WHEN 0 THEN 'stdin_program' WHEN 1 THEN 'class_solution_method' ELSE 'standalone_function' END"


def contract_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _admitted(spark, sf_dir).withColumn("contract", prompts.output_contract())
    return rows.select("id", "contract", prompts.contract_prompt(F.col("contract")).alias("prompt"))


CONTRACT_SQL = f"""
SELECT 'p' || p_partkey AS id, {_CONTRACT_SQL} AS contract,
  CASE p_partkey % 3 WHEN 0 THEN {_quoted(prompts.STDIN_CONTRACT)} WHEN 1 THEN {_quoted(prompts.CLASS_CONTRACT % 'solve')} ELSE {_quoted(prompts.FUNCTION_CONTRACT % 'solve')} END
  || {_NL} || {_NL} || 'Problem:' || {_NL} || 'Find ' || p_name
  || CASE WHEN p_size % 2 = 1 THEN {_NL} || {_NL} || 'Starter signature/imports:' || {_NL} || '```python' || {_NL} || 'import os' || {_NL} || '```' ELSE '' END || {_NL} || {_NL} || 'Python code:' AS prompt FROM part
"""


def rl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RL rows within the length cap: messages, truth as JSON, token counts."""
    kept = _admitted(spark, sf_dir).filter(~admission.over_length(["t1", "t2"], 45))
    out = prompts.with_index(prompts.rl_rows(kept, {"m1": "t1", "m2": "t2"}).withColumn("at", F.col("extra_info.prompt_tokens_max")), "at")
    truth = F.col("reward_model.ground_truth")
    return out.select(
        F.col("extra_info.problem_id").alias("id"), "data_source", F.get("prompt", F.lit(0))["content"].alias("system"), F.get("prompt", F.lit(1))["content"].alias("user"),
        F.get_json_object(truth, "$.tests[0].input").alias("input"), F.get_json_object(truth, "$.starter_code").alias("starter"), "extra_info.canonical_verified",
        F.col("extra_info.prompt_tokens_max").cast("long").alias("most"), F.col("extra_info.index").cast("long").alias("at"), F.col("extra_info.difficulty").alias("difficulty"),
    )


_RL_KIND = " ".join(f"WHEN '{k}' THEN {_quoted(v % 'solve' if '%s' in v else v)}" for k, v in prompts.INTERFACES.items())
RL_SQL = f"""
WITH r AS (SELECT *, {_KIND_SQL} AS kind, ['taco', 'leetcode2k'][p_partkey % 2 + 1] AS dataset, greatest(p_size, p_size * 2 % 31) AS most FROM part)
SELECT 'p' || p_partkey AS id, 'stage3_' || dataset || '_' || kind AS data_source, {_quoted(prompts.SYSTEM)} AS system,
  {_quoted(prompts.RL_HEAD)} || CASE kind {_RL_KIND} END || {_NL} || {_NL} || 'Dataset: ' || dataset || {_NL} || 'Difficulty: ' || CASE WHEN p_partkey % 2 = 0 THEN 'EASY' ELSE 'None' END || {_NL} || 'Problem id: p' || p_partkey
  || {_NL} || 'Verifier test count: 1' || {_NL} || {_NL} || 'Problem statement:' || {_NL} || 'Find ' || p_name || {_NL}
  || CASE WHEN p_size % 2 = 1 THEN {_NL} || {_NL} || 'Starter signature/imports:' || {_NL} || '```python' || {_NL} || 'import os' || {_NL} || '```' ELSE '' END || {_NL} AS "user",
  p_size::VARCHAR AS input, CASE WHEN p_size % 2 = 1 THEN ' import os ' ELSE '' END AS starter, p_partkey % 2 = 0 AS canonical_verified, most::BIGINT AS most, most::BIGINT AS "at",
  CASE WHEN p_partkey % 2 = 0 THEN 'EASY' ELSE '' END AS difficulty FROM r WHERE most <= 45
"""


def dual_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SFT and RL rows of one join, which every RL row must have."""
    rl = prompts.rl_rows(_admitted(spark, sf_dir), {"m": "t1"}).withColumn("id", F.col("extra_info.problem_id")).withColumnRenamed("prompt", "asked")
    sft = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.array(F.struct(F.lit("user").alias("role"), F.col("p_name").alias("content"))).alias("messages"))
    a, b = prompts.dual_export(rl.withColumnRenamed("asked", "prompt"), sft, "id")
    return a.select("id", F.get("messages", F.lit(0))["content"].alias("said")).join(b.select("id", F.size("prompt").cast("long").alias("n_prompt"), "ability"), "id")


DUAL_SQL = "SELECT 'p' || p_partkey AS id, p_name AS said, 2::BIGINT AS n_prompt, 'code' AS ability FROM part"


def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and extra information as typed fields, a new index within the table, four fields as text."""
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    info = F.struct(
        F.col("conv_id").alias("problem_id"), F.lit(3).alias("original_question_id"), F.col("role").alias("source_dataset"), _null().alias("subset"), F.lit("s").alias("style"), F.lit(1.5).alias("difficulty"),
        F.lit("f").alias("entry_point"), F.col("turn").cast("string").alias("test_count_used"), _null("array<string>").alias("test_modules"), F.lit("true").alias("test_code_repaired"), F.lit(0).alias("source_full_execution_verified"),
    )
    rows = turns.withColumns({"info": info, "said": F.array(F.struct(F.col("role"), F.col("text").alias("content"), F.lit(1).alias("extra")))})
    typed = rows.select("id", prompts.normal_messages("said").alias("m"), prompts.extra_info("info", F.col("id") + 1).alias("x"), prompts.as_text("conv_id", "turn", "role", "text").alias("t"))
    return typed.select(
        "id", F.get("m", F.lit(0))["content"].alias("content"), "x.index", "x.problem_id", "x.original_question_id", "x.test_count_used", F.size("x.test_modules").cast("long").alias("modules"),
        "x.test_code_repaired", "x.source_full_execution_verified", F.col("t.turn").alias("turn_text"), F.col("t.conv_id").alias("conv_text"),
    )


TYPED_SQL = """
SELECT conv_id * 1000 + turn AS id, text AS content, conv_id * 1000 + turn + 1 AS "index", conv_id::VARCHAR AS problem_id, '3' AS original_question_id, turn::BIGINT AS test_count_used, 0::BIGINT AS modules,
  true AS test_code_repaired, false AS source_full_execution_verified, turn::VARCHAR AS turn_text, conv_id::VARCHAR AS conv_text FROM conversations
"""


def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows of five shapes with their prompts, made of parts."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    gsm = prompts.gsm8k(p.select("p_partkey", F.col("p_name").alias("question"), F.concat(F.lit("so\n#### "), F.col("p_size"), F.lit(",000 ")).alias("answer")), "p_partkey")
    science = prompts.scienceqa(
        p.select(
            "p_partkey", F.col("p_name").alias("question"), words.alias("choices"), (F.col("p_partkey") % 2).alias("answer"), _cycle("p_size", "look", _null()).alias("hint"), _null().alias("subject"),
            _null().alias("topic"), _null().alias("category"), _null().alias("skill"), F.when(F.col("p_partkey") % 5 == 0, "png").alias("image"),
        ), "p_partkey",
    )
    mbpp = prompts.mbpp(
        p.select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("prompt"), F.lit("code").alias("code"), _null("array<string>").alias("test_imports"), F.array(F.lit("assert f(1)"), F.lit("assert f(2)")).alias("test_list"), F.lit("plus").alias("test")), True
    )
    levels = prompts.levels(p.select("p_partkey", F.col("p_name").alias("problem"), (F.col("p_size") % 6).alias("level")))
    arc = p.select("p_partkey", F.col("p_name").alias("question"), F.array(F.lit("A"), F.lit("B")).alias("choice_labels"), F.slice(words, 1, 2).alias("choice_texts"))
    mmlu = p.select("p_partkey", F.lit("college_mathematics").alias("subject"), F.col("p_name").alias("question"), F.slice(words, 1, 2).alias("choices"))
    row = lambda df, task, key, prompt, extra: df.select(F.lit(task).alias("task"), key.cast("string").alias("key"), prompt.alias("prompt"), extra.cast("string").alias("extra"))
    parts = [
        row(gsm, "gsm8k", F.col("id"), prompts.gsm8k_prompt("Q: 1\nA: 1\n\n"), F.col("answer")),
        row(science, "scienceqa", F.col("id"), prompts.scienceqa_prompt(), F.col("answer_text")),
        row(mbpp, "mbpp", F.col("id"), prompts.mbpp_prompt(F.when(F.col("task_id") % 2 == 0, "f")), F.concat("plus_test", F.size("test_imports"))),
        row(levels, "math", F.col("p_partkey"), prompts.math_prompt(), F.col("bucket")),
        row(arc, "arc", F.col("p_partkey"), prompts.arc_prompt(), _null()),
        row(mmlu, "mmlu", F.col("p_partkey"), prompts.mmlu_prompt(), _null()),
        row(p.withColumn("prompt", F.col("p_name")), "humaneval", F.col("p_partkey"), prompts.humaneval_prompt(), _null()),
        row(p.withColumn("prompt", F.col("p_name")), "apps", F.col("p_partkey"), prompts.apps_prompt(), _null()),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


_pad = lambda prefix: f"'{prefix}' || lpad(p_partkey::VARCHAR, greatest(5, length(p_partkey::VARCHAR))::INT, '0')"
BENCHMARK_SQL = f"""
WITH w AS (SELECT *, string_split(p_name, ' ') AS w, chr(10) AS n FROM part),
l AS (SELECT *, array_to_string(list_transform(range(len(w)), lambda i: chr((65 + i)::INT) || '. ' || w[i + 1]), chr(10)) AS lettered, 'A. ' || w[1] || n || 'B. ' || w[2] AS two FROM w)
SELECT 'gsm8k' AS task, {_pad("gsm8k_")} AS key, 'Solve the problem step by step and end with ''The answer is N.''' || n || n || 'Q: 1' || n || 'A: 1' || n || n || 'Q: ' || p_name || n || 'A:' AS prompt, (p_size || '000') AS extra FROM l
UNION ALL SELECT 'scienceqa', {_pad("scienceqa_")}, 'Answer the science question.' || CASE WHEN p_size % 2 = 0 THEN n || 'Hint: look' ELSE '' END || n || n || p_name || n || lettered || n || n || 'Answer:', w[p_partkey % 2 + 1] FROM l WHERE p_partkey % 5 <> 0
UNION ALL SELECT 'mbpp', p_partkey::VARCHAR, 'Write a complete Python function for the task below.' || CASE WHEN p_partkey % 2 = 0 THEN ' Implement the function named `f`.' ELSE '' END || ' Output only executable Python code.' || n || n || 'Task: ' || p_name
  || n || n || 'The solution must pass these tests:' || n || 'assert f(1)' || n || 'assert f(2)' || n || n || 'Python code:' || n, 'plus0' FROM l
UNION ALL SELECT 'math', p_partkey::VARCHAR, 'Solve the math problem. Put the final answer in \\boxed{{}}.' || n || n || 'Problem: ' || p_name, CASE WHEN p_size % 6 = 3 THEN 'medium' ELSE 'high' END FROM l WHERE p_size % 6 >= 3
UNION ALL SELECT 'arc', p_partkey::VARCHAR, 'Answer this science question.' || n || n || p_name || n || two || n || n || 'Answer:', NULL FROM l
UNION ALL SELECT 'mmlu', p_partkey::VARCHAR, 'Answer the following multiple-choice mathematics question (college mathematics).' || n || n || 'Question: ' || p_name || n || two || n || n || 'Answer with only A, B, C, or D.' || n || 'Answer:', NULL FROM l
UNION ALL SELECT 'humaneval', p_partkey::VARCHAR, 'Complete the Python function. Output only executable Python code.' || n || n || p_name, NULL FROM l
UNION ALL SELECT 'apps', p_partkey::VARCHAR, {_quoted(prompts.STDIN_TASK)} || n || n || 'Problem:' || n || p_name || n || n || 'Python code:' || n, NULL FROM l
"""


def health_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two source shapes of rubric rows as one."""
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("p_name").alias("content")))
    base = table(spark, sf_dir, "part").withColumn("said", said)
    plain = base.select(F.col("p_partkey").alias("prompt_id"), F.col("said").alias("prompt"), F.array(F.struct(F.col("p_type").alias("criterion"), F.col("p_size").alias("points"), F.array(F.lit("t")).alias("tags"))).alias("rubrics"))
    items = F.array(F.struct(F.col("p_type").alias("criterion_text"), F.col("p_size").alias("points")))
    professional = base.select((-F.col("p_partkey")).alias("id"), F.struct(F.col("said").alias("messages")).alias("conversation"), items.alias("rubric_items"))
    both = prompts.health_rows(plain, False).union(prompts.health_rows(professional, True))
    first = F.get("rubrics", F.lit(0))
    return both.select("id", F.get("messages", F.lit(0))["content"].alias("asked"), first["criterion"].alias("criterion"), first["points"].cast("long").alias("points"), F.size(first["tags"]).cast("long").alias("n_tags"))


HEALTH_SQL = """
SELECT p_partkey::VARCHAR AS id, p_name AS asked, p_type AS criterion, p_size::BIGINT AS points, 1::BIGINT AS n_tags FROM part
UNION ALL SELECT (-p_partkey)::VARCHAR, p_name, p_type, p_size::BIGINT, 0::BIGINT FROM part
"""


def verified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with what is known of their verification, metadata where it is present."""
    rows = _admitted(spark, sf_dir).withColumns({"contract": prompts.output_contract(), "status": _cycle("t1", "kept_verified", "repaired_verified"), "url": _cycle("t1", "u", _null()), "repair_kind": _cycle("t1", _null(), "append_main")})
    out = prompts.verified_sft_records(rows, F.col("contract"), ["url", "difficulty"])
    return out.select(
        "id", "output_contract", "entry_point", F.get("messages", F.lit(1))["content"].alias("said"), "verification.status", "verification.repair", F.col("verification.test_count").cast("long").alias("tests"),
        F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("known"),
    )


VERIFIED_SQL = f"""
SELECT 'p' || p_partkey AS id, {_CONTRACT_SQL} AS output_contract, 'solve' AS entry_point, chr(10) || ['class Solution:', 'x = 1', 'y'][p_partkey % 3 + 1] || chr(10) AS said,
  ['kept_verified', 'repaired_verified'][p_size % 2 + 1] AS status, CASE WHEN p_size % 2 = 1 THEN 'append_main' END AS repair, 1::BIGINT AS tests,
  array_to_string(list_concat(CASE WHEN p_partkey % 2 = 0 THEN ['difficulty'] ELSE [] END, CASE WHEN p_size % 2 = 0 THEN ['url'] ELSE [] END), ',') AS known FROM part
"""


def partition_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources united category by category."""
    first, second = _sourced(spark, sf_dir).select("id", "primary_category", "dataset"), _admitted(spark, sf_dir).select("id", F.lit("graph").alias("primary_category"), "dataset")
    return joins.united_by(first, second, "primary_category").groupBy("primary_category", "dataset").agg(F.count("*").alias("n"))


UNION_SQL = f"""
WITH {_PROBLEM_SQL} SELECT primary_category, 'taco' AS dataset, count(*) + coalesce(max((SELECT count(*) FROM part WHERE p_partkey % 2 = 0)) FILTER (primary_category = 'graph'), 0) AS n FROM problems GROUP BY 1
UNION ALL SELECT 'graph', 'leetcode2k', count(*) FROM part WHERE p_partkey % 2 = 1
"""

QUERIES = {
    "problem_rows": problem_rows,
    "second_source_rows": second_source_rows,
    "sft_rows": sft_rows,
    "second_source_prompts": second_source_prompts,
    "contract_prompts": contract_prompts,
    "rl_rows": rl_rows,
    "dual_export": dual_export,
    "typed_records": typed_records,
    "benchmark_rows": benchmark_rows,
    "health_rows": health_rows,
    "verified_records": verified_records,
    "partition_union": partition_union,
}
ORACLE_SQL = {
    "problem_rows": PROBLEM_ROWS_SQL,
    "second_source_rows": SECOND_SQL,
    "sft_rows": SFT_ROWS_SQL,
    "second_source_prompts": SECOND_PROMPT_SQL,
    "contract_prompts": CONTRACT_SQL,
    "rl_rows": RL_SQL,
    "dual_export": DUAL_SQL,
    "typed_records": TYPED_SQL,
    "benchmark_rows": BENCHMARK_SQL,
    "health_rows": HEALTH_SQL,
    "verified_records": VERIFIED_SQL,
    "partition_union": UNION_SQL,
}
