"""Prompts, messages and records as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import filled
from ..functions.text import blank, col, first_filled, padded_id, strip
from ..functions.values import parse_list
from .classify import classified

# The instructions that prompts open with.
STDIN_TASK = (
    "Write a complete Python 3 program that solves the programming problem.\n"
    "Read input from standard input and write output to standard output.\n"
    "Return only valid Python code, with no explanation."
)
FUNCTION_TASK = (
    "Write a Python function named `%s` that solves the programming problem.\n"
    "Return only valid Python code, with no explanation."
)
PLAIN_TASK = "Write Python code that solves the programming problem.\nReturn only valid Python code, with no explanation."
ONLY_CODE = "Return only executable Python code, with no explanation or Markdown fences."
STDIN_CONTRACT = (
    "Write a complete Python 3 program that solves the programming problem.\n"
    "Read input from standard input and write only the required output to standard output.\n" + ONLY_CODE
)
CLASS_CONTRACT = (
    "Write a complete Python file defining `class Solution` with a callable method named `%s`.\n"
    "Do not read standard input or print diagnostics.\n" + ONLY_CODE
)
FUNCTION_CONTRACT = (
    "Write a complete Python file defining a top-level function named `%s`.\n"
    "Do not read standard input or print diagnostics.\n" + ONLY_CODE
)
SYSTEM = "You are a precise Python programming-problem solver."
INTERFACES = {
    "leetcode_function": "Interface contract:\n- Return a complete Python file that defines `class Solution`.\n"
    "- The grader executes the file and evaluates `%s`.\n- Do not read stdin or print diagnostics.",
    "taco_function": "Interface contract:\n- Return a complete Python file defining callable `%s`.\n"
    "- The grader imports the file and calls that function with positional arguments.\n- Do not read stdin or print diagnostics.",
    "taco_stdin": "Interface contract:\n- Return a complete standard-input Python 3 program.\n"
    "- Read from stdin and write only the required answer to stdout.\n- Handle multiple test cases when required by the statement.",
}
RL_HEAD = (
    "Solve the following coding problem.\n\nOutput only executable Python code. Markdown fences and short surrounding text\n"
    "are tolerated by the evaluator, but do not include local tests or diagnostics.\n\n"
)


def _joined(*parts: Column) -> Column:
    """Parts by line; a null part is left out."""
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def _starter(heading: str, fenced: bool = False) -> list[Column]:
    has = ~blank("starter_code")
    body = [F.lit("```python"), strip("starter_code"), F.lit("```")] if fenced else [F.col("starter_code")]
    return [F.when(has, x) for x in (F.lit(""), F.lit(heading), *body)]


def sft_prompt() -> Column:
    """Prompt of a problem row, by its source."""
    fn = F.try_variant_get(F.try_parse_json("input_output"), "$.fn_name", "string")
    named = F.coalesce(fn, F.lit("")) != ""
    task = F.when(named, F.format_string(FUNCTION_TASK, fn)).otherwise(STDIN_TASK)
    tail = [F.lit(""), F.lit("Python code:")]
    first = _joined(task, F.lit(""), F.lit("Problem:"), F.coalesce("question", F.lit("")), *_starter("Starter code:"), *tail)
    second = _joined(
        F.lit(PLAIN_TASK), F.lit(""), F.lit("Problem:"), first_filled("question", "name"), *_starter("Starter code and helper definitions:"), *tail
    )
    return F.when(F.col("dataset") == "leetcode2k", second).otherwise(first)


def messages(prompt: Column, answer: Column) -> Column:
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(say("user", prompt), say("assistant", answer))


def sft_records(rows: DataFrame, arm: Column, source_bucket: Column, removed: Column) -> DataFrame:
    """Training rows; the answer stands between line feeds."""
    answer = F.concat(F.lit("\n"), strip(F.coalesce("canonical_solution", F.lit(""))), F.lit("\n"))
    out = rows.withColumns({"prompt": sft_prompt(), "answer": answer, "arm": arm, "source_bucket": source_bucket, "removed_category": removed})
    names = "id arm source_bucket removed_category primary_category overlap_categories source difficulty name task_id tags raw_tags skill_types prompt answer"
    return out.select(F.coalesce("dataset", F.lit("taco")).alias("dataset"), *names.split(), messages(F.col("prompt"), F.col("answer")).alias("messages"))


def present(*columns: str) -> Column:
    """Map of the named columns that have a value, as text."""
    every = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))
    return F.map_filter(every, lambda k, v: v.isNotNull())


def as_text(*columns: str) -> Column:
    """struct of the columns, each as text."""
    return F.struct(*[F.col(c).cast("string").alias(c) for c in columns])


def verified_sft_records(rows: DataFrame, contract: Column, metadata: list[str]) -> DataFrame:
    """Training rows of verified solutions: contract, entry point, and what the verification has found.

    ``rows`` are admitted problems with ``status`` and ``repair_kind`` (null if the solution stands as it was).
    """
    answer = F.concat(F.lit("\n"), strip(F.coalesce("canonical_solution", F.lit(""))), F.lit("\n"))
    asked = rows.withColumns({"output_contract": contract, "prompt": contract_prompt(contract), "answer": answer})
    found = F.struct(
        F.col("status"), F.col("repair_kind").alias("repair"), F.col("repair_kind").isNotNull().alias("repaired"), F.size("tests").alias("test_count"), F.lit(True).alias("all_tests_passed")
    )
    return asked.select(
        "id", "dataset", "interface_kind", "output_contract", F.coalesce("entry_point", F.lit("")).alias("entry_point"), "prompt", "answer",
        messages(F.col("prompt"), F.col("answer")).alias("messages"), found.alias("verification"), present(*metadata).alias("metadata"),
    )


def usable(rows: DataFrame) -> DataFrame:
    """All rows with ``usable``: a solution, and a question or a name. Tagged once, split later."""
    return rows.withColumn("usable", ~blank("canonical_solution") & (~blank("question") | ~blank("name")))


def output_contract() -> Column:
    both = F.concat(F.coalesce("starter_code", F.lit("")), F.lit("\n"), F.coalesce("canonical_solution", F.lit("")))
    method = (F.col("interface_kind") == "leetcode_function") | both.rlike(r"\bclass\s+Solution\b")
    return F.when(F.col("interface_kind") == "taco_stdin", "stdin_program").when(method, "class_solution_method").otherwise("standalone_function")


def contract_prompt(contract: Column) -> Column:
    entry = strip(F.coalesce("entry_point", F.lit("")))
    task = (
        F.when(contract == "stdin_program", STDIN_CONTRACT)
        .when(contract == "class_solution_method", F.format_string(CLASS_CONTRACT, entry))
        .otherwise(F.format_string(FUNCTION_CONTRACT, entry))
    )
    return _joined(
        task, F.lit(""), F.lit("Problem:"), strip(first_filled("question", "name")), *_starter("Starter signature/imports:", fenced=True), F.lit(""), F.lit("Python code:")
    )


def rl_messages() -> Column:
    """System and user message of an admitted problem."""
    kind, entry = F.col("interface_kind"), F.coalesce("entry_point", F.lit(""))
    interface = F.when(kind == "taco_stdin", INTERFACES["taco_stdin"])
    for k in ("leetcode_function", "taco_function"):
        interface = interface.when(kind == k, F.format_string(INTERFACES[k], entry))
    starter = F.when(
        ~blank("starter_code"), F.concat(F.lit("\n\nStarter signature/imports:\n```python\n"), strip("starter_code"), F.lit("\n```"))
    ).otherwise("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    facts = F.concat(
        F.lit("\n\nDataset: "), text("dataset"), F.lit("\nDifficulty: "), text("difficulty"), F.lit("\nProblem id: "), text("id"),
        F.lit("\nVerifier test count: "), F.size("tests").cast("string"), F.lit("\n\nProblem statement:\n"), F.coalesce("question", F.lit("")), F.lit("\n"), starter, F.lit("\n"),
    )
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(say("system", F.lit(SYSTEM)), say("user", F.concat(F.lit(RL_HEAD), interface, facts)))


def rl_rows(rows: DataFrame, tokens: dict[str, str]) -> DataFrame:
    """RL rows of admitted problems; ``tokens`` names a token-count column for each model."""
    meta = F.struct(
        F.col("id").alias("problem_id"), "dataset", "difficulty", "mode", "interface_kind", "entry_point",
        F.coalesce("starter_code", F.lit("")).alias("starter_code"), F.transform("tests", F.try_parse_json).alias("tests"),
    )
    counts = F.create_map(*[x for k, c in tokens.items() for x in (F.lit(k), F.col(c).cast("int"))])
    most = F.array_max(F.map_values(counts))
    extra = F.struct(
        F.lit(None).cast("int").alias("index"), F.col("id").alias("problem_id"), F.col("dataset"), F.coalesce("difficulty", F.lit("")).alias("difficulty"),
        F.col("mode"), F.col("interface_kind"), F.size("tests").alias("test_count_used"), (F.col("preflight") == "canonical_full_pass").alias("canonical_verified"),
        counts.alias("prompt_tokens_by_model"), most.alias("prompt_tokens_max"),
    )
    return rows.select(
        rl_messages().alias("prompt"),
        F.concat_ws("_", F.lit("stage3"), "dataset", "interface_kind").alias("data_source"),
        F.lit("code").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.to_json(meta, {"ignoreNullFields": "false"}).alias("ground_truth")).alias("reward_model"),
        extra.alias("extra_info"),
    )


def with_index(rows: DataFrame, index: str) -> DataFrame:
    return rows.withColumn("extra_info", F.col("extra_info").withField("index", F.col(index).cast("int"))).drop(index)


def problems(raw: DataFrame, ordinal: str) -> DataFrame:
    """Raw corpus rows, numbered by ``ordinal``, as classified problems."""
    lists = {c: parse_list(F.col(c)) for c in ("raw_tags", "tags", "skill_types")}
    solutions = parse_list(F.col("solutions"))
    rows = raw.withColumns({**lists, "__solutions": solutions})
    tagged = classified(rows, "raw_tags", "tags", "skill_types")
    return tagged.select(
        padded_id("taco_train_", ordinal).alias("id"), F.lit("train").alias("source_split"), "source", "difficulty", "name", "url", "raw_tags", "tags",
        "skill_types", "all_normalized_tags", "overlap_categories", "primary_category", "question", "starter_code", "input_output",
        F.coalesce(F.get("__solutions", F.lit(0)), F.lit("")).alias("canonical_solution"), F.size("__solutions").cast("long").alias("num_solutions"),
        "time_limit", "memory_limit",
    )


def leetcode_problems(raw: DataFrame, ordinal: str, split: str) -> DataFrame:
    """Rows of the second source as problems; tags count in their exact case."""
    tags = filled("meta.tags")
    tagged = classified(raw.withColumn("tags", tags), "tags", exact_case=True)
    task = F.coalesce(F.nullif("task_id", F.lit("")), F.concat(F.lit("row-"), F.col(ordinal).cast("string")))
    return tagged.select(
        padded_id(f"leetcode_{split}_", ordinal).alias("id"), F.lit("leetcode2k").alias("dataset"), F.lit(split).alias("source_split"), F.lit("leetcode").alias("source"),
        F.upper(F.coalesce(F.nullif("meta.difficulty", F.lit("")), F.lit("UNKNOWN"))).alias("difficulty"), F.col("meta.question_title").alias("name"), task.alias("task_id"),
        F.concat(F.lit("https://leetcode.com/problems/"), task, F.lit("/")).alias("url"), F.col("tags").alias("raw_tags"), "tags", F.col("tags").alias("skill_types"),
        F.transform("tags", lambda t: F.lower(strip(t))).alias("all_normalized_tags"), "overlap_categories", "primary_category", F.col("query").alias("question"),
        F.col("prompt").alias("starter_code"), "input_output", F.col("completion").alias("canonical_solution"),
        F.when(F.coalesce("completion", F.lit("")) != "", 1).otherwise(0).cast("long").alias("num_solutions"), "entry_point", "test", "response",
        F.struct("meta.question_id", "meta.estimated_date", "meta.lang_code").alias("metadata"),
    )


INDEX = ("id", "dataset", "primary_category", "overlap_categories", "source", "difficulty", "tags", "raw_tags", "skill_types", "name", "task_id")


def index_of(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in INDEX])


def gsm8k(rows: DataFrame, ordinal: str) -> DataFrame:
    answer = F.replace(strip(F.substring_index("answer", "####", -1)), F.lit(","), F.lit(""))
    checked = F.when(F.contains("answer", F.lit("####")), answer).otherwise(F.raise_error(F.lit("a row has no final answer")).cast("string"))
    return rows.select(
        padded_id("gsm8k_", ordinal).alias("id"), "question", F.col("answer").alias("answer_cot"), checked.alias("answer"),
        F.lit("openai_gsm8k").alias("benchmark"), F.lit("test").alias("split"),
    )


def scienceqa(rows: DataFrame, ordinal: str) -> DataFrame:
    """Text-only rows; ids keep the place among all rows."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.filter("image IS NULL").select(
        padded_id("scienceqa_", ordinal).alias("id"), "question", "choices", F.col("answer").cast("int").alias("answer"),
        F.element_at("choices", F.col("answer").cast("int") + 1).alias("answer_text"), *map(empty, ("hint", "subject", "topic", "category", "skill")),
        F.lit("scienceqa_text_only").alias("benchmark"),
    )


def mbpp(rows: DataFrame, plus: bool) -> DataFrame:
    lists = [F.coalesce(F.col(c), F.expr("cast(array() as array<string>)")).alias(c) for c in ("test_imports", "test_list")]
    out = [F.col("task_id").cast("string").alias("id"), "task_id", "prompt", F.col("code").alias("canonical_solution"), *lists]
    return rows.select(*out, *([F.col("test").alias("plus_test")] if plus else []))


def levels(rows: DataFrame) -> DataFrame:
    """Level 3 is medium, 4 and above high; the others go."""
    level = F.coalesce(F.col("level").cast("int"), F.lit(0))
    return rows.withColumn("bucket", F.when(level == 3, "medium").when(level >= 4, "high")).filter("bucket IS NOT NULL")


def normal_messages(c: Column | str) -> Column:
    return F.transform(col(c), lambda m: F.struct(m["role"].cast("string").alias("role"), m["content"].cast("string").alias("content")))


def plain_chat(c: Column | str) -> Column:
    return F.array_join(F.transform(col(c), lambda m: m["content"]), "\n\n")


def fallback_chat(c: Column | str) -> Column:
    """``Role:`` blocks, then an open one for the assistant."""
    role = lambda m: F.coalesce(m["role"], F.lit("user"))
    block = lambda m: F.concat(F.upper(F.substring(role(m), 1, 1)), F.lower(F.substring(role(m), 2, 1 << 30)), F.lit(":\n"), F.coalesce(m["content"], F.lit("")))
    return F.concat_ws("\n\n", F.array_join(F.transform(col(c), block), "\n\n"), F.lit("Assistant:\n"))


def lettered(choices: Column | str) -> Column:
    """``A. first`` and so on, by line."""
    return F.array_join(F.transform(col(choices), lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c)), "\n")


def labelled(labels: Column | str, texts: Column | str) -> Column:
    return F.array_join(F.zip_with(col(labels), col(texts), lambda a, b: F.concat(a, F.lit(". "), b)), "\n")


def arc_prompt() -> Column:
    return F.concat(F.lit("Answer this science question.\n\n"), F.col("question"), F.lit("\n"), labelled("choice_labels", "choice_texts"), F.lit("\n\nAnswer:"))


def scienceqa_prompt() -> Column:
    hint = F.when(F.coalesce("hint", F.lit("")) != "", F.concat(F.lit("\nHint: "), "hint")).otherwise("")
    return F.concat(F.lit("Answer the science question."), hint, F.lit("\n\n"), F.col("question"), F.lit("\n"), lettered("choices"), F.lit("\n\nAnswer:"))


def gsm8k_prompt(shots: str) -> Column:
    return F.concat(F.lit("Solve the problem step by step and end with 'The answer is N.'\n\n" + shots + "Q: "), F.col("question"), F.lit("\nA:"))


def math_prompt() -> Column:
    return F.concat(F.lit("Solve the math problem. Put the final answer in \\boxed{}.\n\nProblem: "), F.col("problem"))


def humaneval_prompt() -> Column:
    return F.concat(F.lit("Complete the Python function. Output only executable Python code.\n\n"), F.col("prompt"))


def apps_prompt() -> Column:
    return F.concat(F.lit(STDIN_TASK + "\n\nProblem:\n"), F.col("prompt"), F.lit("\n\nPython code:\n"))


def mbpp_prompt(entry: Column) -> Column:
    """``entry`` names the function under test, null if unknown."""
    hint = F.coalesce(F.concat(F.lit(" Implement the function named `"), entry, F.lit("`.")), F.lit(""))
    return F.concat(
        F.lit("Write a complete Python function for the task below."), hint, F.lit(" Output only executable Python code.\n\nTask: "), F.col("prompt"),
        F.lit("\n\nThe solution must pass these tests:\n"), F.array_join("test_list", "\n"), F.lit("\n\nPython code:\n"),
    )


def mmlu_prompt() -> Column:
    return F.concat(
        F.lit("Answer the following multiple-choice mathematics question ("), F.replace("subject", F.lit("_"), F.lit(" ")), F.lit(").\n\nQuestion: "),
        F.col("question"), F.lit("\n"), lettered("choices"), F.lit("\n\nAnswer with only A, B, C, or D.\nAnswer:"),
    )


def health_rows(rows: DataFrame, professional: bool) -> DataFrame:
    """(id, messages, rubrics) of two source shapes."""
    if not professional:
        return rows.select(F.col("prompt_id").cast("string").alias("id"), normal_messages("prompt").alias("messages"), "rubrics")
    rubric = lambda r: F.struct(r["criterion_text"].alias("criterion"), r["points"].alias("points"), F.expr("cast(array() as array<string>)").alias("tags"))
    return rows.select(F.col("id").cast("string").alias("id"), normal_messages("conversation.messages").alias("messages"), F.transform("rubric_items", rubric).alias("rubrics"))


def dual_export(rl: DataFrame, sft: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """SFT and RL rows of one join, in which every RL row must have its SFT source."""
    from .joins import enriched_or_raise

    both = enriched_or_raise(rl, sft, key, "export")
    return both.select(key, "messages", "extra_info"), both.select(key, "prompt", "data_source", "ability", "reward_model", "extra_info")


def extra_info(c: str, index: Column) -> Column:
    """Twelve typed fields, the first of them the new index."""
    text = "problem_id original_question_id source_dataset subset style difficulty entry_point".split()
    get = lambda n: F.col(f"{c}.{n}")
    return F.struct(
        index.cast("long").alias("index"), *[get(n).cast("string").alias(n) for n in text], get("test_count_used").cast("long").alias("test_count_used"),
        F.coalesce(get("test_modules"), F.expr("cast(array() as array<string>)")).alias("test_modules"),
        get("test_code_repaired").cast("boolean").alias("test_code_repaired"), get("source_full_execution_verified").cast("boolean").alias("source_full_execution_verified"),
    )
