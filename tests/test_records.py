"""Raw rows to problems, prompts, RL rows and benchmark rows."""

import json

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import joins, prompts


def test_problems(spark):
    raw = spark.createDataFrame(
        [("q", "['print(1)', 'x']", "", "{}", "EASY", "['DP ', 'graphs']", None, "src", "[]", "not a list", "u", None, None)], schemas.PROBLEM_RAW
    ).withColumn("ord", F.lit(7))
    row = prompts.problems(raw, "ord").first()
    assert (row["id"], row["primary_category"], row["canonical_solution"], row["num_solutions"]) == ("taco_train_00007", "graph", "print(1)", 2)
    assert row["raw_tags"] == ["DP ", "graphs"] and row["skill_types"] == [] and row["all_normalized_tags"] == ["dp", "graphs"]


def test_second_source(spark):
    meta = {"tags": ["Array", "Trie"], "difficulty": "Easy", "question_title": "T", "question_id": "1", "estimated_date": None, "lang_code": "x"}
    raw = spark.createDataFrame(
        [("two-sum", "q", "class Solution:", "code", "[]", "f", "t", "r", meta), (None, "q", "p", None, "[]", "f", "t", "r", None)], schemas.LEETCODE_RAW
    ).withColumn("ord", F.monotonically_increasing_id() * 0 + F.when(F.col("task_id").isNull(), 1).otherwise(0))
    a, b = prompts.leetcode_problems(raw, "ord", "test").orderBy("id").collect()
    assert (a["id"], a["difficulty"], a["url"], a["overlap_categories"]) == ("leetcode_test_00000", "EASY", "https://leetcode.com/problems/two-sum/", ["data_structure"])
    assert (b["task_id"], b["difficulty"], b["primary_category"], b["num_solutions"]) == ("row-1", "UNKNOWN", "no_tags", 0)
    index = prompts.index_of(prompts.leetcode_problems(raw, "ord", "test"))
    assert index.columns == list(prompts.INDEX)
    both = joins.fused(index.drop("dataset"), index, {"dataset": "taco"})
    assert {r["dataset"] for r in both.collect()} == {"taco", "leetcode2k"}


def admitted(spark, kind="taco_function", starter="import os"):
    return spark.createDataFrame(
        [("p1", "taco", None, "function", kind, "f", starter, "Add.", ['{"args":[1],"output":2}'], "canonical_full_pass", 10, 12, "code")],
        "id string, dataset string, difficulty string, mode string, interface_kind string, entry_point string, starter_code string, question string, "
        "tests array<string>, preflight string, t1 int, t2 int, canonical_solution string",
    )


def test_rl_rows(spark):
    row = prompts.rl_rows(admitted(spark), {"m1": "t1", "m2": "t2"}).first()
    assert row["data_source"] == "stage3_taco_taco_function"
    truth = json.loads(row["reward_model"]["ground_truth"])
    assert truth["tests"] == [{"args": [1], "output": 2}] and truth["difficulty"] is None
    extra = row["extra_info"]
    assert (extra["difficulty"], extra["canonical_verified"], extra["prompt_tokens_max"], extra["prompt_tokens_by_model"]) == ("", True, 12, {"m1": 10, "m2": 12})
    system, user = row["prompt"]
    assert system["content"] == prompts.SYSTEM
    assert "defining callable `f`" in user["content"] and "Difficulty: None\nProblem id: p1\nVerifier test count: 1" in user["content"]
    assert user["content"].endswith("Add.\n\n\nStarter signature/imports:\n```python\nimport os\n```\n")
    again = prompts.with_index(prompts.rl_rows(admitted(spark), {"m": "t1"}).withColumn("i", F.lit(4)), "i").first()
    assert again["extra_info"]["index"] == 4


@pytest.mark.parametrize(("kind", "starter", "contract"), [("taco_stdin", "", "stdin_program"), ("taco_function", "class Solution:", "class_solution_method"), ("taco_function", "", "standalone_function")])
def test_contracts(spark, kind, starter, contract):
    rows = admitted(spark, kind, starter).withColumn("name", F.lit(None).cast("string")).withColumn("c", prompts.output_contract())
    row = rows.select("c", prompts.contract_prompt(F.col("c")).alias("p")).first()
    assert row["c"] == contract
    assert row["p"].endswith("\n\nPython code:") and "\n\nProblem:\nAdd.\n" in row["p"]


def test_benchmark_rows(spark):
    science = spark.createDataFrame(
        [("q", ["x", "y"], 1, None, "h", "s", "t", "c", "k", 0), ("q", ["x"], 0, "png", "", "", "", "", "", 1)],
        "question string, choices array<string>, answer long, image string, hint string, subject string, topic string, category string, skill string, ord int",
    )
    assert [(r["id"], r["answer_text"]) for r in prompts.scienceqa(science, "ord").collect()] == [("scienceqa_00000", "y")]
    mbpp = spark.createDataFrame([(3, "p", "code", None, ["assert f(1)"], "more")], "task_id int, prompt string, code string, test_imports array<string>, test_list array<string>, test string")
    row = prompts.mbpp(mbpp, plus=True).first()
    assert (row["id"], row["test_imports"], row["plus_test"]) == ("3", [], "more")
    text = prompts.mbpp(mbpp, plus=False).select(prompts.mbpp_prompt(F.lit("f")).alias("x")).first()["x"]
    assert "Implement the function named `f`." in text and text.endswith("assert f(1)\n\nPython code:\n")
    with pytest.raises(Exception, match="no final answer"):
        prompts.gsm8k(spark.createDataFrame([("q", "no mark", 0)], "question string, answer string, ord int"), "ord").collect()


def test_health_rows(spark):
    one = spark.createDataFrame([("1", [{"role": "user", "content": "c"}], ["r"])], f"prompt_id string, prompt {schemas.MESSAGES}, rubrics array<string>")
    assert prompts.health_rows(one, False).first()["id"] == "1"
    two = spark.createDataFrame(
        [("2", {"messages": [{"role": "user", "content": "c"}]}, [{"criterion_text": "k", "points": 3}])],
        f"id string, conversation struct<messages:{schemas.MESSAGES}>, rubric_items array<struct<criterion_text:string,points:int>>",
    )
    row = prompts.health_rows(two, True).first()
    assert row["rubrics"][0]["criterion"] == "k" and row["messages"][0]["content"] == "c"


def test_dual_export(spark):
    info = "struct<problem_id:int,original_question_id:int,source_dataset:string,subset:string,style:string,difficulty:string,entry_point:string,test_count_used:int,test_modules:array<string>,test_code_repaired:boolean,source_full_execution_verified:boolean>"
    rl = spark.createDataFrame([("a", "p", "d", "code", "rm", (1, 2, "s", "t", "u", "v", "f", 3, None, False, True))], f"id string, prompt string, data_source string, ability string, reward_model string, extra_info {info}")
    sft = spark.createDataFrame([("a", [{"role": "user", "content": "c"}])], f"id string, messages {schemas.MESSAGES}")
    first, second = prompts.dual_export(rl, sft, "id")
    assert first.count() == second.count() == 1
    extra = rl.select(prompts.extra_info("extra_info", F.lit(9)).alias("x")).first()["x"]
    assert (extra["index"], extra["problem_id"], extra["test_modules"], len(extra)) == (9, "1", [], 12)
    with pytest.raises(ValueError, match="export"):
        prompts.dual_export(rl, sft.filter("id = 'z'"), "id")
