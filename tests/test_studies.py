import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions.dates import template_date
from millrace.plans import studies
from millrace.sources import readers


def test_verified_rows(spark):
    legacy = spark.createDataFrame([(i, p, "a") for i, p in (("1", "p"), ("2", "q"), ("3", "p  "), ("4", "r"), ("5", "s"), ("6", "t"))], "id string, prompt string, answer string")
    source = spark.createDataFrame([("1", None), ("2", "invalid_input_output_json"), ("3", None), ("5", None), ("6", None), ("9", None)], "id string, reject_reason string")
    trusted = spark.createDataFrame([("1", True), ("3", False)], "id string, is_val boolean")
    repairs = spark.createDataFrame([("5", "append_main", "fixed"), ("6", None, None)], "id string, kind string, code string")
    got = {r["id"]: r for r in studies.verified_rows(legacy, source, trusted, repairs, True).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "1": "kept_verified", "2": "invalid_input_output_json", "3": "exact_prompt_answer_duplicate",
        "4": "not_in_rl_dedup_source", "5": "repaired_verified", "6": "all_simple_repairs_failed",
    }
    assert got["5"]["answer"] == "fixed" and got["1"]["was_validation"]
    off = {r["id"]: r["status"] for r in studies.verified_rows(legacy, source, trusted).collect()}
    assert off["5"] == "canonical_not_execution_verified"


def index(spark):
    names = ["graph", "string", "greedy_search", None]
    rows = [(str(i), names[i % 4], [names[i % 4], "graph"] if i % 8 == 1 else []) for i in range(80)]
    return spark.createDataFrame(rows, "id string, primary_category string, overlap_categories array<string>")


def test_ablation(spark):
    rows = studies.with_categories(index(spark).select("id"), index(spark))
    got = studies.ablation(rows, 30, 7)
    sizes = {r["arm"]: r["n"] for r in got.groupBy("arm").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"full": 80, "no_graph": 30, "no_other_algorithm": 30, "no_greedy_search": 30, "no_no_tags": 30}
    without = got.filter("arm = 'no_graph'").join(rows, "id").filter(F.array_contains("overlap", "graph"))
    assert without.count() == 0
    with pytest.raises(ValueError):
        studies.ablation(rows, 79, 7)
    with pytest.raises(ValueError, match="category index"):
        studies.with_categories(spark.createDataFrame([("x",)], "id string"), index(spark))


def test_sft_arms(spark):
    rows = index(spark).withColumns(
        {c: F.lit("text") for c in ("question", "name", "canonical_solution", "source", "difficulty", "task_id")}
        | {c: F.lit("") for c in ("starter_code", "input_output")}
        | {c: F.array(F.lit("t")) for c in ("tags", "raw_tags", "skill_types")}
        | {"dataset": F.lit(None).cast("string")}
    )
    got = studies.sft_arms(rows, 20, 7)
    sizes = {r["arm"]: r["n"] for r in got.groupBy("arm").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 9 and sizes.pop("full") == 80 and set(sizes.values()) == {20}
    one = got.filter("arm = 'no_graph'").first()
    assert one["removed_category"] == "graph" and one["dataset"] == "taco" and one["answer"] == "\ntext\n" and one["messages"][1]["role"] == "assistant"


def test_suite(spark):
    records = [
        ("gsm8k", "The answer is 4.\nQ: next 9", "4", None, None, None), ("gsm8k", "5", "6", None, None, None),
        ("finqa", "12%", "0.12", None, None, None), ("finqa", "x", "", None, None, None),
        ("medcalc", "about 7", "7", "6", "8", None), ("legalbench", "Yes", "yes", None, None, None),
        ("mbpp_plus", "code", None, None, None, True), ("mbpp_plus", "code", None, None, None, False), ("mbpp_simple", "code", None, None, None, True),
        ("scienceqa", "B", "B", None, None, None), ("healthbench", "text", None, None, None, None),
    ]
    table = spark.createDataFrame(records, "task string, reply string, target string, lower string, upper string, passed boolean")
    metrics, means = studies.suite(table)
    plan = metrics._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Scan ") == 1
    assert studies.suite(table, ["gsm8k"])[0].count() == 1
    by = {r["task"]: r for r in metrics.collect()}
    assert (by["finqa"]["n"], by["finqa"]["raw_n"], by["finqa"]["accuracy"]) == (1, 2, 1.0)
    assert by["gsm8k"]["accuracy"] == 0.5 and by["healthbench"]["n"] == 0
    row = means.first()
    assert row["hard_mean"] is None and row["diagnostic_mean"] == pytest.approx((0.5 + 1 + 1) / 3)
    assert row["main_scoreable_mean"] == pytest.approx((1 + 1 + 1 + 0.5) / 4) and row["scoreable_dataset_count"] == 7


def test_mix_and_choices(spark):
    records = spark.createDataFrame([("m", "a", True), ("m", "a", False), ("m", "b", True), ("c", "x", False)], "component string, subject string, passed boolean")
    got = {r["component"]: r["macro"] for r in studies.internal_mix(records).collect()}
    assert got == {"m": 0.75, "c": 0.0, "mixed": 0.375}
    rows = spark.createDataFrame([(0, "t", "No"), (1, "t", "Yes"), (2, "t", "No")], "ord int, task_type string, target string")
    assert studies.legal_choices(rows).first()["labels"] == ["No", "Yes"]


@pytest.mark.parametrize(("text", "ok"), [("01 Jan 2000", True), ("1 Jan 2000", True), ("2000-01-01", False), ("31 Foo 2000", False), (None, False)])
def test_template_date(spark, text, ok):
    got = spark.createDataFrame([(text,)], "t string").select(template_date("t").alias("x")).first()["x"]
    assert (got is not None) is ok


def test_file_digests_and_skipped_rows(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    row = readers.file_digests(spark, str(tmp_path / "f")).first()
    assert (row["bytes"], row["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())
    kept, skipped = readers.observed(spark.range(10), "id < 7", "rows")
    assert kept.count() == 7 and skipped.get["skipped"] == 3


def test_rl_split(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("problem_id"), F.lit("taco_stdin").alias("interface_kind"))
    got = studies.rl_split(rows, 100, 7).collect()
    assert sum(r["split"] == "validation" for r in got) == 5
