"""Declared schemas: readers never infer."""

from __future__ import annotations

PROBLEM_RAW = (
    "question string, solutions string, starter_code string, input_output string, difficulty string, raw_tags string, "
    "name string, source string, tags string, skill_types string, url string, time_limit string, memory_limit string"
)
LEETCODE_RAW = (
    "task_id string, query string, prompt string, completion string, input_output string, entry_point string, test string, "
    "response string, meta struct<tags:array<string>,difficulty:string,question_title:string,question_id:string,"
    "estimated_date:string,lang_code:string>"
)
PROBLEM_INDEX = (
    "id string, dataset string, primary_category string, overlap_categories array<string>, source string, difficulty string, "
    "tags array<string>, raw_tags array<string>, skill_types array<string>, name string, task_id string"
)
RL_SOURCE = (
    "id string, dataset string, mode string, entry_point string, starter_code string, input_output string, "
    "canonical_solution string, question string, difficulty string"
)
MESSAGES = "array<struct<role:string,content:string>>"
KOD_ROW = (
    "id string, original_question_id string, source_dataset string, response_source string, subset string, style string, "
    f"difficulty string, prompt string, answer string, messages {MESSAGES}, quality_status string"
)
LABELED_PAIR = "problem_id string, primary_category string, prompt string, response string"
VERDICT = ", ".join(
    f"{c} double"
    for c in (
        "score acc format_ok parse_ok interface_ok pass_frac passed passed_tests total_tests "
        "wrong_answers runtime_errors timeouts status_code"
    ).split()
)
EVAL_RECORD = (
    "id string, component string, dataset string, passed boolean, test_pass_fraction double, status string, "
    "generated_tokens int, truncated boolean, reply string"
)
LOSS_LOG = "step long, epoch double, loss double"
