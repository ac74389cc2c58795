"""Every registered query with SQL gives DuckDB's rows on the smallest tables; entry() runs."""

import re
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver
from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None or isinstance(value, (float, np.floating)) and np.isnan(value):
        return "None"
    if isinstance(value, (float, np.floating)):
        return f"{float(value):.9g}"
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("lacking", ["millrace.llm", "corpus_pipeline"])
def test_the_rest_registers_without_the_training_data_operators(monkeypatch, lacking):
    monkeypatch.setitem(sys.modules, lacking, None)  # an import of it fails
    names = set(driver.queries())
    assert set(registry.QUERIES) <= names and "pipeline" not in names
    assert set(driver.oracle_sql()) <= names


def test_entry_and_registration(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(registry.QUERIES) <= set(driver.queries())


#: What only Python's parser can read goes through Arrow in batches, and so do files and sorted ids that are hashed in pieces.
PARSED = {
    "literal_scalars", "code_scalars", "code_extract", "long_replies", "repair_candidates", "problem_rows", "sft_rows", "second_source_prompts", "partition_union", "formal_categories", "training_arms",
    "file_manifest", "frozen_artifacts", "set_identity", "table_manifest",
}


@pytest.mark.parametrize("name", [n for n in registry.ORACLE_SQL if n != "suite_means" and n not in PARSED])
def test_no_python_in_plans_with_sql(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"EvalPython|pythonUDF|MapIn(?:Pandas|Arrow)|(?:Groups|CoGroups)In(?:Pandas|Arrow)", plan)  # prompts speak of Python, too


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["pending_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
    plan = registry.QUERIES["top_per_category"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
