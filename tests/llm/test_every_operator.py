"""What holds for all document operators: whole results, empty tables, clashing names, any partitioning."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from millrace.llm import queries as q

PER_ROW = [k for k in q.QUERIES if k not in ("op3_threshold_topk", "op7_bm25_packing", "op13_join_maintenance")]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_input_row(spark, sf_dir, corpus, name):
    got = [r["doc_id"] for r in q.QUERIES[name](spark, sf_dir).collect()]
    assert sorted(map(str, got)) == sorted(str(r[0]) for r in corpus)


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_empty_table(spark, empty_dir, name):
    assert q.QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", [*PER_ROW, "op7_bm25_packing", "op13_join_maintenance"])
def test_extra_columns_change_nothing(spark, sf_dir, clashing_dir, name):
    assert rows(q.QUERIES[name](spark, sf_dir)) == rows(q.QUERIES[name](spark, clashing_dir))


#: Names that stages use inside; a table may have columns of these names too.
NAMES = ("gone", "lines", "removed", "key", "id", "fp", "own", "n", "row", "blob", "spans", "__key", "__word", "__spans", "__maybe", "__lines", "__id", "__text", "score", "lang_pred", "C0")


@pytest.mark.parametrize("name", [name for name, _ in p.STAGES[:-1]])
def test_stages_carry_columns_of_any_name(spark, docs, name):
    stage = dict(p.STAGES)[name]
    wide = docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(NAMES)])
    out = stage(spark, wide, "")
    assert out.columns == wide.columns
    got = out.collect()
    assert all([r[c] for c in NAMES] == [f"x{i}" for i in range(len(NAMES))] for r in got)
    assert sorted(repr(r[: len(docs.columns)]) for r in got) == sorted(repr(tuple(r)) for r in stage(spark, docs, "").collect())
