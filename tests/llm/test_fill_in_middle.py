import hashlib
import random
import re

import pytest

from millrace.llm import op12_fill_in_middle as op

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text, seed="1", rate=90, spm_rate=20):
    """(n, form, prefix_chars, middle_chars, output) by regular expressions on code points."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_rows():
    rng = random.Random(3)
    alphabet = ["a", "Zq", "é", "日本", "𝄞", " ", "\n", "0", "<", ">", "P", "<P", "S>", "M", "\x00", "́"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))) for i in range(600)]
    rows += [(i, rng.choice(["x<P>", "<S>", "a<M>b", "<P><S><M>", "<<P", "P>", "<P", "<X>"])) for i in range(600, 700)]
    return [*rows, (None, "a null id"), (None, None), (701, None), (5, "the same id"), (5, rows[5][1]), (702, "A" * 70_000 + "é" * 70_000)]


@pytest.mark.parametrize("chunk", [op.CHUNK_BYTES, 64])
def test_against_regular_expressions(spark, monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK_BYTES", chunk)
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = op.transform(df)
    got = op.restore(made, "__output", "__form").collect()
    assert sorted(repr((r["doc_id"], r["text"], r["__n"], r["__form"], r["__prefix_chars"], r["__middle_chars"], r["__output"])) for r in got) == sorted(repr((i, t, *plainly(i, t))) for i, t in rows)
    assert all(r["__restored"] == (r["text"] or "") for r in got)
    assert {r["__form"] for r in got} == {"plain", "spm", "psm"}


def test_query_digests(spark, sf_dir, corpus):
    want = []
    for i, t, *_ in corpus:
        n, form, p, m, out = plainly(i, t)
        want.append(repr((i, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    assert sorted(map(lambda r: repr(tuple(r)), op.op12_fill_in_middle(spark, sf_dir).collect())) == sorted(want)


def test_rates_and_seed_are_parameters(spark):
    rows = [(i, f"some words {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op.transform(df, seed="x", rate=40, spm_rate=100).collect()
    assert sorted((r["doc_id"], r["__form"], r["__output"]) for r in got) == sorted((i, *[plainly(i, t, "x", 40, 100)[k] for k in (1, 4)]) for i, t in rows)
    assert {r["__form"] for r in got} == {"plain", "spm"}


def test_extra_columns_pass_and_taken_names_stop(spark):
    df = spark.createDataFrame([("x", 1, "a b", 2)], "c0 string, doc_id long, text string, y0 int")
    out = op.restore(op.transform(df), "__output", "__form")
    assert tuple(out.first())[:4] == ("x", 1, "a b", 2)
    with pytest.raises(ValueError, match="name the new ones"):
        op.transform(op.transform(df))


def test_no_shuffle(spark, sf_dir):
    plan = op.op12_fill_in_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
