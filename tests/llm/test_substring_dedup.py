import hashlib
import random

import numpy as np
import pytest

from millrace.llm import op11_substring_dedup as op

LAST = op.LAST


def brute(rows, window=op.WINDOW):
    """(doc_id, text) to (words, removed places), by comparing windows as tuples of words."""
    words = [(t or "").encode().split() for _, t in rows]
    ids = [LAST if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(ids, words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, LAST), i)
    out = []
    for i, w in zip(ids, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((w, gone))
    return out


def held_against_brute(df, rows, window):
    want = sorted((str(i), str(t), len(w), sorted(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()) for (i, t), (w, gone) in zip(rows, brute(rows, window)))
    got = sorted((str(r["doc_id"]), str(r["text"]), r["__words"], [k for s in r["__spans"] for k in range(s["start"], s["end"])], r["__kept"]) for r in df.collect())
    assert got == want
    return sum(len(x[3]) for x in got)


def test_query_against_brute_force(spark, sf_dir, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    want = sorted((str(i), len(w), len(g), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in g)).hexdigest()) for (i, _), (w, g) in zip(rows, brute(rows)))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op.op11_substring_dedup(spark, sf_dir).collect())
    assert got == want
    assert sum(r[2] for r in got) > 500


@pytest.mark.parametrize("chunk", [op.CHUNK_BYTES, 400, 1])
def test_few_words_many_repeats(spark, monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(op, "BUCKET_WINDOWS", 50)
    rng = random.Random(chunk)
    rows = [(rng.randrange(40), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [(None, rows[3][1]), (None, rows[3][1] + " z"), (None, None), (7, None), (8, " \n"), (9, rows[4][1]), (9, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert held_against_brute(op.dedup(df, window=7), rows, 7) > 1000


def test_a_window_that_half_of_all_texts_share_stays_once(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"head{i} {passage} tail{i}" if i % 2 else f"own{i} text") for i in range(400)]
    out = {r["doc_id"]: r for r in op.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert out[1]["__spans"] == []
    assert all([(s["start"], s["end"]) for s in out[i]["__spans"]] == [(1, 61)] and out[i]["__kept"] == f"head{i} tail{i}" for i in range(3, 400, 2))


def test_only_white_space_of_ascii_parts_words(spark):
    text = " ".join(["a b", "c d", "e"] * 20)
    rows = [(1, text), (2, text.replace(" ", "\t\n"))]
    out = op.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["__words"], r["__kept"]) for r in out) == sorted([(60, text), (60, "")])


def test_neighbouring_windows_merge_and_others_do_not():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    h = op.rolled(t, 4, op.BASES[0])
    assert op.intervals(t, h[[2, 6, 20, 22]], 4).tolist() == [[2, 10], [20, 26]]
    assert op.intervals(t, h[:0], 4).tolist() == []


def test_rolled_hashes_are_polynomials():
    t = np.arange(1, 9, dtype=np.uint64)
    for base in op.BASES:
        want = [sum(int(t[i + k]) * base**k for k in range(3)) % (1 << 64) for i in range(6)]
        assert [int(x) for x in op.rolled(t, 3, base)] == want
    assert not len(op.rolled(t[:2], 3, op.BASES[0]))


def test_pieces_of_a_long_text_hold_its_words():
    rng = random.Random(2)
    text = b"".join(bytes([rng.choice(b"ab \n\xc3")]) for _ in range(3000)) + b"x" * 500
    for most in (1, 7, 64, 10_000):
        assert [w for piece in op.word_pieces(text, most) for w in piece] == text.split()


def test_extra_columns_pass(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, gone string, key int")
    out = op.dedup(df)
    assert out.columns == [*df.columns, "__words", "__spans", "__kept"]
    assert out.first()["gone"] == "x" and out.first()["key"] == 5
    with pytest.raises(ValueError, match="name the new ones"):
        op.dedup(df.withColumnRenamed("gone", "__kept"))
