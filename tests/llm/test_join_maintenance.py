import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import op13_join_maintenance as op

KIND = "base long, shifts array<int>, parts array<string>"


def joined(left, right, t):
    """Printed rows of the full outer join at a time, as a bag."""
    at = [Counter((b if b is None else b + s[t], p[t]) for b, s, p in rows if s[t] is not None) for rows in (left, right)]
    out = Counter()
    for (k, p), n in at[0].items():
        meets = [(q, m) for (k2, q), m in at[1].items() if k2 == k and k is not None]
        for q, m in meets or [("-", 1)]:
            out[k, p, q] += n * m
    for (k, q), m in at[1].items():
        if k is None or not any(k2 == k for k2, _ in at[0]):
            out[k, "-", q] += m
    return out


def brute(left, right, batches, initial=False):
    states = [Counter(), *[joined(left, right, t) for t in range(batches + 1)]] if initial else [joined(left, right, t) for t in range(batches + 1)]
    return {(t + 1 - initial, *k): (after[k] - before[k], after[k]) for t, (before, after) in enumerate(zip(states, states[1:])) for k in {*before, *after} if before[k] != after[k]}


def rows_of(rng, n, keys, times, moving, parts):
    out = []
    for _ in range(n):
        shift, shifts, part, own = 0, [], rng.choice(parts), []
        for _ in range(times):
            shift += moving * (rng.random() < 0.4)
            shifts.append(None if rng.random() < 0.3 else shift)
            part = rng.choice(parts) if rng.random() < 0.2 else part
            own.append(part)
        out.append((None if rng.random() < 0.05 else rng.choice(keys), shifts, own))
    return out


def got(df):
    rows = df.collect()
    out = {(r["batch"], r["join_key"], r["left_part"], r["right_part"]): (r["weight"], r["total"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("width", [1, 3, 256])
@pytest.mark.parametrize("initial", [False, True])
def test_against_whole_joins(spark, width, initial):
    rng = random.Random(width)
    keys = [-7, -1, 0, 1, 2, 5, 6, 7, 300, 2**62]
    left = rows_of(rng, 120, keys, 4, 1, ["a", "b", "null", "-"])
    right = rows_of(rng, 90, keys, 4, 0, ["x", "y", "-"])
    df = [spark.createDataFrame(x, KIND).repartition(3) for x in (left, right)]
    assert got(op.changes(*df, 3, width, initial)) == brute(left, right, 3, initial)


def test_a_hot_key_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "PAIRS", 7)
    rng = random.Random(9)
    left = rows_of(rng, 300, [4] * 9 + [1, 3], 3, 1, [f"p{i}" for i in range(20)])
    right = rows_of(rng, 200, [4] * 9 + [2, 5], 3, 0, [f"q{i}" for i in range(15)])
    df = [spark.createDataFrame(x, KIND) for x in (left, right)]
    assert got(op.changes(*df, 2, 4)) == brute(left, right, 2)


def test_a_stored_join_stays_up_to_date(spark):
    rng = random.Random(4)
    left, right = rows_of(rng, 80, range(9), 4, 1, ["a", "b"]), rows_of(rng, 60, range(9), 4, 0, ["x", "y"])
    moves = op.changes(*[spark.createDataFrame(x, KIND) for x in (left, right)], 3, 2, initial=True)
    state = spark.createDataFrame([], "join_key long, left_part string, right_part string, copies long")
    for t in range(4):
        state = op.applied(state, moves.filter(F.col("batch") == t))
        assert {tuple(r)[:3]: r["copies"] for r in state.collect()} == dict(joined(left, right, t))


def test_empty_sides(spark):
    none = spark.createDataFrame([], KIND)
    one = spark.createDataFrame([(3, [None, 0, 1], ["a", "a", "a"])], KIND)
    assert got(op.changes(none, none, 2)) == {}
    assert got(op.changes(one, none, 2)) == {(1, 3, "a", "-"): (1, 1), (2, 3, "a", "-"): (-1, 0), (2, 4, "a", "-"): (1, 1)}
    assert got(op.changes(none, one, 2)) == {(1, 3, "-", "a"): (1, 1), (2, 3, "-", "a"): (-1, 0), (2, 4, "-", "a"): (1, 1)}


def histories(rows, letter, print_part, moving):
    out = []
    for r in rows:
        c = [None if r[0] is None else zlib.crc32(f"{letter}:{r[0]}:{t}".encode()) for t in range(4)]
        there, updates, shifts, parts = c[0] is None or c[0] % 3 != 0, 0, [], []
        for t in range(4):
            if t and c[t] is not None:
                if c[t] % 31 == 0:
                    there = not there
                elif c[t] % 31 == 1 and there:
                    updates += 1
            shifts.append((updates * moving) if there else None)
            parts.append(print_part(r, updates))
        out.append((None if r[0] is None else r[0] // 5, shifts, parts))
    return out


def test_query_against_whole_joins(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i if rng.random() > 0.02 else None, rng.choice(["en", "de", None]), "x") for i in range(-300, 3000)] + [(7, "en", "x")] * 40
    labels = [(rng.choice([*range(-300, 3000), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for _ in range(2500)]
    spark.createDataFrame(docs, "doc_id long, lang string, base string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, event string").write.parquet(f"{tmp_path}/labels.parquet")
    shown = lambda x: "null" if x is None else str(x)
    left = histories(docs, "d", lambda r, u: shown(r[1]), 1)
    right = histories(labels, "l", lambda r, u: f"{shown(r[1] if r[1] is None or u % 2 == 0 else 1 - r[1])},{shown(r[2])}", 0)
    rows = op.op13_join_maintenance(spark, str(tmp_path)).collect()
    want = brute(left, right, 3)
    assert {tuple(r)[:4]: tuple(r)[4:] for r in rows} == want and len(rows) == len(want) > 500


def test_histories_are_counted_before_they_move(spark):
    df = spark.createDataFrame([(1, [0, 0], ["a", "a"])], KIND)
    plan = op.changes(df, df, 1)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Broadcast" not in plan
