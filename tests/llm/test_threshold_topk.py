import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import op3_threshold_topk as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    vectors = []
    for n, (i, v, _) in enumerate(rows):
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.append((n, i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = set()
    for n, i, v in vectors:
        if i % 20:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in vectors if m != n and len(w) == len(v))
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def test_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 50)
    monkeypatch.setattr(op, "TASK_ROWS", 100)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], 0) for i in range(400)]
    rows += [(400 + i, [0.5] * 6, 1) for i in range(60)]  # ties
    rows += [(900, None, 0), (901, [None] * 6, 0), (920, [float("nan")] * 6, 0), (940, [0.0] * 6, 0), (960, [1.0, 2.0], 0), (961, [3.0, -1.0], 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op.op3_threshold_topk(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == brute(rows, 20)


def test_lists_are_left_before_their_end():
    """The threshold stops a search: of a block with one clear winner most vectors are never scored."""
    rng = np.random.default_rng(0)
    vectors = rng.integers(-5, 5, (4000, 8))
    vectors[7] = 60
    block, scored = op.Lists(np.arange(4000), np.arange(4000), vectors), []
    plain = block.scores
    block.scores = lambda q, at: (scored.append(len(at)), plain(q, at))[1]
    best = op.search(np.full(8, 9), -1, block, 1, [np.empty(0, np.int64)] * 3)
    assert best[1].tolist() == [7]
    assert sum(scored) < 400


def test_scores_that_do_not_fit_stop_the_search(spark):
    rows = [(0, [5.0e7]), (1, [4.9e7]), (2, [-4.0])]
    vectors = op.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).withColumn("row", F.col("vec_id"))
    with pytest.raises(Exception, match="do not fit into 64 bits"):
        op.top_k(vectors, vectors.filter("vec_id = 0")).collect()
    fits = op.quantised(spark.createDataFrame([(0, [2.0e7, 1.0]), (1, [1.9e7, 3.0]), (2, [-4.0, 0.0])], "vec_id long, embedding array<double>")).withColumn("row", F.col("vec_id"))
    got = [(r["vec_id"], r["score"]) for r in op.top_k(fits, fits.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1280000000 * 1216000000 + 64 * 192), (2, -256 * 1280000000)]
