"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt to blocks of bounded size. Each block holds one list of its vectors a dimension, sorted
by that component. For a query the lists are read in parallel, from the top where the query's component
is positive and from the bottom where it is negative; each vector met is scored in full at once. No
vector that is still unseen can score more than the sum of the query's components times the values the
lists have reached, so a block is left as soon as that bound is below the kth score so far (a bound equal
to it goes on, because ties go to the smaller id). The lists are read in steps of growing depth. A task
takes its queries through its blocks one after the other and keeps the best k between them, so later
blocks are left the sooner.

Scores are integers: components are floor(64 * x) in double precision, products are summed exactly in 64 bits. Where
they might not fit (the sum of a query's components times the largest one of a block reaches 2^62) the search
stops with an error instead of wrong scores.
Queries and candidates meet share by share, so no pair of single rows is ever made. Null vectors and those
with null or non-finite components take no part. Fewer candidates than k give fewer rows. Repeated ids
are rows of their own, and a query leaves out its own row, not other rows of its id. Vectors of another
length than the query's share no score and are left out for it. An empty table gives an empty result. Only the
id and the vector are read, so other columns may have any names.

Where vectors have no heavy components, as unit vectors in random directions, no sound bound over sorted lists
falls below the kth score before nearly all vectors are met; README has the share that was. A search then costs
what the full product of a block does, and its result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

K, SCALE, QUERY_EVERY = 20, 64, 20
#: Vectors of a block, rows of a share of candidates or queries at most, and candidates' shares at least.
BLOCK, TASK_ROWS, LEAST_SHARES = 4096, 1 << 15, 12
FIRST_DEPTH = 8


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, size and packed (64-bit) integer components of the rows that take part."""
    e = F.col(embedding).cast("array<double>")
    own = vectors.select(F.col(vec_id).alias("vec_id"), e.alias("e")).filter(F.col("e").isNotNull() & F.col("vec_id").isNotNull())
    own = own.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("e").alias("size"), F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))


class Lists:
    """A block's vectors and, for every dimension, their places in descending order of that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows, self.vectors = ids, rows, vectors
        self.down = np.argsort(-vectors, axis=0, kind="stable").T.copy()
        self.sorted = -np.sort(-vectors, axis=0).T
        top = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.exact = vectors.astype(np.float64) if top < 2**40 else None
        self.top = top

    def largest(self, q: np.ndarray) -> float:
        """What no score of the query exceeds; an error if it might not fit into 64 bits."""
        most = float(np.abs(q.astype(np.float64)).sum()) * self.top
        if most >= 2.0**62:  # half of what a long holds, for the rounding of the bound
            raise OverflowError(f"scores up to {most:.3g} do not fit into 64 bits: scale the vectors by less")
        return most

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.exact is None or self.largest(q) >= 2**53:
            return self.vectors[at] @ q
        q = q.astype(np.float64)  # every partial sum is exact
        many = 4 * len(at) > len(self.ids)  # then one product over the block is cheaper than picking its rows
        return ((self.exact @ q)[at] if many else self.exact[at] @ q).astype(np.int64)


def search(q: np.ndarray, own_row: int, block: Lists, k: int, best: list[np.ndarray]) -> list[np.ndarray]:
    """[scores, ids, rows] of the best k so far, by score down and id up, after one more block."""
    n = len(block.ids)
    block.largest(q)
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    seen, left, depth = np.zeros(n, bool), n, 0
    while left:
        full = len(best[0]) >= k
        # what an unseen vector can reach at most
        bound = int(block.sorted[up, depth] @ q[up]) + int(block.sorted[down, n - 1 - depth] @ q[down])
        if full and bound < best[0][k - 1]:
            return best
        next_depth = min(n, max(FIRST_DEPTH, 4 * depth))
        if 4 * left < n or not len(up) + len(down):
            next_depth = n  # few are left: the rest of the lists is read at once
        if next_depth >= n:
            fresh = np.flatnonzero(~seen)
        else:
            met = np.zeros(n, bool)
            met[block.down[up, depth:next_depth].ravel()] = True
            met[block.down[down, n - next_depth : n - depth].ravel()] = True
            fresh = np.flatnonzero(met & ~seen)
        seen[fresh] = True
        left -= len(fresh)
        depth = next_depth
        if len(fresh):
            s = block.scores(q, fresh)
            if full:
                good = s >= best[0][k - 1]
                fresh, s = fresh[good], s[good]
            other = block.rows[fresh] != own_row
            fresh, s = fresh[other], s[other]
            if len(fresh):
                scores, ids, rows = (np.concatenate(x) for x in zip(best, (s, block.ids[fresh], block.rows[fresh])))
                order = np.lexsort((rows, ids, -scores))[:k]
                best = [scores[order], ids[order], rows[order]]
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; both tables are quantised rows with a column ``row`` that names the row."""
    n, q = vectors.count(), queries.count()
    shares = max(LEAST_SHARES, -(-n // TASK_ROWS)), max(LEAST_SHARES // 4, -(-q // TASK_ROWS))
    # a task for each share of candidates and share of queries; every share has a bounded number of rows
    mine = lambda i: F.pmod(F.xxhash64("row"), F.lit(shares[i]).cast("long")).alias("cq"[i])
    every = lambda i: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares[i] - 1).cast("long"))).alias("cq"[i])
    candidates = vectors.select(mine(0), every(1), F.lit(False).alias("asks"), "row", "vec_id", "size", "v")
    asked = queries.select(every(0), mine(1), F.lit(True).alias("asks"), "row", "vec_id", "size", "v")

    def run(rows: pa.Table) -> pa.Table:
        asks = rows["asks"].to_numpy()
        ids, row, size = (rows[c].to_numpy() for c in ("vec_id", "row", "size"))
        flat, ends = rows["v"].combine_chunks().flatten().to_numpy(), np.cumsum(size)
        out: list[tuple[np.ndarray, ...]] = []
        for width in np.unique(size[asks]).tolist():
            at = np.flatnonzero(size == width)
            at = at[np.argsort(row[at], kind="stable")]
            vectors_of = lambda some: flat[(ends[some] - width)[:, None] + np.arange(width)[None, :]]  # noqa: E731, B023
            inner, outer = at[~asks[at]], at[asks[at]]
            state = [[np.empty(0, np.int64)] * 3 for _ in outer]
            asked_vectors = vectors_of(outer)
            for s in range(0, len(inner), BLOCK):
                some = inner[s : s + BLOCK]
                block = Lists(ids[some], row[some], vectors_of(some))
                state = [search(v, int(row[i]), block, k, best) for i, v, best in zip(outer, asked_vectors, state)]
            lengths = [len(best[0]) for best in state]
            out.append((np.repeat(row[outer], lengths), np.repeat(ids[outer], lengths), *(np.concatenate([b[j] for b in state] or [row[:0]]) for j in (1, 2, 0))))
        names = ["query_row", "query_id", "vec_id", "vec_row", "score"]
        return pa.table({c: np.concatenate([x[j] for x in out] or [ids[:0]]) for j, c in enumerate(names)})

    found = candidates.union(asked).groupBy("c", "q").applyInArrow(run, "query_row long, query_id long, vec_id long, vec_row long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut(quantised(read(spark, sf_dir, "embeddings")).withColumn("row", F.monotonically_increasing_id()))
    return top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
WHERE rank <= 20
"""
