"""SimHash near-duplicates, linked by vantage-point trees over blocks of the fingerprint.

A fingerprint is four blocks of 16 bits. Two fingerprints at Hamming distance 4 or less have a block
at distance 1 or less (else each block would differ by 2 or more), so a search of radius 1 in each of
the four block spaces finds every link. In a 16-bit space Hamming distances spread far enough for
triangle bounds to prune, which they don't for radius 4 in 64 bits.

For each block a vantage-point tree splits the 65,536 possible values by their distance to a vantage
value, at the weighted median, until a leaf holds its share of the fingerprints. Its weights are the
counts of all distinct fingerprints by block value, a table of fixed size. A fingerprint lives in one
leaf (its home) and visits the leaves that the triangle bounds leave open for radius 1; of two leaves
only the later one is visited, which still brings every pair together. Leaves are the shards: in each,
homes are compared with homes and visitors whose block value lies within 1, and the full fingerprints
decide. Where both of two such values have many fingerprints, these are searched in the same way by the other
three blocks (of a distance of 4 one of three blocks has 1 at most), so that the comparisons of a fingerprint
don't grow with the rows of its value. A leaf holds a bounded number of rows unless a single value has more;
a shard with too many is dealt in slices, and each pair of slices is a task of its own.

A shard returns for each of its fingerprints one link to the smallest one it is connected with there,
so links grow with the fingerprints and not with the square of a group. Components of these links are
found by ``graph.components``. Equal fingerprints are one node from the start.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows keep their rows.
A null id is larger than any other when the smallest id is taken. An empty table gives an empty result.
Texts of any length are read whole. Columns beside the id and the text are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, plain_names, read, utf8
from .graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 1
VALUES = 1 << BLOCK_BITS
#: A leaf is split further while it holds more homes than LEAF_MOST or this share of all, and than LEAF_LEAST.
LEAF_SHARE, LEAF_LEAST, LEAF_MOST, DEPTH = 1 / 64, 1024, 1 << 19, 16
#: Rows of a shard that one task compares; larger shards are dealt in slices.
TASK_ROWS_LEAST, TASK_ROWS_MOST = 8192, 1 << 20
PAIRS = 1 << 21
#: Fingerprints of each of two block values from which the other blocks are searched too.
DENSE = 1024


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the bits of the XXH64 hashes of word shingles; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], np.uint64)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fp long")


def _block(fps: np.ndarray, b: int) -> np.ndarray:
    return ((fps >> np.uint64(BLOCK_BITS * b)) & np.uint64(VALUES - 1)).astype(np.int64)


def _distance(values: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count((values ^ vantage).astype(np.uint64)).astype(np.int64)


@dataclass(frozen=True)
class Tree:
    """Leaves of one block space: values' homes and visits (CSR by value), and the slices of each leaf."""

    home: np.ndarray
    visit_at: np.ndarray
    visits: np.ndarray
    slices: np.ndarray


def plant(weights: np.ndarray) -> Tree:
    """The vantage-point tree of one block space for counts of fingerprints by block value."""
    present = np.flatnonzero(weights)
    total = int(weights.sum())
    limit = max(LEAF_LEAST, min(int(total * LEAF_SHARE), LEAF_MOST))
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(present, np.empty(0, np.int64), 0)]
    while todo:
        home, visit, depth = todo.pop()
        split = None
        if depth < DEPTH and weights[home].sum() > limit and len(home) > 1:
            heavy = home[np.argsort(-weights[home], kind="stable")[:4]]
            for vantage in {*heavy.tolist(), 0, VALUES - 1, 0x5555, 0x0F0F, 0x00FF}:
                d, dv = _distance(home, vantage), _distance(visit, vantage)
                by = np.bincount(d, weights=weights[home], minlength=BLOCK_BITS + 1)
                mu = int(np.searchsorted(np.cumsum(by), by.sum() / 2))
                for m in (mu - 1, mu):
                    inner, outer = by[: m + 1].sum(), by[m + 1 :].sum()
                    if inner and outer:
                        crossing = by[max(0, m + 1 - BLOCK_RADIUS) : m + 1 + BLOCK_RADIUS].sum()
                        cost = max(inner, outer) + crossing
                        if split is None or cost < split[0]:
                            split = (cost, m, d, dv)
        if split is None:
            leaves.append((home, visit))
            continue
        _, m, d, dv = split
        # triangle bounds: a ball of radius r around v meets the inside if d - r <= m, the outside if d + r > m
        r = BLOCK_RADIUS
        todo.append((home[d > m], np.concatenate([home[(d <= m) & (d + r > m)], visit[dv + r > m]]), depth + 1))
        todo.append((home[d <= m], np.concatenate([home[(d > m) & (d - r <= m)], visit[dv - r <= m]]), depth + 1))
    where = np.full(VALUES, -1, np.int64)
    for i, (home, _) in enumerate(leaves):
        where[home] = i
    later = [np.unique(visit[where[visit] < i]) for i, (_, visit) in enumerate(leaves)]
    value = np.concatenate(later) if leaves else np.empty(0, np.int64)
    leaf = np.repeat(np.arange(len(leaves)), [len(x) for x in later])
    order = np.argsort(value, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=VALUES))])
    load = np.array([weights[h].sum() + weights[v].sum() for (h, _), v in zip(leaves, later)])
    most = min(TASK_ROWS_MOST, max(TASK_ROWS_LEAST, 4 * limit))
    return Tree(where, at, leaf[order], np.maximum(1, -(-load // most)).astype(np.int64))


def _weights(nodes: DataFrame) -> np.ndarray:
    """Counts of fingerprints by block and value: at most BLOCKS * 65,536 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((BLOCKS, VALUES), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for b in range(BLOCKS):
                own[b] += np.bincount(_block(fps, b), minlength=VALUES)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own.ravel()[at])], ["at", "n"])

    got = nodes.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BLOCKS * VALUES, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(BLOCKS, VALUES)


def _dealt(fps: np.ndarray, b: int, tree: Tree) -> Iterator[tuple[np.ndarray, ...]]:
    """(leaf, i, j, fingerprint, role, slice) of every task that a fingerprint takes part in."""
    value = _block(fps, b)
    n = tree.visit_at[value + 1] - tree.visit_at[value]
    who = np.repeat(np.arange(len(fps)), n)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    leaf = np.concatenate([tree.home[value], tree.visits[tree.visit_at[value[who]] + nth]])
    role = np.concatenate([np.zeros(len(fps), np.int8), np.ones(len(who), np.int8)])
    fp = np.concatenate([fps, fps[who]])
    k = tree.slices[leaf]
    own = ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % k
    other = np.arange(len(fp))
    copies = np.repeat(other, k)
    j = np.arange(len(copies)) - np.repeat(np.cumsum(k) - k, k)
    own, leaf, role, fp = own[copies], leaf[copies], role[copies], fp[copies]
    yield leaf, np.minimum(own, j), np.maximum(own, j), fp, role, own


def _unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest member, fully compressed) after linking a[i] with b[i]."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def _expand(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of the ranges left[i] .. + n_left[i] and right[i] .. + n_right[i]."""
    n = n_left * n_right
    at = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return left[at] + nth // n_right[at], right[at] + nth % n_right[at]


def _steps(load: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose loads sum to about PAIRS."""
    upto = np.cumsum(load)
    cuts = [0, *(np.flatnonzero(np.diff(upto // PAIRS)) + 1).tolist(), len(upto)]
    yield from zip(cuts, cuts[1:])


def _dense(fps: np.ndarray, left: slice, right: slice, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs between two ranges of fingerprints with near values of block b: near in another block, too."""
    for c in range(BLOCKS):
        if c == b:
            continue
        wanted, there = _block(fps[left], c), _block(fps[right], c)
        order = np.argsort(there, kind="stable")
        there = there[order]
        for mask in (0, *(1 << i for i in range(BLOCK_BITS))):
            lo = np.searchsorted(there, wanted ^ mask)
            n = np.searchsorted(there, wanted ^ mask, side="right") - lo
            some = np.flatnonzero(n)
            for s, e in _steps(n[some]):
                at = some[s:e]
                x, y = _expand(at, np.ones(len(at), np.int64), lo[at], n[at])
                yield left.start + x, right.start + order[y]


def links(fps: np.ndarray, role: np.ndarray, part: np.ndarray, b: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest one it is connected with here) of one task, by block b.

    Pairs of two visitors are some other leaf's. With ``across`` only pairs of different slices count.
    """
    value = _block(fps, b)
    order = np.lexsort((fps, value))
    fps, role, part, value = fps[order], role[order], part[order], value[order]
    distinct, first, size = np.unique(value, return_index=True, return_counts=True)
    labels = np.arange(len(fps))

    def unite(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        wanted = (x < y) & (labels[x] != labels[y]) & ((role[x] == 0) | (role[y] == 0))
        if across:
            wanted &= part[x] != part[y]
        x, y = x[wanted], y[wanted]
        close = np.bitwise_count(fps[x] ^ fps[y]) <= RADIUS
        return _unite(labels, x[close], y[close])

    step = max(1, PAIRS // max(1, len(distinct)))
    for at in range(0, len(distinct), step):
        near = np.bitwise_count((distinct[at : at + step, None] ^ distinct[None, :]).astype(np.uint16)) <= BLOCK_RADIUS
        u, v = np.nonzero(near)
        u += at
        u, v = u[u <= v], v[u <= v]
        dense = (size[u] >= DENSE) & (size[v] >= DENSE)
        for i, j in zip(u[dense].tolist(), v[dense].tolist()):
            for x, y in _dense(fps, slice(first[i], first[i] + size[i]), slice(first[j], first[j] + size[j]), b):
                labels = unite(labels, x, y)
        u, v = u[~dense], v[~dense]
        # ranges of at most 1024 rows a side, so that a very common value is no single step
        cu, cv = -(-size[u] // 1024), -(-size[v] // 1024)
        i, j = _expand(np.zeros(len(u), np.int64), cu, np.zeros(len(u), np.int64), cv)
        pair = np.repeat(np.arange(len(u)), cu * cv)
        left, right = first[u[pair]] + 1024 * i, first[v[pair]] + 1024 * j
        n_left = np.minimum(1024, first[u[pair]] + size[u[pair]] - left)
        n_right = np.minimum(1024, first[v[pair]] + size[v[pair]] - right)
        for s, e in _steps(n_left * n_right):
            labels = unite(labels, *_expand(left[s:e], n_left[s:e], right[s:e], n_right[s:e]))
    # rows are in order of value, so the smallest label isn't the smallest fingerprint; any member serves
    moved = labels != np.arange(len(fps))
    return fps[moved], fps[labels[moved]]


def link_table(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints (column fp, distinct) within the radius."""
    spark = nodes.sparkSession
    trees = spark.sparkContext.broadcast([plant(w) for w in _weights(nodes)])  # tables over 65,536 values

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for b, tree in enumerate(trees.value):
                for leaf, i, j, fp, role, part in _dealt(fps, b, tree):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(((leaf * BLOCKS + b) << 40) | (i << 20) | j),
                            pa.array(fp.view(np.int64)),
                            pa.array((role + 2 * (part == j)).astype(np.int8)),
                        ],
                        ["shard", "fp", "tag"],
                    )

    def search(shard: pa.Table) -> pa.Table:
        key = shard["shard"][0].as_py()
        tag = shard["tag"].to_numpy()
        across = (key >> 20) & 0xFFFFF != key & 0xFFFFF
        a, b = links(shard["fp"].to_numpy().view(np.uint64), tag & 1, tag >> 1, (key >> 40) % BLOCKS, across)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return nodes.select("fp").mapInArrow(deal, "shard long, fp long, tag byte").groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id, kept (true for one row of each component) of every row."""
    rows = cut(fingerprints(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    nodes = cut(rows.groupBy("fp").agg(F.min(key).alias("first")))
    roots = cut(components(link_table(nodes)))
    labelled = cut(
        nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    least = cut(labelled.groupBy("root").agg(F.min("first").alias("least")))
    of = cut(labelled.select("fp", "root").join(least, "root").select("fp", "least"))
    return rows.join(of, "fp").select(
        "doc_id", "fp", F.col("least.id").alias("component_id"), (F.col("least.row") == F.col("row")).alias("kept")
    )


def op4_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the one with the smallest id (of repeated rows, one)."""
    plain = plain_names(docs)
    names = plain.columns
    at, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    found = near_duplicates(plain, at, text)
    kept = cut(found.filter("kept").select(F.col("doc_id").alias("id"), "fp"))
    several = cut(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("id")))
    same = F.col(at).eqNullSafe(F.col("id"))
    # texts move by their ids, which are as good as unique, so no task gets a hot group
    whole = plain.join(kept.select("id").hint("shuffle_hash"), same, "left_semi")
    if several.isEmpty():
        return whole.toDF(*docs.columns)
    # ids that occur in several rows: those rows are told apart by fingerprint, then one of equals stays
    single = whole.join(several.hint("shuffle_hash"), same, "left_anti")
    repeated = whole.join(several.hint("shuffle_hash"), same, "left_semi")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in utf8(batch.column(names.index(text)))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*names, "own"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    one = repeated.mapInArrow(mark, f"{fields}, own long").join(kept, same & (F.col("own") == F.col("fp")), "left_semi")
    return single.union(one.dropDuplicates([at, "own"]).select(*names)).toDF(*docs.columns)
