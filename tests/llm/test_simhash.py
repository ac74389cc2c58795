import numpy as np
import pytest
import xxhash

from millrace.llm import op4_simhash_vptree as op


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps):
    distinct = np.unique(fps)
    labels = np.arange(len(distinct))
    for s in range(0, len(distinct), 500):
        a, b = np.nonzero(np.bitwise_count(distinct[s : s + 500, None] ^ distinct[None, :]) <= 4)
        labels = op._unite(labels, a + s, b)
    return labels[np.searchsorted(distinct, fps)]


def test_documents(spark, sf_dir, corpus):
    got = op.op4_simhash_vptree(spark, sf_dir).collect()
    want = {r[0]: brute_fingerprint(r[1]) for r in corpus}
    assert all(int(r["fingerprint"], 16) == want[r["doc_id"]] and len(r["fingerprint"]) == 16 for r in got)
    classes = brute_classes(np.array([want[r[0]] for r in corpus], np.uint64))
    least = {}
    for r, c in zip(corpus, classes.tolist()):
        if r[0] is not None:
            least[c] = min(least.get(c, 1 << 60), r[0])
    component = {r[0]: least.get(c) for r, c in zip(corpus, classes.tolist())}
    assert all(r["component_id"] == component[r["doc_id"]] for r in got)


@pytest.mark.parametrize("task_rows", [300, 8192])
def test_every_link_is_found_in_dense_and_random_fingerprints(spark, monkeypatch, task_rows):
    monkeypatch.setattr(op, "LEAF_LEAST", 60)
    monkeypatch.setattr(op, "TASK_ROWS_LEAST", task_rows)
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = []
    for i in range(6000):
        f = int(centres[0]) if i % 3 == 0 else int(rng.integers(0, 1 << 63)) if i % 3 == 1 else int(centres[rng.integers(0, 12)])
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            f ^= 1 << int(b)
        fps.append(f)
    fps = np.unique(np.array(fps, np.uint64))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    edges = op.link_table(nodes).toPandas()
    a, b = edges["a"].to_numpy().view(np.uint64), edges["b"].to_numpy().view(np.uint64)
    labels = op._unite(np.arange(len(fps)), np.searchsorted(fps, a), np.searchsorted(fps, b))
    assert (labels == brute_classes(fps)).all()


@pytest.mark.parametrize("dense", [2, 40, 10**9])
@pytest.mark.parametrize("b", range(4))
def test_dense_values_are_searched_by_the_other_blocks(monkeypatch, dense, b):
    monkeypatch.setattr(op, "DENSE", dense)
    monkeypatch.setattr(op, "PAIRS", 5000)  # many steps
    rng = np.random.default_rng(b)
    # few values in block b, so that most rows share theirs; links by chains of small changes elsewhere
    values = np.array([3, 2, 7, 0x8000], np.uint64)[rng.integers(0, 4, 3000)]
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for i in range(0, 3000, 3):
        f = int(fps[i - 1])
        for bit in rng.integers(0, 64, rng.integers(0, 6)):
            f ^= 1 << int(bit)
        fps[i] = f
    mask = np.uint64(0xFFFF << (16 * b))
    fps = np.unique((fps & ~mask) | (values << np.uint64(16 * b)))
    near = op._block(fps, b)
    zero = np.zeros(len(fps), np.int8)
    x, y = op.links(fps, zero, zero, b, False)
    labels = op._unite(np.arange(len(fps)), np.searchsorted(fps, x), np.searchsorted(fps, y))
    close = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4) & (np.bitwise_count((near[:, None] ^ near[None, :]).astype(np.uint64)) <= 1)
    i, j = np.nonzero(close)
    assert (labels == op._unite(np.arange(len(fps)), i, j)).all()


def test_components_of_a_long_path_and_a_star(spark):
    from millrace.llm.graph import components

    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 80)}}


def test_stage_keeps_one_document_of_each_component(spark, docs, sf_dir):
    out = op.stage(spark, docs, "")
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert len(kept) == len(set(kept))
    want = {r["component_id"] for r in op.op4_simhash_vptree(spark, sf_dir).collect()}
    assert {i for i in kept if i is not None} == {i for i in want if i is not None}
