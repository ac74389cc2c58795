import hashlib
from collections import defaultdict

from millrace.llm import op5_exact_dedup as op


def test_against_brute_force(spark, sf_dir, corpus):
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[(t or "").encode().lower()].append(i)
    got = op.op5_exact_dedup(spark, sf_dir).collect()
    text = {i: (t or "").encode().lower() for i, t, *_ in corpus}
    kept = defaultdict(int)
    for r in got:
        t = text[r["doc_id"]]
        largest = max((i for i in groups[t] if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (largest, len(groups[t]), hashlib.sha256(t).hexdigest())
        kept[t] += r["kept"]
    assert all(n == 1 for n in kept.values())


def test_only_survivors_are_hashed_in_full(spark, docs):
    rows = op.refine(docs).collect()
    assert any(r["sha256"] is None for r in rows)
    assert all(r["sha256"] is not None for r in rows if r["group_size"] > 1)
