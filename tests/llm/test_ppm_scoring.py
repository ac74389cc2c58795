"""Against a direct model with escapes and symbol exclusion, one symbol at a time."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import op2_ppm_scoring as op


def low(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize(("trie", "hot"), [(1 << 20, 1 << 20), (500, 40)])
def test_scores(spark, sf_dir, corpus, monkeypatch, trie, hot):
    monkeypatch.setattr(op, "TRIE_SHARE", trie)
    monkeypatch.setattr(op, "HOT_SHARE", hot)
    got = {(r["doc_id"]): r for r in op.op2_ppm_scoring(spark, sf_dir).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [low(r[1]) for r in corpus if not held(r[0])]
    tokens = Counter(w for t in train for w in t.split())
    tokens[None] = len(train)
    n, v = sum(tokens.values()), len(tokens)
    order = op.ORDER
    grams, after, total, symbols = Counter(), defaultdict(dict), Counter(), 0
    for t in train:
        b = bytes([op.START]) * order + t + bytes([op.END])
        for p in range(order, len(b)):
            symbols += 1
            for k in range(order + 1):
                grams[b[p - k : p + 1]] += 1
    least = max(1, -(-symbols // trie))
    for g, c in grams.items():
        total[g[:-1]] += c
        if c >= least:
            after[g[:-1]][g[-1]] = c

    def log_p(context, s):
        excluded, acc = set(), 0.0
        for k in range(order, -1, -1):
            c = context[order - k :]
            if c not in after:
                continue
            own = {x: m for x, m in after[c].items() if x not in excluded}
            dropped = total[c] - sum(after[c].values())
            below = sum(own.values()) + dropped + len(own)
            if s in own:
                return acc + math.log10(own[s] / below)
            if below:
                acc += math.log10((dropped + len(own)) / below)
            excluded |= set(after[c])
        return acc - math.log10(256 - len(excluded))

    for i, text, *_ in corpus:
        t, r = low(text), got[i]
        words = [*t.split(), None]
        assert r["held_out"] == held(i)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(tokens[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel=1e-9)
        if len(t) < 1500:
            b = bytes([op.START]) * order + t + bytes([op.END])
            assert r["score"] == pytest.approx(sum(log_p(b[p - order : p], b[p]) for p in range(order, len(b))), rel=1e-9)


def test_long_texts_are_scored_in_segments_alike(spark, docs, monkeypatch):
    model = op.fit(docs.select("text"))
    text = low(max((r["text"] or "" for r in docs.collect()), key=len))
    whole = sum(model.score(g).sum() for g, _ in op._segments([text]))
    monkeypatch.setattr(op, "CHUNK_BYTES", 1000)
    assert sum(model.score(g).sum() for g, _ in op._segments([text])) == pytest.approx(whole)


@pytest.mark.parametrize("hot", [1, 300])
def test_grams_by_join_score_like_the_whole_model(spark, docs, monkeypatch, hot):
    training = docs.filter("doc_id % 3 > 0")
    model = op.fit(training.select("text"))
    monkeypatch.setattr(op, "HOT_GRAMS", hot)
    monkeypatch.setattr(op, "CHUNK_BYTES", 3000)
    got = {r["doc_id"]: r["score"] for r in op.score(docs, training).collect()}
    for i, text in docs.select("doc_id", "text").collect():
        assert got[i] == pytest.approx(sum(model.score(g).sum() for g, _ in op._segments([low(text)])), rel=1e-9)


def test_hot_grams_are_scored_like_the_model(spark, docs):
    counts, model = op.count_grams(docs.select("text")), op.fit(docs.select("text"))
    symbols = counts.filter("shiftright(gram, 56) = 1").groupBy().sum("n").first()[0]
    names, logs = op.hot_grams(counts, symbols)
    assert len(names) == counts.filter("shiftright(gram, 56) = 6").count()
    assert logs == pytest.approx(model.score(names & op.np.uint64((1 << 56) - 1)), rel=1e-9)


def test_rare_grams_are_learnt_at_any_size(spark):
    rows = [(0, "the same again " * 140_000), (1, "quixotic zephyrs vex jolly fowl"), (2, "the jolly zephyr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grams, context, kinds = Counter(), Counter(), Counter()
    for _, t in rows:
        b = bytes([op.START]) * op.ORDER + low(t) + bytes([op.END])
        grams.update(b[p - op.ORDER : p + 1] for p in range(op.ORDER, len(b)))
    for g, c in grams.items():
        context[g[:-1]] += c
        kinds[g[:-1]] += 1
    got = {r["doc_id"]: r["score"] for r in op.score(docs, docs).collect()}
    for i, t in rows[1:]:
        b = bytes([op.START]) * op.ORDER + low(t) + bytes([op.END])
        own = [b[p - op.ORDER : p + 1] for p in range(op.ORDER, len(b))]
        assert got[i] == pytest.approx(sum(math.log10(grams[g] / (context[g[:-1]] + kinds[g[:-1]])) for g in own), rel=1e-9)


def test_grams_are_counted_by_text():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 100, rng.integers(0, 12)).astype(np.uint8)) for _ in range(400)]
    want = Counter()
    for i, t in enumerate(texts):
        whole = bytes([op.START] * op.ORDER) + t + bytes([op.END])
        want.update((i, int.from_bytes(whole[k : k + op.ORDER + 1], "big")) for k in range(len(whole) - op.ORDER))
    (grams, owner), *rest = op._segments(texts)
    assert not rest
    assert dict(zip(zip(*(x.tolist() for x in op._counted(owner, grams)[:2])), op._counted(owner, grams)[2].tolist())) == want
    # owners far apart
    far = np.array([3, 3, 65538, 65539, 400_000, 400_000, 400_000])
    key = np.array([7, 7, (1 << 48) - 1, 0, 5, 4, 5], np.uint64)
    got = [x.tolist() for x in op._counted(far, key)]
    assert got == [[3, 65538, 65539, 400_000, 400_000], [7, (1 << 48) - 1, 0, 4, 5], [2, 1, 1, 1, 2]]
    assert [len(x) for x in op._counted(far[:0], key[:0])] == [0, 0, 0]
