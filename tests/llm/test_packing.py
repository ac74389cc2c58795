import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import op7_bm25_packing as op

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.mark.parametrize("shard_tokens", [1 << 19, 3000])
def test_each_id_lies_in_one_piece(spark, sf_dir, corpus, shard_tokens, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = op.tokenise(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    pieces = op.pack(op.cut(tokens), shard_tokens).collect()
    text, copies = {i: t or "" for i, t, *_ in corpus}, defaultdict(int)
    for i, *_ in corpus:
        copies[i] += 1
    of, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(of) == set(copies)
    for i, own in of.items():
        ids = [*library.encode(text[i], add_special_tokens=False).ids, 1]
        assert sum(p["length"] for p in own) == copies[i] * len(ids)
        for p in own:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert (p["ids_crc32"], p["doc_tokens"], p["length"]) == (zlib.crc32(part), len(ids), len(part) // 4)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048  # nothing is padded


def test_a_seed_is_followed_by_its_nearest_neighbours():
    rng = np.random.default_rng(1)
    topics = [rng.integers(100, 200, 40), rng.integers(300, 400, 40)]
    ids = [rng.choice(topics[i % 2], 150).astype("<u2").tobytes() for i in range(30)]
    df = np.full(op.TERMS, 10.0)
    order = op.arrange(ids, np.log1p(30 / df), 150)
    assert sorted(order) == list(range(30))
    assert sum(a % 2 == b % 2 for a, b in zip(order, order[1:])) >= 26


def test_every_neighbour_of_a_shard_is_looked_up_by_all_terms():
    rng = np.random.default_rng(3)
    lists = [rng.zipf(1.3, rng.integers(1, 900)) % 500 for _ in range(60)]
    ids = [x.astype("<u2").tobytes() for x in lists]
    idf, mean = rng.random(op.TERMS) + 0.1, float(np.mean([len(x) for x in lists]))
    counts = [Counter(x.tolist()) for x in lists]

    def score(seed, d):
        size = 1 - op.B + op.B * len(lists[d]) / mean
        return sum(idf[t] * counts[d][t] * (op.K1 + 1) / (counts[d][t] + op.K1 * size) for t in counts[seed] if t in counts[d])

    order, unused, at, crossed = [], list(range(60)), 0, False
    while unused:
        if not crossed:
            order.append(unused.pop(0))
            at += len(lists[order[-1]])
        crossed = False
        if at % op.WINDOW == 0:
            continue
        seed, window = order[-1], at // op.WINDOW
        near = sorted((d for d in unused if score(seed, d) > 0), key=lambda d: -score(seed, d))
        for d in near:
            order.append(d)
            unused.remove(d)
            at += len(lists[d])
            if at // op.WINDOW != window:
                crossed = at % op.WINDOW != 0
                break
    assert op.arrange(ids, idf, mean) == order


def test_layout_has_no_padding():
    for sizes in ([1], [2048], [5000, 3], [1, 1, 2047], [700] * 9):
        document, start, length, sequence, offset = op.lay_out(np.array(sizes))
        assert [int(length[document == d].sum()) for d in range(len(sizes))] == sizes
        for s in set(sequence.tolist()):
            n = int(length[sequence == s].sum())
            assert n & (n - 1) == 0 and n <= 2048


def test_added_tokens_inside_text_have_their_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mark = Tokenizer.from_file(path), "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"x  {mark}{mark}\n y", f"{mark[:-1]} {mark[1:]}", f"é{mark}  ", "<|fim|> <|ENDOFTEXT|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op.tokenise(docs, path, public_tokenizers.PATTERN).collect():
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u2").tolist() == [*want, op.END_ID]
        assert (50256 in want) == (mark in texts[r["doc_id"]])
