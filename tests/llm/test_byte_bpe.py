import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from millrace.llm import op6_byte_bpe as op
from millrace.llm.bytebpe import ID, MergeReplay, ranks_of_json, ranks_of_tiktoken

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of_tiktoken(f), special_tokens={})


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "é", "漢", "😀", "23", "'s", "'ll", "!", "##", "\x00", "<|endoftext|>", "aaaaaaa", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", "\n", " ", " \nx", "\nx", "a" * 3000, "ab" * 2000, "banana" * 400]


def test_odd_texts_round_trip_as_the_library_encodes_them(library, odd_texts):
    codec = op.codec_at(PATH, public_tokenizers.PATTERN)
    for text, packed in zip(odd_texts, codec.encode(odd_texts)):
        assert np.frombuffer(packed, ID).tolist() == library.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def test_texts_of_units_are_those_of_whole_texts(spark, library, odd_texts, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 2000)  # many blocks, which share units
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in op.encode(rows, PATH, public_tokenizers.PATTERN).collect()}
    digests = {r["doc_id"]: r for r in op.encode(rows, PATH, public_tokenizers.PATTERN, digests=True).collect()}
    assert len(got) == len(digests) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        ids = library.encode_ordinary(text)
        assert np.frombuffer(got[i]["ids"], ID).tolist() == ids
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_units_begin_at_white_space():
    assert op.distinct_units(["a b", "a  b\n c"]) == {"a", " b", "  b", "\n c"}


def test_a_merge_that_makes_a_lower_pair_goes_on_with_that_pair():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"abca": 258, b"aa": 259}
    want = tiktoken.Encoding("low", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for word, packed in zip(words, MergeReplay(ranks).encode(words)):
        assert np.frombuffer(packed, ID).tolist() == want.encode_ordinary(word.decode())


def test_query(spark, sf_dir, corpus, library):
    text = {i: t or "" for i, t, *_ in corpus}
    for r in op.op6_byte_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_encoding_and_decoding_tables(spark, docs):
    encoded = op.encode(docs, PATH, public_tokenizers.PATTERN)
    decoded = op.decode(encoded, PATH, public_tokenizers.PATTERN).collect()
    want = sorted((str(r["doc_id"]), (r["text"] or "").encode()) for r in docs.collect())
    assert sorted((str(r["doc_id"]), bytes(r["bytes"])) for r in decoded) == want


def test_both_files_hold_one_vocabulary():
    with open(PATH, "rb") as f, open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as g:
        assert ranks_of_tiktoken(f) == ranks_of_json(g.read())
