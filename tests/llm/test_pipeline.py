import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline as p
from millrace.llm.op7_bm25_packing import library

from .test_secret_scan import RULES
from .test_simhash import brute_classes, brute_fingerprint


def test_stages_hand_over_whole_tables(spark, docs, sf_dir, corpus, tmp_path):
    table, kept = docs, []
    for n, (name, stage) in enumerate(p.STAGES):
        stage(spark, table, sf_dir).write.parquet(f"{tmp_path}/{n}")
        table = spark.read.parquet(f"{tmp_path}/{n}")
        if n < len(p.STAGES) - 1:
            assert table.columns == docs.columns
            kept.append({r["doc_id"] for r in table.collect()})
    assert kept[0] == {r[0] for r in corpus} - {260, 261, 262, 263}
    assert kept[3] <= kept[2] <= kept[1] <= kept[0] and kept[3] == kept[2]
    assert {r["doc_id"] for r in table.collect()} == kept[3]


def test_run_gives_the_same(spark, sf_dir):
    a = sorted(map(repr, p.run(spark, sf_dir).drop("sequence_id").collect()))
    b = sorted(map(repr, p.run(spark, sf_dir).drop("sequence_id").collect()))
    assert a == b and a


def test_empty_table(spark, empty_dir):
    assert p.run(spark, empty_dir).collect() == []


def without_shared_blocks(rows):
    """(id, text) in order: lines of blocks of 10 words that any earlier document has go, by comparing all pairs."""
    ranked = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    lines = [[x.strip() for x in t.split("\n")] for _, t in ranked]
    out = {}
    for j, b in enumerate(lines):
        gone = set()
        for a in lines[:j]:
            for p in range(len(a)):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    if sum(len(x.split()) for x in b[q : q + n]) >= 10:
                        gone.update(range(q, q + n))
        left = [x for i, x in enumerate(ranked[j][1].split("\n")) if i not in gone]
        out[ranked[j]] = "\n".join(left) if gone else ranked[j][1]
    return [(r[0], out[r]) for r in rows if out[r].strip() or out[r] == r[1]]


def without_near_copies(rows):
    """One row of each class of fingerprints within 4 bits, the one with the smallest id."""
    classes = brute_classes(np.array([brute_fingerprint(t) for _, t in rows], np.uint64)).tolist()
    first = {}
    for (i, t), c in zip(rows, classes):
        row = (i is None, i or 0, t)
        first[c] = min(first.get(c, row), row)
    return [(None if none else i, t) for none, i, t in first.values()]


def without_secrets(text):
    spans = sorted((m.start(), m.end()) for _, rule, group, least in RULES for m in rule.finditer(text) if len(m.group(group)) >= least)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_rows_are_those_of_brute_force(spark, sf_dir, corpus):
    small = [r for r in corpus if r[0] is None or r[0] not in (260, 261, 262, 263)]  # the others have no letter
    rows = without_near_copies(without_shared_blocks([(r[0], r[1]) for r in small]))
    encode = library(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).encode
    want = {i: [*encode(without_secrets(t), allowed_special="all"), 1] for i, t in rows}
    got, sequences = {}, {}
    for r in p.run(spark, sf_dir).collect():
        ids = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(want[r["doc_id"]]), zlib.crc32(ids.tobytes()))
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(got) == set(want)
    for pieces, whole in [*((got[i], len(want[i])) for i in got), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == whole if whole else at == 2048 or at < 2048 and at & (at - 1) == 0
