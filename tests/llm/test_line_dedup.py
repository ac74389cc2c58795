import hashlib
import random
from collections import Counter

import numpy as np

from millrace.llm import op8_line_dedup as op


def brute(corpus):
    docs = {}
    for i, t, *_ in corpus:
        docs[i, t] = (i is None, i if i is not None else 0)
    order, first, out = sorted(docs, key=lambda k: (docs[k], op_key(k))), {}, {}
    lines = {k: [x.strip() for x in (k[1] or "").encode().split(b"\n")] for k in order}
    words = {k: [len(x.split()) for x in lines[k]] for k in order}
    runs = {k: {tuple(lines[k][s:e]) for s, e in op.spans(np.array(words[k]), op.MIN_WORDS)} for k in order}
    for k in order:
        for x in runs[k]:
            first.setdefault(x, k)
    for k in order:
        gone = set()
        for p in {first[x] for x in runs[k]} - {k}:
            gone |= set(op.deleted(lines[p], lines[k], words[k], op.MIN_WORDS))
        out[k[0]] = (0 if k[1] is None else len(k[1].split("\n")), len(gone), "\n".join(x for j, x in enumerate((k[1] or "").split("\n")) if j not in gone))
    return out


def op_key(k):
    return 0  # ids tie only in rows that are equal


def test_against_brute_force(spark, sf_dir, corpus):
    want = brute(corpus)
    got = op.op8_line_dedup(spark, sf_dir).collect()
    assert sum(r["n_removed"] for r in got) > 50
    for r in got:
        n, gone, left = want[r["doc_id"]]
        assert (r["n_lines"], r["n_removed"], r["text_sha256"]) == (n, gone, hashlib.sha256(left.encode()).hexdigest())


def test_patience_keeps_order_and_recurses():
    a, b = list("abcdxefgh"), list("abzcdyefqh")
    pairs = op.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len(pairs)
    assert "".join(a[i] for i, _ in pairs) == "abcdefh"


def test_moved_blocks_are_found():
    a = [1, 2, 3, 4, 5, 6]
    assert sorted(op.deleted(a, [9, 4, 5, 8, 1, 2, 7], [6] * 7, 10)) == [1, 2, 4, 5]
    assert op.deleted(a, [1, 9, 3], [6] * 3, 10) == []


def test_one_copy_of_every_block_stays(spark, docs, corpus):
    out = op.stage(spark, docs, "").collect()
    left = Counter(x for r in out for x in {y.strip() for y in (r["text"] or "").split("\n")})
    for i, t, *_ in corpus:
        for x in (t or "").split("\n"):
            assert left[x.strip()] >= 1
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"] is not None)
    assert len({r["doc_id"] for r in out}) > 200


def common(a, b, words, least):
    """Lines of b in any common block of enough words, by trying all pairs of places."""
    gone = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(words[j : j + n]) >= least:
                gone |= set(range(j, j + n))
    return gone


def test_short_shared_lines_hide_no_moved_block():
    a, b = [1, 2, 3, 4], [4, 1, 8, 2, 9, 3]
    assert op.deleted(a, b, [50, 2, 1, 2, 1, 2], 10) == [0]


def test_every_common_block_is_deleted():
    rng = random.Random(5)
    size = [0, 1, 2, 3, 4, 6, 12]
    for _ in range(400):
        a, b = ([rng.randrange(7) for _ in range(rng.randint(0, 25))] for _ in range(2))
        words = [size[x] for x in b]
        assert set(op.deleted(a, b, words, 10, gap=-1)) - {j for j in range(len(b)) if not words[j]} == {j for j in common(a, b, words, 10) if words[j]}


def test_a_passage_that_a_document_repeats_is_found(spark):
    p = "one passage of more than ten words that several documents share as it is"
    rows = [(1, p), (2, f"{p}\nmine\n{p}"), (3, "other words"), (4, f"q {p}\nx\nq {p}"), (5, f"q {p}")]
    out = op.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {1: p, 2: "mine", 3: "other words", 4: rows[3][1], 5: ""}


def test_short_lines_with_many_first_holders(spark):
    lines = [f"{i} short line of six words" for i in range(9)]
    rows = [(i, f"{x}\nown {i}") for i, x in enumerate(lines)] + [(20 + i, "\n".join([f"start {i}", *lines])) for i in range(2)]
    out = {r["doc_id"]: r["text"] for r in op.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {**dict(rows), 21: "start 1"}


def test_against_all_pairs(spark):
    rng = random.Random(9)
    lines = ["", "a", "b c", "d e f g", "h i j k l m", "n o p q r s t u v w x", "y z"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    want = {}
    for i, (doc, text) in enumerate(rows):
        own = text.split("\n")
        words = [len(x.split()) for x in own]
        gone = set().union(*[common(t.split("\n"), own, words, op.MIN_WORDS) for _, t in rows[:i]])
        want[doc] = [x for j, x in enumerate(own) if x and j not in gone]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in op.dedup(df, gap=-1).collect():
        assert [x for x in (r["text"] or "").split("\n") if x] == want[r["doc_id"]]
    for r in op.dedup(df).collect():  # the short lines beside them go too, and nothing comes back
        left = iter(want[r["doc_id"]])
        assert all(x in left for x in (r["text"] or "").split("\n") if x)


def test_alignment_takes_the_short_lines_of_an_edited_passage(monkeypatch):
    a, b = list("AxyBzC"), list("AqyBwzD")  # one line of the passage is edited, one put in
    words = [12, 3, 3, 12, 3, 3, 12]
    assert op.deleted(a, b, words, 10) == [0, 2, 3, 5]
    assert op.deleted(a, b, words, 10, gap=-1) == [0, 2, 3]
    assert op.deleted(a, list("Aq.yD"), [12, 3, 3, 3, 12], 10) == [0]  # two other lines are too many
    monkeypatch.setattr(op, "patience", lambda a, b: [])
    assert op.deleted(a, b, words, 10) == [0, 2, 3]


def test_short_blocks_go_only_with_one_of_enough_words():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.randrange(30) for _ in range(rng.randint(0, 40))] for _ in range(2))
        words = [(x * 7) % 13 for x in b]
        core, wide = (set(op.deleted(a, b, words, 10, gap)) for gap in (-1, 2))
        assert core <= wide
        if not core:
            assert not wide
        assert all(any(abs(j - k) <= len(wide) * 4 for k in core) for j in wide - core)
        aligned = op.blocks(op.patience(a, b))
        assert sorted((i + k, j + k) for i, j, n in aligned for k in range(n)) == op.patience(a, b)


def test_an_edited_copy_loses_its_short_lines_too(spark):
    long = lambda x: " ".join(f"{x}{i}" for i in range(12))
    first = "\n".join([long("a"), "short one", "short two", "short three", "end of it"])
    second = "\n".join(["own head", long("a"), "short one", "edited here", "short three", "own", "tail"])
    rows = [(1, first), (2, second), (3, "short three\nelsewhere")]
    got = {r["doc_id"]: r["text"] for r in op.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: first, 2: "own head\nedited here\nown\ntail", 3: "short three\nelsewhere"}
