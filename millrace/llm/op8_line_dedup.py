"""Line deduplication by pairwise alignment.

Lines are named by 128-bit hashes of their stripped text, documents by those of their id and text, so that
unequal ones don't meet by chance at any size. A run is the shortest sequence of lines with at least
MIN_WORDS words on from a line, or back from it; the runs inside a shared block cover it. For every run
that several documents share, however often it stands in one, each later document is paired with the
first one that has it, so every shared block has a pair for each of its lines, and the pairs of a run grow
with the documents that have it, not with their square. No run is too frequent to count.

Each pair is aligned by patience diff: equal heads and tails, then lines that are unique on both sides in
their longest common order, then the same between them. An aligned block of at least MIN_WORDS words is
deleted from the later document, and with it the shorter blocks that the alignment puts next to it with at most
GAP other lines between on either side: the lines of a passage that is the same but for a few edited ones. Its
rest is aligned once more for blocks that have moved. Blocks of MIN_WORDS words that no alignment shows, of
repeated lines or behind short ones, are found by their runs. The first holder of a run keeps it, so one copy
always stays.

Documents come in order of doc_id, null last. Rows of equal id and text are one document and are treated
alike. Null texts stay null, empty texts stay empty, neither has shared lines. An empty table gives an
empty result. Texts of any length are aligned whole, line by line; a text without line feeds is one line.
Any other columns, whatever their names, pass through ``dedup`` as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, plain_names, read, utf8

#: Words of an aligned block from which it is deleted.
MIN_WORDS = 10
#: Other lines between an aligned block that is deleted and a shorter one that goes with it, on either side.
GAP = 1
NAME_BYTES = 16


def _key(doc_id: str, text: str) -> Column:
    """Names a document by its id and text, alike in every read."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in (doc_id, text)]
    return F.unhex(F.md5(F.concat(parts[0], F.lit("\0"), parts[1]).cast("binary")))


def _names(packed: bytes) -> list[bytes]:
    return [packed[i : i + NAME_BYTES] for i in range(0, len(packed), NAME_BYTES)]


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key, none, doc_id, names (packed 128-bit line hashes), words (packed 32-bit word counts)."""
    own = docs.select(
        _key(doc_id, text).alias("key"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, words = [], []
            for t in utf8(batch.column(3)):
                lines = [x.strip() for x in t.split(b"\n")]
                names.append(b"".join([xxhash.xxh3_128_digest(x) for x in lines]))
                words.append(np.array([len(x.split()) for x in lines], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(names, pa.binary()), pa.array(words, pa.binary())], ["key", "none", "doc_id", "names", "words"]
            )

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"key binary, none boolean, doc_id {kind}, names binary, words binary")


def spans(words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs of lines with enough words from every line on and back from every line.

    Together those inside a block of enough words cover it.
    """
    total, some, least = np.concatenate([[0], np.cumsum(words)]), np.flatnonzero(words > 0), max(1, min_words)
    end = np.searchsorted(total, total[some] + least)
    start = np.searchsorted(total, total[some + 1] - least, side="right") - 1
    on, back = end <= len(words), start >= 0
    return sorted({*zip(some[on].tolist(), end[on].tolist()), *zip(start[back].tolist(), (some[back] + 1).tolist())})


def _runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(run, n, none, doc_id, tie) for every different run of lines that just has enough words."""
    given = lines.select("n", "none", "doc_id", F.xxhash64("key").alias("tie"), "names", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (names, words) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                runs = spans(np.frombuffer(words, "<i4").astype(np.int64), min_words)
                own = {xxhash.xxh3_64_intdigest(names[NAME_BYTES * s : NAME_BYTES * e]) for s, e in runs}
                found.append(np.fromiter(own, np.uint64, len(own)).view(np.int64))
                at.append(np.full(len(own), i))
            at = pa.array(np.concatenate([*at, np.empty(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*found, np.empty(0, np.int64)])), *[batch.column(j).take(at) for j in range(4)]],
                ["run", "n", "none", "doc_id", "tie"],
            )

    kind = lines.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"run long, n long, none boolean, doc_id {kind}, tie long")


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails, at, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two line lists, in order."""
    matched, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1}
        anchors = [(place[x], j) for j, x in enumerate(b[b0:b1], b0) if x in place and in_b[x] == 1]
        chain = [anchors[k] for k in _increasing([i for i, _ in anchors])]
        if not chain:
            continue
        matched += chain
        for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)]):
            todo.append((i + 1, i2, j + 1, j2))
    return sorted(matched)


def _shared(a: list, b: list, words: list[int], min_words: int) -> set[int]:
    """Lines of b in any block of enough words that a has too, wherever it stands."""
    size = dict(zip(b, words))
    of_a = {tuple(a[s:e]) for s, e in spans(np.array([size.get(x, 0) for x in a], np.int64), min_words)}
    return {y for s, e in spans(np.array(words, np.int64), min_words) if tuple(b[s:e]) in of_a for y in range(s, e)}


def blocks(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, lines) of the runs of aligned places that follow each other on both sides."""
    out: list[tuple[int, int, int]] = []
    for i, j in pairs:
        if out and (i, j) == (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]):
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


def taken(aligned: list[tuple[int, int, int]], words: list[int], min_words: int, gap: int) -> list[bool]:
    """Which aligned blocks go: those of enough words, and shorter ones at most ``gap`` lines from one that goes."""
    goes = [sum(words[j : j + n]) >= min_words for _, j, n in aligned]
    near = [max(i2 - i - n, j2 - j - n) <= gap for (i, j, n), (i2, j2, _) in zip(aligned, aligned[1:])]
    for k in range(1, len(aligned)):
        goes[k] = goes[k] or goes[k - 1] and near[k - 1]
    for k in range(len(aligned) - 1, 0, -1):
        goes[k - 1] = goes[k - 1] or goes[k] and near[k - 1]
    return goes


def deleted(a: list, b: list, words: list[int], min_words: int, gap: int = GAP) -> list[int]:
    """Lines of b that go: aligned blocks of enough words with the shorter ones beside them.

    What is deleted leaves the alignment, and the rest is aligned again until nothing more goes. Aligned
    blocks that are too short keep their place and may hide a moved block, and repeated lines anchor
    nothing, so the blocks of enough words that are then still shared are found by their runs of lines.
    A negative ``gap`` leaves all shorter blocks.
    """
    rest = list(b)
    gone: list[int] = []
    while True:
        aligned = blocks(patience(a, rest))
        new = [y for (_, j, n), goes in zip(aligned, taken(aligned, words, min_words, gap)) if goes for y in range(j, j + n)]
        if not new:
            return sorted({*gone, *_shared(a, b, words, min_words)})
        gone += new
        for j in new:
            rest[j] = None


def deletions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, gap: int = GAP) -> DataFrame:
    """(key, gone): packed 32-bit line numbers to delete, for documents that lose any."""
    # inside, a document goes by a number, which is as long as it need be
    lines = cut(line_table(docs, doc_id, text).dropDuplicates(["key"]).withColumn("n", F.monotonically_increasing_id()))
    held_runs = cut(_runs(lines, min_words))
    order = F.struct("none", "doc_id", "tie", "n")
    holders = cut(held_runs.groupBy("run").agg(F.min(order).alias("first"), F.count("*").alias("docs")).filter("docs > 1").select("run", F.col("first.n").alias("held")))
    # tables from files on both sides of every join: adaptive execution splits the partition of a hot run or holder
    pairs = cut(held_runs.select("run", "n").join(holders, "run").filter("n <> held").select("held", "n").distinct())
    left = lines.select(F.col("n").alias("held"), F.col("names").alias("a"))
    with_left = cut(pairs.join(left, "held"))
    both = with_left.join(lines.select("n", "key", F.col("names").alias("b"), "words"), "n").select("key", "a", "b", "words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for a, b, words in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                gone.append(np.array(deleted(_names(a), _names(b), np.frombuffer(words, "<i4").tolist(), min_words, gap), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.binary())], ["key", "gone"])

    found = both.mapInArrow(align, "key binary, gone binary").filter(F.octet_length("gone") > 0)
    # at most one entry a line of the document
    return found.groupBy("key").agg(F.collect_list("gone").alias("gone"))


def _without(plain: DataFrame, doc_id: str, text: str, min_words: int, gap: int = GAP) -> DataFrame:
    """Rows of a table with plain names, the text without its deleted lines, then lines and removed (line counts)."""
    gone = cut(deletions(plain, doc_id, text, min_words, gap))
    names, at = plain.columns, plain.columns.index(text)
    given = plain.withColumn("key", _key(doc_id, text)).join(gone.hint("shuffle_hash"), "key", "left").select(*names, "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            for t, parts in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                lines = [] if t is None else t.split("\n")
                drop = {int(x) for p in parts or () for x in np.frombuffer(p, "<i4")}
                texts.append("\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else t)
                total.append(len(lines))
                removed.append(len(drop))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "lines", "removed"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, plain.schema.fields))
    return given.mapInArrow(run, f"{fields}, lines long, removed long")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, counts: tuple[str, str] = ("__lines", "__removed"), gap: int = GAP) -> DataFrame:
    """All rows and columns, the text without its deleted lines, then two line counts, which need names of their own."""
    if {*counts} & {*docs.columns}:
        raise ValueError(f"the table has a column {counts[0]} or {counts[1]}: name the counts otherwise")
    plain = plain_names(docs)
    at = dict(zip(docs.columns, plain.columns))
    return _without(plain, at[doc_id], at[text], min_words, gap).toDF(*docs.columns, *counts)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text that is left (null text: empty)."""
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    left = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(left.cast("binary"), 256).alias("text_sha256")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated blocks; one that has lost all its words goes. ``n_chars`` follows."""
    plain = plain_names(docs)
    at = dict(zip(docs.columns, plain.columns))
    out = _without(plain, at["doc_id"], at["text"], MIN_WORDS)
    out = out.filter((F.col("removed") == 0) | F.col(at["text"]).rlike(r"\S"))
    if "n_chars" in at:
        length = F.when(F.col("removed") > 0, F.length(at["text"])).otherwise(F.col(at["n_chars"]))
        out = out.withColumn(at["n_chars"], length.cast(plain.schema[at["n_chars"]].dataType))
    return out.select(*plain.columns).toDF(*docs.columns)
