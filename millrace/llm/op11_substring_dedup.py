"""Substring deduplication: every window of WINDOW words that also starts in a document with a smaller id goes.

Every window of every text gets a Rabin-Karp hash: of its words' hashes t, the sum of t * B^i modulo 2^64, rolled
on as differences of prefix sums. A second polynomial gives 16 bits of name more, and the bucket, in which Spark
brings equal windows together; so windows are told apart by 80 bits and the bits of the bucket, of which there
are more the larger the input is.

A chunk of texts tells Spark each of its different windows once, with its smallest document: of the chunk's others
it is known at once that a smaller one has the window. So a window that very many documents share is a few bytes
for each chunk, and a bucket holds at most BUCKET_WINDOWS windows on average, of whatever frequency. A bucket finds
the smallest document of every window; the windows that are to go return to their documents, which roll their
hashes once more and merge what goes into maximal intervals of words. Only texts that lose words are shuffled;
which they may be is known from a bitmap of bounded size.

Null ids count as larger than any other, rows of one id (also null) take nothing from each other, whatever their
texts, and rows equal in id and text are treated alike. Null texts, empty ones and ones without words have no
words and stay so; texts of fewer words than a window stay whole. An empty table gives an empty result. Texts of
any length are read whole, split by pieces of CHUNK_BYTES. Any other columns, whatever their names, pass through.
``docs`` must give the same rows when a task is repeated, as files and checkpoints do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, cut, marked, plain_names, read, runs, utf8

WINDOW = 50
#: Bytes of text whose windows a worker holds at one time, and windows of a bucket on average.
CHUNK_BYTES = 1 << 21
BUCKET_WINDOWS = 1 << 21
#: Texts whose windows return together.
BLOCK_TEXTS = 256
#: Bits of the broadcast bitmap of documents that lose words (8 MB).
MARK_BITS = 1 << 26
SPACES = b" \t\n\v\f\r"
LAST = np.iinfo(np.int64).max
#: Odd multipliers, which have inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n; kept, since every chunk needs them."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 1 << 20)
        one = np.ones(1, np.uint64)
        inverse = pow(base, -1, 1 << 64)
        _powers[base] = tuple(np.cumprod(np.concatenate([one, np.full(size, x, np.uint64)])) for x in (base, inverse))
    return _powers[base]


def rolled(tokens: np.ndarray, window: int, base: int) -> np.ndarray:
    """The hash of the window that starts at each token, by differences of prefix sums."""
    n = len(tokens)
    if n < window:
        return np.empty(0, np.uint64)
    up, down = powers(base, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up[:n])])
    return (sums[window:] - sums[:-window]) * down[: n - window + 1]


def word_pieces(text: bytes, most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, by pieces that end at white space; a longer word is not cut."""
    start = 0
    while len(text) - start > most:
        end = max(text.rfind(bytes([c]), start, start + most) for c in SPACES)
        if end < 0:
            end = min((x for c in SPACES if (x := text.find(bytes([c]), start)) >= 0), default=len(text))
        yield text[start : end + 1].split()
        start = end + 1
    yield text[start:].split()


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash a word, white space being that of ASCII."""
    found = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) for words in word_pieces(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def second(tokens: np.ndarray) -> np.ndarray:
    """Other hashes of the same words, for the second polynomial."""
    return (tokens ^ (tokens >> np.uint64(29))) * MIX


def windows(tokens: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the text, hash, second hash) of every window of several texts."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    every = np.concatenate([*tokens, np.empty(0, np.uint64)])
    first, other = rolled(every, window, BASES[0]), rolled(second(every), window, BASES[1])
    owner = np.repeat(np.arange(len(tokens)), sizes)
    inside = owner[: len(first)] == owner[len(every) - len(first) :]
    other = other[inside]
    return owner[: len(first)][inside], first[inside], (other ^ (other >> np.uint64(31))) * MIX


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


def beyond_first(ids: np.ndarray, *names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, gone): rows sorted by name and id, and which of them have a larger id than the first of their name."""
    order = np.lexsort((ids, *names[::-1]))
    begin = starts_of(*[x[order] for x in names])
    least = np.repeat(ids[order][begin], np.diff(np.append(begin, len(order))))
    return order, ids[order] > least


def _deltas(values: np.ndarray) -> bytes:
    """Differences of 64-bit numbers, mostly small, which the shuffle compresses."""
    return np.diff(values, prepend=np.int64(0)).astype("<i8").tobytes()


def _summed(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, "<i8"))


DEALT = "bucket int, n long, id long, key long, rows binary, ids binary, sizes binary, hashes binary, tags binary"


def _chunk(n: np.ndarray, ids: np.ndarray, keys: np.ndarray, none: np.ndarray, texts: list[bytes], window: int, buckets: int) -> pa.RecordBatch:
    """A row for each text with the windows that are known to go, and a row for each bucket with windows to be looked up."""
    _, once = np.unique(np.stack([ids, keys]), axis=1, return_index=True)
    once = np.sort(once)
    n, ids, keys, none = n[once], ids[once], keys[once], none[once]
    owner, first, other = windows([word_hashes(texts[i]) for i in once], window)
    order, gone = beyond_first(ids[owner], first)
    owner, first, other = owner[order], first[order], other[order]
    # a window that stands several times in a text is told once
    by = np.lexsort((first, gone, owner))
    owner, first, other, gone = owner[by], first[by], other[by], gone[by]
    some = starts_of(owner, gone, first)
    owner, first, other, gone = owner[some], first[some], other[some], gone[some]

    known, cuts = first[gone], np.searchsorted(owner[gone], np.arange(len(n) + 1))
    local = [known[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    owner, first, other = owner[~gone], first[~gone], other[~gone]
    bucket = ((other >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    owner, first, other, bucket = owner[by], first[by], other[by].astype("<u2"), bucket[by]
    at = np.append(starts_of(bucket), len(bucket))
    rows, sent, sizes, hashes, tags = [], [], [], [], []
    for a, b in zip(at[:-1], at[1:]):
        begin = starts_of(owner[a:b])
        rows.append(_deltas(n[owner[a:b][begin]]))
        sent.append(_deltas(ids[owner[a:b][begin]]))
        sizes.append(np.diff(np.append(begin, b - a)).astype("<i4").tobytes())
        hashes.append(first[a:b].astype("<u8").tobytes())
        tags.append(other[a:b].tobytes())
    # what is known already travels with any bucket
    anywhere = n % buckets
    m, k = len(n), len(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([anywhere, bucket[at[:-1]]]), pa.int32()), pa.array([*n.tolist(), *[None] * k], pa.int64()),
            pa.array([*[None if x else i for x, i in zip(none.tolist(), ids.tolist())], *[None] * k], pa.int64()), pa.array([*keys.tolist(), *[None] * k], pa.int64()),
            *[pa.array([*[None] * m, *x], pa.binary()) for x in (rows, sent, sizes)], pa.array([*local, *hashes], pa.binary()), pa.array([*[None] * m, *tags], pa.binary()),
        ],
        ["bucket", "n", "id", "key", "rows", "ids", "sizes", "hashes", "tags"],
    )


FOUND = "block long, n long, id long, key long, rows binary, sizes binary, gone binary"


def _bucket(group: pa.Table) -> pa.Table:
    """Hashes of the windows that go, by text, a row for each block of texts; what was known passes."""
    known = group.filter(pc.is_valid(group["n"]))
    rest = group.filter(pc.is_null(group["n"]))
    packed = [rest[c].to_pylist() for c in ("rows", "ids", "sizes", "hashes", "tags")]
    empty = np.empty(0, np.int64)
    n, ids = (np.concatenate([empty, *[np.repeat(_summed(x), np.frombuffer(s, "<i4")) for x, s in zip(values, packed[2])]]) for values in packed[:2])
    hashes = np.frombuffer(b"".join(packed[3]), "<u8")
    tags = np.frombuffer(b"".join(packed[4]), "<u2")
    # most windows are alone: those whose hash stands twice are few to sort by all columns
    by = np.argsort(hashes)
    same = hashes[by][1:] == hashes[by][:-1]
    twice = by[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(by) else by
    n, ids, hashes, tags = n[twice], ids[twice], hashes[twice], tags[twice]
    order, gone = beyond_first(ids, hashes, tags)
    n, hashes = n[order][gone], hashes[order][gone]
    by = np.argsort(n, kind="stable")
    n, hashes = n[by], hashes[by]
    block = n // BLOCK_TEXTS
    at = np.append(starts_of(block), len(n))
    rows, sizes, out = [], [], []
    for a, b in zip(at[:-1], at[1:]):
        begin = starts_of(n[a:b])
        rows.append(_deltas(n[a:b][begin]))
        sizes.append(np.diff(np.append(begin, b - a)).astype("<i4").tobytes())
        out.append(hashes[a:b].tobytes())
    m, k = known.num_rows, len(out)
    blocks = np.concatenate([known["n"].to_numpy() // BLOCK_TEXTS, block[at[:-1]]])
    more = [pa.concat_arrays([known[c].combine_chunks(), pa.nulls(k, pa.int64())]) for c in ("n", "id", "key")]
    binary = [pa.array([*[None] * m, *x], pa.binary()) for x in (rows, sizes)]
    return pa.table([pa.array(blocks, pa.int64()), *more, *binary, pa.array([*known["hashes"].to_pylist(), *out], pa.binary())], ["block", "n", "id", "key", "rows", "sizes", "gone"])


def _block(group: pa.Table) -> pa.Table:
    """(id, key, gone) of the texts of a block that lose windows."""
    known = group.filter(pc.is_valid(group["n"]))
    rest = group.filter(pc.is_null(group["n"]))
    own = dict(zip(known["n"].to_pylist(), zip(known["id"].to_pylist(), known["key"].to_pylist())))
    gone = {n: [x] for n, x in zip(known["n"].to_pylist(), known["gone"].to_pylist()) if x}
    for rows, sizes, hashes in zip(*(rest[c].to_pylist() for c in ("rows", "sizes", "gone"))):
        ends = 8 * np.cumsum(np.frombuffer(sizes, "<i4"))
        for n, a, b in zip(_summed(rows).tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            gone.setdefault(n, []).append(hashes[a:b])
    ids, keys = (pa.array([own[n][i] for n in gone], pa.int64()) for i in (0, 1))
    return pa.table([ids, keys, pa.array([b"".join(x) for x in gone.values()], pa.binary())], ["id", "key", "gone"])


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, key, gone): packed hashes of the windows to remove, for documents that lose any. key: XXH64 of id and text."""
    spark = docs.sparkSession
    given = docs.select(F.monotonically_increasing_id().alias("n"), F.col(doc_id).cast("long").alias("id"), _key(doc_id, text).alias("key"), F.col(text).cast("string").alias("text"))
    # a window takes six bytes of text or so
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = min((1 << 31) - 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 // BUCKET_WINDOWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, none = utf8(batch.column(3)), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            n, keys = (batch.column(i).to_numpy() for i in (0, 2))
            ids = batch.column(1).fill_null(LAST).to_numpy()
            for a, b in runs([len(t) for t in texts], CHUNK_BYTES):
                yield _chunk(n[a:b], ids[a:b], keys[a:b], none[a:b], texts[a:b], window, buckets)

    found = given.mapInArrow(run, DEALT).groupBy("bucket").applyInArrow(_bucket, FOUND)
    return found.groupBy("block").applyInArrow(_block, "id long, key long, gone binary").dropDuplicates(["id", "key"])


def _key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def intervals(tokens: np.ndarray, gone: np.ndarray, window: int) -> np.ndarray:
    """(start, end) of the maximal runs of words that the windows with these hashes cover."""
    at = np.flatnonzero(np.isin(rolled(tokens, window, BASES[0]), gone))
    begin = np.flatnonzero(np.concatenate([[True], np.diff(at) > window])) if len(at) else at
    return np.stack([at[begin], at[np.append(begin[1:], len(at)) - 1] + window], axis=1) if len(at) else np.empty((0, 2), np.int64)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, names: tuple[str, str, str] = ("__words", "__spans", "__kept")) -> DataFrame:
    """All rows and columns, then the number of words, the removed intervals of words, and the kept words joined by a space."""
    if {*names} & {*docs.columns}:
        raise ValueError(f"the table has one of the columns {', '.join(names)}: name the new ones otherwise")
    plain = plain_names(docs)
    at = dict(zip(docs.columns, plain.columns))
    doc_id, text = at[doc_id], at[text]
    gone = cut(removals(plain, doc_id, text, window))
    keyed = plain.withColumn("key", _key(doc_id, text))
    maybe = marked(keyed, "key", bitmap(gone, "key", MARK_BITS), MARK_BITS, "maybe")
    whole = maybe.filter(~F.col("maybe")).select(*plain.columns, F.lit(None).cast("binary").alias("gone"))
    own = F.col("id").eqNullSafe(F.col(doc_id).cast("long"))
    some = maybe.filter("maybe").join(gone.withColumnRenamed("key", "gone_key").hint("shuffle_hash"), (F.col("key") == F.col("gone_key")) & own, "left").select(*plain.columns, "gone")
    own_names = plain.columns
    place = own_names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sets = utf8(batch.column(place).cast(pa.string())), batch.column(len(own_names))
            for a, b in runs([len(t) for t in texts], CHUNK_BYTES):
                counts, spans, kept = [], [], []
                for t, hashes in zip(texts[a:b], sets.slice(a, b - a).to_pylist()):
                    words = [w for piece in word_pieces(t) for w in piece]
                    cuts = intervals(word_hashes(t), np.frombuffer(hashes, "<u8"), window).tolist() if hashes else []
                    counts.append(len(words))
                    spans.append([{"start": s, "end": e} for s, e in cuts])
                    for s, e in reversed(cuts):
                        del words[s:e]
                    kept.append(b" ".join(words))
                columns = [c.slice(a, b - a) for c in batch.columns[:-1]]
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                new = [pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *new], [*own_names, "words", "spans", "kept"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(plain.columns, plain.schema.fields))
    out = whole.union(some).mapInArrow(run, f"{fields}, words long, spans array<struct<start:long,end:long>>, kept string")
    return out.toDF(*docs.columns, *names)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", F.col("__words").alias("n_words"), removed.alias("n_removed"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), wins AS (
    SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS win
    FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 48))) AS i FROM w)
), first_seen AS (
    SELECT win, min(doc_id) AS first_id FROM wins GROUP BY win
), gone AS (
    SELECT wins.doc_id, wins.i FROM wins JOIN first_seen USING (win) WHERE wins.doc_id > first_id
), each AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), covered AS (
    SELECT e.doc_id, e.i, e.word,
        count(g.i) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS removed
    FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i
), texts AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept
    FROM covered GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN texts USING (doc_id)
"""
