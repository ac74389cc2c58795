"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ORDER bytes. All training texts are counted: tasks count
the (ORDER + 1)-grams of their texts, shorter grams follow from these, and one shuffle sums them. Every
counted gram is kept, so what is learnt grows with the corpus. No machine holds the trie: it lies in the
shared folder and is dealt by the last NEAR bytes of the context. All longer contexts that end alike are
in one part, shorter ones, of which there are at most 256^NEAR, are known to every part, and so a part
codes its symbols through all escapes alone.

The probability of a symbol depends on its (ORDER + 1)-gram only. Grams with at least 1 / HOT_GRAMS of all
symbols, of which there are at most HOT_GRAMS, are looked up on the spot; the others are joined to their
logarithms, one row for each text and gram, and each different gram is coded once.

A symbol is coded in the longest context that the trie has. Escape estimation is method C. After an
escape the symbols of the longer context are excluded from the shorter one. What is excluded depends on
the longer context alone, since the symbols seen after it were seen after its suffix too, so every
context's sums with exclusion are computed once. Symbols that no context has are uniform over those not
excluded. Where TRIE_SHARE is set, grams of less than that share of the symbols are dropped, and their
occurrences are added to the escape weight.

Texts are coded in UTF-8 with A-Z lower-cased, from a start mark to an end mark; null counts as empty.
Scores are base-10 logarithms of probabilities; the code length in bits is -score / log10(2).

The unigram base counts every token of the training texts. Tokens with at least 1 / HOT_SHARE of all
occurrences, of which there are at most HOT_SHARE, are looked up on the spot; the others are joined to
the counts, one row for each text and token. Tokens are named by 64-bit hashes. Rows of equal id and text
are scored each; an empty table gives an empty result; without training rows all is uniform. Texts of any
length are coded whole, in segments. Scores have no ties to break. Only the id and text columns are read, so
others may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, crc_bucket, cut, read, runs, utf8

ORDER, HOT_SHARE, HOT_GRAMS = 5, 1 << 20, 1 << 22
#: A gram of less than 1 / TRIE_SHARE of all symbols is dropped; None drops nothing.
TRIE_SHARE: int | None = None
#: Bytes at the end of a context by which the trie is dealt, and grams of a part.
NEAR, PART_GRAMS = 3, 200_000
START, END = 0xFE, 0xFF  # bytes that UTF-8 doesn't have
SYMBOLS = 256
#: Grams that a counting task holds before it hands them on.
HELD_GRAMS = 1_000_000
CACHED_WORDS = 200_000
#: Bytes of text whose grams a worker holds as arrays at one time.
SEGMENT_BYTES = CHUNK_BYTES // 2

_ONE = np.uint64(1)


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, text of each): the ORDER + 1 bytes that end at each symbol, by segments of bounded size."""
    todo: list[tuple[int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        whole = bytes([START] * ORDER) + t.lower() + bytes([END])
        for at in range(0, len(whole) - ORDER, SEGMENT_BYTES):
            part = whole[at : at + SEGMENT_BYTES + ORDER]
            if todo and size + len(part) > SEGMENT_BYTES:
                yield _grams(todo)
                todo, size = [], 0
            todo.append((i, part))
            size += len(part)
    if todo:
        yield _grams(todo)


def _grams(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for _, p in parts], np.int64)
    n = int(sizes.sum()) - ORDER
    # eight bytes from every place on, the first one highest, of which a gram has the first
    raw = b"".join([*(p for _, p in parts), bytes(8 - ORDER - 1)])
    key = (np.ndarray((n,), ">u8", raw, strides=(1,)) >> np.uint64(64 - 8 * (ORDER + 1))).astype(np.uint64)
    inside = np.ones(n + ORDER, bool)
    for j, s in enumerate(np.cumsum(sizes) - sizes):
        inside[s : s + ORDER] = False
    owner = np.repeat(np.array([i for i, _ in parts]), sizes - ORDER)
    return key[inside[ORDER:]], owner


def _merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    if not len(key):
        return key, n
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _counted(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, count) of the different pairs, in order of owner; so are the owners given."""
    if not len(key):
        return owner, key, np.empty(0, np.int64)
    shift = np.uint64(8 * (ORDER + 1))
    bases = np.arange(owner[0], owner[-1] + 1, 1 << (64 - int(shift)))  # owner and gram share 64 bits
    cuts, out = [*np.searchsorted(owner, bases).tolist(), len(owner)], []
    for base, a, b in zip(bases.tolist(), cuts, cuts[1:]):
        both = np.sort(((owner[a:b] - base).astype(np.uint64) << shift) | key[a:b])
        first = np.flatnonzero(np.concatenate([np.ones(min(1, b - a), bool), both[1:] != both[:-1]]))
        out.append(((both[first] >> shift).astype(np.int64) + base, both[first] & ((_ONE << shift) - _ONE), np.diff(np.append(first, b - a))))
    return tuple(np.concatenate(x) for x in zip(*out))


def _all_orders(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Grams of every length from the longest; the length stands in the top byte."""
    keys, counts = [key | np.uint64((ORDER + 1) << 56)], [n]
    for m in range(ORDER, 0, -1):
        key, n = _merged(key & np.uint64((1 << 8 * m) - 1), n)
        keys.append(key | np.uint64(m << 56))
        counts.append(n)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts))], ["gram", "n"])


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n) over all texts of a one-column table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for grams, _ in _segments(utf8(batch.column(0))):
                new, counts = np.unique(grams, return_counts=True)
                key, n = _merged(np.concatenate([key, new]), np.concatenate([n, counts.astype(np.int64)]))
                if len(key) > HELD_GRAMS:
                    yield _all_orders(key, n)
                    key, n = key[:0], n[:0]
        yield _all_orders(key, n)

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Table:
    """Read-only map from 64-bit keys (not 0) to their ranks in the given order, looked up by array."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.slots = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        left, h = np.arange(len(keys)), self._hash(keys)
        while len(left):
            free = self.slots[h] == 0
            _, first = np.unique(h[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slots[h[won]], self.at[h[won]] = keys[left[won]], left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, h = left[rest], (h[rest] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Ranks, -1 where a key is absent."""
        h = self._hash(keys)
        slot = self.slots[h]
        out = np.where(slot == keys, self.at[h], -1)
        open_ = np.flatnonzero((slot != keys) & (slot != 0))
        while len(open_):
            h[open_] = (h[open_] + 1) & ((1 << self.bits) - 1)
            slot = self.slots[h[open_]]
            hit = slot == keys[open_]
            out[open_[hit]] = self.at[h[open_[hit]]]
            open_ = open_[~hit & (slot != 0)]
        return out


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


@dataclass
class Model:
    """top: longest grams and their log-probabilities; grams: all grams and log-counts; nodes: contexts.

    Of a context, ``plain`` is (log denominator, log escape) when coding starts there, ``after`` the same
    of its suffix context with this context's symbols excluded.
    """

    top: Table
    top_log: np.ndarray
    grams: Table
    gram_log: np.ndarray
    nodes: Table
    plain: np.ndarray
    after: np.ndarray
    floor: float

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of the last byte of each gram after the bytes before it."""
        at = self.top.get(keys | np.uint64((ORDER + 1) << 56))
        out = self.top_log[at]
        todo = np.flatnonzero(at < 0)
        acc, behind, keys = np.zeros(len(todo)), np.full(len(todo), -1, np.int64), keys[todo]
        for k in range(ORDER, -1, -1):
            gram = (keys & np.uint64((1 << 8 * (k + 1)) - 1)) | np.uint64((k + 1) << 56)
            context = ((keys >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1)) | np.uint64((k + 1) << 56)
            node = self.nodes.get(context)
            here = node >= 0
            values = np.where((behind >= 0)[:, None], self.after[behind], self.plain[node])
            g = self.grams.get(gram)
            done = here & (g >= 0)
            out[todo[done]] = acc[done] + self.gram_log[g[done]] - values[done, 0]
            acc[here] += values[here, 1]
            behind[here] = node[here]
            rest = ~done
            todo, acc, behind, keys = todo[rest], acc[rest], behind[rest], keys[rest]
        out[todo] = acc + self.floor
        return out


def _contexts(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context of each gram, named by the gram's length, and where each begins; grams in order."""
    context = ((gram & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | (gram & np.uint64(0xFF << 56))
    return context, np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))


def build(gram: np.ndarray, n: np.ndarray, least: int = 1) -> Model:
    """The model of all grams (length in the top byte) after the contexts at hand; those below the least count are dropped."""
    order = np.argsort(gram)
    gram, n = gram[order], n[order].astype(np.float64)
    if not len(gram):
        none = Table(np.empty(0, np.uint64))
        return Model(none, np.zeros(1), none, np.zeros(1), none, np.zeros((1, 2)), np.zeros((1, 2)), -float(np.log10(SYMBOLS)))
    context, first = _contexts(gram)
    total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(gram))))
    keep = n >= least
    gram, n, total = gram[keep], n[keep], total[keep]
    context, first = _contexts(gram)
    grams = Table(gram)
    length = (gram >> np.uint64(56)).astype(np.int64)
    body = gram & np.uint64((1 << 56) - 1)
    name = context[first]
    size = length[first] - 1
    bare = name & np.uint64((1 << 56) - 1)
    total = total[first]
    kept = np.add.reduceat(n, first)
    distinct = np.diff(np.append(first, len(gram))).astype(np.float64)
    plain = np.stack([_log(total + distinct), _log((total - kept + distinct) / (total + distinct))], axis=1)
    nodes = Table(name)
    mask = lambda bits: (_ONE << (8 * np.maximum(bits, 0)).astype(np.uint64)) - _ONE
    suffix = grams.get((body & mask(length - 1)) | ((length - 1).astype(np.uint64) << np.uint64(56)))
    excluded = np.add.reduceat(np.where(suffix >= 0, n[suffix], 0.0), first)
    parent = nodes.get((bare & mask(size - 1)) | (size.astype(np.uint64) << np.uint64(56)))
    left = total[parent] - excluded + distinct[parent] - distinct
    escape = total[parent] - kept[parent] + distinct[parent] - distinct
    after = np.stack([_log(left), np.where(left > 0, _log(escape / np.maximum(left, 1e-300)), 0.0)], axis=1)
    top = length == ORDER + 1
    where = np.repeat(np.arange(len(first)), distinct.astype(np.int64))
    root = np.flatnonzero(size == 0)
    free = SYMBOLS - (distinct[root[0]] if len(root) else 0)
    return Model(
        Table(gram[top]), np.append(_log(n[top]) - plain[where[top], 0], 0.0), grams, _log(n), nodes, plain, after,
        -float(np.log10(max(free, 1))),
    )


def _least(symbols: int) -> int:
    return 1 if TRIE_SHARE is None else max(1, -(-symbols // TRIE_SHARE))


def fit(texts: DataFrame) -> Model:
    """The whole model of a one-column table of training texts that one machine can hold."""
    got = count_grams(texts).toArrow()
    gram, n = got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy()
    return build(gram, n, _least(int(n[gram >> np.uint64(56) == 1].sum())))


def _length() -> Column:
    return F.shiftright("gram", 56)


def _part(parts: int) -> Column:
    """The part of the trie that has the context of a gram longer than NEAR."""
    return F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND((1 << 8 * NEAR) - 1)), F.lit(parts)).cast("int")


def hot_grams(counts: DataFrame, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest grams with at least 1 / HOT_GRAMS of all symbols and their log-probabilities."""
    least = _least(symbols)
    hot = F.when(F.col("n") >= max(least, -(-symbols // HOT_GRAMS)), F.struct("gram", "n"))
    by_context = counts.filter(_length() == ORDER + 1).groupBy(F.shiftright("gram", 8).alias("context")).agg(
        F.sum("n").alias("total"), F.count_if(F.col("n") >= least).alias("kinds"), F.collect_list(hot).alias("hot")
    )
    got = by_context.select(F.explode("hot").alias("x"), (F.col("total") + F.col("kinds")).alias("below")).select("x.gram", "x.n", "below").toArrow()
    return got["gram"].to_numpy().view(np.uint64), np.log10(got["n"].to_numpy() / got["below"].to_numpy())


def gram_logs(counts: DataFrame, wanted: DataFrame, symbols: int) -> DataFrame:
    """(gram, log) of the wanted (ORDER + 1)-grams, each coded once by the part of the trie that has its contexts."""
    least = _least(symbols)
    near = counts.filter(_length() <= NEAR).toArrow()  # at most 256^NEAR grams of a length
    shared = counts.sparkSession.sparkContext.broadcast((near["gram"].to_numpy().view(np.uint64), near["n"].to_numpy()))
    far = counts.filter(_length() > NEAR)
    parts = max(64, far.count() // PART_GRAMS)

    def code(wanted: pa.Table, own: pa.Table) -> pa.Table:
        gram, n = shared.value
        names = wanted["gram"].to_numpy()
        logs = np.empty(0)
        if len(names):
            model = build(np.concatenate([gram, own["gram"].to_numpy().view(np.uint64)]), np.concatenate([n, own["n"].to_numpy()]), least)
            logs = model.score(names.view(np.uint64) & np.uint64((1 << 56) - 1))
        return pa.table({"gram": pa.array(names, pa.int64()), "log": pa.array(logs, pa.float64())})

    dealt = wanted.select(_part(parts).alias("part"), "gram").groupBy("part")
    return dealt.cogroup(far.select(_part(parts).alias("part"), "gram", "n").groupBy("part")).applyInArrow(code, "gram long, log double")


def _lists(sizes: list[int] | np.ndarray, keys: list[int] | np.ndarray, counts: list[int] | np.ndarray) -> list[pa.ListArray]:
    """The keys and the counts of every row as two flat lists, which take less room than structs."""
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(np.asarray(keys).astype(np.int64))), pa.ListArray.from_arrays(at, pa.array(np.asarray(counts).astype(np.int32)))]


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, n): 64-bit names and counts of all words of a one-column table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            names = np.array([xxhash.xxh3_64_intdigest(w) for w in held], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(held.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for t in utf8(batch.column(0)):
                held.update(t.lower().split())
                if len(held) > CACHED_WORDS:
                    yield out()
                    held.clear()
        yield out()

    return texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row, learnt from the training rows."""
    spark = docs.sparkSession
    learnt = training.select(F.col(text).cast("string").alias("text"))
    vocabulary = cut(count_tokens(learnt))
    sums = vocabulary.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    ends = learnt.count()
    counts = cut(count_grams(learnt))
    symbols = counts.filter(_length() == 1).agg(F.sum("n")).first()[0] or 0
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    below = total + 0.5 * (distinct + 1)
    hot = vocabulary.filter(F.col("n") * HOT_SHARE >= total).toArrow()  # at most HOT_SHARE tokens
    name = hot["token"].to_numpy()
    order = np.argsort(name)
    shared = spark.sparkContext.broadcast((name[order], np.log10((hot["n"].to_numpy()[order] + 0.5) / below), *hot_grams(counts, symbols)))
    end_log = float(np.log10((ends + 0.5) / below))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs, hot, hot_log = shared.value
        table, hot_log = Table(hot), np.append(hot_log, 0.0)
        cache: dict[bytes, tuple[int, float]] = {}  # name and log-probability, 1 for a token that isn't hot

        def look_up(words: list[bytes]) -> None:
            got = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)
            at = np.searchsorted(names, got)
            known = np.zeros(len(got), bool)
            inside = at < len(names)
            known[inside] = names[at[inside]] == got[inside]
            value = np.ones(len(got))
            value[known] = logs[at[known]]
            cache.update(zip(words, zip(got.tolist(), value.tolist())))

        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in runs([len(t) for t in texts], SEGMENT_BYTES):
                some = texts[a:b]
                model_log, others, size = np.zeros(len(some)), [], np.zeros(len(some), np.int64)
                for grams, owner in _segments(some):
                    at = table.get(grams | np.uint64((ORDER + 1) << 56))
                    model_log += np.bincount(owner, weights=hot_log[at], minlength=len(some))
                    mine, key, n = _counted(owner[at < 0], grams[at < 0])
                    size += np.bincount(mine, minlength=len(some))  # owners come in order
                    others.append((key, n))
                keys, ns = (np.concatenate([x[k] for x in others] or [np.empty(0, np.int64)]) for k in (0, 1))
                grams_of = _lists(size, keys, ns)
                counted = [Counter(t.lower().split()) for t in some]
                if len(cache) > CACHED_WORDS:
                    cache.clear()
                look_up(list({w for x in counted for w in x if w not in cache}))
                n_tokens, n_known, base, rare = [], [], [], []
                for x in counted:
                    s, k, r, n_all = end_log, int(ends > 0), [], 1
                    for w, n in x.items():
                        token, value = cache[w]
                        n_all += n
                        if value <= 0:
                            s += n * value
                            k += n
                        else:
                            r.append((token, n))
                    n_tokens.append(n_all)
                    n_known.append(k)
                    base.append(s)
                    rare.append(r)
                flat = [p for r in rare for p in r]
                lists = _lists([len(r) for r in rare], [t for t, _ in flat], [n for _, n in flat])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(model_log), *lists, *grams_of],
                    ["doc_id", "n_tokens", "n_known", "base", "score", "rare", "rare_n", "others", "others_n"],
                )

    kind = own.schema["doc_id"].dataType.simpleString()
    scored = own.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base double, score double, rare array<long>, rare_n array<int>, others array<long>, others_n array<int>")
    rows = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.rare_n").alias("times"))
    found = rare.join(vocabulary, "token", "left").select(
        "row", "times", F.coalesce("n", F.lit(0)).alias("n")
    )
    added = cut(
        found.groupBy("row").agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / below)).alias("more"),
        )
    )
    others = rows.select("row", F.explode(F.arrays_zip("others", "others_n")).alias("x")).select("row", F.col("x.others").alias("gram"), F.col("x.others_n").alias("times"))
    # tables from files on both sides: adaptive execution splits the partition of a gram that many texts have
    logs = cut(gram_logs(counts, others.select("gram").distinct(), symbols))
    coded = cut(others.join(logs, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("coded")))
    return rows.drop("rare", "rare_n", "others", "others_n").join(added, "row", "left").join(coded, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("coded", F.lit(0.0))).alias("score"),
    )


def op2_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    training = docs.filter(F.coalesce(crc_bucket("doc_id", 5) != 1, F.lit(True)))
    held = F.coalesce(crc_bucket("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return score(docs, training).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
