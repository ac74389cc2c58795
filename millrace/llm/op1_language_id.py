"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table of slots holds the filters of all languages, a bit of a slot for each filter. Looking up an
n-gram ANDs its slots, which gives the mask of every language whose filter contains it. A language has two
filters: one holds every n-gram of its sample, however rare or shared; the other those that it has at least
MIN_SHARE as often as the language that has them most, so that foreign words and wrong labels weigh less.
Per filter the set bits are counted over a text and the expected false positives (fill ** probes) are taken
off. The largest sum of a language's two counts decides, ties go to the language that sorts first; the score
is the corrected share of the text's n-grams that the first filter has.

The filters are fitted on a bounded sample of the labelled rows: ``sample_docs`` expected rows of
each language, chosen by a hash of the row. Every row is then predicted from its whole text. Labels are
few (at most MOST_LANGS, else an error), so their list and the table of slots are small on any corpus.

Null texts and texts without a letter give ``und`` and score 0. A text whose n-grams are in no filter
gets the first language and score 0. With no labelled row at all every text is ``und``. Texts of any length
are read whole. Rows with a null id are predicted like any other; repeated rows give repeated results. An
empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, read, runs, utf8

#: Expected labelled rows of each language in the fitting sample.
SAMPLE_DOCS = 2000
GRAM, PROBES, SLOT_BITS = 4, 3, 20
#: Labels at most: two filters of each in words of 63 and 2^SLOT_BITS slots of 8 bytes make 264 MB, which is what the
#: driver holds and broadcasts at worst; a column with more labels is none of languages.
MOST_LANGS = 1 << 10
#: Share of an n-gram's largest rate in any language from which it enters a language's second filter.
MIN_SHARE = 0.25
UND = "und"

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_LETTERS = bytes(
    (c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class Filters:
    """slots: (words, 2 ** SLOT_BITS) masks, 63 filters a word, the languages' first, then their second ones.

    noise: each filter's false-positive rate.
    """

    langs: tuple[str, ...]
    slots: np.ndarray
    noise: np.ndarray


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of normalised texts as integers, and the text each comes from.

    A-Z are lower-cased, other ASCII bytes become spaces, runs of spaces become one, and a space
    stands before and after each text.
    """
    plain = [t.translate(_LETTERS).strip(b" ") for t in texts]
    raw = np.frombuffer(b" ".join([b"", *plain, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in plain], np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    owner = np.append(owner, np.int32(len(texts) - 1))  # the last space
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    keep[np.cumsum(sizes) - sizes] = True  # the space before each text
    raw, owner = raw[keep], owner[keep]
    if len(raw) < GRAM:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    grams = np.zeros(len(raw) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams |= raw[i : len(raw) - GRAM + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    # the space after a text stands before the next one, so a window may end on the next text's space
    whole = owner[: len(grams)] == owner[GRAM - 2 : GRAM - 2 + len(grams)]
    return grams[whole], owner[: len(grams)][whole]


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    return [((grams * np.uint64(m)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in _MULTIPLIERS[:PROBES]]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Filters from rows with a non-null label. Only a slot table of fixed size reaches the driver."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    langs = tuple(sorted(counts))
    if not langs:
        return Filters((), np.zeros((1, 1 << SLOT_BITS), np.int64), np.zeros(0))
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} labels: this is no column of languages")
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_docs / counts[k]))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(draw < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {k: i for i, k in enumerate(langs)}
        for batch in batches:
            texts, labels = utf8(batch.column(0)), np.array([at[x] for x in batch.column(1).to_pylist()], np.int32)
            for a, b in runs([len(t) for t in texts]):
                grams, owner = _grams(texts[a:b])
                key, n = np.unique((grams << np.uint64(16)) | labels[a:b][owner].astype(np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key >> np.uint64(16)).astype(np.int64)), pa.array((key & np.uint64(0xFFFF)).astype(np.int32)), pa.array(n)],
                    ["gram", "l", "n"],
                )

    grams = sample.mapInArrow(count, "gram long, l int, n long").groupBy("gram", "l").agg(F.sum("n").alias("n"))
    size = {r["lang"]: float(max(1, r["n"] or 0)) for r in sample.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    total = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (i, size.get(k, 1.0))])
    rated = grams.select("gram", "l", (F.col("n") / total[F.col("l")]).alias("rate"))
    by_gram = rated.groupBy("gram").agg(F.collect_list(F.struct("l", "rate")).alias("by"), F.max("rate").alias("most"))  # at most one entry a language
    each = by_gram.select("gram", "most", F.explode("by").alias("x"))
    strong = F.when(F.col("x.rate") >= MIN_SHARE * F.col("most"), F.array(F.lit(0), F.lit(len(langs)))).otherwise(F.array(F.lit(0)))
    kept = each.select("gram", F.explode(strong).alias("plane"), "x.l").select("gram", (F.col("l") + F.col("plane")).alias("l"))

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, l = batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(_slots(gram))),
                    pa.array(np.tile(l // 63, PROBES).astype(np.int32)),
                    pa.array(np.tile(np.int64(1) << (l % 63).astype(np.int64), PROBES)),
                ],
                ["slot", "word", "mask"],
            )

    filters = 2 * len(langs)
    table = np.zeros(((filters + 62) // 63, 1 << SLOT_BITS), np.int64)
    got = kept.mapInArrow(to_slots, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table[got["word"].to_numpy(), got["slot"].to_numpy()] = got["mask"].to_numpy()
    fill = np.array([np.mean((table[i // 63] >> (i % 63)) & 1) for i in range(filters)])
    if filters <= 16:
        table = table.astype(np.uint8 if filters <= 8 else np.uint16)  # stays in the cache of a core
    return Filters(langs, table, fill**PROBES)


def score(texts: list[bytes], model: Filters) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, n = model.langs, len(texts)
    preds, scores = [UND] * n, np.zeros(n)
    if not langs:
        return preds, scores
    for a, b in runs([len(t) for t in texts]):
        some = texts[a:b]
        grams, owner = _grams(some)
        at = _slots(grams)
        total = np.maximum(np.bincount(owner, minlength=b - a), 1)
        credit = np.zeros((2 * len(langs), b - a))
        for w, table in enumerate(model.slots):
            mask = table[at[0]]
            for x in at[1:]:
                mask &= table[x]
            for i in range(63 * w, min(len(credit), 63 * w + 63)):
                hits = np.bincount(owner, weights=(mask >> (i % 63)) & 1, minlength=b - a)
                credit[i] = np.clip((hits - total * model.noise[i]) / (1 - model.noise[i] + 1e-12), 0, None)
        best = (credit[: len(langs)] + credit[len(langs) :]).argmax(axis=0)
        for i, t in enumerate(some):
            if _ASCII_LETTER.search(t) or any(c.isalpha() for c in t.decode("utf-8", "replace")):
                preds[a + i] = langs[best[i]]
                scores[a + i] = min(1.0, credit[best[i], i] / total[i])
    return preds, scores


def identify(docs: DataFrame, model: Filters, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, ``lang_pred`` and ``score`` of every row; the text itself is only read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            preds, scores = score(utf8(batch.column(batch.num_columns - 1)), own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(scores)], [*carried, "lang_pred", "score"]
            )

    given = docs.select(*carry, F.col(text).cast("string").alias("__text"))
    carried = list(given.columns[:-1])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(predict, f"{fields}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows to learn from: crc32 of the id modulo 4 is not 2."""
    return docs.filter(F.coalesce(crc_bucket("doc_id", 4) != 2, F.lit(True)))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(training_rows(docs)))
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


#: Texts that no learned language explains at least this far are rejected, as are texts without letters.
KEEP_SCORE = 0.05


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are in some learned language; all their columns, and whole texts."""
    model = fit(training_rows(docs))
    plain = [f"c{i}" for i in range(len(docs.columns))]  # any names may stand beside the operator's own
    out = identify(docs.toDF(*plain), model, text=plain[docs.columns.index("text")], carry=tuple(plain))
    kept = out.filter((F.col("lang_pred") != UND) & (F.col("score") >= KEEP_SCORE))
    return kept.select(*plain).toDF(*docs.columns)
