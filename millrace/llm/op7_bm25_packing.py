"""Packing of token sequences by lexical retrieval from a sharded BM25 index.

Every text becomes token ids with a closing id. Document frequencies of token ids are counted over all
documents; the table is as long as the vocabulary. A document's shard follows from one of its heaviest
BM25 terms, chosen by a hash order so that documents with like terms tend to choose the same one; the
tokens by chosen term, again a table as long as the vocabulary, are dealt to shards of equal size, and a
term with more than a shard's share is spread over several. Each shard holds a BM25 inverted index of
its documents, with the statistics of all. From a seed document the index returns the unused neighbours,
best first, which fill the seed's window; the document that crosses the end of a window is cut there, and
its rest opens the next window as the seed. When no unused neighbour is left, the next unused document
is the seed. The last window of a shard is cut into sequences whose lengths are powers of two, which
need no padding, so nothing is padded at all.

Null and empty texts have the closing id alone. Texts of any length are cut over as many windows as they
need. Repeated rows are packed each. Null ids keep their rows. An empty table gives an empty result. Of
neighbours with equal scores the first by id, then by content goes first, as do seeds. Only the id and text
columns are read, so others may have any names.

A seed is looked up by all its terms, so within its shard no neighbour is missed; README says what share of the best
neighbours of the whole index lies there.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import ranks_of_json
from .common import cut, read, runs

WINDOW, END_ID = 2048, 1
#: Ids are held in 16 bits; tables by term have this many entries.
TERMS = 1 << 16
#: Tokens of a shard; a row counts as ROW_TOKENS more, so that short documents don't crowd a shard.
SHARD_TOKENS, ROW_TOKENS = 1 << 19, 128
#: BM25 parameters, and the heaviest terms that may name a shard.
K1, B, KEY_TERMS = 1.2, 0.75, 8

#: Encoders of this worker process by vocabulary file.
_LIBRARIES: dict[str, tiktoken.Encoding] = {}


def library(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a JSON file with its added tokens, which have their ids inside text too."""
    if path not in _LIBRARIES:
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        ranks, added = ranks_of_json(spec), {x["content"]: x["id"] for x in json.loads(spec).get("added_tokens", [])}
        if max([*ranks.values(), *added.values()]) >= TERMS:
            raise ValueError(f"ids of {path} don't fit 16 bits")
        _LIBRARIES[path] = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return _LIBRARIES[path]


def tokenise(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (packed little-endian unsigned 16-bit, the closing id included)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = library(path, pattern).encode_to_numpy, np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            ids = [encode(t or "", allowed_special="all").astype("<u2").tobytes() + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids binary")


def _postings(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of distinct terms in order of document and term, and lengths."""
    sizes = np.array([len(x) // 2 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), "<u2").astype(np.int64)
    key = np.sort(np.repeat(np.arange(len(ids)) * TERMS, sizes) + flat)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[first] // TERMS, key[first] % TERMS, np.diff(np.append(first, len(key))), sizes


def _by_term(tokens: DataFrame, run: Callable) -> np.ndarray:
    """Sums by term of what each task has summed; the result is as long as the vocabulary."""
    got = tokens.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TERMS, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def _sums(own: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(own)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(own[at])], ["term", "n"])


def _weights(tf: np.ndarray, idf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _keys(ids: list[bytes], idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """The term that names each document's shard, and its load."""
    doc, term, n, sizes = _postings(ids)
    weight = _weights(n, idf[term], sizes[doc], mean)
    # by document, then weight down; places of equal weight are in order of term already
    down = np.uint64(0xFFFFFFFF) - weight.astype(np.float32).view(np.uint32).astype(np.uint64)
    order = np.argsort((doc.astype(np.uint64) << np.uint64(32)) | down, kind="stable")
    doc, term = doc[order], term[order]
    first = np.searchsorted(doc, np.arange(len(ids)))
    heavy = np.arange(len(doc)) - first[doc] < KEY_TERMS
    doc, term = doc[heavy], term[heavy]
    draw = (term.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    order = np.lexsort((draw, doc))
    return term[order][np.searchsorted(doc[order], np.arange(len(ids)))], sizes + ROW_TOKENS


def _deal(load: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of every term, so that a shard's load is about the share."""
    count = np.maximum(1, -(-load // share))
    first, at, used = np.zeros(TERMS, np.int64), 0, 0
    for t in np.argsort(-load, kind="stable").tolist():
        if not load[t]:
            break
        if count[t] > 1:
            first[t], at = at, at + int(count[t])
            continue
        if used + load[t] > share and used:
            at, used = at + 1, 0
        first[t] = at
        used += int(load[t])
    return first, count


def arrange(ids: list[bytes], idf: np.ndarray, mean: float) -> list[int]:
    """The order in which one shard's documents are laid end to end."""
    doc, term, n, sizes = _postings(ids)
    weight = _weights(n, idf[term], sizes[doc], mean)
    of = np.searchsorted(doc, np.arange(len(ids) + 1))
    inverted = np.lexsort((doc, term))
    p_doc, p_weight = doc[inverted], weight[inverted]
    begin = np.searchsorted(term[inverted], np.arange(TERMS + 1))
    unused, order, at, next_doc = np.ones(len(ids), bool), [], 0, 0
    while True:
        if not order or at % WINDOW == 0 or not found:
            while next_doc < len(ids) and not unused[next_doc]:
                next_doc += 1
            if next_doc == len(ids):
                return order
            seed = next_doc
            order.append(seed)
            unused[seed] = False
            at += int(sizes[seed])
            if at % WINDOW == 0:
                continue
        else:
            seed = order[-1]
        own = term[of[seed] : of[seed + 1]]
        n_hits = begin[own + 1] - begin[own]
        hit = np.repeat(begin[own] - (np.cumsum(n_hits) - n_hits), n_hits) + np.arange(n_hits.sum())
        score = np.bincount(p_doc[hit], weights=p_weight[hit], minlength=len(ids)) * unused
        near = np.flatnonzero(score > 0)
        found, window = False, at // WINDOW
        for d in near[np.argsort(-score[near], kind="stable")].tolist():
            order.append(d)
            unused[d] = False
            at += int(sizes[d])
            if at // WINDOW != window:
                found = True  # it crosses the end: its rest opens the next window
                break


def lay_out(sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset) of the pieces of documents laid end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    starts = [*range(0, total - total % WINDOW + 1, WINDOW)]
    at, rest = starts[-1], total % WINDOW
    while rest:  # powers of two, the largest first
        at += 1 << (rest.bit_length() - 1)
        rest -= 1 << (rest.bit_length() - 1)
        starts.append(at)
    bounds = np.array(starts)  # of sequences; the last is the total
    cuts = np.unique(np.concatenate([[0], ends, bounds]))
    left, right = cuts[:-1], cuts[1:]
    document = np.searchsorted(ends, left, side="right")
    sequence = np.searchsorted(bounds, left, side="right") - 1
    return document, left - (ends - sizes)[document], right - left, sequence, left - bounds[sequence]


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(tokens: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents (doc_id, packed ids): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    context = tokens.sparkSession.sparkContext
    total = tokens.agg(F.count("*").alias("n"), F.sum(F.octet_length("ids") / 2).alias("tokens")).first()
    n_docs, mean = total["n"], (total["tokens"] or 1) / max(1, total["n"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(TERMS, np.int64)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for a, b in runs([len(x) for x in ids]):
                own += np.bincount(_postings(ids[a:b])[1], minlength=TERMS)
        yield _sums(own)

    df = _by_term(tokens, frequencies)
    idf = context.broadcast(np.log1p((n_docs - df + 0.5) / (df + 0.5)))  # as long as the vocabulary

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(TERMS, np.int64)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for a, b in runs([len(x) for x in ids]):
                key, load = _keys(ids[a:b], idf.value, mean)
                np.add.at(own, key, load)
        yield _sums(own)

    dealt_out = _deal(_by_term(tokens, loads), shard_tokens)
    shards, n_shards = context.broadcast(dealt_out), int((dealt_out[0] + dealt_out[1]).max())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count = shards.value
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for a, b in runs([len(x) for x in ids]):
                key, _ = _keys(ids[a:b], idf.value, mean)
                # documents of a term with several shards are dealt by id and content, alike in every attempt
                draw = np.array([zlib.crc32(str(d).encode(), zlib.crc32(x)) for d, x in zip(batch.column(0).slice(a, b - a).to_pylist(), ids[a:b])])
                shard = first[key] + draw % count[key]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)], ["shard", "doc_id", "ids"]
                )

    def fill(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        ids = shard["ids"].to_pylist()
        order = arrange(ids, idf.value, mean)
        sizes = np.array([len(ids[d]) // 2 for d in order], np.int64)
        document, start, length, sequence, offset = lay_out(sizes)
        rows = np.array(order)[document]
        wide = {d: np.frombuffer(ids[d], "<u2").astype("<u4").tobytes() for d in order}
        crc = [zlib.crc32(wide[d][4 * s : 4 * (s + n)]) for d, s, n in zip(rows.tolist(), start.tolist(), length.tolist())]
        return pa.table(
            {
                "doc_id": shard["doc_id"].take(pa.array(rows)),
                "start": start,
                "length": length,
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": sizes[document],
                "sequence_id": (shard["shard"][0].as_py() << 32) + sequence,
                "offset": offset,
            }
        )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    dealt = tokens.mapInArrow(deal, f"shard long, doc_id {kind}, ids binary")
    # as many partitions as shards, so that no task's share grows with the corpus
    return dealt.repartition(n_shards, "shard").groupBy("shard").applyInArrow(fill, f"doc_id {kind}, {PIECE}")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document that the stages before have kept."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(cut(tokenise(docs, path, public_tokenizers.PATTERN)))


def op7_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, read(spark, sf_dir, "documents"), sf_dir)
