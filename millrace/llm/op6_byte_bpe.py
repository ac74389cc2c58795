"""Byte-level BPE encoding and decoding by merge replay over the distinct words of the corpus.

Each task cuts its documents into blocks of about BLOCK_BYTES and names the distinct units (``bytebpe``) of
each. The units of all blocks are dealt to shards by their hash, so that all that are equal meet in one
place. There every distinct unit is pretokenized once, the distinct pretokens are encoded by replaying the
merges in rank order over an inverted index (``bytebpe.MergeReplay``), and the ids go back to the blocks
that asked. A block puts its texts together from the ids of its units. Words are independent of each other,
so a shard of the corpus' words gives the ids that all of them would.

Texts move once, compressed by block, and so do the distinct units of a block and their ids: a unit is sent
once a block, however often it stands there. Blocks and shards have bounded sizes, and their numbers grow
with the corpus. Blocks are named by the partition they lie in and their place there. Should a table be dealt
to partitions otherwise when it is read for the second time, a block lacks answers, and encodes those units itself.

Ids are those of the rank file without special tokens; decoding concatenates the bytes of the ids. Null
and empty texts have no ids. Texts of any length are encoded whole; one longer than a block makes a larger
one. Ties, repeated rows and null ids need no care, because every row stands alone. An empty table gives
an empty result. Only the id and text columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import ID, UNIT, MergeReplay, parted, ranks_of_tiktoken, whole
from .common import CHUNK_BYTES, read, runs

#: Bytes of text of a block, of text for each shard of units, and of distinct units that are replayed together.
BLOCK_BYTES, SHARD_BYTES, REPLAY_BYTES = 1 << 24, 1 << 26, 2 * CHUNK_BYTES
#: Shards at least, so that a small table has work for many tasks.
SHARDS = 64

#: Encoders of this worker process by rank file, so that tasks in the same worker share them.
_ENCODERS: dict[tuple[str, str], Codec] = {}


class Codec:
    """Encoder and decoder for the ranks and pretokenizer pattern given."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.pattern = MergeReplay(ranks), regex.compile(pattern)
        self.names = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.names[i] = b
        self.decimals = [b"%d" % i for i in range(len(self.names))]

    def encode(self, units: list[str]) -> list[bytes]:
        """Packed ids of each unit, or of whole texts."""
        pieces = [self.pattern.findall(u) for u in units]
        new = list({p for x in pieces for p in x})
        known = dict(zip(new, self.replay.encode([p.encode("utf-8", "replace") for p in new])))
        return [known[x[0]] if len(x) == 1 else b"".join([known[p] for p in x]) for x in pieces]

    def decode(self, packed: bytes) -> bytes:
        names = self.names
        return b"".join([names[i] for i in np.frombuffer(packed, ID).tolist()])


def codec_at(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path, pattern] = Codec(ranks_of_tiktoken(f), pattern)
    return _ENCODERS[path, pattern]


def distinct_units(texts: Iterable[str]) -> set[str]:
    found, parts = set(), set()
    for t in texts:
        some = parted(t)
        if some is None:
            found.update(UNIT.findall(t))
        else:
            found.add(some[0])
            parts.update(some[1:])
    found.update(map(whole, parts))
    return found


class Block:
    """Finds the values of the units of a text."""

    def __init__(self, units: Iterable[str], values: Iterable):
        self.parts: dict[str, object] = {}  # by what ``parted`` gives for a unit
        self.others: dict[str, object] = {}
        for u, v in zip(units, values):
            if u[0] == "\n":
                self.parts[u] = v
            elif u[0] == " " and u[1:2] != "\n":
                self.parts[u[1:]] = v
            else:
                self.others[u] = v

    def _value(self, unit: str) -> object:
        if unit[0] == "\n":
            return self.parts[unit]
        return self.parts[unit[1:]] if unit[0] == " " and unit[1:2] != "\n" else self.others[unit]

    def __call__(self, text: str) -> list:
        some = parted(text)
        if some is None:
            return list(map(self._value, UNIT.findall(text)))
        return [self.others[some[0]], *map(self.parts.__getitem__, some[1:])]


def _pack(parts: list[bytes]) -> bytes:
    """Byte strings as one, compressed."""
    sizes = np.array([len(parts), *map(len, parts)], ID)
    return zstandard.compress(b"".join([sizes.tobytes(), *parts]), 3)


def _unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, ID, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, ID, n, ID.itemsize), dtype=np.int64) + ID.itemsize * (n + 1)
    out, start = [], ID.itemsize * (n + 1)
    for e in ends.tolist():
        out.append(raw[start:e])
        start = e
    return out


def _text(raw: bytes) -> str:
    return str(raw, "utf-8", "replace")


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[bytes]]]:
    """(name, ids, texts) of the blocks of this task's rows (id, text)."""
    ids, texts, size, nth = [], [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, t in zip(range(len(batch)), batch.column(1).cast(pa.binary()).to_pylist()):
            ids.append(batch.column(0)[i])
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield nth, pa.array(ids, batch.schema.field(0).type), texts
                ids, texts, size, nth = [], [], 0, nth + 1
    if ids:
        yield nth, pa.array(ids, batch.schema.field(0).type), texts


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and the packed ids (little-endian unsigned 32-bit) of every text.

    With ``digests`` the ids are replaced by ids_sha256 and decoded_sha256. The rank file lies at the
    same path on every executor, as an installed package does.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, parts = max(SHARDS, -(-size // SHARD_BYTES)), max(1, -(-size // BLOCK_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in blocks(batches):
            by_shard: dict[int, list[bytes]] = {}
            for u in sorted(distinct_units(map(_text, texts))):  # neighbours are alike, so they compress well
                raw = u.encode("utf-8", "replace")
                by_shard.setdefault(xxhash.xxh3_64_intdigest(raw) % shards, []).append(raw)
            packed = pa.array(map(_pack, by_shard.values()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(by_shard, pa.int64()), pa.array([block] * len(by_shard), pa.int64()), packed], ["shard", "block", "units"])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(batches):
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), listed, pa.array([_pack(texts)], pa.binary())], ["block", "doc_ids", "texts"])

    def replay(shard: pa.Table) -> pa.Table:
        codec, packed = codec_at(path, pattern), shard["units"].to_pylist()
        place: dict[bytes, int] = {}
        rows = []
        for x in packed:
            units = _unpack(x)
            for u in units:
                place.setdefault(u, len(place))
            rows.append([place[u] for u in units])
        ids: list[bytes] = []
        every = list(place)
        for a, b in runs([len(u) for u in every], REPLAY_BYTES):
            ids += codec.encode([_text(u) for u in every[a:b]])
        answers = [_pack([ids[k] for k in row]) for row in rows]
        return pa.table({"block": shard["block"], "units": pa.array(packed, pa.binary()), "answers": pa.array(answers, pa.binary())})

    def finish(given: pa.Table, answers: pa.Table) -> pa.Table:
        codec, texts, known = codec_at(path, pattern), [], {}
        for x, y in zip(answers["units"].to_pylist(), answers["answers"].to_pylist()):
            known.update(zip(map(_text, _unpack(x)), _unpack(y)))
        ids = pa.concat_arrays([x.values for x in given["doc_ids"].chunks] or [pa.array([], given.schema.field("doc_ids").type.value_type)])
        for x in given["texts"].to_pylist():
            texts += map(_text, _unpack(x))
        try:
            columns = put_together(codec, texts, known)
        except KeyError:
            lacking = list(distinct_units(texts) - known.keys())
            columns = put_together(codec, texts, known | dict(zip(lacking, codec.encode(lacking))))
        return pa.table({"doc_id": ids, **columns})

    def put_together(codec: Codec, texts: list[str], known: dict[str, bytes]) -> dict[str, pa.Array]:
        if not digests:
            values = Block(known, known.values())
            ids = [b"".join(values(t)) for t in texts]
            return {"n_tokens": pa.array([len(x) // ID.itemsize for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
        flat = np.frombuffer(b"".join(known.values()), ID).tolist()
        numbers, names = map(codec.decimals.__getitem__, flat), map(codec.names.__getitem__, flat)
        sizes = [len(x) // ID.itemsize for x in known.values()]
        values = Block(known, ((b" ".join(islice(numbers, k)), b"".join(islice(names, k))) for k in sizes))
        del flat, numbers, names, sizes
        n, of_ids, of_bytes = [], [], []
        for t in texts:
            ids, raw = zip(*values(t)) if t else ((), ())  # a text is looked up once for both digests
            ids = b" ".join(ids)
            n.append(ids.count(b" ") + 1 if ids else 0)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(b"".join(raw)).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())}

    kind = own.schema["doc_id"].dataType.simpleString()
    asked = own.mapInArrow(ask, "shard long, block long, units binary")
    # as many partitions as shards and blocks, so that no task's share grows with the corpus
    answers = asked.repartition(shards, "shard").groupBy("shard").applyInArrow(replay, "block long, units binary, answers binary")
    texts = own.mapInArrow(give, f"block long, doc_ids array<{kind}>, texts binary")
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    by_block = lambda df: df.repartition(parts, "block").groupBy("block")
    return by_block(texts).cogroup(by_block(answers)).applyInArrow(finish, f"doc_id {kind}, n_tokens long, {rest}")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_at(path, pattern)
        for batch in batches:
            texts = [codec.decode(p or b"") for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    own = encoded.select("doc_id", "ids")
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, bytes binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)
