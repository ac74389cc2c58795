"""Fill-in-middle transformation of texts, a batch of UTF-8 bytes at a time.

A text is cut into units: runs of A-Z and a-z, and every other code point. Where they begin is seen on the bytes
alone: each byte has a class (letter, continuation of a code point, other), and a unit begins at every byte that
is neither a continuation nor a letter after a letter of the same text. The running count of beginnings over the
whole batch, less its value where a text begins, numbers the units of every text; one search in it finds the cuts
of all texts together. What lies between the cuts is copied as it is, never decoded.

Cuts and form come from the id: h1 to h4 are the first four 8-digit groups of the hex SHA-256 of ``seed:id``, so
a repeated task or another partitioning gives the same. The prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) units, the middle after the larger. A text is left plain if it is empty, holds a mark already, or
h3 % 100 reaches ``rate``; of the others those with h4 % 100 below ``spm_rate`` begin with the suffix.

``restore`` rebuilds the texts from output and form alone: a text that is not plain holds no mark of its own, so
the three marks of its output are those that were put there.

Null texts count as empty and give an empty, plain output. A null id is hashed as ``null``; rows of equal id are
cut by the same numbers. An empty table gives an empty result. Long texts are cut whole, with about eight bytes
of work for each of theirs; there is no shuffle. Any other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, plain_names, read, runs

SEED = "1"
#: Of 100 texts those that are transformed, and of these those in which the suffix comes first.
RATE, SPM_RATE = 90, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

LETTER, REST, OTHER = 1, 2, 0
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[128:192] = REST


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of an Arrow column, null as empty."""
    given = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(given.buffers()[1], np.int64)[given.offset : given.offset + len(given) + 1]
    data = np.frombuffer(given.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a mark begins that lies in one text."""
    middle = data[1:-1]
    found = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]) & ((middle == PREFIX[1]) | (middle == SUFFIX[1]) | (middle == MIDDLE[1]))) if len(data) > 2 else np.empty(0, np.int64)
    end = offsets[np.searchsorted(offsets, found, side="right")]
    return found[found + 3 <= end]


def units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Running count over all bytes of the units that have begun."""
    kind = CLASS[data]
    after_letter = np.zeros(len(data), bool)
    after_letter[1:] = kind[:-1] == LETTER
    after_letter[offsets[:-1][offsets[:-1] < len(data)]] = False
    begins = (kind != REST) & ~((kind == LETTER) & after_letter)
    return np.cumsum(begins, dtype=np.int32 if len(data) < 1 << 31 else np.int64)


def _before(running: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The running count ahead of each place."""
    return np.where(at > 0, running[np.maximum(at, 1) - 1], 0).astype(np.int64) if len(running) else np.zeros(len(at), np.int64)


def cuts(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, rate: int = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, whether plain, end of the prefix, end of the middle) of every text, in bytes of the batch."""
    running = units(data, offsets)
    base, end = _before(running, offsets[:-1]), offsets[1:]
    n = _before(running, end) - base
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    first, second = (np.minimum(np.searchsorted(running, base + k + 1), end) for k in (np.minimum(a, b), np.maximum(a, b)))
    held = np.zeros(len(n), bool)
    held[np.searchsorted(offsets, marks(data, offsets), side="right") - 1] = True
    return n, (end == offsets[:-1]) | held | (h[2] % 100 >= rate), first, second


def _strings(parts: list, sizes: np.ndarray) -> pa.Array:
    """An Arrow array of texts from their pieces and their lengths."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(parts))])
    return whole.cast(pa.string())


def transformed(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, rate: int = RATE, spm_rate: int = SPM_RATE) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of every text."""
    n, plain, first, second = cuts(data, offsets, h, rate)
    chars = np.cumsum(CLASS[data] != REST, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    at = [_before(chars, x) for x in (offsets[:-1], first, second)]
    spm = h[3] % 100 < spm_rate
    view, parts = memoryview(data), []
    for start, p, m, end, is_plain, is_spm in zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist()):
        if is_plain:
            parts.append(view[start:end])
        elif is_spm:
            parts += (SUFFIX, view[m:end], PREFIX, view[start:p], MIDDLE, view[p:m])
        else:
            parts += (PREFIX, view[start:p], SUFFIX, view[m:end], MIDDLE, view[p:m])
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    counts = [pa.array(x, pa.int64(), mask=plain) for x in (at[1] - at[0], at[2] - at[1])]
    return [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *counts, _strings(parts, np.diff(offsets) + np.where(plain, 0, 9))]


def restored(data: np.ndarray, offsets: np.ndarray, forms: list[str]) -> pa.Array:
    """The texts of outputs and their forms."""
    plain, spm = (np.array([f == x for f in forms], bool) for x in ("plain", "spm"))
    found = marks(data, offsets)
    found = found[~plain[np.searchsorted(offsets, found, side="right") - 1]].reshape(-1, 3).tolist()
    view, parts, left = memoryview(data), [], iter(found)
    for start, end, is_plain, is_spm in zip(offsets[:-1].tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist()):
        if is_plain:
            parts.append(view[start:end])
            continue
        a, b, c = next(left)
        head, other, middle = view[a + 3 : b], view[b + 3 : c], view[c + 3 : end]
        parts += (other, middle, head) if is_spm else (head, middle, other)
    return _strings(parts, np.diff(offsets) - np.where(plain, 0, 9))


def numbers(doc_id: str, seed: str = SEED) -> list[Column]:
    """h1 to h4 of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _added(df: DataFrame, extra: list[Column], text: str, names: tuple[str, ...], kinds: str, kernel: Callable[..., list[pa.Array]]) -> DataFrame:
    """The table with the columns that the kernel makes of the bytes of a text column and the extra columns."""
    if {*names} & {*df.columns}:
        raise ValueError(f"the table has one of the columns {', '.join(names)}: name the new ones otherwise")
    plain = plain_names(df)
    own, place = plain.columns, df.columns.index(text)
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(own, plain.schema.fields))
    given = df.select("*", *[c.alias(f"__x{i}") for i, c in enumerate(extra)]).toDF(*own, *[f"x{i}" for i in range(len(extra))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = joined(batch.column(place))
            for a, b in runs(np.diff(offsets).tolist(), CHUNK_BYTES):
                part = [c.slice(a, b - a) for c in batch.columns]
                new = kernel(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], part[len(own) :])
                yield pa.RecordBatch.from_arrays([*part[: len(own)], *new], [*own, *[f"y{i}" for i in range(len(new))]])

    made = ", ".join(f"y{i} {kind}" for i, kind in enumerate(kinds.split()))
    return given.mapInArrow(run, f"{fields}, {made}").toDF(*df.columns, *names)


def transform(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: str = SEED,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    names: tuple[str, ...] = ("__n", "__form", "__prefix_chars", "__middle_chars", "__output"),
) -> DataFrame:
    """All rows and columns, then the units of the text, its form, the code points of prefix and middle (null if plain), and the output."""

    def kernel(data: np.ndarray, offsets: np.ndarray, h: list[pa.Array]) -> list[pa.Array]:
        return transformed(data, offsets, np.array([x.to_numpy() for x in h]).reshape(4, -1), rate, spm_rate)

    return _added(docs, numbers(doc_id, seed), text, names, "long string long long string", kernel)


def restore(df: DataFrame, output: str, form: str, name: str = "__restored") -> DataFrame:
    """All rows and columns, then the text that an output was made of."""

    def kernel(data: np.ndarray, offsets: np.ndarray, forms: list[pa.Array]) -> list[pa.Array]:
        return [restored(data, offsets, forms[0].to_pylist())]

    return _added(df, [F.col(form)], output, (name,), "string", kernel)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    made = transform(read(spark, sf_dir, "documents").select("doc_id", "text"), names=names).drop("text")
    out = restore(made, "output", "form", "restored")
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM documents
), u AS (
    SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
        ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2,
        ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4
    FROM d
), c AS (
    SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM u
), p AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
           ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""
