"""Incremental maintenance of a full outer join whose left rows change their key.

A row comes with its history: for every batch, from the state before the first on, the distance of its key from
its base key (null: absent then) and its printed part. Rows of equal histories are counted before anything moves,
so a key that very many rows have is a few rows. Keys are dealt in ranges of WIDTH; a row goes to the range of its
base key, and a copy of it to a neighbour for which an update carries its key over the boundary (the halo). So
every range has all that its keys ever join with, one shuffle serves all batches, and nothing is broadcast.

Within a range, counts by (key, part) and batch lie in arrays sorted by key with one offset a key. Of keys that no
batch touches nothing is computed. The others' joined copies are outer products of their two columns of counts,
taken for all keys and batches together, at most PAIRS pairs at a time; what differs from the batch before is a
change. A side that is empty at a key pads the other with ``-``: its count of that part is one then.

Null base keys match nothing: every such row meets a pad, under a null key. Parts are texts in which nulls
are printed already; a part that prints like a pad or like another is the same joined row. Repeated rows count as
often as they stand. Empty tables give no rows, and one empty side pads the other. The rows of one key can have no
more joined parts than the product of their different parts, which is the result itself.

``changes`` is the operator, ``applied`` brings a stored join up to date with its rows. The query derives
histories from hashes of ids; of the tables it reads the columns it names and no other, whatever they hold. A null
id has no hash: such a row is there from the start and never changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Keys of a range.
WIDTH = 256
#: Pairs of counts that a worker multiplies at one time.
PAIRS = 1 << 18
PAD = "-"
BATCHES = 3
KEYS_PER = 5

CHANGES = "batch int, join_key long, left_part string, right_part string, weight long, total long"


def _codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts, the pad being 0, and the texts by number."""
    coded = pa.concat_arrays([pa.array([PAD], pa.string()), values.cast(pa.string())]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False)[1:], np.array(coded.dictionary.to_pylist(), object)


class Side:
    """Counts of one side of a range by (key, part), sorted by key; ``at`` has the offset of every key. The first of a key is the pad's."""

    def __init__(self, keys: np.ndarray, parts: np.ndarray, counts: np.ndarray, width: int, times: int) -> None:
        # keys, parts: (rows, times), a key out of the range is -1; counts: (rows)
        row, when = np.nonzero(keys >= 0)
        key, part = keys[row, when], parts[row, when]
        key, part, when, n = (np.concatenate(x) for x in ((np.arange(width), key), (np.zeros(width, np.int64), part), (np.zeros(width, np.int64), when), (np.zeros(width, np.int64), counts[row])))
        most = int(part.max()) + 1
        names, place = np.unique(key * most + part, return_inverse=True)
        self.key, self.part = names // most, names % most
        self.counts = np.zeros((len(names), times), np.int64)
        np.add.at(self.counts, (place, when), n)
        self.at = np.searchsorted(self.key, np.arange(width + 1))

    def moved(self) -> np.ndarray:
        """Keys at which a batch changes a count."""
        changed = (np.diff(self.counts, axis=1) != 0).any(axis=1)
        return np.logical_or.reduceat(changed, self.at[:-1])

    def padded(self) -> np.ndarray:
        """Adds the pad where this side is empty; returns it by key and time."""
        pad = (np.add.reduceat(self.counts, self.at[:-1], axis=0) == 0).astype(np.int64)
        self.counts[self.at[:-1]] += pad
        return pad


def _changed(copies: np.ndarray, key: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """(time, key, left part, right part, weight, total) where copies differ from the time before."""
    weight = np.diff(copies, axis=1)
    row, when = np.nonzero(weight)
    return when + 1, key[row], left[row], right[row], weight[row, when], copies[row, when + 1]


def _range(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], width: int, times: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The changes of a range, in blocks."""
    a, b = Side(*left, width, times), Side(*right, width, times)
    moved = a.moved() | b.moved()
    pads = a.padded(), b.padded()
    rows = np.flatnonzero(moved[a.key])
    wide = np.diff(b.at)[a.key[rows]]
    block = (np.cumsum(wide) - wide) // PAIRS
    for begin, end in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))(np.searchsorted(block, np.arange(block[-1] + 2 if len(block) else 1)))):
        some, n = rows[begin:end], wide[begin:end]
        if not len(some):
            continue
        i = np.repeat(some, n)
        j = np.repeat(b.at[a.key[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        copies = a.counts[i] * b.counts[j]
        both = (a.part[i] == 0) & (b.part[j] == 0)
        copies[both] -= (pads[0] * pads[1])[a.key[i[both]]]  # a pad joins no pad
        yield _changed(copies, a.key[i], a.part[i], b.part[j])


def _side(rows: DataFrame, left: bool, width: int) -> DataFrame:
    """(left, range, base, shifts, parts, n): histories counted, in every range that they ever lie in."""
    counted = rows.filter("base IS NOT NULL").groupBy("base", "shifts", "parts").agg(F.count("*").alias("n"))
    ranges = F.array_distinct(F.array_compact(F.transform("shifts", lambda s: _floor(F.col("base") + s, width))))
    return counted.select(F.lit(left).alias("left"), F.explode(ranges).alias("range"), "base", "shifts", "parts", "n")


def _alone(left: DataFrame, right: DataFrame, batches: int, initial: bool) -> DataFrame:
    """The changes under a null key, where every row meets a pad: counts by part and time, in as many tasks as there are parts."""
    rows = None
    for side, names in ((left, ("part", "pad")), (right, ("pad", "part"))):
        each = side.filter("base IS NULL").select(F.posexplode(F.arrays_zip("shifts", "parts")).alias("at", "x")).filter("x.shifts IS NOT NULL")
        shown = {"part": F.col("x.parts"), "pad": F.lit(PAD)}
        one = each.select(*[shown[k].alias(c) for k, c in zip(names, ("left_part", "right_part"))], "at")
        rows = one if rows is None else rows.union(one)
    times = range(batches + 1)
    sums = rows.groupBy("left_part", "right_part").agg(*[F.count_if(F.col("at") == t).alias(f"n{t}") for t in times])
    before = lambda t: F.col(f"n{t - 1}") if t else F.lit(0).cast("long")
    moves = [F.struct(F.lit(t).alias("batch"), (F.col(f"n{t}") - before(t)).alias("weight"), F.col(f"n{t}").alias("total")) for t in times[0 if initial else 1 :]]
    changed = sums.select("left_part", "right_part", F.explode(F.array(*moves)).alias("m")).filter("m.weight <> 0")
    return changed.select("m.batch", F.lit(None).cast("long").alias("join_key"), "left_part", "right_part", "m.weight", "m.total")


def changes(left: DataFrame, right: DataFrame, batches: int, width: int = WIDTH, initial: bool = False) -> DataFrame:
    """(batch, join_key, left_part, right_part, weight, total) for each batch and joined row whose copies change.

    ``left`` and ``right`` are (base long, shifts array<int>, parts array<string>), both arrays of batches + 1
    elements. With ``initial`` batch 0 builds the join from nothing.
    """
    times = batches + 1 + initial

    def run(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = key[0].as_py() * width
        table = pa.Table.from_batches(list(group)).combine_chunks()
        n = table["n"].to_numpy()
        base = table["base"].to_numpy()
        shifts = np.array(table["shifts"].to_pylist(), float).reshape(len(n), batches + 1)
        places = np.where(np.isnan(shifts), -1, base[:, None] - first + np.nan_to_num(shifts).astype(np.int64))
        places[(places < 0) | (places >= width)] = -1
        parts, names = _codes(table["parts"].combine_chunks().flatten())
        parts = parts.reshape(len(n), batches + 1).astype(np.int64)
        if initial:
            places, parts = (np.concatenate([np.full((len(n), 1), -1), x], axis=1) for x in (places, parts))
        is_left = table["left"].to_numpy(zero_copy_only=False).astype(bool)
        sides = [(places[x], parts[x], n[x]) for x in (is_left, ~is_left)]
        for when, k, a, b, weight, total in _range(*sides, width, times):
            yield pa.RecordBatch.from_arrays(
                [pa.array(when - initial, pa.int32()), pa.array(k + first, pa.int64()), *[pa.array(names[x], pa.string()) for x in (a, b)], pa.array(weight), pa.array(total)],
                ["batch", "join_key", "left_part", "right_part", "weight", "total"],
            )

    both = _side(left, True, width).union(_side(right, False, width))
    return both.groupBy("range").applyInArrow(run, CHANGES).union(_alone(left, right, batches, initial))


def applied(state: DataFrame, changed: DataFrame) -> DataFrame:
    """(join_key, left_part, right_part, copies): a stored join after the changes."""
    keys = ["join_key", "left_part", "right_part"]
    moves = changed.select(*keys, F.col("weight").alias("copies"))
    return state.select(*keys, "copies").union(moves).groupBy(*keys).agg(F.sum("copies").alias("copies")).filter("copies <> 0")


def _floor(c: Column, by: int) -> Column:
    """Whole-number division that rounds down, exact for all longs."""
    return F.call_function("div", c - F.pmod(c, F.lit(by)), F.lit(by))


def _history(rows: DataFrame, letter: str, batches: int) -> DataFrame:
    """The table with p0, p1, ... (present) and u0, u1, ... (updates so far) as the hashes of its ids say."""
    for t in range(batches + 1):
        c = F.crc32(F.concat(F.lit(f"{letter}:"), F.col("doc_id").cast("string"), F.lit(f":{t}")).cast("binary"))
        if t == 0:
            rows = rows.withColumns({"p0": F.coalesce(c % 3 != 0, F.lit(True)), "u0": F.lit(0)})
            continue
        event = F.coalesce(c % 31, F.lit(2))
        rows = rows.withColumn("event", event).withColumns(
            {f"p{t}": F.col(f"p{t - 1}") != (F.col("event") == 0), f"u{t}": F.col(f"u{t - 1}") + (F.col(f"p{t - 1}") & (F.col("event") == 1)).cast("int")}
        )
    return rows


def _printed(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def document_history(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Documents: an update moves the key by one."""
    rows, times = _history(docs.select("doc_id", "lang"), "d", batches), range(batches + 1)
    shifts = [F.when(F.col(f"p{t}"), F.col(f"u{t}")) for t in times]
    return rows.select(_floor(F.col("doc_id"), KEYS_PER).alias("base"), F.array(*shifts).alias("shifts"), F.array_repeat(_printed(F.col("lang")), len(times)).alias("parts"))


def label_history(labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Labels: an update turns the quality."""
    rows, times = _history(labels.select("doc_id", "quality", "toxic"), "l", batches), range(batches + 1)
    shifts = [F.when(F.col(f"p{t}"), F.lit(0)) for t in times]
    quality = [F.when(F.col(f"u{t}") % 2 == 1, 1 - F.col("quality")).otherwise(F.col("quality")) for t in times]
    parts = [F.concat(_printed(q), F.lit(","), _printed(F.col("toxic"))) for q in quality]
    return rows.select(_floor(F.col("doc_id"), KEYS_PER).alias("base"), F.array(*shifts).alias("shifts"), F.array(*parts).alias("parts"))


def op13_join_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch, join_key, doc_part, label_part, weight and total of the joined rows whose copies change in batches 1 to 3."""
    found = changes(document_history(read(spark, sf_dir, "documents")), label_history(read(spark, sf_dir, "labels")), BATCHES)
    return found.withColumnsRenamed({"left_part": "doc_part", "right_part": "label_part"})


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''), lambda ch: [unicode(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295)"""
_HASHES = ", ".join(f"{_CRC.format(text=f"@ || ':' || doc_id || ':{t}'")} AS c{t}" for t in range(BATCHES + 1))

SQL = f"""
WITH dc AS (
    SELECT doc_id, lang, {_HASHES.replace("@", "'d'")} FROM documents WHERE doc_id IS NOT NULL
), lc AS (
    SELECT doc_id, quality, toxic, {_HASHES.replace("@", "'l'")} FROM labels WHERE doc_id IS NOT NULL
), d AS (
    SELECT *, c0 % 3 <> 0 AS p0, p0 <> (c1 % 31 = 0) AS p1, p1 <> (c2 % 31 = 0) AS p2, p2 <> (c3 % 31 = 0) AS p3,
        (p0 AND c1 % 31 = 1)::INT AS u1, u1 + (p1 AND c2 % 31 = 1)::INT AS u2, u2 + (p2 AND c3 % 31 = 1)::INT AS u3 FROM dc
), l AS (
    SELECT *, c0 % 3 <> 0 AS p0, p0 <> (c1 % 31 = 0) AS p1, p1 <> (c2 % 31 = 0) AS p2, p2 <> (c3 % 31 = 0) AS p3,
        (p0 AND c1 % 31 = 1)::INT AS u1, u1 + (p1 AND c2 % 31 = 1)::INT AS u2, u2 + (p2 AND c3 % 31 = 1)::INT AS u3 FROM lc
), docs AS (
    SELECT t, (doc_id - ((doc_id % 5) + 5) % 5) // 5 + u AS join_key, coalesce(lang, 'null') AS doc_part, count(*) AS n
    FROM (SELECT doc_id, lang, unnest([0, 1, 2, 3]) AS t, unnest([0, u1, u2, u3]) AS u, unnest([p0, p1, p2, p3]) AS p FROM d) WHERE p GROUP BY ALL
), labs AS (
    SELECT t, (doc_id - ((doc_id % 5) + 5) % 5) // 5 AS join_key,
        coalesce((CASE WHEN u % 2 = 1 THEN 1 - quality ELSE quality END)::VARCHAR, 'null') || ',' || coalesce(toxic::VARCHAR, 'null') AS label_part, count(*) AS n
    FROM (SELECT doc_id, quality, toxic, unnest([0, 1, 2, 3]) AS t, unnest([0, u1, u2, u3]) AS u, unnest([p0, p1, p2, p3]) AS p FROM l) WHERE p GROUP BY ALL
), joined AS (
    SELECT t, join_key, coalesce(doc_part, '-') AS doc_part, coalesce(label_part, '-') AS label_part, sum(coalesce(docs.n, 1) * coalesce(labs.n, 1)) AS n
    FROM docs FULL JOIN labs USING (t, join_key) GROUP BY ALL
), moves AS (
    SELECT t AS batch, join_key, doc_part, label_part, n AS after_n, 0 AS before_n FROM joined WHERE t > 0
    UNION ALL SELECT t + 1, join_key, doc_part, label_part, 0, n FROM joined WHERE t < 3
)
SELECT batch, join_key, doc_part, label_part, (sum(after_n) - sum(before_n))::BIGINT AS weight, sum(after_n)::BIGINT AS total
FROM moves GROUP BY batch, join_key, doc_part, label_part HAVING sum(after_n) <> sum(before_n)
"""
