"""Scans with declared schemas."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As jsonl, but a line that is no object is an error with its file and number.

    Lines are checked where they lie, files of any size in splits; of a file with a bad line the lines are
    numbered, in splits too, to say where it is.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    ok = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT")), F.lit(False))
    rows = lines.filter("trim(value) <> ''")
    bad = rows.filter(~ok).limit(1).collect()
    if bad:
        number = numbered_lines(spark, bad[0]["file"]).filter("trim(value) <> ''").filter(~ok).agg(F.min("line")).first()[0]
        raise ValueError(f"not a JSON object at {bad[0]['file']}:{number}")
    return rows.select(F.from_json("value", schema).alias("row")).select("row.*")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file, line, value), lines from 1 in their file; files of any size are read in splits.

    A split lies in one task, in order, so a line's place in it is its running number less the split's first. The
    splits' counts, a row a split, give the lines before each.
    """
    at = {"path": F.col("_metadata.file_path"), "file": F.col("_metadata.file_name"), "split": F.col("_metadata.file_block_start"), "n": F.monotonically_increasing_id()}
    lines = spark.read.text(path).select("value", *[c.alias(k) for k, c in at.items()])
    splits = lines.groupBy("path", "split").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    start = splits.select(F.col("path").alias("__path"), F.col("split").alias("__split"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("start"))
    met = lines.join(start, (F.col("path") == F.col("__path")) & (F.col("split") == F.col("__split")))
    return met.select("path", "file", (F.col("start") + F.col("n") + 1).alias("line"), "value")


def ordered(spark: SparkSession, pattern: str, schema: str, name: str = "ord") -> DataFrame:
    """The rows of all files of a pattern, Parquet or JSON lines by their suffix, with the place of each in its file.

    Files count in order of their paths; ``numbered`` makes one sequence of the places. Blank lines are no rows, but
    keep their numbers.
    """
    files = listed(spark, pattern)
    columns = [c for c in files if c.endswith(".parquet")], [c for c in files if not c.endswith(".parquet")]
    place = lambda file, row: F.struct(file.alias("file"), row.alias("row")).alias(name)
    parts = []
    if columns[0]:
        parts.append(spark.read.schema(schema).parquet(*columns[0]).select("*", place(F.col("_metadata.file_path"), F.col("_metadata.row_index"))))
    if columns[1]:
        lines = numbered_lines(spark, columns[1]).filter("trim(value) <> ''")
        parts.append(lines.select(F.from_json("value", schema).alias("r"), place(F.col("path"), F.col("line") - 1)).select("r.*", name))
    if not parts:
        raise FileNotFoundError(pattern)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def by_suffix(spark: SparkSession, path: str, schema: str, json_lines: bool = False) -> DataFrame:
    """Parquet, a JSON array (or lines, where ``json_lines`` says so), or JSON lines."""
    suffix = Path(path).suffix
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".json":
        return jsonl(spark, path, schema) if json_lines else json_array(spark, path, schema)
    if suffix == ".jsonl" or not json_lines:
        return jsonl(spark, path, schema)
    raise ValueError(f"unknown suffix: {path}")


def with_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """The place of each row in its Parquet source, files in name order.

    Order is carried as a column; nothing downstream depends on the order of partitions.
    """
    return df.withColumn(name, F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")))


def numbered(df: DataFrame, order: str = "ord", name: str = "index") -> DataFrame:
    """The place of every row of a scan, from 0 over all its files in name order.

    ``order`` comes from ``with_ordinal`` on the whole scan. Rows of the files before are counted, a row a
    file, and each row adds its own place in its file: nothing is sorted, and a retry gives the same numbers.
    """
    counts = df.groupBy(F.col(f"{order}.file").alias("__file")).agg((F.max(f"{order}.row") + 1).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    start = counts.select("__file", F.coalesce(before, F.lit(0)).alias("__start"))
    placed = df.join(start, F.col(f"{order}.file") == F.col("__file"))
    return placed.withColumn(name, F.col("__start") + F.col(f"{order}.row")).drop("__file", "__start")


def limited(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by order; all for 0."""
    return df.orderBy(order).limit(n) if n > 0 else df


def globbed(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All files of a pattern with the name of each row's file."""
    return spark.read.schema(schema).json(pattern).withColumn("file", F.col("_metadata.file_name"))


def stepped(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Files named ``<number>.jsonl``; the number becomes ``step``. Steps are positive and unique."""
    rows = globbed(spark, f"{folder}/*.jsonl", schema)
    named = rows.withColumn("step", F.regexp_extract("file", r"^(\d+)\.jsonl$", 1))
    return named.filter("step <> ''").withColumn("step", F.col("step").cast("long")).filter("step > 0")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def first_existing(paths: list[str], spark: SparkSession | None = None) -> str:
    """The first path of several layouts that exists; all are named if none does.

    With a session the paths may lie in any store that it reads, else on this machine.
    """
    for p in paths:
        if Path(p).exists() if spark is None else file_system(spark, p).exists(hadoop_path(spark, p)):
            return p
    raise FileNotFoundError(", ".join(paths))


def hadoop_path(spark: SparkSession, path: str):  # noqa: ANN201
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """The store that holds a path, by its scheme or the session's default."""
    return hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def config(path: str, spark: SparkSession | None = None) -> dict | list:
    """A small JSON file; with a session it may lie in any store that it reads."""
    if spark is None:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def trusted(rows: DataFrame, schema: str) -> DataFrame:
    """Problems whose canonical solution was verified, their tests parsed, with the validation flag."""
    ok = F.coalesce(F.col("extra_info.canonical_verified"), F.lit(False))
    return rows.filter(ok).select(
        F.col("extra_info.problem_id").alias("id"), F.from_json("reward_model.ground_truth", schema).alias("meta"), F.col("is_val")
    )


#: Bytes of a file that a task holds at a time.
PIECE = 1 << 20


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, rows, bytes, sha256) of whole files of any size.

    Names are dealt to tasks, and a task streams each of its files in pieces of 1 MiB and counts its lines as it
    goes; empty files are listed too. The files must lie in a store that Arrow opens by the same address (local,
    HDFS, S3, GCS).
    """
    files = spark.createDataFrame([(p,) for p in listed(spark, pattern)], "path string")
    dealt = files.repartition(spark.sparkContext.defaultParallelism, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest_of(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]], ["path", "rows", "bytes", "sha256"])

    return dealt.mapInArrow(run, "path string, rows long, bytes long, sha256 string")


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files of a pattern and of the folders that it meets, but hidden ones."""
    store = file_system(spark, pattern)
    found = store.globStatus(hadoop_path(spark, pattern)) or []
    files = [f for x in found for f in (store.listStatus(x.getPath()) if x.isDirectory() else [x]) if f.isFile()]
    return sorted(f.getPath().toString() for f in files if f.getPath().getName()[0] not in "._")


def digest_of(path: str) -> tuple[int, int, str]:
    """(lines, bytes, SHA-256) of one file; a last line without a line feed counts."""
    local = re.sub(r"^file:(//)?(?=/)", "", path)
    store, at = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
    digest, lines, size, last = hashlib.sha256(), 0, 0, b"\n"
    with store.open_input_stream(at, compression=None) as stream:
        while piece := stream.read(PIECE):
            digest.update(piece)
            lines, size, last = lines + piece.count(b"\n"), size + len(piece), piece[-1:]
    return lines + (last != b"\n"), size, digest.hexdigest()


def observed(df: DataFrame, keep: str, name: str) -> tuple[DataFrame, Observation]:
    """Rows that satisfy ``keep``, and a counter of the others that is filled as the rows pass."""
    counter = Observation(name)
    return df.observe(counter, F.count_if(~F.expr(keep)).alias("skipped")).filter(keep), counter
