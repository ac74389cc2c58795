"""Queries that write a table by each sink and read it by each source."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import contracts, histograms
from ..session import table
from ..sources import readers, writers
from ..sources.scratch import named_file, scratch
from ..streaming import appends, status

_DOC = "doc_id long, text string, lang string, source string"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _digest(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "lang", *extra)


_DIGEST = "doc_id, sha256(text) AS text_sha256, lang"


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through JSON lines, null fields written."""
    path = scratch(spark, "jsonl")
    writers.jsonl(_docs(spark, sf_dir).withColumn("none", F.lit(None).cast("string")), path)
    return _digest(readers.jsonl(spark, path, _DOC))


JSONL_SQL = f"SELECT {_DIGEST} FROM documents"


def strict_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the reader that stops at a line which is no object."""
    path = scratch(spark, "strict")
    writers.jsonl(_docs(spark, sf_dir), path)
    return _digest(readers.strict_jsonl(spark, path, _DOC))


def array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations as one JSON array in a file of its own."""
    path = scratch(spark, "array")
    nations = table(spark, sf_dir, "nation")
    one = nations.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))).alias("value"))  # a region's nations are few
    one.select("n_regionkey", "value").write.partitionBy("n_regionkey").text(path)
    return readers.json_array(spark, f"{path}/*", "id long, name string")


ARRAY_SQL = "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation"


def sorted_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet in order of id with its list of ids, read by suffix: both list the same rows."""
    path = f"{scratch(spark, 'sorted')}.parquet"
    writers.sorted_parquet(_docs(spark, sf_dir), path, "doc_id")
    listed = spark.read.text(f"{path}.ids").select(F.col("value").cast("long").alias("doc_id"))
    return _digest(readers.by_suffix(spark, path, _DOC).join(listed, "doc_id"))


def category_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by language, to which the second half is appended; files by pattern, each knowing its column."""
    path, docs = scratch(spark, "category"), _docs(spark, sf_dir)
    writers.by_category(docs.filter("doc_id % 2 = 0"), path, "lang")
    writers.by_category(docs.filter("doc_id % 2 = 1"), path, "lang", mode="append")
    rows = readers.globbed(spark, f"{path}/*/*.json", _DOC)
    return _digest(rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"/__lang=([^/]*)/", 1)), "folder")


CATEGORY_SQL = f"SELECT {_DIGEST}, lang AS folder FROM documents"


def stepped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose names are steps; the last record of a key counts."""
    path, turns = scratch(spark, "steps"), table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    for step in (1, 2, 10):
        named_file(turns.filter(F.col("turn") % 10 < step).select(F.to_json(F.struct("conv_id", "turn", "role")).alias("value")), f"{path}/{step}.jsonl")
    rows = readers.stepped(spark, path, "conv_id long, turn long, role string")
    last = readers.last_by_key(rows.select("conv_id", (F.col("step") * 1000 + F.col("turn")).alias("at"), "turn", "role"), "conv_id", "at")
    return last.join(rows.groupBy("conv_id").agg(F.count_distinct("step").alias("steps")), "conv_id")


STEPPED_SQL = """
WITH t AS (SELECT conv_id, turn, role, s FROM conversations, (VALUES (1), (2), (10)) v(s) WHERE turn % 10 < s)
SELECT conv_id, arg_max(turn, s * 1000 + turn)::BIGINT AS turn, arg_max(role, s * 1000 + turn) AS role, count(DISTINCT s) AS steps FROM t GROUP BY conv_id
"""


def folder_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by folder of a partitioned table."""
    path = scratch(spark, "folders")
    writers.by_category(_docs(spark, sf_dir), path, "source")
    return histograms.folder_totals(spark.read.schema(_DOC).json(f"{path}/*"))


FOLDER_SQL = "SELECT '__source=' || source AS folder, count(*) AS n FROM documents GROUP BY source"


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 80 customers with most orders, line by line, with shares of all rows."""
    return histograms.report(table(spark, sf_dir, "orders"), "o_custkey", "customer")


REPORT_SQL = """
WITH c AS (SELECT o_custkey::VARCHAR AS name, count(*) AS n, sum(count(*)) OVER () AS t, row_number() OVER (ORDER BY count(*) DESC, o_custkey::VARCHAR) AS k FROM orders GROUP BY 1)
SELECT 0::BIGINT AS line, '| customer | rows | share |' AS text UNION ALL SELECT 1, '| --- | ---: | ---: |' UNION ALL SELECT k + 1, '| ' || name || ' | ' || n || ' | ' || printf('%.2f', n * 100.0 / t) || '% |' FROM c WHERE k <= 80
"""


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    writers.csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.option("header", True).csv(path).select(F.col("n_nationkey").cast("long"), "n_name")


CSV_SQL = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation"


def resumed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interrupted run goes on: rows that are there already are not written again."""
    path, docs = scratch(spark, "resumed"), _docs(spark, sf_dir)
    writers.append_pending(docs.filter("doc_id % 3 <> 0"), path, None, "doc_id")
    writers.append_pending(docs, path, readers.jsonl(spark, path, _DOC), "doc_id")
    return _digest(readers.jsonl(spark, path, _DOC))


def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a table of many files, the first rows by place, and the largest place."""
    path = scratch(spark, "numbered")
    table(spark, sf_dir, "orders").select("o_orderkey").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    rows = readers.numbered(readers.with_ordinal(readers.parquet(spark, path, ["o_orderkey", "_metadata"])))
    first = readers.limited(rows, 30, "index").select("index", F.lit(True).alias("early"))
    return rows.join(first, "index", "left").select(F.col("index").cast("long"), "o_orderkey", F.coalesce("early", F.lit(False)).alias("early"))


NUMBERED_SQL = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS \"index\", o_orderkey, row_number() OVER (ORDER BY o_orderkey) <= 30 AS early FROM orders"


def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in folders of Parquet and of JSON lines, one after the other by path: the place of each row in all of them."""
    path, orders = scratch(spark, "ordered"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    for k in range(4):
        part = orders.filter(F.col("o_orderkey") % 4 == k).repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")
        writers.parquet(part, f"{path}/{k}") if k % 2 else writers.jsonl(part, f"{path}/{k}")
    rows = readers.numbered(readers.ordered(spark, f"{path}/*", "o_orderkey long, o_orderpriority string"))
    return rows.select(F.col("index").cast("long"), "o_orderkey", "o_orderpriority")


ORDERED_SQL = 'SELECT row_number() OVER (ORDER BY o_orderkey % 4, o_orderkey) - 1 AS "index", o_orderkey, o_orderpriority FROM orders'


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file for each priority, numbered in splits."""
    path = scratch(spark, "lines")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("value"), F.substring("o_orderpriority", 1, 1).alias("p"))
    rows.repartition("p").sortWithinPartitions("p", F.col("value").cast("long")).write.partitionBy("p").text(path)
    got = readers.numbered_lines(spark, f"{path}/*")
    return got.select(F.regexp_extract("path", "/p=([^/]*)/", 1).alias("priority"), "line", F.col("value").cast("long").alias("o_orderkey"))


LINES_SQL = "SELECT o_orderpriority[1] AS priority, row_number() OVER (PARTITION BY o_orderpriority[1] ORDER BY o_orderkey) AS line, o_orderkey FROM orders"


def trusted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems whose solution was verified, with their parsed truth and the validation flag."""
    extra = F.struct(F.concat(F.lit("p"), F.col("p_partkey")).alias("problem_id"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3 == 1).alias("canonical_verified"))
    truth = F.struct(F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("ground_truth"))
    rows = table(spark, sf_dir, "part").select(extra.alias("extra_info"), truth.alias("reward_model"), (F.col("p_partkey") % 10 == 0).alias("is_val"))
    out = readers.trusted(rows, "name string, size long")
    return out.select("id", "meta.name", "meta.size", "is_val")


TRUSTED_SQL = "SELECT 'p' || p_partkey AS id, p_name AS name, p_size::BIGINT AS size, p_partkey % 10 = 0 AS is_val FROM part WHERE p_size % 3 = 1"


def table_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, keys and the digest of each language's ids; totals by folder."""
    docs = _docs(spark, sf_dir)
    whole = writers.manifest(docs, "doc_id").first()
    of = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).join(hashing.set_digests(docs, "doc_id", "lang"), "lang")
    return of.withColumns({"rows": F.lit(whole["rows"]), "keys": F.lit(whole["keys"]), "share": histograms.percent(F.col("n"), F.lit(whole["rows"]))})


MANIFEST_SQL = """
SELECT lang, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR) || chr(10)) AS digest, sum(strlen(text))::BIGINT AS bytes,
  (SELECT count(*) FROM documents) AS rows, (SELECT count(DISTINCT doc_id) FROM documents) AS keys, printf('%.2f%%', count(*) * 100.0 / (SELECT count(*) FROM documents)) AS share FROM documents GROUP BY lang
"""


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a written table with rows, bytes and SHA-256, held against their content by line."""
    path = scratch(spark, "files")
    table(spark, sf_dir, "region").select(F.concat("r_regionkey", F.lit(" "), "r_name").alias("value"), "r_regionkey").write.partitionBy("r_regionkey").text(path)
    return writers.file_manifest(spark, f"{path}/*").select("rows", "bytes", "sha256")


FILES_SQL = """
SELECT 1::BIGINT AS rows, strlen(r_regionkey || ' ' || r_name || chr(10))::BIGINT AS bytes, sha256(r_regionkey || ' ' || r_name || chr(10)) AS sha256 FROM region
"""


def frozen_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each priority, recorded, then changed in one byte, in its rows, taken away or added: what differs."""
    path, orders = scratch(spark, "frozen"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    line = lambda end: F.concat(F.col("o_orderkey"), F.lit(" "), F.when(F.col("o_orderkey") == F.col("first"), end).otherwise(F.lit("a")))
    first = orders.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("first"))  # a priority's smallest key
    rows = orders.join(F.broadcast(first), "o_orderpriority").repartition("o_orderpriority").withColumn("p", F.substring("o_orderpriority", 1, 1))
    more = rows.filter("p = '2' AND o_orderkey = first")
    for name, now in (("then", rows.filter("p <> '5'").select("p", line(F.lit("a")).alias("value"))), ("now", rows.filter("p <> '4'").union(more).repartition("p").select("p", line(F.when(F.col("p") == "1", "b").otherwise("a")).alias("value")))):
        now.sortWithinPartitions("p", "value").write.partitionBy("p").text(f"{path}/{name}")
    found = {x: writers.file_manifest(spark, f"{path}/{x}/*").withColumn("path", F.regexp_extract("path", r"/p=([^/]*)/", 1)) for x in ("then", "now")}
    return contracts.artifact_differences(found["then"], found["now"]).withColumnRenamed("path", "priority")


FROZEN_SQL = """
SELECT DISTINCT o_orderpriority[1] AS priority, CASE o_orderpriority[1] WHEN '1' THEN 'sha256' WHEN '2' THEN 'rows,bytes,sha256' WHEN '4' THEN 'missing' ELSE 'not recorded' END AS reason FROM orders WHERE o_orderpriority[1] <> '3'
"""


#: Batches in which a table is streamed, and the most bytes of text that one of its files is to have.
BATCHES, FILE_BYTES = 4, 1 << 26


def _files(docs: DataFrame) -> int:
    """Files for a stream of documents: as many as keep each of them small, one a batch at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(BATCHES, -(-size // FILE_BYTES))


def ledgered_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files is appended by batches, killed between the rows of the second and its entry, and goes on.

    Files are of bounded size, since a task writes each; a batch has a share of them.
    """
    path, docs = scratch(spark, "ledgered"), _docs(spark, sf_dir)
    files = _files(docs)
    writers.jsonl(docs.repartition(files, "doc_id"), f"{path}/in")

    def kill(number: int) -> None:
        if number == 1:
            raise InterruptedError("killed")

    stream = lambda: spark.readStream.schema(_DOC).option("maxFilesPerTrigger", -(-files // BATCHES)).json(f"{path}/in")
    with contextlib.suppress(StreamingQueryException):
        appends.append(stream(), f"{path}/out", f"{path}/state", kill).awaitTermination()
    seen = appends.read(spark, f"{path}/out", _DOC).agg(F.max("batch")).first()[0]  # what a reader sees meanwhile
    appends.append(stream(), f"{path}/out", f"{path}/state").awaitTermination()
    rows = appends.read(spark, f"{path}/out", _DOC)
    return _digest(rows.withColumn("killed_after", F.lit(seen)), "killed_after")


LEDGERED_SQL = f"SELECT {_DIGEST}, 0::BIGINT AS killed_after FROM documents"


def counted_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an answer go; the counter knows how many."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_name")).alias("answer"))
    kept, counter = readers.observed(rows, "answer IS NOT NULL", "skips")
    n = kept.agg(F.count("*").alias("kept")).collect()[0]["kept"]
    return spark.createDataFrame([(n, counter.get["skipped"])], "kept long, skipped long")


SKIPS_SQL = "SELECT count(*) FILTER (p_size % 4 > 0) AS kept, count(*) FILTER (p_size % 4 = 0) AS skipped FROM part"

def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses counted from a stream of appended files; records that a resumed run has written again count once."""
    path, name = scratch(spark, "stream"), f"counts_{uuid.uuid4().hex}"
    graded = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = graded.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("dataset"), F.when(F.col("quality") == 1, "passed").otherwise("wrong_answer").alias("status"))
    writers.jsonl(rows, f"{path}/in")
    writers.jsonl(rows.filter("cast(id AS long) % 7 = 0"), f"{path}/in", mode="append")
    counts = status.status_counts(status.records(spark, f"{path}/in"))
    run = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    run.start().awaitTermination()
    return spark.table(name).select("dataset", "status", "n")


STREAM_SQL = """
SELECT lang AS dataset, CASE WHEN quality = 1 THEN 'passed' ELSE 'wrong_answer' END AS status, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL
"""

QUERIES = {
    "streamed_counts": streamed_counts,
    "jsonl_round_trip": jsonl_round_trip,
    "strict_round_trip": strict_round_trip,
    "array_round_trip": array_round_trip,
    "sorted_round_trip": sorted_round_trip,
    "category_round_trip": category_round_trip,
    "stepped_files": stepped_files,
    "folder_totals": folder_totals,
    "report_lines": report_lines,
    "csv_round_trip": csv_round_trip,
    "resumed_append": resumed_append,
    "numbered_rows": numbered_rows,
    "trusted_rows": trusted_rows,
    "table_manifest": table_manifest,
    "file_manifest": file_manifest,
    "counted_skips": counted_skips,
    "frozen_artifacts": frozen_artifacts,
    "ordered_union": ordered_union,
    "numbered_lines": numbered_lines,
    "ledgered_append": ledgered_append,
}
ORACLE_SQL = {
    "streamed_counts": STREAM_SQL,
    "jsonl_round_trip": JSONL_SQL,
    "strict_round_trip": JSONL_SQL,
    "array_round_trip": ARRAY_SQL,
    "sorted_round_trip": JSONL_SQL,
    "category_round_trip": CATEGORY_SQL,
    "stepped_files": STEPPED_SQL,
    "folder_totals": FOLDER_SQL,
    "report_lines": REPORT_SQL,
    "csv_round_trip": CSV_SQL,
    "resumed_append": JSONL_SQL,
    "numbered_rows": NUMBERED_SQL,
    "trusted_rows": TRUSTED_SQL,
    "table_manifest": MANIFEST_SQL,
    "file_manifest": FILES_SQL,
    "counted_skips": SKIPS_SQL,
    "frozen_artifacts": FROZEN_SQL,
    "ordered_union": ORDERED_SQL,
    "numbered_lines": LINES_SQL,
    "ledgered_append": LEDGERED_SQL,
}
