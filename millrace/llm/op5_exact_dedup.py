"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

The first pass reads of each text its byte length and the hash of a short prefix. Only rows whose
(length, prefix hash) occurs again go on; a bitmap of those pairs, whose size has a bound, tells the second
pass which texts to hash in full. A false positive of the bitmap costs one more hash and nothing else,
because groups form on length, prefix hash and full hash together; beyond some ten million different pairs
that occur again it tells less and less, and more texts are hashed in full than need be.

Texts are equal if identical after lower-casing A-Z. Null counts as empty. Texts of any length are read
whole. Of equal rows the one with the largest doc_id stays (a null id is smallest; of repeated rows with
that id, one stays). An empty table gives an empty result; only the id and text columns are read, so
others may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bitmap, cut, marked, read

PREFIX_CHARS = 256
#: Bits of the map of pairs that go on: at most MARK_BITS / 64 rows are broadcast.
MARK_BITS = 1 << 24


def refine(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, sha256.

    sha256 is null for rows that left the refinement early, unless ``digest_all`` asks for the
    digest of every text (which the second pass then computes in the same read).
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # lower-casing A-Z changes no length, so the first pass lowers the prefix alone
    prefix = F.xxhash64(ascii_lower(F.substring("text", 1, PREFIX_CHARS))).alias("prefix")
    sized = own.select("doc_id", "text", F.octet_length("text").alias("size"), prefix)
    pairs = cut(sized.groupBy("size", "prefix").agg(F.count("*").alias("n")))
    # a length that only one row has can't hold a copy; then the same for its (length, prefix)
    lengths = pairs.groupBy("size").agg(F.sum("n").alias("rows")).filter("rows > 1").select("size")
    again = pairs.filter("n > 1").join(lengths, "size", "left_semi")
    pair = F.xxhash64("size", "prefix").alias("pair")
    marks = cut(bitmap(again.select(pair), "pair", MARK_BITS))
    seen = marked(sized.withColumn("pair", pair), "pair", marks, MARK_BITS, "survives")
    digest = F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)
    hashed = seen.select("doc_id", "size", "prefix", "survives", (digest if digest_all else F.when(F.col("survives"), digest)).alias("sha256"))
    rows = cut(hashed.withColumn("row", F.monotonically_increasing_id()))
    same = ["size", "prefix", "sha256"]
    groups = cut(
        rows.filter("survives")
        .groupBy(*same)
        .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    # both sides come from files, so adaptive execution can split the partition of a hot group
    return rows.join(groups, same, "left").select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("keep").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
        "sha256",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine(read(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed("sha256", "text_sha256")


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
