"""The corpus pipeline: language ID, line dedup, near-dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as
Parquet in the shared folder and hands the reread table to the next one, so a lost executor costs at most
a stage. All but the last return the columns of ``documents``, whatever further columns these have.

Null and empty texts go in the first stage, as do texts without letters. Of documents that repeat lines,
copies and near copies what comes first by doc_id stays, a null id last; of rows that are alike in id and
text one stays. Texts of any length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import op1_language_id, op4_simhash_vptree, op7_bm25_packing, op8_line_dedup, op9_secret_scan
from millrace.llm.common import shared_folder

STAGES = [
    ("language_id", op1_language_id.stage),
    ("line_dedup", op8_line_dedup.stage),
    ("simhash_near_dedup", op4_simhash_vptree.stage),
    ("secret_scan", op9_secret_scan.stage),
    ("packing", op7_bm25_packing.stage),
]

#: Bloom filters, XXH64 and byte-pair merges have no DuckDB counterpart; a brute-force test stands in.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the result of the last one. A stage's table goes once the next is written."""
    folder, docs, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs
