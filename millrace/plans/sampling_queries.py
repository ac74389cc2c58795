"""Queries over samples, allocations, arms and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import arm_seed_column, set_digests, set_fingerprint
from ..operators import allocation, arms, sampling, splits
from ..session import table

SEED = 7


def loo_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-category-out arm over documents: as many rows as the whole less its largest category."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    recipe = [{"name": "no_fr", "mode": "leave_out", "categories": ["fr"]}]
    ids = arms.build(docs, recipe, SEED, "doc_id", "lang").select("doc_id")
    return docs.join(ids, "doc_id").select("doc_id", "lang", "n_chars")


LOO_SQL = """
WITH n AS (SELECT sum(c) - max(c) AS n FROM (SELECT count(*) AS c FROM documents GROUP BY lang)),
r AS (SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY sha256('7|no_fr|fr|' || doc_id), doc_id::VARCHAR) AS nth
      FROM documents WHERE lang <> 'fr')
SELECT doc_id, lang, n_chars FROM r, n WHERE nth <= n.n
"""

RECIPE = [
    {"name": "everything", "mode": "full"},
    {"name": "control", "mode": "random", "total": 60},
    {"name": "no_en", "mode": "leave_out", "categories": ["en"], "total": 50},
    {"name": "only_de", "mode": "single", "categories": ["de"], "per_category": 15},
    {"name": "de_es", "mode": "mixture", "categories": ["de", "es"], "per_category": 15},
    {"name": "shares", "mode": "mixture", "categories": ["de", "en", "es", "fr"], "total": 41, "proportional": True},
]


def recipe_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six arms of five modes in one plan."""
    return arms.build(table(spark, sf_dir, "documents"), RECIPE, SEED, "doc_id", "lang").select("arm", "doc_id", "lang")


RECIPE_SQL = """
WITH d AS (SELECT doc_id, lang FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|single_pool|' || lang || '|' || doc_id), doc_id::VARCHAR) AS nth FROM d),
p AS (SELECT lang, count(*) AS w, sum(count(*)) OVER () AS t FROM d GROUP BY lang),
q AS (SELECT lang, 41 * w // t AS f, 41 * w % t AS r, sha256('7|allocation|' || lang || '|') AS tie FROM p),
a AS (SELECT lang, f + CASE WHEN row_number() OVER (ORDER BY r DESC, tie) <= 41 - sum(f) OVER () THEN 1 ELSE 0 END AS take FROM q)
SELECT 'everything' AS arm, doc_id, lang FROM d
UNION ALL SELECT 'control', doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY sha256('7|control|all|' || doc_id), doc_id::VARCHAR) AS nth FROM d) WHERE nth <= 60
UNION ALL SELECT 'no_en', doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY sha256('7|no_en|en|' || doc_id), doc_id::VARCHAR) AS nth FROM d WHERE lang <> 'en') WHERE nth <= 50
UNION ALL SELECT 'only_de', doc_id, lang FROM s WHERE lang = 'de' AND nth <= 15
UNION ALL SELECT 'de_es', doc_id, lang FROM s WHERE lang IN ('de', 'es') AND nth <= 15
UNION ALL SELECT 'shares', s.doc_id, s.lang FROM s JOIN a ON s.lang = a.lang WHERE nth <= take
"""


def nested_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the single arm that the mixture lacks: none."""
    both = recipe_arms(spark, sf_dir)
    single = both.filter("arm = 'only_de'").select("doc_id")
    mixture = both.filter("arm = 'de_es'").select("doc_id")
    return single.join(mixture, "doc_id", "left_anti").agg(F.count("*").alias("outside"))


def _allocated(spark: SparkSession, sf_dir: str, balanced: bool) -> DataFrame:
    pools = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("size"))
    return allocation.allocate(pools, "source", 93, SEED, balanced).select("source", "size", "take")


def balanced_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allocated(spark, sf_dir, True)


def proportional_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allocated(spark, sf_dir, False)


ALLOC_SQL = """
WITH p AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
q AS (SELECT source, size, {w} AS w, sum({w}) OVER () AS t FROM p),
f AS (SELECT source, size, (93 * w // t)::BIGINT AS f, 93 * w % t AS r, sha256('7|allocation|' || source || '|') AS tie FROM q)
SELECT source, size, (f + CASE WHEN row_number() OVER (ORDER BY r DESC, tie) <= 93 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS take FROM f
"""


def equal_size_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every language in the full, control and leave-one-out arms."""
    built = arms.equal_size(table(spark, sf_dir, "documents"), SEED, "doc_id", "lang")
    return built.groupBy("arm", "lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


EQUAL_SQL = """
WITH d AS (SELECT doc_id, lang FROM documents),
n AS (SELECT sum(c) - max(c) AS n FROM (SELECT count(*) AS c FROM d GROUP BY lang)),
l AS (SELECT DISTINCT lang AS gone FROM d),
a AS (
  SELECT 'full' AS arm, doc_id, lang, 0 AS nth FROM d
  UNION ALL SELECT 'random_control', doc_id, lang, row_number() OVER (ORDER BY sha256('7|random_control|all|' || doc_id), doc_id::VARCHAR) FROM d
  UNION ALL SELECT 'no_' || gone, doc_id, lang, row_number() OVER (PARTITION BY gone ORDER BY sha256('7|no_' || gone || '|' || gone || '|' || doc_id), doc_id::VARCHAR)
  FROM d JOIN l ON lang <> gone)
SELECT arm, lang, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM a, n WHERE nth <= n.n GROUP BY arm, lang
"""


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 line items, proportional over flag and status."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"), F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("stratum")
    )
    return sampling.stratified(lines, "line_id", "stratum", 1000, SEED, "lines")


STRATIFIED_SQL = """
WITH d AS (SELECT l_orderkey || '-' || l_linenumber AS line_id, l_returnflag || l_linestatus AS stratum FROM lineitem),
p AS (SELECT stratum, count(*) AS w, sum(count(*)) OVER () AS t FROM d GROUP BY stratum),
f AS (SELECT stratum, 1000 * w // t AS f, 1000 * w % t AS r FROM p),
a AS (SELECT stratum, f + CASE WHEN row_number() OVER (ORDER BY r DESC, stratum DESC) <= 1000 - sum(f) OVER () THEN 1 ELSE 0 END AS take FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7|lines|' || stratum || '|' || line_id), line_id) AS nth FROM d)
SELECT line_id, n.stratum FROM n JOIN a ON n.stratum = a.stratum WHERE nth <= take
"""


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents at most, a tenth of all, over source and language; documents of low quality are forced in."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    forced = labels.filter("quality = 0 AND toxic = 1").select("doc_id")
    return splits.holdout(docs, "doc_id", ["source", "lang"], 100, SEED, forced).select("doc_id", "split")


HOLDOUT_SQL = """
WITH d AS (SELECT doc_id, source || '/' || lang AS s, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1) AS forced FROM documents),
n AS (SELECT greatest(0, least(100, count(*) // 10) - count(*) FILTER (forced)) AS n, least(100, count(*) // 10) AS most FROM d),
o AS (SELECT * FROM d WHERE NOT forced),
p AS (SELECT s, count(*) AS w, sum(count(*)) OVER () AS t FROM o GROUP BY s),
f AS (SELECT s, n.n * w // t AS f, n.n * w % t AS r, n.n FROM p, n),
a AS (SELECT s, f + CASE WHEN row_number() OVER (ORDER BY r DESC, s) <= n - sum(f) OVER () THEN 1 ELSE 0 END AS take FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sha256('7|holdout|' || s || '|' || doc_id), doc_id::VARCHAR) AS nth FROM o)
SELECT doc_id, CASE WHEN nth <= take THEN 'validation' ELSE 'train' END AS split FROM k JOIN a ON k.s = a.s
UNION ALL SELECT doc_id, 'validation' FROM d WHERE forced
"""


def split_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index within each split."""
    return splits.reindexed(holdout_split(spark, sf_dir), "split", "doc_id", SEED).select("doc_id", "split", "index")


INDEX_SQL = f"""
WITH h AS ({HOLDOUT_SQL})
SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY sha256('7|index|' || split || '|' || doc_id), doc_id::VARCHAR) - 1 AS "index" FROM h
"""


def first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 first orders by hash."""
    return sampling.first_by_rank(table(spark, sf_dir, "orders"), "o_orderkey", 200, SEED, "single_pool", "orders")


FIRST_SQL = "SELECT o_orderkey FROM orders ORDER BY sha256('7|single_pool|orders|' || o_orderkey), o_orderkey::VARCHAR LIMIT 200"


def top_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 first customers of each segment by hash."""
    people = table(spark, sf_dir, "customer")
    return sampling.first_by_category(people, "c_custkey", "c_mktsegment", 10, SEED).select("c_custkey", "c_mktsegment", F.col("nth").cast("long"))


TOP_SQL = """
SELECT * FROM (SELECT c_custkey, c_mktsegment,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7|single_pool|' || c_mktsegment || '|' || c_custkey), c_custkey::VARCHAR) AS nth FROM customer)
WHERE nth <= 10
"""


def set_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each language's ids that doesn't depend on order, and the seeds of their arms."""
    docs = table(spark, sf_dir, "documents")
    return set_digests(docs, "doc_id", "lang").withColumn("seed", arm_seed_column(SEED, "lang").cast("string"))


IDENTITY_SQL = """
SELECT lang, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR) || chr(10)) AS digest,
       (('0x' || substr(sha256('7:' || lang), 1, 16))::UBIGINT)::VARCHAR AS seed FROM documents GROUP BY lang
"""


def set_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-free digest of ids that holds for sets of any size."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(set_fingerprint("o_orderkey").cast("string").alias("digest"), F.count("*").alias("n"))


FINGERPRINT_SQL = "SELECT o_orderpriority, sum(('0x' || sha256(o_orderkey::VARCHAR)[1:15])::HUGEINT)::VARCHAR AS digest, count(*) AS n FROM orders GROUP BY o_orderpriority"


QUERIES = {
    "loo_arm": loo_arm,
    "recipe_arms": recipe_arms,
    "nested_check": nested_check,
    "balanced_alloc": balanced_alloc,
    "proportional_alloc": proportional_alloc,
    "equal_size_arms": equal_size_arms,
    "stratified_sample": stratified_sample,
    "holdout_split": holdout_split,
    "split_index": split_index,
    "first_ids": first_ids,
    "top_per_category": top_per_category,
    "set_identity": set_identity,
    "set_fingerprints": set_fingerprints,
}
ORACLE_SQL = {
    "loo_arm": LOO_SQL,
    "recipe_arms": RECIPE_SQL,
    "nested_check": "SELECT 0::BIGINT AS outside",
    "balanced_alloc": ALLOC_SQL.format(w="1"),
    "proportional_alloc": ALLOC_SQL.format(w="size"),
    "equal_size_arms": EQUAL_SQL,
    "stratified_sample": STRATIFIED_SQL,
    "holdout_split": HOLDOUT_SQL,
    "split_index": INDEX_SQL,
    "first_ids": FIRST_SQL,
    "top_per_category": TOP_SQL,
    "set_identity": IDENTITY_SQL,
    "set_fingerprints": FINGERPRINT_SQL,
}
