"""Queries over what a run leaves beside its tables: recipes, receipts, names, paths and verdict records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..operators import arms, contracts, rewards
from ..session import dealt, table
from ..sources import readers, writers
from ..sources.scratch import scratch

SEED = 7


def recipe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe of the languages, written in one step beside the run, not to be overwritten, found among layouts and read again."""
    folder = scratch(spark, "recipe")
    sizes = arms.pool_sizes(table(spark, sf_dir, "documents"), "lang")
    writers.atomic_json([{"name": f"no_{c}", "removed": c, "rows": n} for c, n in sorted(sizes.items())], f"{folder}/v2/recipe.json", spark)
    try:
        writers.exclusive_json([], f"{folder}/v2/recipe.json", spark)
        refused = False
    except FileExistsError:
        refused = True
    found = readers.first_existing([f"{folder}/v1/recipe.json", f"{folder}/v2/recipe.json"], spark)
    lines = spark.createDataFrame(readers.config(found, spark), "name string, removed string, rows long")  # a line a language
    return lines.select("name", "removed", "rows", F.lit(writers.relative_or_whole(found, folder)).alias("path"), F.lit(refused).alias("refused"))


RECIPE_SQL = "SELECT 'no_' || lang AS name, lang AS removed, count(*) AS rows, 'v2/recipe.json' AS path, true AS refused FROM documents GROUP BY lang"


def fallback_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of records whose graders name them differently; empty texts fall through, zeros do not."""
    size = F.col("p_size").cast("double")
    some = lambda k, v: F.when(F.col("p_partkey") % k == 0, v)
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", some(2, size * 0).alias("pass_frac"), some(3, size / 64).alias("test_pass_fraction"), some(5, size / 128).alias("pass_ratio"), some(7, size / 256).alias("score"), some(11, F.col("p_size") > 25).alias("passed"),
        some(2, F.lit("")).alias("status"), some(3, F.lit("timeout")).alias("verdict"),
    )
    return rows.select("p_partkey", rewards.fallback_fraction().alias("fraction"), rewards.fallback_status("status", "verdict").alias("status"))


FALLBACK_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN p_size / 64 WHEN p_partkey % 5 = 0 THEN p_size / 128 WHEN p_partkey % 7 = 0 THEN p_size / 256 WHEN p_partkey % 11 = 0 THEN (p_size > 25)::INT END::DOUBLE AS fraction,
  CASE WHEN p_partkey % 3 = 0 THEN 'timeout' ELSE 'unknown' END AS status FROM part
"""


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of arms as files may have them: what is wrong with each, and how often it stands."""
    kinds = F.array(F.col("p_brand"), F.concat(F.lit("-"), F.col("p_partkey")), F.concat(F.lit("arm_"), F.col("p_partkey")), F.lit("base"), F.concat(F.col("p_partkey"), F.lit("\n")))
    return arms.name_faults(table(spark, sf_dir, "part").select(kinds[F.col("p_partkey") % 5].alias("name")), "name")


NAME_SQL = """
WITH n AS (SELECT [p_brand, '-' || p_partkey, 'arm_' || p_partkey, 'base', p_partkey || chr(10)][p_partkey % 5 + 1] AS name FROM part)
SELECT name, count(*) AS n, CASE WHEN NOT regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9_-]*') THEN 'unsafe' WHEN name = 'base' THEN 'reserved' ELSE 'repeated' END AS fault FROM n GROUP BY name
HAVING NOT regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9_-]*') OR name = 'base' OR count(*) > 1
"""


def smallest_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of all languages with as many rows of each as the smallest one has."""
    docs = table(spark, sf_dir, "documents")
    recipe = [{"name": "even", "mode": "mixture", "categories": sorted(arms.pool_sizes(docs, "lang")), "per_category": "minimum"}]
    return arms.build(docs, recipe, SEED, "doc_id", "lang").select("arm", "doc_id", "lang")


SMALLEST_SQL = f"""
SELECT 'even' AS arm, doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}|single_pool|' || lang || '|' || doc_id), doc_id::VARCHAR) AS nth FROM documents)
WHERE nth <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
"""

RESUME_KEYS = ("model", "adapter", "seed", "prompt_mode", "temperature", "top_p", "max_tokens", "tasks", "data_sha256")


def resume_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumed runs, a part each: which of the nine settings are not what the run began with."""
    p = table(spark, sf_dir, "part")
    before = p.select("p_partkey", F.col("p_brand").alias("model"), F.when(F.col("p_size") > 9, F.col("p_type")).alias("adapter"), *[F.concat(F.lit(f"{k} "), F.col("p_size")).alias(k) for k in RESUME_KEYS[2:]])
    changed = {k: F.when(F.col("p_partkey") % (i + 3) == 0, F.lit("other")).otherwise(F.col(k)) for i, k in enumerate(RESUME_KEYS)}
    now = before.filter("p_partkey % 13 <> 0").withColumns(changed)
    return contracts.resume_differences(before, now, "p_partkey", RESUME_KEYS)


RESUME_SQL = f"""
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'not resumed' ELSE concat_ws(',', {", ".join(f"CASE WHEN p_partkey % {i + 3} = 0 THEN '{k}' END" for i, k in enumerate(RESUME_KEYS))}) END AS changed FROM part
WHERE p_partkey % 13 = 0 OR {" OR ".join(f"p_partkey % {i + 3} = 0" for i in range(len(RESUME_KEYS)))}
"""


def paths_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output paths, a part each, and whether they lie in the checkout once dots are resolved."""
    shapes = ["concat('/work/repo/', p_brand)", "concat('/work/repo/../', p_brand)", "concat('/work/repos/', p_brand)", "concat('/work/x/.././repo/', p_partkey)", "'/work/repo'", "concat('/work//repo/a/../../', p_partkey)"]
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"array({', '.join(shapes)})[p_partkey % 6] AS path")
    return rows.select("p_partkey", contracts.inside("path", "/work/repo").alias("inside"))


OUTSIDE_SQL = "SELECT p_partkey, p_partkey % 6 IN (0, 3, 4) AS inside FROM part"


def long_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with NULs, and some beyond what the parser looks at: what is read of them."""
    pad = F.when(F.col("p_size") == 7, F.repeat(F.concat(F.lit("# "), F.col("p_name"), F.lit("\n")), 12_000)).otherwise("")
    reply = F.concat(F.lit("```python\nx"), F.lit("\0"), F.lit(" = "), F.col("p_size"), F.lit("\n"), pad, F.lit("\0y = 2\n```"))
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    rows = parts.select("p_partkey", reply.alias("reply"))
    read = rows.select("p_partkey", code.reward_code("reply").alias("code"))
    return read.select("p_partkey", F.length("code").cast("long").alias("chars"), F.sha2(F.col("code").cast("binary"), 256).alias("code_sha256"))


LONG_SQL = f"""
WITH c AS (SELECT p_partkey, trim(('x = ' || p_size || chr(10) || CASE WHEN p_size = 7 THEN repeat('# ' || p_name || chr(10), 12000) ELSE '' END || 'y = 2')[1:{code.REWARD_CHARS}], ' ' || chr(10)) AS code FROM part)
SELECT p_partkey, length(code) AS chars, sha256(code) AS code_sha256 FROM c
"""

QUERIES = {
    "recipe_files": recipe_files,
    "fallback_verdicts": fallback_verdicts,
    "safe_names": safe_names,
    "smallest_arms": smallest_arms,
    "resume_contract": resume_contract,
    "paths_outside": paths_outside,
    "long_replies": long_replies,
}
ORACLE_SQL = {
    "recipe_files": RECIPE_SQL,
    "fallback_verdicts": FALLBACK_SQL,
    "safe_names": NAME_SQL,
    "smallest_arms": SMALLEST_SQL,
    "resume_contract": RESUME_SQL,
    "paths_outside": OUTSIDE_SQL,
    "long_replies": LONG_SQL,
}
