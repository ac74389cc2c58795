"""Queries over classification, counts, joins, duplicates and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, hashing
from ..functions import text as tx
from ..operators import classify, contracts, dedup, histograms, joins, prompts
from ..session import table

#: Tags that parts are given here by their size and key, some in other spellings and one unknown.
POOL = ("DP ", "graphs", "Arrays", "math", "greedy", "strings", "geometry", "bits", "recursion", "sorting", "implementation", "mystery tag", "")
_POOL_SQL = "[" + ", ".join(f"'{t}'" for t in POOL) + "]"
_TAG_SQL = ", ".join(f"('{t}', '{c}')" for t, c in classify.tag_map(classify.TAGS).items())
_PRIORITY_SQL = ", ".join(f"('{c}', {i})" for i, c in enumerate(classify.CATEGORIES))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    pool = F.array(*[F.lit(t) for t in POOL])
    pick = lambda c: F.array(F.get(pool, (F.col(c) % len(POOL)).cast("int")))
    rows = parts.select("p_partkey", pick("p_size").alias("raw_tags"), pick("p_partkey").alias("tags"), F.split("p_name", " ").alias("skill_types"))
    return classify.classified(rows, "raw_tags", "tags", "skill_types")


#: (p_partkey, tag) of distinct clean tags, then categories by priority.
_TAGGED_SQL = f"""
m(tag, category) AS (VALUES {_TAG_SQL}), pr(category, place) AS (VALUES {_PRIORITY_SQL}),
t AS (SELECT DISTINCT p_partkey, trim(lower(x)) AS tag FROM (
  SELECT p_partkey, unnest(list_concat([{_POOL_SQL}[p_size % {len(POOL)} + 1], {_POOL_SQL}[p_partkey % {len(POOL)} + 1]], string_split(p_name, ' '))) AS x FROM part)
  WHERE trim(x) <> ''),
c AS (SELECT DISTINCT p_partkey, m.category, place FROM t JOIN m ON t.tag = m.tag JOIN pr ON pr.category = m.category),
k AS (SELECT p.p_partkey, (SELECT count(*) FROM t WHERE t.p_partkey = p.p_partkey) AS n_tags,
      coalesce(string_agg(c.category, ',' ORDER BY place), '') AS categories,
      coalesce(min_by(c.category, place), 'other_tagged') AS first_category
      FROM part p LEFT JOIN c ON c.p_partkey = p.p_partkey GROUP BY p.p_partkey),
tagged AS (SELECT p_partkey, n_tags, categories, CASE WHEN n_tags = 0 THEN 'no_tags' ELSE first_category END AS primary_category FROM k)
"""


def tag_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select(
        "p_partkey", F.size("all_normalized_tags").cast("long").alias("n_tags"), F.array_join("overlap_categories", ",").alias("categories"), "primary_category"
    )


def primary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.frequency(_tagged(spark, sf_dir), "primary_category")


def overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir).withColumn("shown", classify.overlap_or_primary("overlap_categories", "primary_category"))
    return histograms.exploded_frequency(rows, "shown")


OVERLAP_SQL = f"WITH {_TAGGED_SQL} SELECT name, count(*) AS n FROM (SELECT unnest(string_split(CASE WHEN categories = '' THEN primary_category ELSE categories END, ',')) AS name FROM tagged) GROUP BY name"


def bucket_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir).withColumn("bucket", classify.bucket("primary_category"))
    return histograms.zero_filled(rows, "bucket", [*classify.CORE_BUCKETS, "other_algorithm", "no_tags"])


_SMALL_SQL = ", ".join(f"'{c}'" for c in classify.CORE_BUCKETS)
BUCKET_SQL = f"""
WITH {_TAGGED_SQL}, d(name) AS (VALUES {", ".join(f"('{c}')" for c in (*classify.CORE_BUCKETS, "other_algorithm", "no_tags"))}),
b AS (SELECT CASE WHEN primary_category IN ({_SMALL_SQL}, 'no_tags') THEN primary_category ELSE 'other_algorithm' END AS name FROM tagged)
SELECT d.name, count(b.name) AS n FROM d LEFT JOIN b ON b.name = d.name GROUP BY d.name
"""


def overlap_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stay when a bucket and all that overlaps it goes."""
    gone = F.array(*[F.lit(c) for c in classify.removed_by("other_algorithm")])
    kept = _tagged(spark, sf_dir).filter(~arrays.overlaps("overlap_categories", gone))
    return kept.groupBy(classify.formal("primary_category").alias("name")).agg(F.count("*").alias("n"))


EXCLUSION_SQL = f"""
WITH {_TAGGED_SQL}
SELECT CASE WHEN primary_category IN ({_SMALL_SQL}, 'no_tags') THEN primary_category ELSE 'other_algorithm' END AS name, count(*) AS n
FROM tagged WHERE NOT list_has_any(string_split(categories, ','), [{", ".join(f"'{c}'" for c in classify.SMALL_CATEGORIES)}]) GROUP BY 1
"""


def unmapped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.unmapped(_tagged(spark, sf_dir), "all_normalized_tags", classify.dimension(spark, classify.TAGS))


UNMAPPED_SQL = f"WITH {_TAGGED_SQL} SELECT tag, count(*) AS n FROM t WHERE tag NOT IN (SELECT tag FROM m) GROUP BY tag"


def taxonomy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels under groups, mapped by exact entry or wildcard."""
    groups = F.array(*[F.lit(x) for x in ("array_hashing_and_sorting", "string_and_parsing", "dynamic_programming", "unknown_group")])
    names = F.array(*[F.lit(x) for x in ("sorting", "matrix", "anything")])
    parts = table(spark, sf_dir, "part")
    label = F.concat(F.get(groups, F.col("p_size") % 4), F.lit("/"), F.get(names, (F.col("p_partkey") % 3).cast("int")))
    return parts.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n")).select("label", classify.taxonomy("label").alias("mapped"), "n")


TAXONOMY_SQL = f"""
WITH m(k, v) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in classify.TAXONOMY.items())}),
l AS (SELECT ['array_hashing_and_sorting', 'string_and_parsing', 'dynamic_programming', 'unknown_group'][p_size % 4 + 1] || '/' || ['sorting', 'matrix', 'anything'][p_partkey % 3 + 1] AS label FROM part)
SELECT label, coalesce((SELECT v FROM m WHERE k = label), (SELECT v FROM m WHERE k = string_split(label, '/')[1] || '/*')) AS mapped, count(*) AS n FROM l GROUP BY label
"""


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.distribution(table(spark, sf_dir, "documents"), "lang", "source")


DISTRIBUTION_SQL = """
SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
"""


def role_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.distribution(table(spark, sf_dir, "conversations"), "role", "turn")


ROLE_SQL = """
SELECT 'role' AS dimension, role AS value, count(*) AS n FROM conversations GROUP BY role
UNION ALL SELECT 'turn', turn::VARCHAR, count(*) FROM conversations GROUP BY turn
"""


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most common first, ties by first appearance."""
    return histograms.most_common(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey").select("name", "n")


TOP_SQL = "SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, min(o_orderkey) LIMIT 80"


def composite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.composite(table(spark, sf_dir, "documents"), "lang", "source")


COMPOSITE_SQL = "SELECT lang || '::' || source AS name, count(*) AS n FROM documents GROUP BY 1"


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, mean, median, least and most of lengths by language."""
    return histograms.summary(table(spark, sf_dir, "documents"), "n_chars", "lang")


STATS_SQL = "SELECT lang, count(n_chars) AS n, sum(n_chars)::BIGINT AS total, avg(n_chars) AS mean, median(n_chars) AS median, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang"


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile by three definitions."""
    return histograms.percentiles(table(spark, sf_dir, "documents"), "n_chars", 0.95)


PERCENTILE_SQL = """
WITH r AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT min(v) FILTER (k = floor(0.95 * (n - 1))) AS lower, min(v) FILTER (k = least(n - 1, floor(0.95 * n))) AS upper,
       min(v) FILTER (k = round_even((n - 1) * 0.95, 0)) AS nearest FROM r
"""


def reason_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 ids of each source."""
    out = histograms.examples(table(spark, sf_dir, "documents"), "source", "doc_id")
    return out.select("source", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


EXAMPLES_SQL = """
SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS examples
FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 20 GROUP BY source
"""


def loss_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histograms.loss_summary(table(spark, sf_dir, "events"), "event_id", "value")
    return out.select("n", "first_loss", "last_loss", "min_loss", F.round("std_loss", 6).alias("std_loss"), F.round("tail_mean", 6).alias("tail_mean"))


LOSS_SQL = """
SELECT count(*) AS n, arg_min(value, event_id) AS first_loss, arg_max(value, event_id) AS last_loss, min(value) AS min_loss,
       round(stddev_pop(value), 6) AS std_loss,
       (SELECT round(avg(value), 6) FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 20)) AS tail_mean FROM events
"""


def multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents share, up to white space."""
    return histograms.multiplicity(table(spark, sf_dir, "documents").select(dedup.text_key("text").alias("k")), "k")


_COLLAPSED = r"trim(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ' ', 'g'))"
MULTIPLICITY_SQL = f"""
SELECT count(*) AS distinct_keys, count(*) FILTER (n > 1) AS repeated_keys, sum(n - 1)::BIGINT AS extra_rows
FROM (SELECT count(*) AS n FROM documents GROUP BY {_COLLAPSED})
"""


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document with the same text up to white space."""
    return dedup.keep_first(table(spark, sf_dir, "documents"), "doc_id", dedup.text_key("text")).select(F.col("id").alias("doc_id"), "kept_id")


DEDUP_SQL = f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {_COLLAPSED}) AS kept_id FROM documents"


def pair_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as (role, text) pairs: keys and first rows."""
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    keyed = rows.select("id", hashing.pair_key("role", "text").alias("key"))
    return keyed.groupBy("key").agg(F.min("id").alias("kept_id"), F.count("*").alias("n"))


PAIR_SQL = f"SELECT sha256(role || chr(0) || {_COLLAPSED}) AS key, min(conv_id * 1000 + turn) AS kept_id, count(*) AS n FROM conversations GROUP BY 1"


def index_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.missing_summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return out.select("matched", "missing", F.array_join(F.transform("first_missing", lambda x: x.cast("string")), ",").alias("first_missing"))


MISSING_SQL = """
WITH j AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS hit FROM documents)
SELECT count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit) AS missing,
       (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM j WHERE NOT hit ORDER BY doc_id LIMIT 20)) AS first_missing FROM j
"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return joins.transitions(
        labels.select("doc_id", (F.col("quality") == 1).alias("passed")), labels.select("doc_id", (F.col("toxic") == 0).alias("passed")), "doc_id"
    )


TRANSITIONS_SQL = """
SELECT count(*) AS compared, count(*) FILTER (quality = 1 AND toxic = 1) AS pass_to_fail, count(*) FILTER (quality <> 1 AND toxic = 0) AS fail_to_pass FROM labels
"""


def overlap_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts that stand whole in a document's line, up to white space."""
    docs = table(spark, sf_dir, "documents").select(F.explode(tx.lines("text")).alias("line")).select(tx.collapse("line").alias("text"))
    return joins.overlap(table(spark, sf_dir, "benchmark").select(tx.collapse("text").alias("text")), docs, "text")


GUARD_SQL = f"""
WITH b AS (SELECT DISTINCT {_COLLAPSED} AS text FROM benchmark),
l AS (SELECT {_COLLAPSED} AS text FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents))
SELECT text FROM b WHERE text IN (SELECT text FROM l)
"""


def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


PENDING_SQL = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user by first appearance."""
    out = joins.label_sets(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")
    return out.select("user_id", F.array_join("labels", ",").alias("labels"))


LABEL_SQL = """
SELECT user_id, string_agg(event_type, ',' ORDER BY seen) AS labels
FROM (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY ALL) GROUP BY user_id
"""


def order_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose role isn't the one that alternation gives."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "role", "turn")
    wanted = turns.select("ord", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("role"))
    return joins.order_differences(turns, wanted, "ord", "role")


ORDER_SQL = """
SELECT ord, role AS "left", want AS "right" FROM (
  SELECT conv_id * 1000 + turn AS ord, role, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS want FROM conversations) WHERE role <> want
"""


def union_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    firms = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return joins.fused(people, firms, {"segment": "NONE", "kind": "customer"}).select("id", "name", "segment", "kind")


FUSION_SQL = """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'customer' AS kind FROM customer
UNION ALL SELECT s_suppkey, s_name, 'NONE', 'supplier' FROM supplier
"""


def job_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "region").select(F.col("r_name").alias("model"))
    seeds = spark.createDataFrame([(7,), (11,)], "seed long")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("arm"))
    return joins.jobs(models, seeds, names).select("model", F.coalesce(F.col("seed").cast("string"), F.lit("none")).alias("seed"), "arm")


JOBS_SQL = """
SELECT r_name AS model, seed::VARCHAR AS seed, n_name AS arm FROM region, (VALUES (7::BIGINT), (11)) s(seed), nation
UNION ALL SELECT r_name, 'none', 'base' FROM region
"""


def group_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advantages of line items within their order; orders of one price level drop out."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    out = joins.group_normalised(lines, "l_orderkey", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", F.round("advantage", 6).alias("advantage"))


NORMAL_SQL = """
SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / (stddev_samp(l_quantity) OVER w + 1e-6), 6) AS advantage
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey) QUALIFY min(l_quantity) OVER w < max(l_quantity) OVER w
"""


def messages_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pairs of turns as training rows; those that break the contract, by reason."""
    turns = table(spark, sf_dir, "conversations")
    said = lambda n: F.max(F.when(F.col("turn") == n, F.struct("role", F.col("text").alias("content"))))
    rows = turns.groupBy("conv_id").agg(F.array_compact(F.array(said(0), said(1))).alias("messages"))
    rows = rows.select("conv_id", "messages", F.get("messages", F.lit(0))["content"].alias("prompt"), F.get("messages", F.lit(1))["content"].alias("answer"))
    bad = contracts.row_violations(rows, ["prompt", "answer"])
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


CONTRACT_SQL = """
WITH c AS (SELECT conv_id, max(role) FILTER (turn = 0) AS r0, max(text) FILTER (turn = 0) AS t0, max(role) FILTER (turn = 1) AS r1, max(text) FILTER (turn = 1) AS t1 FROM conversations GROUP BY conv_id),
r AS (SELECT CASE WHEN coalesce(t0, t1) IS NULL THEN 'missing prompt,answer' WHEN t0 IS NULL OR t1 IS NULL THEN 'missing answer'
  WHEN r0 <> 'user' OR r1 <> 'assistant' THEN 'messages are not the prompt and the answer' END AS reason FROM c)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason
"""


def chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as plain and as role-headed text: digests."""
    turns = table(spark, sf_dir, "conversations")
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    rows = turns.groupBy("conv_id").agg(said.alias("m"))
    return rows.select("conv_id", F.sha2(prompts.plain_chat("m"), 256).alias("plain"), F.sha2(prompts.fallback_chat("m"), 256).alias("headed"))


CHAT_SQL = """
SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS plain,
       sha256(string_agg(upper(role[1]) || lower(role[2:]) || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Assistant:' || chr(10)) AS headed
FROM conversations GROUP BY conv_id
"""


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of JSON in events and the sum of a field."""
    events = table(spark, sf_dir, "events")
    parsed = arrays.lenient_object("props", "k bigint")
    return events.groupBy(arrays.json_kind("props").alias("kind"), "event_type").agg(F.count("*").alias("n"), F.sum(parsed["k"]).alias("k_sum"))


JSON_SQL = """
SELECT CASE json_type(TRY_CAST(props AS JSON)) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE coalesce('other', 'invalid') END AS kind,
       event_type, count(*) AS n, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS k_sum FROM events GROUP BY 1, 2
"""


def lint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name a home folder, a credential or a run."""
    hits = table(spark, sf_dir, "documents").select("doc_id", *tx.lint_hits("text"))
    return hits.filter("home_path OR credential OR run_id")


LINT_SQL = "SELECT * FROM (SELECT doc_id, {}) WHERE home_path OR credential OR run_id".format(
    ", ".join("regexp_matches(text, '{}') AS {}".format(p.replace("'", "''"), k) for k, p in tx.LINT.items()) + " FROM documents"
)


def collapsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(tx.collapse("html"), 256).alias("digest"))


COLLAPSED_SQL = f"SELECT page_id, sha256({_COLLAPSED.replace('text', 'html')}) AS digest FROM pages"


def level_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by level bucket, their size modulo 6 standing for the level."""
    rows = table(spark, sf_dir, "part").withColumn("level", F.col("p_size") % 6)
    return prompts.levels(rows).groupBy("bucket").agg(F.count("*").alias("n"))


LEVEL_SQL = "SELECT CASE WHEN p_size % 6 = 3 THEN 'medium' ELSE 'high' END AS bucket, count(*) AS n FROM part WHERE p_size % 6 >= 3 GROUP BY 1"

QUERIES = {
    "tag_classify": tag_classify,
    "primary_counts": primary_counts,
    "overlap_counts": overlap_counts,
    "bucket_rollup": bucket_rollup,
    "overlap_exclusion": overlap_exclusion,
    "unmapped_tags": unmapped_tags,
    "taxonomy_map": taxonomy_map,
    "distribution": distribution,
    "role_distribution": role_distribution,
    "top_sources": top_sources,
    "composite_counts": composite_counts,
    "token_stats": token_stats,
    "percentiles": percentiles,
    "reason_examples": reason_examples,
    "loss_summary": loss_summary,
    "multiplicity": multiplicity,
    "exact_dedup": exact_dedup,
    "pair_dedup": pair_dedup,
    "index_join_missing": index_join_missing,
    "transitions": transitions,
    "overlap_guard": overlap_guard,
    "pending_rows": pending_rows,
    "label_sets": label_sets,
    "order_differences": order_differences,
    "union_fusion": union_fusion,
    "job_matrix": job_matrix,
    "group_normalised": group_normalised,
    "messages_contract": messages_contract,
    "chat_texts": chat_texts,
    "json_props": json_props,
    "lint_paths": lint_paths,
    "collapsed_text": collapsed_text,
    "level_buckets": level_buckets,
}
ORACLE_SQL = {
    "tag_classify": f"WITH {_TAGGED_SQL} SELECT * FROM tagged",
    "primary_counts": f"WITH {_TAGGED_SQL} SELECT primary_category AS name, count(*) AS n FROM tagged GROUP BY 1",
    "overlap_counts": OVERLAP_SQL,
    "bucket_rollup": BUCKET_SQL,
    "overlap_exclusion": EXCLUSION_SQL,
    "unmapped_tags": UNMAPPED_SQL,
    "taxonomy_map": TAXONOMY_SQL,
    "distribution": DISTRIBUTION_SQL,
    "role_distribution": ROLE_SQL,
    "top_sources": TOP_SQL,
    "composite_counts": COMPOSITE_SQL,
    "token_stats": STATS_SQL,
    "percentiles": PERCENTILE_SQL,
    "reason_examples": EXAMPLES_SQL,
    "loss_summary": LOSS_SQL,
    "multiplicity": MULTIPLICITY_SQL,
    "exact_dedup": DEDUP_SQL,
    "pair_dedup": PAIR_SQL,
    "index_join_missing": MISSING_SQL,
    "transitions": TRANSITIONS_SQL,
    "overlap_guard": GUARD_SQL,
    "pending_rows": PENDING_SQL,
    "label_sets": LABEL_SQL,
    "order_differences": ORDER_SQL,
    "union_fusion": FUSION_SQL,
    "job_matrix": JOBS_SQL,
    "group_normalised": NORMAL_SQL,
    "messages_contract": CONTRACT_SQL,
    "chat_texts": CHAT_SQL,
    "json_props": JSON_SQL,
    "lint_paths": LINT_SQL,
    "collapsed_text": COLLAPSED_SQL,
    "level_buckets": LEVEL_SQL,
}
