"""Queries over whole studies: audits, ablation and training arms, graded tasks, contracts."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import arms, classify, contracts, dedup, evaluate, histograms, sampling
from ..session import dealt, table
from . import studies
from .grading_queries import _GRADED_SQL, _graded
from .record_queries import _BUCKET_SQL, _PROBLEM_SQL, _cycle, _null, _problems
from .text_queries import READ_SQL, REPLY

SEED = 7


def _legacy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Parts as legacy rows, admitted problems, verified ones, repair candidates and their verdicts."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), "p_partkey", "p_size", "p_type", "p_brand")
    legacy = p.select("id", F.col("p_type").alias("prompt"), F.concat(F.lit(" "), F.col("p_brand")).alias("answer"))
    source = p.filter("p_partkey % 5 <> 0").select("id", F.when(F.col("p_partkey") % 7 == 0, "invalid_input_output_json").alias("reject_reason"))
    trusted = p.filter("p_partkey % 3 = 0").select("id", (F.col("p_partkey") % 2 == 0).alias("is_val"))
    pairs = p.filter("p_partkey % 2 = 0").select("id", "p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    candidates = pairs.select("id", "pos", F.concat(F.lit("kind"), F.col("pos")).alias("kind"), F.concat(F.lit("code "), F.col("pos")).alias("code"))
    verdicts = pairs.select("id", "pos", ((F.col("p_size") + F.col("pos")) % 3 == 0).alias("passed"))
    return legacy, source, trusted, candidates, verdicts


def verified_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and final answer of every legacy row; what is rejected is marked for export."""
    legacy, source, trusted, candidates, verdicts = _legacy(spark, sf_dir)
    repairs = candidates.select("id").distinct().join(dedup.first_repair(candidates, verdicts), "id", "left")
    audited = studies.verified_rows(legacy, source, trusted, repairs, True)
    rejected = dedup.rejected_rows(audited).select("id", F.lit(True).alias("rejected"))
    return audited.join(rejected, "id", "left").select("id", "status", "answer", "was_validation", F.coalesce("rejected", F.lit(False)).alias("rejected"))


AUDIT_SQL = """
WITH p AS (SELECT 'p' || p_partkey AS id, *, CASE WHEN p_partkey % 2 = 0 AND p_size % 3 = 0 THEN 0 WHEN p_partkey % 2 = 0 AND (p_size + 1) % 3 = 0 THEN 1 END AS pos FROM part),
s AS (SELECT id, p_type, coalesce('code ' || pos, ' ' || p_brand) AS answer, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 END, false) AS was_validation,
  CASE WHEN p_partkey % 5 = 0 THEN 'not_in_rl_dedup_source' WHEN p_partkey % 7 = 0 THEN 'invalid_input_output_json' WHEN p_partkey % 3 = 0 THEN 'kept_verified' WHEN pos IS NOT NULL THEN 'repaired_verified'
    WHEN p_partkey % 2 = 0 THEN 'all_simple_repairs_failed' ELSE 'canonical_failed_no_safe_mechanical_repair' END AS status FROM p),
d AS (SELECT *, CASE WHEN status IN ('kept_verified', 'repaired_verified') THEN min(id) FILTER (status IN ('kept_verified', 'repaired_verified')) OVER (PARTITION BY p_type, trim(answer)) END AS kept_id FROM s),
f AS (SELECT id, CASE WHEN kept_id <> id THEN 'exact_prompt_answer_duplicate' ELSE status END AS status, answer, was_validation FROM d)
SELECT *, status NOT IN ('kept_verified', 'repaired_verified') AS rejected FROM f
"""


def canonical_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", _cycle("p_partkey", "code", " ", _null()).alias("solution"), (F.col("p_size") % 2 == 0).alias("passed"), (F.col("p_size") % 7).alias("code"))
    return rows.select("p_partkey", dedup.preflight(F.col("solution"), F.col("passed"), F.col("code")).alias("reason"))


PREFLIGHT_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'no_canonical_structural_only' WHEN p_size % 2 = 0 THEN 'canonical_full_pass' ELSE 'canonical_failed_status_' || p_size % 7 END AS reason FROM part
"""


def _categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _problems(spark, sf_dir)
    return studies.with_categories(rows.select("id"), rows.select("id", "primary_category", "overlap_categories"))


_FORMAL = lambda c: f"CASE WHEN {c} IN ({', '.join(repr(x) for x in (*classify.CORE_BUCKETS, 'no_tags'))}) THEN {c} ELSE 'other_algorithm' END"
_CATEGORY_SQL = f"""
{_PROBLEM_SQL}, cats AS (SELECT id, ord, {_FORMAL("primary_category")} AS category,
  CASE WHEN len(overlap) = 0 THEN [{_FORMAL("primary_category")}] ELSE list_sort(list_distinct(list_transform(overlap, lambda c: {_FORMAL("c")}))) END AS overlap FROM problems)
"""


def formal_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their formal category and overlap from the index, which must have them all."""
    return _categorised(spark, sf_dir).select("id", "category", F.array_join("overlap", ",").alias("overlap"))


FORMAL_SQL = f"WITH {_CATEGORY_SQL} SELECT id, category, array_to_string(overlap, ',') AS overlap FROM cats"

ARM_ROWS = 40


def ablation_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms of equal size, each without the rows that have one category in their overlap."""
    return studies.ablation(_categorised(spark, sf_dir), ARM_ROWS, SEED)


ABLATION_SQL = f"""
WITH {_CATEGORY_SQL}, g AS (SELECT DISTINCT category AS gone FROM cats),
r AS (SELECT gone, id, row_number() OVER (PARTITION BY gone ORDER BY sha256('{SEED}|ablation|' || gone || '|' || id), id) AS nth FROM cats, g WHERE NOT list_contains(overlap, gone))
SELECT 'full' AS arm, id FROM cats UNION ALL SELECT 'no_' || gone, id FROM r WHERE nth <= {ARM_ROWS}
"""


def training_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of the full arm, a balanced control and an arm without each bucket."""
    rows = _problems(spark, sf_dir).withColumns({"dataset": _null(), "task_id": _null()})
    return studies.sft_arms(rows, ARM_ROWS, SEED).select("id", "arm", "removed_category", "source_bucket")


def _stratified_sql(label: str, seed: int, where: str) -> str:
    return f"""SELECT '{label}' AS arm, n.id FROM (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY sha256('{seed}|{label}|' || bucket || '|' || id), id) AS nth FROM usable WHERE {where}) n
  JOIN (SELECT bucket, f + CASE WHEN row_number() OVER (ORDER BY r DESC, bucket DESC) <= {ARM_ROWS} - sum(f) OVER () THEN 1 ELSE 0 END AS take
    FROM (SELECT bucket, {ARM_ROWS} * count(*) // sum(count(*)) OVER () AS f, {ARM_ROWS} * count(*) % sum(count(*)) OVER () AS r FROM usable WHERE {where} GROUP BY bucket)) t ON t.bucket = n.bucket WHERE nth <= take"""


_BUCKETS = (*classify.CORE_BUCKETS, "other_algorithm")
_without = lambda b: f"NOT list_has_any(shown, [{', '.join(repr(c) for c in classify.removed_by(b))}])"
ARMS_SQL = f"""
WITH {_PROBLEM_SQL}, usable AS (SELECT id, {_BUCKET_SQL} AS bucket, CASE WHEN len(overlap) > 0 THEN overlap ELSE [primary_category] END AS shown FROM problems WHERE canonical_solution <> ''),
a AS (SELECT 'full' AS arm, id FROM usable UNION ALL {_stratified_sql("balanced", SEED, "true")}
  {" ".join("UNION ALL " + _stratified_sql(f"no_{b}", SEED + 100 + i, _without(b)) for i, b in enumerate(_BUCKETS))})
SELECT id, arm, CASE WHEN starts_with(arm, 'no_') THEN arm[4:] END AS removed_category, bucket AS source_bucket FROM a JOIN usable USING (id)
"""


def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RL rows split by interface, with an index in hash order within each part."""
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("problem_id"), _cycle("p_size", "taco_stdin", "taco_function", "leetcode_function").alias("interface_kind"))
    return studies.rl_split(rows, 15, SEED).select("problem_id", "split", F.col("index").cast("long"))


VALIDATION_SQL = f"""
WITH d AS (SELECT 'p' || p_partkey AS problem_id, ['taco_stdin', 'taco_function', 'leetcode_function'][p_size % 3 + 1] AS s FROM part),
n AS (SELECT least(15, count(*) // 10) AS n FROM d),
p AS (SELECT s, count(*) AS w, sum(count(*)) OVER () AS t FROM d GROUP BY s),
f AS (SELECT s, n.n * w // t AS f, n.n * w % t AS r, n.n FROM p, n),
a AS (SELECT s, f + CASE WHEN row_number() OVER (ORDER BY r DESC, s) <= n - sum(f) OVER () THEN 1 ELSE 0 END AS take FROM f),
k AS (SELECT problem_id, s, row_number() OVER (PARTITION BY s ORDER BY sha256('{SEED}|holdout|' || s || '|' || problem_id), problem_id) AS nth FROM d),
h AS (SELECT problem_id, CASE WHEN nth <= take THEN 'validation' ELSE 'train' END AS split FROM k JOIN a ON k.s = a.s)
SELECT problem_id, split, row_number() OVER (PARTITION BY split ORDER BY sha256('{SEED}|index|' || split || '|' || problem_id), problem_id) - 1 AS "index" FROM h
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded replies of every task, made of parts in one scan; a small file is dealt out, since grading is work."""
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    base = parts.select("p_partkey", "p_size", F.expr(REPLY).alias("said"))
    size, letter = F.col("p_size").cast("string"), _cycle("p_size", "A", "B", "C")
    row = lambda task, reply, target, lower=_null(), upper=_null(), passed=_null("boolean"): F.struct(
        F.lit(task).alias("task"), reply.alias("reply"), target.alias("target"), lower.alias("lower"), upper.alias("upper"), passed.alias("passed")
    )
    said, asks = F.col("said"), F.concat(F.col("said"), F.lit("\nQ: and 17?"))
    finqa = F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(size)
    bound = lambda d: F.when(F.col("p_partkey") % 9 == 0, "none").otherwise((F.col("p_size") + d).cast("string"))
    code = lambda task: row(task, F.lit("code"), F.lit(""), passed=F.when(F.col("p_size") % 8 > 0, F.col("p_size") % 2 == 1))
    # of the harder formulas a third are equal, if at all, only when multiplied out
    product = F.expr("concat('(x+', p_size, ')(x-', p_partkey % 5, ')')")
    expanded = F.expr("concat('Hence \\\\boxed{x^{2}+(', p_size - p_partkey % 4, ')x-', p_size * (p_partkey % 4), '}.')")
    third = F.col("p_partkey") % 3 == 0
    rows = F.array(
        row("arc_challenge", letter, _cycle("p_partkey", "A", "B", "C")), row("scienceqa", letter, F.lit("B")), row("gsm8k", asks, size), row("math500_medium", said, size),
        row("math500_high_level", F.when(third, expanded).otherwise(said), F.when(third, product).otherwise(F.concat(F.lit("\\frac{"), size, F.lit("}{4}")))),
        row("medcalc", said, size, bound(-1), bound(1)), row("finqa", said, finqa), row("legalbench", _cycle("p_size", " Yes ", "no"), _cycle("p_partkey", "yes", "No")),
        *map(code, ("humaneval", "mbpp_plus", "mbpp_simple", "apps_hard")), row("healthbench", said, F.lit("")),
    )
    return base.select(F.explode(rows).alias("r")).select("r.*")


def task_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, scored rows and accuracy of every task from its recorded replies."""
    metrics, _ = studies.suite(_records(spark, sf_dir))
    return metrics.select("task", "suite", "n", "correct", F.round("accuracy", 9).alias("accuracy"), "raw_n")


_CLOSE = lambda t: f"abs(value - {t}) <= greatest(abs({t}) * 1e-6, 1e-4) OR percent AND abs(value / 100 - {t}) <= greatest(abs({t}) * 1e-6, 1e-4)"
_TASK_SQL = f"""
{READ_SQL}, graded AS (
  SELECT 'arc_challenge' AS task, p_size % 3 = p_partkey % 3 AS passed FROM part
  UNION ALL SELECT 'scienceqa', p_size % 3 = 1 FROM part
  UNION ALL SELECT 'gsm8k', coalesce({_CLOSE("p_size")}, false) FROM v
  UNION ALL SELECT 'math500_medium', coalesce({_CLOSE("p_size")}, false) FROM v
  UNION ALL SELECT 'math500_high_level', CASE WHEN p_partkey % 3 = 0 THEN list_bool_and(list_transform([0.5, 2.25, -3.75], lambda x: abs((x + p_size) * (x - p_partkey % 5) - (x * x + (p_size - p_partkey % 4) * x - p_size * (p_partkey % 4))) < 1e-9))
    ELSE coalesce({_CLOSE("(p_size / 4)")}, false) END FROM v
  UNION ALL SELECT 'medcalc', CASE WHEN p_partkey % 9 = 0 THEN value IS NOT NULL AND contains(reply, p_size::VARCHAR) ELSE coalesce(value BETWEEN p_size - 1 AND p_size + 1, false) END FROM v
  UNION ALL SELECT 'finqa', CASE WHEN p_partkey % 5 <> 0 THEN coalesce({_CLOSE("p_size")}, false) END FROM v
  UNION ALL SELECT 'legalbench', p_size % 2 = p_partkey % 2 FROM part
  UNION ALL SELECT unnest(['humaneval', 'mbpp_plus', 'mbpp_simple', 'apps_hard']), CASE WHEN p_size % 8 > 0 THEN p_size % 2 = 1 END FROM part
  UNION ALL SELECT 'healthbench', NULL FROM part),
m AS (SELECT task, count(passed) AS n, count(*) FILTER (passed) AS correct, count(*) FILTER (passed) / greatest(count(passed), 1)::DOUBLE AS accuracy, count(*) AS raw_n FROM graded GROUP BY task)
"""
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
TASK_SQL = f"""
WITH {_TASK_SQL} SELECT task, CASE WHEN task IN ({_list(evaluate.HARD)}) THEN 'hard' WHEN task IN ({_list(evaluate.DIAGNOSTIC)}) THEN 'diagnostic' ELSE 'main' END AS suite, n, correct, round(accuracy, 9) AS accuracy, raw_n FROM m
"""


def graded_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks name their grader in a table; one plan grades the replies of all, whatever the table says."""
    named = spark.createDataFrame([*studies.GRADED_BY.items(), ("healthbench", "none")], "task string, grader string")
    rows = _records(spark, sf_dir).join(F.broadcast(named), "task")  # a row a task
    verdict = studies.verdict(F.col("grader"), {g: g for g in studies.GRADERS})
    return evaluate.accuracy(rows.withColumn("passed", verdict), "grader").select("grader", "n", "correct", "raw_n")


_GRADER_CASE = " ".join(f"WHEN '{t}' THEN '{g}'" for t, g in studies.GRADED_BY.items())
BY_NAME_SQL = f"""
WITH {_TASK_SQL} SELECT CASE task {_GRADER_CASE} ELSE 'none' END AS grader, sum(n)::BIGINT AS n, sum(correct)::BIGINT AS correct, sum(raw_n)::BIGINT AS raw_n FROM m GROUP BY 1
"""


def task_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the tasks of the suites; names and aliases say which tasks there are."""
    _, means = studies.suite(_records(spark, sf_dir), evaluate.tasks("all"))
    return means.select(*[F.round(c, 9).alias(c) if c.endswith("mean") else F.col(c) for c in means.columns])


MEANS_SQL = f"""
WITH {_TASK_SQL} SELECT round(avg(accuracy) FILTER (task IN ({_list([x for x in evaluate.MAIN if x not in evaluate.UNSCORED])})), 9) AS main_scoreable_mean, round(avg(accuracy) FILTER (task IN ({_list(evaluate.HARD)})), 9) AS hard_mean,
  round(avg(accuracy) FILTER (task IN ({_list(evaluate.DIAGNOSTIC)})), 9) AS diagnostic_mean, round(avg(accuracy) FILTER (task IN ({_list(evaluate.OVERALL)})), 9) AS scoreable_overall_mean,
  count(*) FILTER (task IN ({_list(evaluate.OVERALL)})) AS scoreable_dataset_count FROM m
"""


def target_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric and text targets among names, sizes and types of parts."""
    none = F.expr("cast(array() as array<string>)")
    rows = table(spark, sf_dir, "part").select("p_partkey", _cycle("p_partkey", F.col("p_name"), F.concat(F.lit("$"), F.col("p_size")), F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand"))).alias("t"))
    return rows.select("p_partkey", evaluate.target_type("t", none).alias("kind"))


TYPES_SQL = "SELECT p_partkey, CASE WHEN regexp_matches([p_name, '$' || p_size, p_type || ' ' || p_brand][p_partkey % 3 + 1], '[0-9]') THEN 'numeric' ELSE 'text' END AS kind FROM part"


def mixed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components weighted alike over their subjects, and their mean."""
    out = studies.internal_mix(_graded(spark, sf_dir).select(F.col("lang").alias("component"), F.col("source").alias("subject"), "passed"))
    return out.select("component", F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"), "n")


MIX_SQL = f"""
WITH {_GRADED_SQL}, c AS (SELECT lang AS component, avg(correct / greatest(n, 1)::DOUBLE) AS macro, sum(correct) / greatest(sum(n), 1)::DOUBLE AS micro, sum(n)::BIGINT AS n FROM a GROUP BY lang)
SELECT component, round(macro, 9) AS macro, round(micro, 9) AS micro, n FROM c
UNION ALL SELECT 'mixed', round(avg(macro), 9), round(sum(micro * n) / sum(n), 9), sum(n)::BIGINT FROM c
"""


def choice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice with the largest mean log-probability, the first of equals."""
    some = lambda *cs: F.array(*[-F.col(c) for c in cs])
    choices = F.array(some("l_discount", "l_tax"), some("l_tax"), F.expr("cast(array() as array<double>)"), some("l_tax", "l_discount"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", evaluate.mean_log_probs(choices).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", evaluate.best_choice("s").cast("long").alias("choice"), (F.round(F.array_max("s"), 9) + F.lit(0.0)).alias("score"))


SCORES_SQL = """
SELECT l_orderkey, l_linenumber, CASE WHEN -(l_discount + l_tax) / 2 >= -l_tax THEN 0 ELSE 1 END::BIGINT AS choice, round(greatest((-l_discount - l_tax) / 2, -l_tax), 9) + 0.0 AS score FROM lineitem
"""


def label_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the label set of its type, labels by first appearance."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("ord"), F.col("p_brand").alias("task_type"), (F.col("p_size") % 7).cast("string").alias("target"))
    return studies.legal_choices(rows).select("p_partkey", F.array_join("labels", ",").alias("labels"))


CHOICES_SQL = """
WITH l AS (SELECT p_brand, string_agg(t, ',' ORDER BY seen) AS labels FROM (SELECT p_brand, (p_size % 7)::VARCHAR AS t, min(p_partkey) AS seen FROM part GROUP BY ALL) GROUP BY p_brand)
SELECT p_partkey, labels FROM part JOIN l USING (p_brand)
"""


def evaluation_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages whose recorded counts or ids are not those of their records: two are falsified here."""
    records = _graded(spark, sf_dir).select(F.col("lang").alias("task"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), "passed")
    truth = records.select("task", "ord", F.when((F.col("task") == "de") & (F.col("ord") % 100 == 0), "other").otherwise(F.col("id")).alias("id"))
    said = evaluate.accuracy(records, "task").withColumn("correct", F.when(F.col("task") == "fr", F.col("correct") + 1).otherwise(F.col("correct")))
    return contracts.evaluation_differences(records, truth, said).select("task", "correct", "correct_", "id_differences")


CONTRACT_SQL = f"""
WITH {_GRADED_SQL} SELECT lang AS task, count(*) FILTER (passed) + (lang = 'fr')::INT AS correct, count(*) FILTER (passed) AS correct_, count(*) FILTER (lang = 'de' AND doc_id % 100 = 0) AS id_differences
FROM g GROUP BY lang HAVING lang = 'fr' OR count(*) FILTER (lang = 'de' AND doc_id % 100 = 0) > 0
"""


def repeated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that stand in more than one language, as tasks in suites."""
    return contracts.repeated_sections(table(spark, sf_dir, "documents").select(F.col("source").alias("task"), F.col("lang").alias("suite")))


SECTIONS_SQL = "SELECT source AS task, count(DISTINCT lang) AS suites FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1"


def guarded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that pass every guard on the way, with the checks on their numbers and the brands that a sample lacks."""
    p = contracts.guarded_unique(contracts.guarded(table(spark, sf_dir, "part"), name=F.col("p_name").isNotNull(), size=F.col("p_size") > 0), "p_partkey")
    lacking = contracts.coverage(p.filter("p_size < 10"), p, "p_brand").select("p_brand", F.lit(True).alias("lacks"))
    sound = contracts.finite_positive("p_size", "x")
    rows = p.withColumn("x", F.when(F.col("p_partkey") % 3 == 0, F.lit(float("inf"))).when(F.col("p_partkey") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("p_size") - 5))
    return rows.join(lacking, "p_brand", "left").select("p_partkey", sound.alias("sound"), F.coalesce("lacks", F.lit(False)).alias("brand_lacks"))


GUARD_SQL = """
SELECT p_partkey, p_partkey % 3 = 2 AND p_size > 5 AS sound, p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 10) AS brand_lacks FROM part
"""


def guard_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with repeated rows, missing names, keys and brands: all that breaks a guard, and whether a run over them stops."""
    p = table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 97 > 0, F.col("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 40 > 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") != 7, F.col("p_brand")).alias("brand"), "p_size"
    )
    p = p.union(p.filter("id % 50 = 0")).union(p.filter("id % 100 = 0"))

    def stops(df: DataFrame) -> bool:
        try:
            df.write.format("noop").mode("overwrite").save()
        except PySparkException as e:
            return "USER_RAISED_EXCEPTION" in str(e)
        return False

    runs = {"repeated": contracts.guarded_unique(p.filter("id IS NOT NULL"), "id"), "missing key": contracts.guarded_unique(p, "id"), "missing name": contracts.guarded(p, name=F.col("name").isNotNull()), "rows": contracts.guarded(p, size=F.col("p_size") > 0)}
    stopped = spark.createDataFrame([(k, stops(df)) for k, df in runs.items()], "guard string, stops boolean")
    found = contracts.violations(p, "id", ["name", "brand"], expected=table(spark, sf_dir, "part").count())
    return found.join(F.broadcast(stopped), "guard", "left").select("guard", "key", "n", F.coalesce("stops", F.lit(False)).alias("stops"))  # a row a guard


VIOLATION_SQL = """
WITH p AS (SELECT CASE WHEN p_partkey % 97 > 0 THEN p_partkey END AS id, CASE WHEN p_partkey % 40 > 0 THEN p_name END AS name, CASE WHEN p_size <> 7 THEN p_brand END AS brand FROM part),
a AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE id % 50 = 0 UNION ALL SELECT * FROM p WHERE id % 100 = 0),
k AS (SELECT id::VARCHAR AS key, count(*) AS n, count(*) - count(name) AS names, count(*) - count(brand) AS brands FROM a GROUP BY id)
SELECT 'missing key' AS guard, key, n, true AS stops FROM k WHERE key IS NULL UNION ALL SELECT 'repeated', key, n, true FROM k WHERE n > 1 AND key IS NOT NULL
UNION ALL SELECT 'missing name', key, names, true FROM k WHERE names > 0 UNION ALL SELECT 'missing brand', key, brands, false FROM k WHERE brands > 0
UNION ALL SELECT 'rows', NULL, sum(n)::BIGINT, false FROM k HAVING sum(n) <> (SELECT count(*) FROM part)
"""


def largest_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest category, the first by name of equal ones."""
    return arms.largest(table(spark, sf_dir, "documents"), "lang")


LARGEST_SQL = "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 1"


def supervised_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that count by source: the answer's tokens, the prompt's are ignored."""
    docs = table(spark, sf_dir, "documents").select("source", F.sequence(F.lit(1), (F.col("doc_id") % 50 + 1).cast("int")).alias("p"), F.sequence(F.lit(1), (F.col("doc_id") % 90 + 1).cast("int")).alias("a"))
    out = histograms.supervised_lengths(docs, arrays.label_mask("p", "a"), arrays.IGNORED_LABEL, "source")
    return out.withColumn("mean", F.round("mean", 6))


SUPERVISED_SQL = "SELECT source, count(*) AS n, round(avg(doc_id % 90 + 1), 6) AS mean, max(doc_id % 90 + 1) AS most, max(doc_id % 50 + doc_id % 90 + 2) AS longest FROM documents GROUP BY source"


def shuffled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash order of every order row within its priority: a whole shuffle."""
    return sampling.ranked(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", SEED, "shuffle").select("o_orderkey", "nth")


SHUFFLE_SQL = f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('{SEED}|shuffle|' || o_orderpriority || '|' || o_orderkey), o_orderkey::VARCHAR) AS nth FROM orders"

QUERIES = {
    "verified_audit": verified_audit,
    "canonical_preflight": canonical_preflight,
    "formal_categories": formal_categories,
    "ablation_arms": ablation_arms,
    "training_arms": training_arms,
    "validation_split": validation_split,
    "task_metrics": task_metrics,
    "task_means": task_means,
    "graded_by_name": graded_by_name,
    "target_types": target_types,
    "mixed_means": mixed_means,
    "choice_scores": choice_scores,
    "label_choices": label_choices,
    "evaluation_contract": evaluation_contract,
    "repeated_sections": repeated_sections,
    "guarded_rows": guarded_rows,
    "guard_violations": guard_violations,
    "largest_category": largest_category,
    "supervised_lengths": supervised_lengths,
    "shuffled_places": shuffled_places,
}
ORACLE_SQL = {
    "verified_audit": AUDIT_SQL,
    "canonical_preflight": PREFLIGHT_SQL,
    "formal_categories": FORMAL_SQL,
    "ablation_arms": ABLATION_SQL,
    "training_arms": ARMS_SQL,
    "validation_split": VALIDATION_SQL,
    "task_metrics": TASK_SQL,
    "task_means": MEANS_SQL,
    "graded_by_name": BY_NAME_SQL,
    "target_types": TYPES_SQL,
    "mixed_means": MIX_SQL,
    "choice_scores": SCORES_SQL,
    "label_choices": CHOICES_SQL,
    "evaluation_contract": CONTRACT_SQL,
    "repeated_sections": SECTIONS_SQL,
    "guarded_rows": GUARD_SQL,
    "guard_violations": VIOLATION_SQL,
    "largest_category": LARGEST_SQL,
    "supervised_lengths": SUPERVISED_SQL,
    "shuffled_places": SHUFFLE_SQL,
}
