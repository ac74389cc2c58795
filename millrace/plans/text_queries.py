"""Queries over scalar functions: lines, numbers, arrays, literals, code and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, code, dates, formulas, numbers, values
from ..functions import text as tx
from ..operators import evaluate
from ..session import dealt, table

_WS = tx.WS_RE2
_trim_sql = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_blank_sql = lambda x: f"{_trim_sql(x)} = ''"


def _part(spark: SparkSession, sf_dir: str, *columns: Column | str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *columns)


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dealt to all cores: the file is small, the work on each row is not."""
    return dealt(table(spark, sf_dir, "part"), "p_partkey")


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("concat(' \\t', p_name, '  \\nQ: what is ', p_brand, '? ')")
    rows = _part(spark, sf_dir, t.alias("t"), "p_name", "p_size", "p_type")
    named = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("no_"), F.col("p_name"))).otherwise(F.col("p_name"))
    return rows.select(
        "p_partkey",
        tx.strip("t").alias("stripped"),
        F.upper(tx.strip("p_name")).alias("upper"),
        F.lower(tx.strip("p_type")).alias("lower"),
        tx.cut_at_next_question("t").alias("before_question"),
        tx.after_last(F.concat(F.lit("1 #### "), F.col("p_name"), F.lit("####"), F.col("p_size").cast("string")), "####").alias("after_marker"),
        tx.padded_id("part_", "p_partkey").alias("padded"),
        tx.without_prefix(named, "no_").alias("without_prefix"),
        tx.spaced(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("spaced"),
        tx.rstrip_lines(F.concat(F.col("p_name"), F.lit(" \t\n\n"), F.col("p_type"), F.lit("  \n\n"))).alias("trimmed_lines"),
    )


TEXT_SQL = f"""
WITH r AS (SELECT *, ' ' || chr(9) || p_name || '  ' || chr(10) || 'Q: what is ' || p_brand || '? ' AS t FROM part)
SELECT p_partkey, {_trim_sql("t")} AS stripped, upper({_trim_sql("p_name")}) AS upper, lower({_trim_sql("p_type")}) AS lower,
  regexp_replace(t, '(?s)\\n\\s*(?:Q:|Question:).*', '') AS before_question, string_split('1 #### ' || p_name || '####' || p_size, '####')[-1] AS after_marker,
  'part_' || lpad(p_partkey::VARCHAR, greatest(5, length(p_partkey::VARCHAR))::INT, '0') AS padded,
  regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN 'no_' || p_name ELSE p_name END, '^no_', '') AS without_prefix,
  replace(replace(p_type, ' ', '_'), '_', ' ') AS spaced,
  rtrim(array_to_string(list_transform(string_split(p_name || ' ' || chr(9) || chr(10) || chr(10) || p_type || '  ' || chr(10) || chr(10), chr(10)), lambda x: regexp_replace(x, '{_WS}+$', '')), chr(10)), chr(10)) AS trimmed_lines
FROM r
"""

#: Replies with code in several layouts; line feeds and tabs are written out.
_LAYOUTS = (
    "Some prose\n\nfrom os import path\ndef f():\n    return 1\n# tail",
    "```python\nx = '%s'\n```",
    "return '%s'\n\nx = 2",
    "\n \n\tx = 1\n\ty = '%s'\n   \n",
    "import os\n\nfrom sys import argv\nx = '%s'\nimport late",
    "def g(a):\n    return a\nassert g(1)\nx = 1",
    "x = '%s'\n    ### not a heading\n### Unit tests\ny = 2",
)
_layout_sql = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _LAYOUTS) + "]"


def line_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = F.get(F.array(*[F.lit(x) for x in _LAYOUTS]), (F.col("p_partkey") % len(_LAYOUTS)).cast("int"))
    rows = _part(spark, sf_dir, F.replace(layout, F.lit("%s"), F.col("p_name")).alias("t"))
    return rows.select(
        "p_partkey",
        tx.strip_whole_fence("t").alias("unfenced"),
        tx.from_first_code_line("t").alias("code"),
        tx.trim_blank_lines("t").alias("trimmed"),
        tx.indent_body("t").alias("indented"),
        tx.leading_imports("t").alias("imports"),
        tx.cut_test_tail("t").alias("without_tests"),
    )


LINES_SQL = f"""
WITH r AS (SELECT p_partkey, replace({_layout_sql}[p_partkey % {len(_LAYOUTS)} + 1], '%s', p_name) AS t FROM part),
l AS (SELECT *, string_split(t, chr(10)) AS x, {_trim_sql("t")} AS bare FROM r),
p AS (SELECT *, list_position(list_transform(x, lambda y: regexp_matches({_trim_sql("y")}, '{tx.CODE_LINE}')), true) AS opens,
  list_position(list_transform(x, lambda y: NOT {_blank_sql("y")} AND NOT regexp_matches({_trim_sql("y")}, '^(import |from )')), true) AS other,
  list_position(list_transform(x, lambda y: regexp_matches({_trim_sql("y")}, '^def\\s+check\\s*\\(|^### Canonical solution|^### Unit tests') OR regexp_matches(y, '^assert ')), true) AS tests FROM l)
SELECT p_partkey,
  CASE WHEN regexp_full_match(bare, '(?si)```(?:python|py)?\\s*\\n.*\\n```') THEN {_trim_sql("regexp_extract(bare, '(?si)^```(?:python|py)?\\s*\\n(.*)\\n```$', 1)")} ELSE bare END AS unfenced,
  CASE WHEN opens > 0 THEN {_trim_sql("array_to_string(x[opens:], chr(10))")} ELSE bare END AS code,
  regexp_replace(replace(t, chr(9), '    '), '\\A(?:[^\\S\\n]*\\n)+|(?:\\n[^\\S\\n]*)+\\z', '', 'g') AS trimmed,
  CASE WHEN NOT list_contains(list_transform(x, lambda y: regexp_matches(y, '^[ \\t]+\\S')), true) AND bare <> ''
    THEN array_to_string(list_transform(x, lambda y: CASE WHEN {_blank_sql("y")} THEN y ELSE '    ' || y END), chr(10)) ELSE t END AS indented,
  array_to_string(list_filter(CASE WHEN other > 0 THEN x[1:other - 1] ELSE x END, lambda y: NOT {_blank_sql("y")}), chr(10)) AS imports,
  array_to_string(CASE WHEN tests > 0 THEN x[1:tests - 1] ELSE x END, chr(10)) AS without_tests
FROM p
"""


def number_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios, clamps, ceilings and roundings of line items."""
    q, d, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(numbers.safe_ratio(q, n - 1), 9).alias("ratio"),
        numbers.clamp(q, 10, 40).cast("double").alias("clamped"),
        F.floor(q / 7).alias("div"),
        (q.cast("long") % 7).alias("mod"),
        numbers.whole_seconds(q / 4).alias("limit"),
        F.round(numbers.rounded_seconds(d + q / 8, 1), 6).cast("double").alias("rounded"),
    )


NUMBERS_SQL = """
SELECT l_orderkey, l_linenumber, round(l_quantity / greatest(l_linenumber - 1, 1)::DOUBLE, 9) AS ratio, least(greatest(l_quantity, 10), 40)::DOUBLE AS clamped,
  floor(l_quantity / 7)::BIGINT AS div, l_quantity::BIGINT % 7 AS mod, greatest(ceil(l_quantity / 4), 1)::BIGINT AS "limit",
  round(round_even(l_discount + l_quantity / 8, 1), 6)::DOUBLE AS rounded FROM lineitem
"""


def text_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that name the part's type, compared as texts."""
    reply = F.get(
        F.array(
            F.concat(F.lit("Well.\nThe answer is: "), F.initcap("p_type"), F.lit(".")), F.concat(F.col("p_type"), F.lit(" indeed")),
            F.concat(F.lit("not "), F.col("p_type")), F.concat(F.lit("#### "), F.upper("p_type")),
        ),
        (F.col("p_partkey") % 4).cast("int"),
    )
    rows = _part(spark, sf_dir, reply.alias("reply"), "p_type")
    none = F.expr("cast(array() as array<string>)")
    got = numbers.normalise_text_answer(numbers.answer_spans("reply", none), "reply")
    wanted = numbers.normalise_text_answer(numbers.answer_spans("p_type", none), "p_type")
    return rows.select("p_partkey", got.alias("read"), numbers.text_answer_matches(got, wanted).alias("matches"), numbers.first_number("p_type", none).isNotNull().alias("numeric"))


_ANSWER = r"(?i)(?:final\s+answer|the\s+answer|answer)\s*(?:is|=|:)\s*([^\n]+)"
TEXT_ANSWER_SQL = f"""
WITH r AS (SELECT p_partkey, p_type, ['Well.' || chr(10) || 'The answer is: ' || p_type || '.', p_type || ' indeed', 'not ' || p_type, '#### ' || upper(p_type)][p_partkey % 4 + 1] AS reply FROM part),
s AS (SELECT *, CASE WHEN regexp_matches(reply, '####') THEN regexp_extract(reply, '####\\s*([^\\n]+)', 1) WHEN regexp_matches(reply, '{_ANSWER}') THEN regexp_extract(reply, '{_ANSWER}', 1)
  ELSE string_split(reply, chr(10))[-1] END AS span FROM r),
n AS (SELECT *, lower(regexp_replace(regexp_replace({_trim_sql("span")}, '^[.,:;]+|[.,:;]+$', '', 'g'), '\\s+', ' ', 'g')) AS read, lower(p_type) AS want FROM s)
SELECT p_partkey, read, read = want OR starts_with(read, want || ' ') AS matches, regexp_matches(p_type, '[0-9]') AS numeric FROM n
"""


def array_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    rows = _part(spark, sf_dir, words.alias("w"), F.slice(words, 1, F.greatest((F.col("p_partkey") % 4).cast("int"), F.lit(1))).alias("few"), F.split("p_type", " ").alias("k"))
    pairs = arrays.aligned("w", "k")
    return rows.select(
        "p_partkey",
        F.array_join(F.transform(pairs, lambda x: F.concat(x["input"], F.lit("="), x["output"])), ",").alias("pairs"),
        F.array_join(F.zip_with(letters, "k", lambda a, b: F.concat(a, F.lit(". "), b)), "|").alias("labelled"),
        arrays.unwrapped("few").alias("only"),
        F.size(arrays.head("w", 2)).cast("long").alias("two"),
        F.size(arrays.head("w", 0)).cast("long").alias("every"),
        arrays.same_set("w", F.reverse("w")).alias("same"),
        arrays.same_set("w", "few").alias("covers"),
        F.size(F.array_except("w", "few")).cast("long").alias("rest"),
        F.size(F.array_intersect("w", "few")).cast("long").alias("common"),
    )


ARRAY_SQL = """
WITH r AS (SELECT p_partkey, string_split(p_name, ' ') AS w, string_split(p_type, ' ') AS k, p_partkey % 4 AS m FROM part),
f AS (SELECT *, w[1:greatest(m, 1)] AS few FROM r)
SELECT p_partkey, CASE WHEN len(w) = len(k) THEN array_to_string(list_transform(list_zip(w, k), lambda x: x[1] || '=' || x[2]), ',') END AS pairs,
  array_to_string(list_transform(list_zip(['A', 'B', 'C', 'D'], k)[1:least(4, len(k))], lambda x: x[1] || '. ' || x[2]), '|') AS labelled,
  CASE WHEN len(few) = 1 THEN few[1] END AS only, len(w[1:2])::BIGINT AS two, len(w)::BIGINT AS every, true AS same,
  len(list_filter(w, lambda x: NOT list_contains(few, x))) = 0 AS covers,
  len(list_distinct(list_filter(w, lambda x: NOT list_contains(few, x))))::BIGINT AS rest, len(list_distinct(few))::BIGINT AS common FROM f
"""


def literal_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python and JSON literals made of parts."""
    q = F.lit("'")
    rows = _part(
        spark, sf_dir,
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("["), q, F.col("p_brand"), q, F.lit(", "), q, F.col("p_type"), q, F.lit("]")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('["'), F.col("p_brand"), F.lit('"]'))).otherwise(F.col("p_name")).alias("listed"),
        F.when(F.col("p_partkey") % 4 == 0, "None").when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("("), F.col("p_size"), F.lit(", 2)")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("["), F.col("p_size"), F.lit("]"))).otherwise(F.col("p_brand")).alias("literal"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("n = "), F.col("p_size"), F.lit(", s = 'x'"))).otherwise(F.lit("**n")).alias("call"),
        F.concat(F.lit("["), F.col("p_size"), F.lit("]")).alias("one"),
        F.concat(F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, ".0000001").otherwise(".5")).alias("number"),
    )
    return rows.select(
        "p_partkey", F.array_join(values.parse_list("listed"), "|").alias("listed"), values.safe_literal("literal").alias("literal"), values.call_kwargs("call").alias("kwargs"),
        values.values_equal("one", "number").alias("equal"), values.values_equal_unwrapped("one", "number").alias("equal_unwrapped"),
    )


LITERAL_SQL = """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN p_brand ELSE '' END AS listed,
  CASE p_partkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN '[' || p_size || ', 2]' WHEN 2 THEN '[' || p_size || ']' ELSE '"' || p_brand || '"' END AS literal,
  CASE WHEN p_partkey % 2 = 0 THEN '{"n": ' || p_size || ', "s": "x"}' END AS kwargs, false AS equal, p_partkey % 2 = 0 AS equal_unwrapped FROM part
"""


def code_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs made of parts' names in replies of several layouts, read, completed and renamed."""
    key, fenced = F.col("p_partkey"), lambda a, x, b, y: F.concat(F.lit(f"Here:\n```{a}\n"), x, F.lit(f"\n```\n```{b}\n"), y, F.lit("\n```"))
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    body = F.concat(F.lit("    return '"), F.col("p_name"), F.lit("'"))
    whole = F.concat(F.lit("def "), name, F.lit("(x):\n"), body)
    rows = _dealt(spark, sf_dir).select(
        "p_partkey", name.alias("name"), whole.alias("whole"), body.alias("body"),
        F.when(key % 4 == 0, F.concat(whole, F.lit("\nthis is no code"))).when(key % 4 == 1, whole)
        .when(key % 4 == 2, F.concat(F.lit("Some prose.\r\n"), whole, F.lit("\n)"))).otherwise(F.concat(whole, F.lit("\n\n\treturn ("))).alias("broken"),
        F.when(key % 5 == 0, F.concat(whole, F.lit("\nreturn 1"))).otherwise(whole).alias("program"),
        F.when(key % 4 == 0, fenced("python", whole, "py", F.lit("x = 1"))).when(key % 4 == 1, fenced("PY", F.lit("x = 1"), "", whole))
        .when(key % 4 == 2, fenced("", whole, "python", F.lit("def g(x):\n    return 1"))).otherwise(fenced("python", F.lit("def ("), "py", whole)).alias("reply"),
        F.concat(F.lit("import os\ndef "), name, F.lit("(x):\n")).alias("prompt"),
        F.array(F.when(key % 2 == 0, F.concat(F.lit("assert abs("), name, F.lit("(1)) == 2"))).otherwise(F.concat(F.lit("assert "), name, F.lit("(1) == (")))).alias("tests"),
    )
    return rows.select(
        "p_partkey", code.reward_code("broken").alias("longest_head"), code.reward_code("reply").alias("first_fence"),
        code.suite_code("reply", name="name").alias("best_fence"), code.completion_code("body", "prompt", "name").alias("completed"),
        code.completion_code("reply", "prompt", "name").alias("whole"), code.renamed_code("whole", F.lit("solve")).alias("renamed"),
        code.entry_point("tests").alias("entry"), code.entry_point(F.expr("cast(array() as array<string>)"), "whole").alias("last_function"),
        code.compiles("program").alias("good"), code.compiles("broken").alias("bad"),
    )


CODE_SQL = """
WITH r AS (SELECT p_partkey, 'f' || p_partkey AS name, '    return ''' || p_name || '''' AS body FROM part), w AS (SELECT *, 'def ' || name || '(x):' || chr(10) || body AS whole FROM r)
SELECT p_partkey, whole AS longest_head, CASE p_partkey % 4 WHEN 1 THEN 'x = 1' WHEN 3 THEN 'def (' ELSE whole END AS first_fence, whole AS best_fence, 'import os' || chr(10) || whole AS completed, 'import os' || chr(10) || chr(10) || whole AS whole,
  replace(whole, 'def ' || name, 'def solve') AS renamed, name AS entry, name AS last_function, p_partkey % 5 <> 0 AS good, p_partkey % 4 = 1 AS bad FROM w
"""


def template_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written as templates do, and in two other ways."""
    d = F.col("o_orderdate").cast("date")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "dd MMM yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd MMM yy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(dates.template_date(shown), "yyyy-MM-dd").alias("day"))


DATE_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate::DATE, '%Y-%m-%d') END AS day FROM orders"

#: Replies of every form in which an answer is read, braces nested in the last one.
REPLY = r"""CASE p_partkey % 8 WHEN 0 THEN concat('so #### ', p_size * 1000, '.') WHEN 1 THEN concat('The answer is ', p_size, '.50 then prose')
 WHEN 2 THEN concat('half is ', p_size, '/4') WHEN 3 THEN concat('first 7', chr(10), 'last $', p_size, ',000') WHEN 4 THEN concat(p_size, '%')
 WHEN 5 THEN concat('first \\boxed{9}, then \\boxed{', p_size, '}') WHEN 6 THEN concat('it is \\boxed{\\frac{', p_size, '}{4}} of 3') ELSE 'no digits' END"""
#: The same reading in SQL: spans, the last number of the first that has one, fractions before numbers.
READ_SQL = r"""
r AS (SELECT p_partkey, p_size, """ + REPLY.replace("\\\\", "\\") + r""" AS reply FROM part),
s AS (SELECT *, list_concat(list_concat(list_reverse(regexp_extract_all(reply, '\\boxed\s*\{((?:[^{}]|\{[^{}]*\})*)\}', 1)), list_reverse(regexp_extract_all(reply, '####\s*([^\n]+)', 1))),
  list_concat(list_reverse(regexp_extract_all(reply, '(?i)(?:final\s+answer|the\s+answer|answer)\s*(?:is|=|:)\s*([^\n]+)', 1)), [string_split(reply, chr(10))[-1], reply])) AS spans FROM r),
f AS (SELECT *, list_filter(list_transform(spans, lambda x: CASE WHEN regexp_matches(x, '\\frac\{\d+\}\{\d+\}') THEN regexp_extract_all(x, '\\frac\{\d+\}\{\d+\}')[-1]
  WHEN regexp_matches(x, '\d+\s*/\s*\d+') THEN regexp_extract_all(x, '\d+\s*/\s*\d+')[-1] ELSE regexp_extract_all(x, '-?\$?\d[\d,]*(?:\.\d+)?(?:[eE][+-]?\d+)?%?')[-1] END), lambda y: y IS NOT NULL)[1] AS found FROM s),
v AS (SELECT *, found LIKE '%\%' ESCAPE '\' AS percent, CASE WHEN regexp_matches(found, '\D\d+\}\{|/')
  THEN regexp_extract(found, '(\d+)\D+(\d+)', 1)::DOUBLE / regexp_extract(found, '(\d+)\D+(\d+)', 2)::DOUBLE ELSE regexp_replace(found, '[$,%]', '', 'g')::DOUBLE END AS value FROM f)
"""


def numeric_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir).select("p_partkey", F.expr(REPLY).alias("reply"))
    got = numbers.first_number("reply")
    return rows.select("p_partkey", got["value"].alias("value"), F.coalesce(got["percent"], F.lit(False)).alias("percent"))


NUMERIC_SQL = f"WITH {READ_SQL} SELECT p_partkey, value, coalesce(percent, false) AS percent FROM v"


def numeric_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies against the size of the part, plain or as a per cent."""
    target = F.expr("concat(p_size, CASE WHEN p_partkey % 2 = 0 THEN '%' ELSE '' END)")
    rows = _dealt(spark, sf_dir).select("p_partkey", F.expr(REPLY).alias("reply"), target.alias("target"))
    return rows.select("p_partkey", evaluate.grade_number("reply", "target").alias("passed"))


MATCH_SQL = f"""
WITH {READ_SQL}, x AS (SELECT *, p_size::DOUBLE AS t, p_partkey % 2 = 0 AS tp, greatest(p_size * 1e-6, 1e-4) AS tol FROM v)
SELECT p_partkey, coalesce(abs(value - t) <= tol OR (tp AND NOT percent AND abs(value * 100 - t) <= tol) OR (percent AND NOT tp AND abs(value / 100 - t) <= tol), false) AS passed FROM x
"""


def math_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised formulas, plain and boxed, and whether they are numbers."""
    shape = r"CASE p_partkey % 3 WHEN 0 THEN concat('$\\dfrac{', p_size, '}{X Y}\\, + \\left(', p_brand, '\\right).$') WHEN 1 THEN concat('so \\boxed{ ', p_size, '{Z} } is it') ELSE concat(p_size, '.5') END"
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(shape).alias("t"))
    return rows.select("p_partkey", numbers.normalise_math("t").alias("formula"), numbers.is_numeric_math("t").alias("numeric"))


MATH_SQL = """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower('(' || p_size || ')/(xy)+(' || p_brand || ')') WHEN 1 THEN p_size || '{z}' ELSE p_size || '.5' END AS formula, p_partkey % 3 = 2 AS numeric FROM part
"""

#: Pairs of formulas that are equal where p_partkey % 5 and p_partkey % 4 are, and never in the same spelling.
FORMULAS = r"""CASE p_partkey % 6
 WHEN 0 THEN array(concat('(x+', a, ')(x-', k, ')'), concat('x^2+(', a - j, ')x-', a * j)) WHEN 1 THEN array(concat('\\frac{', a, 'x}{', k + 1, '}'), concat('\\frac{', a, '}{', j + 1, '}x'))
 WHEN 2 THEN array(concat('\\sqrt{', a * a * (k + 1), '}'), concat(a, '\\sqrt ', j + 1)) WHEN 3 THEN array(concat('2^{', k, '+x}'), concat('2^{x}\\cdot 2^', j))
 WHEN 4 THEN array(concat('\\left(', a, ', \\frac{', k, '}{2}\\right)'), concat('(', a, '.0,', j, '/2)')) ELSE array(concat('\\sin(', k, 'y + y)'), concat('\\sin((', j + 1, ')y)')) END"""


def formula_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of formulas in unequal spelling, and whether their values are equal."""
    rows = _dealt(spark, sf_dir).selectExpr("p_partkey", "p_size AS a", "p_partkey % 5 AS k", "p_partkey % 4 AS j")
    return rows.select("p_partkey", F.expr(FORMULAS).alias("f")).select("p_partkey", formulas.equal(F.col("f")[0], F.col("f")[1]).alias("equal"))


#: The same formulas in numbers, at several points.
FORMULA_SQL = """
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 5)::DOUBLE AS k, (p_partkey % 4)::DOUBLE AS j, unnest([0.37, 1.91, 2.74, 5.13]) AS x FROM part),
v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN (x + a) * (x - k) WHEN 1 THEN a * x / (k + 1) WHEN 2 THEN sqrt(a * a * (k + 1)) WHEN 3 THEN pow(2, k + x) WHEN 4 THEN k / 2 ELSE sin(k * x + x) END AS f,
  CASE p_partkey % 6 WHEN 0 THEN x * x + (a - j) * x - a * j WHEN 1 THEN a / (j + 1) * x WHEN 2 THEN a * sqrt(j + 1) WHEN 3 THEN pow(2, x) * pow(2, j) WHEN 4 THEN j / 2 ELSE sin((j + 1) * x) END AS g FROM p)
SELECT p_partkey, bool_and(abs(f - g) < 1e-9) AS equal FROM v GROUP BY p_partkey
"""

QUERIES = {
    "text_scalars": text_scalars,
    "line_scalars": line_scalars,
    "number_scalars": number_scalars,
    "text_answers": text_answers,
    "array_scalars": array_scalars,
    "literal_scalars": literal_scalars,
    "code_scalars": code_scalars,
    "template_dates": template_dates,
    "numeric_extract": numeric_extract,
    "numeric_match": numeric_match,
    "math_text": math_text,
    "formula_match": formula_match,
}
ORACLE_SQL = {
    "text_scalars": TEXT_SQL,
    "line_scalars": LINES_SQL,
    "number_scalars": NUMBERS_SQL,
    "text_answers": TEXT_ANSWER_SQL,
    "array_scalars": ARRAY_SQL,
    "literal_scalars": LITERAL_SQL,
    "code_scalars": CODE_SQL,
    "template_dates": DATE_SQL,
    "numeric_extract": NUMERIC_SQL,
    "numeric_match": MATCH_SQL,
    "math_text": MATH_SQL,
    "formula_match": FORMULA_SQL,
}
