import json
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, code, formulas, numbers, values
from millrace.functions import text as tx
from millrace.operators import evaluate


def one(spark, column, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["\t a b \n", " x y\u001c", "a\r\nb", "", "\u0085z ", "plain"])
def test_white_space_is_pythons(spark, text):
    assert one(spark, tx.strip("t"), t=text) == text.strip()
    assert one(spark, tx.collapse("t"), t=text) == " ".join(text.split())


def test_fences(spark):
    reply = "a\n```python\n  x = 1\n```\nb\n```\ny\n```"
    assert one(spark, tx.fences("t"), t=reply) == ["  x = 1\n", "y\n"]
    assert one(spark, tx.fences("t"), t="no fence") == []
    assert one(spark, tx.strip_whole_fence("t"), t="```py\nx = 1\n```") == "x = 1"


def test_lines(spark):
    assert one(spark, tx.from_first_code_line("t"), t="prose\nimport os\nx") == "import os\nx"
    assert one(spark, tx.from_first_code_line("t"), t=" prose only ") == "prose only"
    assert one(spark, tx.indent_body("t"), t="a\n\nb") == "    a\n\n    b"
    assert one(spark, tx.indent_body("t"), t="a\n  b") == "a\n  b"
    assert one(spark, tx.leading_imports("t"), t="import os\n\nfrom a import b\nx = 1\nimport c") == "import os\nfrom a import b"
    assert one(spark, tx.cut_test_tail("t"), t="x = 1\nassert x\ny") == "x = 1"
    assert one(spark, tx.rstrip_lines("t"), t="a  \nb\t\n\n") == "a\nb"
    assert one(spark, tx.cut_at_next_question("t"), t="7\n\nQ: next") == "7"
    assert one(spark, tx.without_prefix("t", "no_"), t="no_graph") == "graph"


@pytest.mark.parametrize(
    ("text", "value", "percent"),
    [
        ("\\boxed{\\frac{1}{2}}", 0.5, False),
        ("x \\boxed{3} then \\boxed{4}", 4.0, False),
        ("so #### 1,234", 1234.0, False),
        ("50%", 50.0, True),
        ("about 3/4", 0.75, False),
        ("The answer is 7. And then prose", 7.0, False),
        ("first 1\nlast 2", 2.0, False),
        ("nothing", None, None),
        ("-$1,000.5", -1000.5, False),
        ("1/0 or 5", None, None),
    ],
)
def test_first_number(spark, text, value, percent):
    got = one(spark, numbers.first_number("t"), t=text)
    assert (got and got["value"], got and got["percent"]) == (value, percent)


def bodies(text):
    """Bodies of boxed answers by trying every opening brace."""
    out, past = [], 0
    for m in re.finditer(r"\\boxed\s*(?=\{)", text):
        depth, at = 0, m.end()
        while at < len(text):
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            if not depth:
                break
            at += 1
        if m.start() >= past and at < len(text):
            out.append(text[m.end() + 1 : at])
            past = at + 1
    return out


def test_nested_braces(spark):
    rng = random.Random(1)
    texts = [r"\boxed{a{b}c} and \boxed {d} \boxed{open \boxed{e}", "", "no command {", r"} } \boxed{\boxed{𝄞}x}\boxed{}", r"\boxed", "\\boxed{" * 50 + "}" * 30]
    texts += ["".join(rng.choice([r"\boxed{", r"\boxed {", "{", "}", "}", "x", "\\", "𝄞y"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", numbers.boxed("t").alias("b"))
    assert bodies(texts[0]) == ["a{b}c", "d", "e"]
    assert [(r["t"], r["b"]) for r in df.collect()] == [(t, bodies(t)) for t in texts] + [(None, [])]


FORMULAS = [
    (r"\frac{1}{2}", "0.5", True), (r"\frac12x", "x/2", True), (r"\sqrt{8}", r"2\sqrt{2}", True), ("(x+1)^2", "x^2+2x+1", True), ("(x+1)^2", "x^2+2x+2", False),
    (r"\sqrt{x}\sqrt x", "x", True), (r"\sqrt[3]{54}", r"3\sqrt[3]{2}", True), ("2^{x+1}", r"2\cdot 2^x", True), ("-x^2", "(-x)^2", False), ("-x^2", "-(x^2)", True),
    (r"(3,\frac{\pi}{2})", r"(3, 0.5\pi)", True), ("(3,1)", "(1,3)", False), ("[1,2)", "(1,2)", False), ("[1,2)", "[1,4/2)", True), ("x=5", "5", True), ("10,000", "10^4", True),
    ("listen", "silent", False), (r"\text{east}", "seat", False), (r"\sin(2x)", r"\sin(x+x)", True), (r"\sin(x)", r"\cos(x)", False), ("1/0", "1/0", False),
    (r"90^\circ", "90", True), (r"5\text{ cm}", "5", True), (r"\frac{\sqrt{3}}{3}", r"\frac{1}{\sqrt{3}}", True), ("x^{-1}", r"\frac1x", True), ("((x)", "(x)", False), ("x)", "x", False),
    ("", "", False), (r"x \leq 2", r"x \leq 2", False), ("2^{3^2}", "512", True), ("2/3/4", "1/6", True), (r"2\frac{1}{2}^2", "1/2", True), (r"\frac{x^2-1}{x-1}", "x+1", True),
    ("4^{1/2}", "2", True), ("e^{2x}", "(e^x)^2", True), ("3 - -2", "5", True), ("2 3", "6", False), (None, "x", False), ("1,2", "1, 4/2", True), ("+", "+", False), ("0^{-1}", "0", False),
    (r"\frac{1+\sqrt{5}}{2}", r"\frac{2}{\sqrt 5-1}", True), ("1.25", "5/4", True), ("x" * 3, "x^3", False), (r"\alpha\beta", r"\beta\alpha", True), (r"\unknown x", r"\unknown x", False),
]


def test_formulas(spark):
    got = spark.createDataFrame(FORMULAS, "a string, b string, want boolean").select("a", "b", "want", formulas.equal("a", "b").alias("got"))
    assert [r for r in got.collect() if r["want"] is not r["got"]] == []


def test_random_formulas_against_exact_fractions(spark):
    rng = random.Random(6)

    def made(depth):
        if depth == 0:
            return rng.choice([(str(n := rng.randint(0, 9)), Fraction(n)), (f"{(n := rng.randint(0, 99))}.5", n + Fraction(1, 2))])
        (s, x), (t, y) = made(depth - 1), made(depth - 1)
        kind = rng.randrange(6)
        if kind == 5 and abs(x) < 100:
            n = rng.randint(0, 3)
            return f"({s})^{{{n}}}", x**n
        if kind == 4 and y:
            return rf"\frac{{{s}}}{{{t}}}", x / y
        return [(f"({s})+{t}", x + y), (f"({s})-({t})", x - y), (f"({s})({t})", x * y), (f"-({s})", -x)][kind % 4]

    pairs = []
    for _ in range(120):
        (s, x) = made(3)
        y = rng.choice([x, x, x + Fraction(1, 7)])
        pairs.append((s, f"{y.numerator}/{y.denominator}", x == y))
    got = spark.createDataFrame(pairs, "a string, b string, want boolean").select("a", "b", "want", formulas.equal("a", "b").alias("got")).collect()
    assert [r for r in got if r["want"] != r["got"]] == []
    assert {r["want"] for r in got} == {True, False}


@pytest.mark.parametrize(
    ("reply", "target", "passed"),
    [("50%", "0.5", True), ("0.5", "50%", True), ("7", "7.00001", True), ("7", "8", False), ("x", "8", False), ("1e3", "1000", True)],
)
def test_numbers_match(spark, reply, target, passed):
    assert one(spark, evaluate.grade_number("r", "t"), r=reply, t=target) is passed


def test_other_graders(spark):
    grade = lambda f, **c: one(spark, f(*c), **c)
    assert grade(evaluate.grade_interval, r="about 5", t="5", lo="4", hi="6") is True
    assert grade(evaluate.grade_interval, r="about 5", t="5", lo="low", hi="6") is True
    assert grade(evaluate.grade_numeric_or_text, r="Paris.", t="paris") is True
    assert grade(evaluate.grade_numeric_or_text, r="anything", t=" ") is None
    assert grade(evaluate.grade_math, r="so \\boxed{\\dfrac{x}{2}}", t="\\frac{x}{2}") is True
    assert grade(evaluate.grade_math, r="\\boxed{0.5}", t="\\frac{1}{2}") is True
    assert grade(evaluate.grade_math, r="so \\boxed{x^2-1}", t="(x-1)(x+1)") is True
    assert grade(evaluate.grade_math, r="so \\boxed{x^2+1}", t="(x-1)(x+1)") is False
    assert grade(evaluate.grade_math, r="a word", t="drow a") is False
    assert grade(evaluate.grade_label, r=" Yes ", t="yes") is True
    assert one(spark, evaluate.best_choice(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1


def test_task_names():
    assert evaluate.tasks("diag, gsm8k,finqa") == ["gsm8k", "mbpp_simple", "scienceqa", "finqa"]
    assert len(evaluate.tasks("all")) == 14 and len(evaluate.tasks("scoreable")) == 11
    with pytest.raises(ValueError):
        evaluate.tasks("nonsense")


def test_literals():
    assert values.read_list("['dp','DP ']") == ["dp", "DP "]
    assert values.read_list('["graphs"]') == ["graphs"]
    assert values.read_list("not a list") == values.read_list("") == values.read_list(None) == []
    assert json.loads(values.read_call("n = 3, s = 'x'")) == {"n": 3, "s": "x"}
    assert values.read_call("**x") is None and values.read_call("a = f()") is None
    assert [values.read_literal(x) for x in ("None", "[1]", "(1, 2)", "text")] == ["null", "[1]", "[1, 2]", '"text"']
    assert values.same_value([1.0, (2,)], [1.0000001, [2]]) and not values.same_value(True, 1)


def test_two_readings_of_a_reply(spark):
    reply = "```python\ndef a():\n    return 1\n```\n```python\ndef b():\n    return 2\n```"
    read = lambda c, text: one(spark, c, r=text)
    assert read(code.reward_code("r"), reply).startswith("def a")
    assert read(code.suite_code("r"), reply).startswith("def b")
    assert read(code.suite_code("r", name=F.lit("a")), reply).startswith("def a")
    assert read(code.reward_code("r"), "text\nimport os\nthis is no code") == "import os"
    assert read(code.reward_code("r"), "a\0b = 1") == "ab = 1"


def test_code_helpers():
    assert "def f(" in code.renamed("def g(x):\n    return g(x - 1)", "f")
    assert [k for k, _ in code.repairs("```py\ndef main(argv=None):\n    pass\n```")] == ["strip_markdown_fence", "append_main"]
    assert code.repairs("x = 1") == []


def test_completions(spark):
    done = lambda reply, prompt: one(spark, code.completion_code("r", "p", "n"), r=reply, p=prompt, n="f")
    prompt = "import os\ndef f(x):\n"
    assert done("    return x + 1", prompt) == "import os\ndef f(x):\n    return x + 1"
    assert done("return x + 1", prompt) == "import os\ndef f(x):\n    return x + 1"
    assert done("```python\ndef f(x):\n    return 1\n```", prompt) == "import os\n\ndef f(x):\n    return 1"
    assert done("```python\n\ndef g(x):\n    return 1\nassert g(1)\n```", prompt) == "import os\n\ndef f(x):\n    return 1"
    # the name asked for beats another, and the later of equals stays
    assert done("```\ndef f(x):\n    return 1\n```\n```\ndef g(x):\n    return 2\n```", "") == "def f(x):\n    return 1"
    assert done("```\ndef f(x):\n    return 1\n```\n```\ndef f(x):\n    return 2\n```", "") == "def f(x):\n    return 2"
    assert done(None, "def f(x):\n") == "def f(x):\n"


def test_python_2():
    old = "def main(n=3):\n    for i in xrange(3):\n        print i, 'x'\n    try:\n        s = raw_input()\n    except ValueError, e:\n        print\n"
    made = dict(code.repairs(old))
    assert set(made) == {"python2_to_python3", "python2_to_python3_and_main"}
    new = made["python2_to_python3"]
    assert code.Snippet(new).compiles and "print(i, 'x')" in new and "except ValueError as e:" in new and "range(3)" in new
    assert code.from_python2("print 'a;b#', \"c;\"; print 1") == "print('a;b#', \"c;\"); print(1)"
    assert code.from_python2("print(1)") is None and code.from_python2("print 1 +") is None


def test_arrays(spark):
    a, n = F.array(F.lit("a"), F.lit(None)), F.lit(None).cast("array<string>")
    assert one(spark, arrays.overlaps(a, F.array(F.lit("z")))) is False
    assert one(spark, arrays.overlaps(n, a)) is False
    assert one(spark, arrays.merged_tags(F.array(F.lit(" DP"), F.lit("")), n, F.array(F.lit("dp")))) == ["dp"]
    cut = one(spark, arrays.truncated(F.sequence(F.lit(1), F.lit(900)), F.sequence(F.lit(1), F.lit(700)), 1000))
    assert (len(cut["prompt"]), len(cut["answer"])) == (500, 500)
    assert one(spark, arrays.label_mask(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)))) == [-100, -100, 3]
    assert one(spark, arrays.json_kind("t"), t='{"a": 1}') == "object"
    assert one(spark, arrays.json_kind("t"), t="{broken") == "invalid"
