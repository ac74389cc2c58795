"""Python literals in text. Only literals are read; nothing is evaluated."""

from __future__ import annotations

import ast
import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

_FAILURES = (ValueError, SyntaxError, TypeError, MemoryError, RecursionError)


def read_list(text: str | None) -> list[str]:
    """A Python literal or JSON list as strings; anything else is empty."""
    if not text or not text.strip():
        return []
    for parse in (ast.literal_eval, json.loads):
        try:
            value = parse(text)
        except _FAILURES:
            continue
        return [str(x) for x in value] if isinstance(value, (list, tuple)) else []
    return []


def read_literal(text: str | None) -> str | None:
    """JSON text of a value written as JSON or as a Python literal; other text stands for itself."""
    if text is None:
        return None
    bare = text.strip()
    if bare == "None":
        return "null"
    for parse in (json.loads, ast.literal_eval):
        try:
            return json.dumps(parse(bare), ensure_ascii=False)
        except _FAILURES:
            continue
    return json.dumps(text, ensure_ascii=False)


def read_call(text: str | None) -> str | None:
    """JSON object of ``a = 1, b = 'x'``; null if it is no list of literal keyword arguments."""
    try:
        call = ast.parse(f"f({text})", mode="eval").body
        if not isinstance(call, ast.Call) or any(k.arg is None for k in call.keywords):
            return None
        return json.dumps({k.arg: ast.literal_eval(k.value) for k in call.keywords}, ensure_ascii=False)
    except _FAILURES:
        return None


def same_value(expected, actual) -> bool:
    """Recursive equality: floats within 1e-6, booleans apart from numbers, lists and tuples alike."""
    if isinstance(expected, bool) or isinstance(actual, bool):
        return expected is actual
    numbers = (int, float)
    if isinstance(expected, numbers) and isinstance(actual, numbers):
        return expected == actual or math.isclose(expected, actual, rel_tol=1e-6, abs_tol=1e-6)
    if isinstance(expected, (list, tuple)) and isinstance(actual, (list, tuple)):
        return len(expected) == len(actual) and all(map(same_value, expected, actual))
    if isinstance(expected, dict) and isinstance(actual, dict):
        return expected.keys() == actual.keys() and all(same_value(v, actual[k]) for k, v in expected.items())
    return expected == actual


def _same_json(expected: str | None, actual: str | None, unwrap: bool) -> bool:
    try:
        a, b = json.loads(expected), json.loads(actual)
    except _FAILURES:
        return False
    return same_value(a, b) or (unwrap and isinstance(a, list) and len(a) == 1 and same_value(a[0], b))


@F.pandas_udf(ArrayType(StringType()))
def parse_list(texts: pd.Series) -> pd.Series:
    return texts.map(read_list)


@F.pandas_udf(StringType())
def safe_literal(texts: pd.Series) -> pd.Series:
    return texts.map(read_literal)


@F.pandas_udf(StringType())
def call_kwargs(texts: pd.Series) -> pd.Series:
    return texts.map(read_call)


@F.pandas_udf(BooleanType())
def values_equal(expected: pd.Series, actual: pd.Series) -> pd.Series:
    return pd.Series([_same_json(a, b, False) for a, b in zip(expected, actual)])


@F.pandas_udf(BooleanType())
def values_equal_unwrapped(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """As values_equal, or equal to the only element of the expected list."""
    return pd.Series([_same_json(a, b, True) for a, b in zip(expected, actual)])


@F.pandas_udf(StructType([StructField("bad", LongType()), StructField("tests", ArrayType(StringType()))]))
def call_tests(calls: pd.Series, outputs: pd.Series) -> pd.DataFrame:
    """Of a row's calls and expected outputs: calls that can't be read, and the others as JSON tests in order."""
    bad, tests = [], []
    for texts, wanted in zip(calls, outputs):
        read = [(read_call(c or ""), read_literal(o)) for c, o in zip(() if texts is None else texts, () if wanted is None else wanted)]
        bad.append(sum(kwargs is None for kwargs, _ in read))
        tests.append([f'{{"kwargs":{kwargs},"output":{"null" if output is None else output}}}' for kwargs, output in read if kwargs is not None])
    return pd.DataFrame({"bad": bad, "tests": tests})
