"""Structural admission of problems, with the first reason against each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from ..functions.values import call_tests


def _array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _size(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def structural_reason(unparseable_call: Column | None = None) -> Column:
    """Reason against a row of (dataset, mode, entry_point, starter_code, input_output), null if admitted."""
    io = F.try_parse_json("input_output")
    kind = F.coalesce(F.schema_of_variant(io), F.lit(""))
    listed, object_ = F.startswith(kind, F.lit("ARRAY")), F.startswith(kind, F.lit("OBJECT"))
    inputs, outputs = _array(io, "$.inputs"), _array(io, "$.outputs")
    unaligned = (_size(inputs) == 0) | (_size(inputs) != _size(outputs))
    name = F.coalesce(F.nullif(F.try_variant_get(io, "$.fn_name", "string"), F.lit("")), F.nullif(F.col("entry_point"), F.lit("")))
    positional = F.forall(F.coalesce(inputs, F.array().cast("array<variant>")), lambda x: F.startswith(F.schema_of_variant(x), F.lit("ARRAY")))
    leetcode, taco = F.col("dataset") == "leetcode2k", F.col("dataset") == "taco"
    stdin, function = taco & (F.col("mode") == "stdin"), taco & (F.col("mode") == "function")
    no_interface = ~F.coalesce(F.col("mode") == "function", F.lit(False)) | (F.coalesce("entry_point", F.lit("")) == "") | ~listed
    call = F.lit(False) if unparseable_call is None else unparseable_call
    return (
        F.when(kind == "", "invalid_input_output_json")
        .when(leetcode & no_interface, "leetcode_unsupported_interface")
        .when(leetcode & call, "leetcode_unparseable_call")
        .when(stdin & ~blank("starter_code"), "taco_pseudo_stdin_nonempty_starter")
        .when(stdin & ~object_, "taco_stdin_bad_io_type")
        .when(stdin & unaligned, "taco_stdin_unaligned_io")
        .when(function & ~object_, "taco_function_bad_io_type")
        .when(function & (name.isNull() | unaligned), "taco_function_unaligned_io")
        .when(function & ~positional, "taco_function_nonpositional_input")
        .when(~F.coalesce(leetcode | stdin | function, F.lit(False)), "unsupported_dataset_or_mode")
        .when(leetcode & (_size(_array(io, "$")) == 0), "no_normalized_tests")
    )


def admitted(rows: DataFrame) -> DataFrame:
    """Rows with ``reject_reason``, ``interface_kind`` and ``tests`` (JSON texts).

    Calls and literals of function tests are Python syntax, so the arrays of a row go through Arrow, row by
    row: equal rows stay apart, and nothing is shuffled. The rest is native.
    """
    io = F.try_parse_json("input_output")
    items = F.coalesce(_array(io, "$"), F.array().cast("array<variant>"))
    listed = F.when(F.col("dataset") == "leetcode2k", items).otherwise(F.array().cast("array<variant>"))
    field = lambda name: F.transform(listed, lambda x: F.try_variant_get(x, name, "string"))
    joined = rows.withColumn("__calls", call_tests(field("$.input"), field("$.output")))
    reason = structural_reason(F.col("__calls.bad") > 0)
    kind = F.when(F.col("dataset") == "leetcode2k", "leetcode_function").otherwise(F.concat(F.lit("taco_"), F.col("mode")))
    inputs = F.coalesce(_array(io, "$.inputs"), F.array().cast("array<variant>"))
    outputs = F.coalesce(_array(io, "$.outputs"), F.array().cast("array<variant>"))
    single = lambda o: F.when(
        (F.col("mode") == "function") & F.startswith(F.schema_of_variant(o), F.lit("ARRAY")) & (F.size(F.try_variant_get(o, "$", "array<variant>")) == 1),
        F.to_json(F.try_variant_get(o, "$[0]", "variant")),
    ).otherwise(F.to_json(o))
    name = F.when(F.col("mode") == "function", "args").otherwise("input")
    pairs = F.zip_with(inputs, outputs, lambda i, o: F.concat(F.lit('{"'), name, F.lit('":'), F.to_json(i), F.lit(',"output":'), single(o), F.lit("}")))
    tests = F.when(F.col("dataset") == "leetcode2k", F.col("__calls.tests")).otherwise(pairs)
    out = joined.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    return out.withColumn("interface_kind", F.when(ok, kind)).withColumn("tests", F.when(ok, tests)).drop("__calls")


def over_length(lengths: list[str], most: int) -> Column:
    """Whether the largest of several token counts is above the cap."""
    longest = F.greatest(*lengths) if len(lengths) > 1 else F.col(lengths[0])
    return longest > most
