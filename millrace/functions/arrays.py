"""Array, map and JSON expressions; a missing array counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

_EMPTY = "cast(array() as array<string>)"


def filled(c: Column | str) -> Column:
    """Never null, without null elements."""
    return F.array_compact(F.coalesce(col(c), F.expr(_EMPTY)))


def merged_tags(*lists: Column | str, lower: bool = True) -> Column:
    """Tags of all lists, stripped, first occurrence kept, empties dropped."""
    clean = F.transform(F.concat(*[filled(x) for x in lists]), lambda t: strip(F.lower(t) if lower else t))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def overlaps(a: Column | str, b: Column | str) -> Column:
    return F.arrays_overlap(filled(a), filled(b))


def aligned(inputs: Column | str, outputs: Column | str) -> Column:
    """array of struct(input, output), or null if the lists differ in length."""
    a, b = col(inputs), col(outputs)
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("input"), b.alias("output")))


def unwrapped(c: Column | str) -> Column:
    """The only element of a list of one."""
    return F.when(F.size(col(c)) == 1, F.get(col(c), F.lit(0)))


def head(c: Column | str, n: int) -> Column:
    """The first n, or all for 0."""
    return F.slice(col(c), 1, n) if n > 0 else col(c)


def same_set(a: Column | str, b: Column | str) -> Column:
    return (F.size(F.array_except(filled(a), filled(b))) == 0) & (F.size(F.array_except(filled(b), filled(a))) == 0)


IGNORED_LABEL = -100


def label_mask(prefix: Column | str, suffix: Column | str) -> Column:
    """Labels of a prompt and its answer: the prompt's tokens are ignored."""
    return F.concat(F.array_repeat(F.lit(IGNORED_LABEL), F.size(col(prefix))), col(suffix))


def truncated(prompt: Column | str, answer: Column | str, most: int, answer_least: int = 256) -> Column:
    """struct(prompt, answer) cut to ``most`` tokens: the answer has its budget, the prompt the rest of it."""
    p, a = col(prompt), col(answer)
    budget = F.greatest(F.lit(answer_least), F.least(F.size(a), F.lit(most // 2)))
    room = F.greatest(F.lit(most) - budget, F.lit(0))
    cut_p = F.when(F.size(p) > room, F.slice(p, F.lit(1), room)).otherwise(p)
    cut_a = F.slice(a, F.lit(1), F.greatest(F.lit(most) - F.size(cut_p), F.lit(0)))
    fits = F.size(p) + F.size(a) <= most
    return F.struct(F.when(fits, p).otherwise(cut_p).alias("prompt"), F.when(fits, a).otherwise(cut_a).alias("answer"))


def lenient_object(c: Column | str, schema: str) -> Column:
    """Parsed JSON object; an object without fields for anything that isn't one. Of equal keys the parser's choice holds."""
    parsed = F.from_json(F.when(is_json_object(c), col(c)), schema)
    return F.coalesce(parsed, F.from_json(F.lit("{}"), schema))


def is_json_object(c: Column | str) -> Column:
    """Whether the text is one JSON object."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(col(c))), F.lit("OBJECT")), F.lit(False))


def json_kind(c: Column | str) -> Column:
    """object, array, other, or invalid (null counts as invalid)."""
    kind = F.schema_of_variant(F.try_parse_json(col(c)))
    return F.when(kind.isNull(), "invalid").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("other")
