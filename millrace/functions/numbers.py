"""Numbers and answers in free text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, col, strip

# The patterns by which answers are read, in Java's dialect.
NUMBER = r"-?\$?\d[\d,]*(?:\.\d+)?(?:[eE][+-]?\d+)?%?"
ANSWER_IS = r"(?i)(?:final\s+answer|the\s+answer|answer)\s*(?:is|=|:)\s*([^\n]+)"
HASH_ANSWER = r"####\s*([^\n]+)"
LATEX_FRACTION = r"\\frac\{(-?\d+(?:\.\d+)?)\}\{(-?\d+(?:\.\d+)?)\}"
SLASH_FRACTION = r"(?<![\w.])-?\d+(?:\.\d+)?\s*/\s*-?\d+(?:\.\d+)?(?![\w.])"
EDGE_MARKS = r"[.。,:;，；]"
PLAIN_NUMBER = r"[+-]?(?:\d+(?:_?\d+)*\.?(?:\d+(?:_?\d+)*)?|\.\d+(?:_?\d+)*)(?:[eE][+-]?\d+)?"

PARSED = "struct<value:double,percent:boolean>"


def _bodies(text: str, begins: str) -> str:
    """SQL text of a fold over the braces of a text: their depth, the commands that are open, what has been found."""
    depth = "CASE WHEN endswith(t, '{') THEN a.depth + 1 WHEN t = '}' THEN greatest(a.depth - 1, 0) ELSE a.depth END"
    at = "a.at + length(t)"
    outside = "CASE WHEN try_element_at(a.found, -1).start > w.start THEN filter(a.found, f -> f.start < w.start) ELSE a.found END"
    ended = f"get(transform(array(try_element_at(a.open, -1)), w -> named_struct('at', {at}, 'depth', {depth}, 'open', slice(a.open, 1, size(a.open) - 1), 'found', concat({outside}, array(named_struct('start', w.start, 'stop', a.at))))), 0)"
    opened = rf"CASE WHEN startswith(t, r'\') AND endswith(t, '{{') THEN concat(a.open, array(named_struct('depth', {depth}, 'start', {at}))) ELSE a.open END"
    step = f"CASE WHEN t = '}}' AND coalesce(try_element_at(a.open, -1).depth = a.depth, false) THEN {ended} ELSE named_struct('at', {at}, 'depth', {depth}, 'open', {opened}, 'found', a.found) END"
    start = "named_struct('at', 1, 'depth', 0, 'open', cast(array() AS array<struct<depth:int,start:int>>), 'found', cast(array() AS array<struct<start:int,stop:int>>))"
    pieces = rf"regexp_extract_all({text}, r'({begins}|[{{}}]|[^{{}}\\]+|\\)', 1)"
    return f"aggregate({pieces}, {start}, (a, t) -> {step}, a -> transform(a.found, f -> substr({text}, f.start, f.stop - f.start)))"


def boxed(c: Column | str, command: str = "boxed") -> Column:
    """Bodies of a LaTeX command in order, nested braces kept; a body inside a found one is not listed.

    Nothing is scanned ahead of the first such command, or in a text without one.
    """
    begins = rf"\\{command}{WS}*\{{"
    from_first = F.array(F.regexp_extract(col(c), f"(?s){begins}.*", 0))
    found = F.get(F.call_function("transform", from_first, F.expr(f"x -> {_bodies('x', begins)}")), F.lit(0))
    return F.when(F.coalesce(col(c).rlike(begins), F.lit(False)), found).otherwise(F.array().cast("array<string>"))


def answer_spans(c: Column | str, bodies: Column | None = None) -> Column:
    """Likely final answers, strongest first; ``bodies`` replaces the nested search for boxed answers."""
    text = F.coalesce(col(c), F.lit(""))
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda x: x != "")
    last = F.when(F.size(lines) > 0, F.slice(lines, -1, 1)).otherwise(F.array().cast("array<string>"))
    found = [boxed(text) if bodies is None else bodies, *(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (HASH_ANSWER, ANSWER_IS))]
    return F.concat(*[F.reverse(x) for x in found], last, F.array(text))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_number(c: Column | str) -> Column:
    """struct(value, percent) of one number's text; value null if it is none."""
    raw = F.regexp_replace(strip(c), f"^{EDGE_MARKS}+|{EDGE_MARKS}+$", "")
    raw = F.regexp_replace(raw, r"\$|,|\\,|\\!|\\left|\\right", "")
    raw = F.regexp_replace(raw, r"\\[dt]frac", r"\\frac")
    percent = F.endswith(raw, F.lit("%"))
    body = strip(F.regexp_replace(raw, "%+$", ""))
    return F.struct(once(body, _value).alias("value"), percent.alias("percent"))


def _double(text: Column) -> Column:
    return text.try_cast("double")


def _value(body: Column) -> Column:
    latex, slash = f"^{LATEX_FRACTION}$", r"^(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)$"
    ratio = lambda p: _double(F.regexp_extract(body, p, 1)) / F.nullif(_double(F.regexp_extract(body, p, 2)), F.lit(0.0))
    # of slashed numbers only integers make a fraction above a positive denominator
    whole = r"^-?\d+\s*/\s*\d+$"
    return (
        F.when(body.rlike(latex), ratio(latex))
        .when(body.rlike(whole), ratio(slash))
        .when(body.rlike(f"^{PLAIN_NUMBER}$"), _double(F.replace(body, F.lit("_"), F.lit(""))))
    )


def candidate(spans: Column) -> Column:
    """struct(value, percent) of the last number in the first span that has one; fractions go before numbers."""

    def in_span(s: Column) -> Column:
        s = strip(s)
        fractions = F.concat(*[F.regexp_extract_all(s, F.lit(p), F.lit(0)) for p in (LATEX_FRACTION, SLASH_FRACTION)])
        found = F.when(F.size(fractions) > 0, fractions).otherwise(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(0)))
        return F.filter(F.transform(found, parse_number), lambda x: x["value"].isNotNull())

    hits = F.filter(F.transform(spans, in_span), lambda x: F.size(x) > 0)
    return F.try_element_at(F.get(hits, F.lit(0)), F.lit(-1))


def first_number(c: Column | str, bodies: Column | None = None) -> Column:
    return candidate(answer_spans(c, bodies))


def numbers_match(prediction: Column, target: Column) -> Column:
    """Whether two parsed numbers agree within max(|t| * 1e-6, 1e-4), a per cent sign on one side allowed."""

    def match(x: Column) -> Column:
        p, t, p_percent, t_percent = x["p"]["value"], x["t"]["value"], x["p"]["percent"], x["t"]["percent"]
        close = lambda v: F.abs(v - t) <= F.greatest(F.abs(t) * 1e-6, F.lit(1e-4))
        return close(p) | (t_percent & ~p_percent & close(p * 100.0)) | (p_percent & ~t_percent & close(p / 100.0))

    return F.coalesce(once(F.struct(prediction.alias("p"), target.alias("t")), match), F.lit(False))


def interval_match(prediction: Column, predicted_text: Column, target: Column, lower: Column, upper: Column) -> Column:
    """Within both bounds; bounds that are no numbers fall back to the target standing in the prediction."""
    lo, hi = _double(strip(lower)), _double(strip(upper))
    inside = F.coalesce((prediction["value"] >= lo) & (prediction["value"] <= hi), F.lit(False))
    contained = F.contains(F.lower(strip(predicted_text)), F.lower(strip(target)))
    return F.when(lo.isNull() | hi.isNull(), F.when(prediction.isNull(), F.lit(False)).otherwise(contained)).otherwise(inside)


def normalise_text_answer(spans: Column, c: Column | str) -> Column:
    first = F.element_at(spans, 1)
    text = F.when(strip(first) != "", first).otherwise(strip(c))
    bare = F.regexp_replace(strip(text), f"^{EDGE_MARKS}+|{EDGE_MARKS}+$", "")
    return F.lower(F.regexp_replace(bare, f"{WS}+", " "))


def text_answer_matches(prediction: Column, target: Column) -> Column:
    """Equal to the normalised target, or beginning with it and a space."""
    return F.coalesce((target != "") & ((prediction == target) | F.startswith(prediction, F.concat(target, F.lit(" ")))), F.lit(False))


def normalise_math(c: Column | str, bodies: Column | None = None) -> Column:
    """Canonical spelling of a formula; the first boxed body counts."""
    text = F.coalesce(F.get(boxed(col(c)) if bodies is None else bodies, F.lit(0)), col(c))
    text = F.regexp_replace(text, r"\\[dt]frac", r"\\frac")
    text = F.regexp_replace(text, r"\\frac\{([^{}]+)\}\{([^{}]+)\}", r"($1)/($2)")
    text = strip(F.lower(F.regexp_replace(text, r"\\left|\\right| |\$|\\,|\\!", "")))
    return F.regexp_replace(text, r"^\.+|\.+$", "")


def is_numeric_math(c: Column | str) -> Column:
    text = strip(c)
    plain = strip(F.regexp_replace(text, r"[$,]", ""))
    return text.rlike(LATEX_FRACTION) | text.rlike(SLASH_FRACTION) | plain.rlike(r"^-?\d+(?:\.\d+)?%?$")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def safe_ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))


def whole_seconds(c: Column) -> Column:
    """Seconds as a limit in whole ones: rounded up, 1 at least."""
    return F.greatest(F.ceil(c), F.lit(1).cast("long"))


def rounded_seconds(c: Column, digits: int = 3) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(c, digits)
