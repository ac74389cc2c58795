"""Text expressions. Everything here stays inside code generation; nothing runs Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split and str.strip treat as white space, spelt so that Java agrees on every code point.
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
#: Its characters one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The same for regular expressions of DuckDB.
WS_RE2 = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
FENCE = r"(?si)```(?:python|py)?[^\n\r]*\r?\n(.*?)```"
CODE_LINE = r"^(from\s+\S+\s+import\s+|import\s+\S+|class\s+\w+|def\s+\w+|if\s+__name__)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(SPACES))  # no pattern: that would be tried at every character of a long text


def collapse(c: Column | str) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(col(c), f"{WS}+", " "))


def blank(c: Column | str) -> Column:
    """Null or nothing but white space."""
    return F.coalesce(strip(c), F.lit("")) == ""


def first_filled(*cs: Column | str) -> Column:
    """The first value that is not null and not empty; else the empty string."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit(""))


def lines(c: Column | str) -> Column:
    return F.split(col(c), r"\r\n|\r|\n")


def after_last(c: Column | str, marker: str) -> Column:
    return F.substring_index(col(c), marker, -1)


def fences(c: Column | str) -> Column:
    """Bodies of fenced code blocks, in order, with their indentation."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(FENCE), F.lit(1))


def strip_whole_fence(c: Column | str) -> Column:
    """The body if one fence encloses the whole text, else the stripped text."""
    text = strip(c)
    return F.when(text.rlike(r"(?si)\A```(?:python|py)?\s*\n.*\n```\z"), strip(F.regexp_replace(text, r"(?si)\A```(?:python|py)?\s*\n(.*)\n```\z", "$1"))).otherwise(text)


def from_first_code_line(c: Column | str) -> Column:
    """The text from its first line that looks like code, or all of it, stripped."""
    all_lines = lines(c)
    at = F.array_position(F.transform(all_lines, lambda x: strip(x).rlike(CODE_LINE)), F.lit(True)).cast("int")
    tail = F.array_join(F.slice(all_lines, F.greatest(at, F.lit(1)), F.size(all_lines)), "\n")
    return F.when(at > 0, strip(tail)).otherwise(strip(c))


def trim_blank_lines(c: Column | str) -> Column:
    """Without blank lines at either end; a tab is four spaces."""
    return F.regexp_replace(F.replace(col(c), F.lit("\t"), F.lit("    ")), rf"\A(?:[^\S\n]*\n)+|(?:\n[^\S\n]*)+\z", "")


def indent_body(c: Column | str) -> Column:
    """Indents every line by four spaces unless some line is indented already."""
    every = lines(c)
    bare = ~F.exists(every, lambda x: x.rlike(r"^[ \t]+\S")) & ~blank(c)
    return F.when(bare, F.array_join(F.transform(every, lambda x: F.when(blank(x), x).otherwise(F.concat(F.lit("    "), x))), "\n")).otherwise(col(c))


#: What marks prose in front of an answer.
PROSE_MARKERS = ("here is", "explanation", "```python", "the solution")


def format_ok(c: Column | str) -> Column:
    """Neither a fence anywhere nor a prose marker in the first 160 characters."""
    text = strip(c)
    head = F.lower(F.substring(text, 1, 160))
    prose = [F.contains(head, F.lit(m)) for m in PROSE_MARKERS]
    bad = F.contains(text, F.lit("```"))
    for p in prose:
        bad = bad | p
    return F.coalesce((text != "") & ~bad, F.lit(False))


def cut_at_next_question(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?s)\n\s*(?:Q:|Question:).*", "")


def rstrip_lines(c: Column | str) -> Column:
    """Every line without trailing white space, the whole without trailing white space."""
    cleaned = F.array_join(F.transform(lines(c), lambda x: F.regexp_replace(x, f"{WS}+$", "")), "\n")
    return F.regexp_replace(cleaned, f"{WS}+$", "")


def padded_id(prefix: str, n: Column | str, width: int = 5) -> Column:
    return F.format_string(f"{prefix}%0{width}d", col(n))


def without_prefix(c: Column | str, prefix: str) -> Column:
    return F.when(F.startswith(col(c), F.lit(prefix)), F.substring(col(c), len(prefix) + 1, 1 << 30)).otherwise(col(c))


def spaced(c: Column | str) -> Column:
    """Underscores as spaces."""
    return F.replace(col(c), F.lit("_"), F.lit(" "))


def leading_imports(c: Column | str) -> Column:
    """Import lines up to the first other line that is not blank."""
    every = lines(c)
    other = F.transform(every, lambda x: ~blank(x) & ~strip(x).rlike(r"^(import |from )"))
    stop = F.array_position(other, F.lit(True)).cast("int")
    head = F.when(stop > 0, F.slice(every, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(every)
    return F.array_join(F.filter(head, lambda x: ~blank(x)), "\n")


def cut_test_tail(c: Column | str) -> Column:
    """Up to the first line that opens the tests: ``def check(``, a solution or test heading, a bare assert."""
    every = lines(c)
    opens = F.transform(
        every,
        lambda x: strip(x).rlike(r"^def\s+check\s*\(|^### Canonical solution|^### Unit tests") | x.rlike(r"^assert "),
    )
    stop = F.array_position(opens, F.lit(True)).cast("int")
    return F.when(stop > 0, F.array_join(F.slice(every, F.lit(1), stop - 1), "\n")).otherwise(F.array_join(every, "\n"))


#: Repository lint: home directories, credentials and run ids in text.
LINT = {
    "home_path": r"/(?:home|Users)/[A-Za-z0-9._-]+",
    "credential": r"(?i)\b(?:api_?key|secret|token|password)\b[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_-]{12,}",
    "run_id": r"\brun[-_][0-9]{6,}",
}


def lint_hits(c: Column | str) -> list[Column]:
    return [col(c).rlike(p).alias(k) for k, p in LINT.items()]
