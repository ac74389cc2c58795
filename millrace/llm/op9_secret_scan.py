"""Secret scanning over a content-addressed ledger of text versions, in DataFrame operations only.

Every text is a blob named by its SHA-256. A blob is scanned by a version of a rule only if the ledger
does not hold that pair, and once however many paths (document rows) carry it: when one rule changes,
known blobs are scanned by that rule alone. The findings of a blob then go back to all its paths by a join on
the blob's name.

A scan finds per rule the leftmost non-overlapping matches. Spark has no function for the positions of
all matches, but the pieces between matches (``split``) and the matches themselves
(``regexp_extract_all``) alternate, so running sums of their lengths are the positions, in code points.

Kinds ``assign``, ``access`` and ``hex`` are the base rules. The method adds ``key`` (a private key
block: header, body and footer) and ``hook`` (tokens with the prefixes of public code and chat hosts).

Null texts count as empty. Texts of any length are scanned whole. Repeated rows and null ids keep their
rows. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, cut, marked, plain_names, read

#: A private key from its header to its footer of the same name, with any headers (Proc-Type) between; without a
#: footer, to the end of the lines in base64. Line ends may be written out as in JSON.
_EOL = r"(?:\s|\\[rnt])"
_KEY = (
    r"-----BEGIN ((?:[A-Z0-9]++ )*?PRIVATE KEY(?: BLOCK)?)-----"
    rf"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END \1-----|(?:{_EOL}++[A-Za-z-]++: [^\r\n\\]*+)*+(?:{_EOL}*+[A-Za-z0-9+/=]{{16,}}+)*+(?:{_EOL}++[A-Za-z0-9+/]*+={{1,2}})?+)"
)
#: kind, pattern, group whose length counts, least length. A match that is too short is dropped after
#: it has taken its place, so patterns must not be narrowed to the length where that changes matches.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("key", _KEY, 0, 1),
    ("hook", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})", 0, 1),
)
BASE = ("assign", "access", "hex")
#: Version of each rule; raise it when the rule changes.
VERSIONS = {"assign": "1", "access": "1", "hex": "1", "key": "2", "hook": "1"}

SPAN = "struct<start:int,kind:int,end:int>"
_NONE = f"cast(array() as array<{SPAN}>)"


#: Numbers that one fold sums up: a fold copies what it has gathered at every step.
TOGETHER = 64


def _let(name: str, value: str, body: str) -> str:
    """SQL text of the body, in which the value goes by a name and is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(values: str) -> str:
    """SQL text of the sums ahead of every number of an array (and some zeros' after them), in groups of groups.

    Each fold has TOGETHER numbers, so the work grows with the numbers, not with their square.
    """
    n = TOGETHER
    groups = lambda v: f"sequence(0, greatest(size({v}) - 1, 0) div {n})"
    inside = lambda v: f"sequence(0, greatest(least({n - 1}, size({v}) - 1 - {n} * j), 0))"
    number = lambda v: f"coalesce(get({v}, {n} * j + i), 0)"
    sums = lambda v: f"transform({groups(v)}, j -> aggregate({inside(v)}, 0, (s, i) -> s + {number(v)}))"
    ahead = lambda v, before: f"flatten(transform({groups(v)}, j -> slice(aggregate({inside(v)}, array(coalesce(get({before}, j), 0)), (s, i) -> concat(s, array(element_at(s, -1) + {number(v)}))), 1, {n})))"
    top = "aggregate(s1, array(0), (s, x) -> concat(s, array(element_at(s, -1) + x)))"
    return _let("v", values, _let("s0", sums("v"), _let("s1", sums("s0"), _let("p2", top, _let("p1", ahead("s0", "p2"), ahead("v", "p1"))))))


def _matches(text: str, kind: int) -> Column:
    """Spans of one rule: array of (start, kind, end)."""
    _, pattern, group, least = RULES[kind]
    t, p = F.col(text), F.lit(pattern)
    whole = F.transform(F.regexp_extract_all(t, p, F.lit(0)), F.length)
    counted = whole if group == 0 else F.transform(F.regexp_extract_all(t, p, F.lit(group)), F.length)
    given = F.struct(F.transform(F.split(t, pattern, -1), F.length).alias("gaps"), whole.alias("sizes"), counted.alias("counted"))
    moves = running("zip_with(slice(m.gaps, 1, size(m.sizes)), m.sizes, (g, z) -> g + z)")
    span = f"named_struct('start', get(at, i) + get(m.gaps, i), 'kind', {kind}, 'end', get(at, i) + get(m.gaps, i) + z)"
    spans = f"filter(transform(m.sizes, (z, i) -> CASE WHEN get(m.counted, i) >= {least} THEN {span} END), x -> x IS NOT NULL)"
    found = F.get(F.call_function("transform", F.array(given), F.expr(f"m -> {_let('at', moves, spans)}")), F.lit(0)).cast(f"array<{SPAN}>")
    return F.when(t.rlike(pattern), found).otherwise(F.expr(_NONE))


def rule_versions(versions: dict[str, str] | str | None = None) -> list[str]:
    """``kind:version`` of every rule in order; one version for all, or by kind where it differs from VERSIONS."""
    given = dict.fromkeys(VERSIONS, versions) if isinstance(versions, str) else VERSIONS | (versions or {})
    return [f"{kind}:{given[kind]}" for kind, *_ in RULES]


def scan(blobs: DataFrame, names: list[str]) -> DataFrame:
    """Ledger rows of the blobs (blob, text, and todo: the rule versions to scan by, all if the column is absent).

    blob, rule_versions (what has been scanned by), spans sorted by start, then kind.
    """
    every = F.array(*[F.lit(n) for n in names])
    todo = F.col("todo") if "todo" in blobs.columns else every
    wanted = lambda k: F.array_contains("todo", names[k]) if "todo" in blobs.columns else F.lit(True)
    found = [F.when(wanted(k), _matches("text", k)).otherwise(F.expr(_NONE)) for k in range(len(RULES))]
    return blobs.select("blob", todo.alias("rule_versions"), F.array_sort(F.concat(*found)).alias("spans"))


def scan_paths(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, version: dict[str, str] | str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(findings of every path, new ledger rows).

    Findings: doc_id, blob, spans, one row per input row. Append the new ledger rows to the table that
    is given as ``ledger`` (blob, rule_versions, spans) next time, and only unseen pairs are scanned.
    """
    names = rule_versions(version)
    every = F.array(*[F.lit(n) for n in names])
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    named = own.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("blob"), "text")
    paths = cut(named.select("doc_id", "blob"))
    # one path stands for each blob; its text moves by the path's id, so copies of a hot blob don't meet
    keep = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rule_versions"))).alias("seen"))  # a row a scan
        todo = F.array_except(every, F.coalesce("seen", F.expr("cast(array() as array<string>)")))
        keep = cut(keep.join(seen, "blob", "left").select("blob", "doc_id", todo.alias("todo")).filter(F.size("todo") > 0))
    same = F.col("t.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("t.blob") == F.col("k.blob"))
    text_of = named.alias("t").join(keep.hint("shuffle_hash").alias("k"), same, "left_semi" if ledger is None else "inner")
    unseen = text_of.select("t.blob", "t.text", *([] if ledger is None else ["k.todo"]))
    new = cut(scan(unseen, names).dropDuplicates(["blob"]))
    found = new.select("blob", "spans")
    if ledger is not None:  # of older rows, what was found by versions that still hold
        valid = F.filter("spans", lambda s: F.array_contains(F.col("rule_versions"), F.element_at(every, s["kind"] + 1)))
        both = found.unionByName(ledger.select("blob", valid.alias("spans")))
        found = both.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    hits = cut(found.filter(F.size("spans") > 0))
    # both sides come from files, so adaptive execution can split the partition of a hot blob
    findings = paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.expr(_NONE)).alias("spans"))
    return findings, new


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in RULES])
    one = lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])
    return F.array_join(F.transform(spans, one), ",")


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = scan_paths(read(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    counts = [F.size(F.filter(spans, _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return findings.select(
        "doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans")
    )


MASK = "[secret]"


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, or union of overlapping spans, replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], F.concat(state["out"], gap, F.lit(MASK))).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate(spans, start, step)
    rebuilt = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, rebuilt).otherwise(text)


#: Bits of the marks that tell which texts may have findings: at most MARK_BITS / 64 rows are broadcast.
MARK_BITS = 1 << 23


def masked(docs: DataFrame, hits: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows without findings, rows with findings and their masked text); hits: blob, spans, one row a blob.

    Rows that the bitmap clears stay where they are. The others, few unless most texts have secrets, move
    once to meet their findings; a false positive of the bitmap costs one such move.
    """
    named = docs.withColumn("__blob", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    seen = marked(named, "__blob", cut(bitmap(hits, "blob", MARK_BITS)), MARK_BITS, "__maybe")
    found = seen.filter("__maybe").join(hits.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")), "__blob", "left")
    clean = redact(F.col(text), F.coalesce("__spans", F.expr(_NONE))).alias(text)
    return seen.filter(~F.col("__maybe")).select(*docs.columns), found.select(*[clean if c == text else F.col(c) for c in docs.columns], "__spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; no document goes. ``n_chars`` follows the text.

    Null texts stay null. Equal texts are masked alike, repeated rows stay. Columns of any names pass through.
    """
    plain = plain_names(docs)
    at = dict(zip(docs.columns, plain.columns))
    findings, new = scan_paths(plain, at["doc_id"], at["text"])
    # findings belong to a content, so they come back by content
    clear, touched = masked(plain, cut(new.filter(F.size("spans") > 0).select("blob", "spans")), at["text"])
    if "n_chars" in at:
        length = F.when(F.col("__spans").isNotNull(), F.length(at["text"])).otherwise(F.col(at["n_chars"]))
        touched = touched.withColumn(at["n_chars"], length.cast(plain.schema[at["n_chars"]].dataType))
    return clear.unionByName(touched.drop("__spans")).toDF(*docs.columns)
