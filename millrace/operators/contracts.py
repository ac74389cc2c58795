"""Checks on tables: each gives rows that break it, or stops the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import set_fingerprint


def row_violations(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows of (prompt, answer, messages, test_code, ...) that break the training contract, with the first reason."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    m = F.col("messages")
    said = lambda i, role, text: (F.get(m, F.lit(i))["role"] == role) & (F.get(m, F.lit(i))["content"] == F.col(text))
    pair = (F.size(m) == 2) & said(0, "user", "prompt") & said(1, "assistant", "answer")
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
    reason = reason.when(~F.coalesce(pair, F.lit(False)), "messages are not the prompt and the answer")
    if "test_code" in rows.columns:
        leaked = F.coalesce((F.col("test_code") != "") & F.contains("prompt", F.col("test_code")), F.lit(False))
        reason = reason.when(leaked, "prompt holds the tests")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL")


def count_or_raise(df: DataFrame, expected: int, name: str) -> None:
    n = df.count()
    if n != expected:
        raise ValueError(f"{name}: {n} rows, {expected} expected")


def frozen_or_raise(df: DataFrame, key: str, rows: int, digest: str, name: str) -> None:
    """Rows and key set as recorded."""
    got = df.agg(F.count("*").alias("n"), set_fingerprint(key).alias("d")).first()
    if (got["n"], str(got["d"])) != (rows, digest):
        raise ValueError(f"{name}: {got['n']} rows with digest {got['d']}, recorded are {rows} and {digest}")


def artifact_differences(recorded: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """(key, reason): files (key, rows, bytes, sha256) that are missing, were never recorded, or are not as recorded."""
    then, now = (df.select(F.col(key).alias(f"{x}_key"), *[F.col(c).alias(f"{x}_{c}") for c in ("rows", "bytes", "sha256")]) for df, x in ((recorded, "then"), (found, "now")))
    both = then.join(now, F.col("then_key") == F.col("now_key"), "full")
    changed = [F.when(F.col(f"then_{c}") != F.col(f"now_{c}"), F.lit(c)) for c in ("rows", "bytes", "sha256")]
    reason = F.when(F.col("now_key").isNull(), "missing").when(F.col("then_key").isNull(), "not recorded").otherwise(F.array_join(F.array_compact(F.array(*changed)), ","))
    return both.select(F.coalesce("then_key", "now_key").alias(key), reason.alias("reason")).filter("reason <> ''")


def artifacts_or_raise(recorded: DataFrame, found: DataFrame, key: str = "path", shown: int = 5) -> None:
    """Stops if a file is not as recorded; the error names the first."""
    wrong = artifact_differences(recorded, found, key).orderBy(key).limit(shown).collect()
    if wrong:
        raise ValueError(f"not as recorded: {', '.join(f'{r[key]} ({r["reason"]})' for r in wrong)}")


def guarded(df: DataFrame, **rules: Column) -> DataFrame:
    """The rows, each held against every rule as it passes; the first that breaks one stops the run and is shown.

    A rule is a condition, null counting as broken. There is no job and no scan of its own: the check is part of
    whatever reads the rows, and lies below all that is done with them.
    """
    shown = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    fine = F.lit(True)
    for name, holds in rules.items():
        broken = F.raise_error(F.concat(F.lit(f"{name}: "), F.substring(shown, 1, 500))).cast("boolean")
        fine = F.when(F.coalesce(holds, F.lit(False)), fine).otherwise(broken)
    return df.filter(fine)


def guarded_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The rows, none of whose keys is null or repeated; the first that is stops the run.

    Rows meet by key in one shuffle, which a later join or grouping by it uses again. Of a key that very many rows
    have, a task counts no further than to the second.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    counted = df.withColumn("__nth", nth).filter("__nth <= 2")
    return guarded(counted, **{f"missing {', '.join(keys)}": known, f"repeated {', '.join(keys)}": F.col("__nth") == 1}).drop("__nth")


def violations(df: DataFrame, key: str, required: list[str], expected: int | None = None) -> DataFrame:
    """(guard, key, n) of all that breaks a guard, from one scan and one shuffle of keys and partial counts.

    ``missing <column>``: rows of the key without it; ``repeated``: rows of a key that has several; ``missing key``;
    ``rows``: how many there are, if that is not what is expected.
    """
    gone = [F.count_if(F.col(c).isNull()).alias(f"__{c}") for c in required]
    by_key = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"), *gone)
    one = lambda guard, n, when: F.when(when, F.struct(F.lit(guard).alias("guard"), F.col("key"), n.alias("n")))
    n, none = F.col("n"), F.col("key").isNull()
    found = F.array(one("missing key", n, none), one("repeated", n, ~none & (n > 1)), *[one(f"missing {c}", F.col(f"__{c}"), F.col(f"__{c}") > 0) for c in required])
    out = by_key.select(F.explode(F.array_compact(found)).alias("v")).select("v.*")
    if expected is None:
        return out
    total = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).filter(F.col("n") != expected)
    return out.union(total.select(F.lit("rows"), F.lit(None).cast("string"), "n"))


def coverage(sample: DataFrame, pool: DataFrame, category: str) -> DataFrame:
    """Categories of the pool that the sample lacks."""
    return pool.select(category).distinct().join(sample.select(category).distinct(), category, "left_anti")


def finite_positive(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v > 0)
    return ok


def evaluation_differences(records: DataFrame, truth: DataFrame, metrics: DataFrame, by: str = "task", tolerance: float = 1e-12) -> DataFrame:
    """Tasks whose ids or recomputed counts differ from what metrics (task, n, correct, accuracy) say."""
    ids = records.select(by, "ord", "id").join(truth.select(by, "ord", F.col("id").alias("want")), [by, "ord"], "full")
    wrong = ids.groupBy(by).agg(F.count_if(~F.col("id").eqNullSafe(F.col("want"))).alias("id_differences"))
    n, ok = F.count("passed"), F.count_if("passed")
    own = records.groupBy(by).agg(n.alias("n_"), ok.alias("correct_"), (ok / F.greatest(n, F.lit(1))).alias("accuracy_"))
    both = metrics.join(own, by, "full").join(wrong, by, "left")
    same = (F.col("n") == F.col("n_")) & (F.col("correct") == F.col("correct_")) & (F.abs(F.col("accuracy") - F.col("accuracy_")) <= tolerance)
    return both.filter(~F.coalesce(same & (F.col("id_differences") == 0), F.lit(False)))


def repeated_sections(metrics: DataFrame) -> DataFrame:
    """Tasks that stand in more than one suite."""
    return metrics.groupBy("task").agg(F.count_distinct("suite").alias("suites")).filter("suites > 1")


def resume_or_raise(before: dict, now: dict, keys: tuple[str, ...]) -> None:
    changed = [k for k in keys if before.get(k) != now.get(k)]
    if changed:
        raise ValueError(f"a resumed run must keep {', '.join(changed)}")


def resume_differences(before: DataFrame, now: DataFrame, key: str, settings: tuple[str, ...]) -> DataFrame:
    """(key, changed): of runs that began with one table of settings and go on with another, what has changed."""
    other = now.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in settings])
    changed = F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in settings])
    both = before.join(other, F.col(key) == F.col("__key"), "left")
    return both.select(key, F.when(F.col("__key").isNull(), "not resumed").otherwise(changed).alias("changed")).filter("changed <> ''")


def inside(path: Column | str, root: str) -> Column:
    """Whether an absolute path is the root or lies in it once ``.``, ``..`` and repeated slashes are resolved."""
    p = F.col(path) if isinstance(path, str) else path
    step = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x.isin("", "."), a).otherwise(F.concat(a, F.array(x)))
    whole = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    return F.startswith(F.concat(F.lit("/"), whole, F.lit("/")), F.lit(f"{root.rstrip('/')}/"))


def outside_or_raise(path: str, root: str) -> None:
    from pathlib import Path

    if Path(path).resolve().is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} lies inside {root}")


def options_or_raise(options: dict, allowed: dict[str, tuple]) -> None:
    """Every option is known and has one of its values."""
    wrong = [f"{k}={v}" for k, v in options.items() if k not in allowed or v not in allowed[k]]
    if wrong:
        raise ValueError(f"options not allowed: {', '.join(wrong)}")


def inputs_digest(files: DataFrame) -> DataFrame:
    """One row: files, bytes and a SHA-256 over the (path, sha256) of a job's inputs, however they are listed."""
    each = F.concat(F.col("path"), F.lit(" "), F.col("sha256"))
    whole = F.sha2(F.array_join(F.array_sort(F.collect_list(each)), "\n").cast("binary"), 256)  # a job's inputs are few files
    return files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), whole.alias("inputs_sha256"))
