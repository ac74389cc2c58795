import hashlib
import json
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import hashing
from millrace.operators import admission, classify, contracts, dedup, histograms, prompts, rewards, select
from millrace.plans import io_queries
from millrace.sources import readers, writers
from millrace.streaming import appends, status


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "x", "n": 1}\n\n{"id": "y"}\n')
    assert [tuple(r) for r in readers.jsonl(spark, str(path), "id string, n long").collect()] == [("x", 1), ("y", None)]
    assert readers.strict_jsonl(spark, str(path), "id string").count() == 2
    path.write_text('{"id": "x"}\n[1]\n')
    with pytest.raises(Exception, match="a.jsonl:2"):
        readers.strict_jsonl(spark, str(path), "id string").collect()


def test_suffixes_and_steps(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x"}, {"id": "y"}]')
    assert readers.by_suffix(spark, str(tmp_path / "a.json"), "id string").count() == 2
    with pytest.raises(ValueError):
        readers.by_suffix(spark, "a.txt", "id string", json_lines=True)
    logs = tmp_path / "logs"
    logs.mkdir()
    for name in ("10.jsonl", "0.jsonl", "x.jsonl"):
        (logs / name).write_text('{"score": 1.0}\n')
    assert [r["step"] for r in readers.stepped(spark, str(logs), "score double").collect()] == [10]


def test_ordinals(spark, tmp_path):
    spark.range(1000, numPartitions=4).write.parquet(str(tmp_path / "p"))
    rows = readers.numbered(readers.with_ordinal(readers.parquet(spark, str(tmp_path / "p"))))
    got = rows.orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(1000)) and [r["id"] for r in got] == list(range(1000))
    assert readers.limited(rows, 3, "index").count() == 3 and readers.limited(rows, 0, "index").count() == 1000
    last = readers.last_by_key(rows.select((F.col("id") % 3).alias("k"), "id", "index"), "k", "index")
    assert {r["k"]: r["id"] for r in last.collect()} == {0: 999, 1: 997, 2: 998}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x/y")], "id string, cat string")
    writers.jsonl(df, str(tmp_path / "j"))
    assert '"cat":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    with pytest.raises(Exception, match="exist"):
        writers.jsonl(df, str(tmp_path / "j"))
    writers.by_category(df, str(tmp_path / "c"), "cat")
    assert sorted(str(r["cat"]) for r in spark.read.json(str(tmp_path / "c")).collect()) == ["None", "x/y"]
    done = spark.createDataFrame([("a",)], "id string")
    writers.append_pending(df, str(tmp_path / "inc"), done)
    assert spark.read.json(str(tmp_path / "inc")).count() == 1
    writers.atomic_json({"a": 1}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1}
    with pytest.raises(FileExistsError):
        writers.exclusive_json({}, str(tmp_path / "m.json"))
    one, two = (writers.manifest(df.repartition(n), "id").first() for n in (1, 3))
    assert one == two and one["rows"] == 2
    rows = spark.createDataFrame([(f"t{i:03d}",) for i in range(100) for _ in range(20)], "tag string")
    report = [r["text"] for r in histograms.report(rows, "tag", "tag").orderBy("line").collect()]
    assert len(report) == 82 and report[2] == "| t000 | 20 | 1.00% |"


def test_small_files_in_any_store(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    for value in ({"a": 1}, {"a": "é"}):
        writers.atomic_json(value, path, spark)
        assert json.loads((tmp_path / "m.json").read_text()) == value
    with pytest.raises(FileExistsError):
        writers.exclusive_json({}, path, spark)
    writers.exclusive_json({}, f"file://{tmp_path}/new.json", spark)
    assert readers.first_existing([f"file://{tmp_path}/none", f"file://{tmp_path}/new.json"], spark).endswith("new.json")
    with pytest.raises(FileNotFoundError):
        readers.first_existing([f"file://{tmp_path}/none"], spark)


def test_job_plans(spark, tmp_path):
    contracts.options_or_raise({"mode": "full"}, {"mode": ("full", "random")})
    for wrong in ({"mode": "other"}, {"speed": 1}):
        with pytest.raises(ValueError):
            contracts.options_or_raise(wrong, {"mode": ("full", "random")})
    for name in "ab":
        (tmp_path / name).write_text(name)
    first = contracts.inputs_digest(readers.file_digests(spark, str(tmp_path / "*"))).first()
    assert (first["files"], first["bytes"]) == (2, 2)
    (tmp_path / "b").write_text("c")
    assert contracts.inputs_digest(readers.file_digests(spark, str(tmp_path / "*"))).first()["inputs_sha256"] != first["inputs_sha256"]


def test_tag_tables():
    assert len(classify.tag_map(classify.TAGS)) == 108
    assert len(classify.tag_map(classify.EXACT_TAGS)) == 63


def test_classification(spark):
    rows = spark.createDataFrame([(["DP ", "graphs"],), (["nothing known"],), ([],), (None,)], "tags array<string>")
    got = classify.classified(rows, "tags").collect()
    assert [r["primary_category"] for r in got] == ["graph", "other_tagged", "no_tags", "no_tags"]
    assert got[0]["overlap_categories"] == ["graph", "dynamic_programming"]
    exact = classify.classified(spark.createDataFrame([(["array", "Array"],)], "tags array<string>"), "tags", exact_case=True).first()
    assert exact["overlap_categories"] == ["data_structure"]
    formal = spark.createDataFrame([("string",), (None,), ("graph",)], "c string").select(classify.formal("c").alias("x"))
    assert [r["x"] for r in formal.collect()] == ["other_algorithm", "no_tags", "graph"]


IO = '{"inputs": ["1"], "outputs": ["2"]}'
CASES = [
    ("taco", "stdin", None, "", "{", "invalid_input_output_json"),
    ("leetcode2k", "stdin", "f", "", "[]", "leetcode_unsupported_interface"),
    ("leetcode2k", "function", "f", "", '[{"input": "a = g()", "output": "1"}]', "leetcode_unparseable_call"),
    ("taco", "stdin", None, "def f", IO, "taco_pseudo_stdin_nonempty_starter"),
    ("taco", "stdin", None, " ", "[1]", "taco_stdin_bad_io_type"),
    ("taco", "stdin", None, "", '{"inputs": ["1"], "outputs": []}', "taco_stdin_unaligned_io"),
    ("taco", "function", "f", "", "[1]", "taco_function_bad_io_type"),
    ("taco", "function", None, "", IO, "taco_function_unaligned_io"),
    ("taco", "function", "f", "", IO, "taco_function_nonpositional_input"),
    ("other", "stdin", None, "", IO, "unsupported_dataset_or_mode"),
    ("leetcode2k", "function", "f", "", "[]", "no_normalized_tests"),
    ("taco", "stdin", None, "", IO, None),
    ("taco", "function", None, "", '{"inputs": [[1]], "outputs": [[2]], "fn_name": "f"}', None),
    ("leetcode2k", "function", "f", "", '[{"input": "a = 1", "output": "[2]"}]', None),
]


def test_admission(spark):
    rows = spark.createDataFrame([(str(i), *c[:5]) for i, c in enumerate(CASES)], "id string, dataset string, mode string, entry_point string, starter_code string, input_output string")
    got = {int(r["id"]): r for r in admission.admitted(rows).collect()}
    assert [got[i]["reject_reason"] for i in range(len(CASES))] == [c[5] for c in CASES]
    assert [json.loads(t) for t in got[12]["tests"]] == [{"args": [1], "output": 2}]
    assert [json.loads(t) for t in got[13]["tests"]] == [{"kwargs": {"a": 1}, "output": [2]}]
    assert got[11]["interface_kind"] == "taco_stdin" and got[0]["tests"] is None


def test_equal_rows_keep_their_own_tests(spark):
    calls = '[{"input": "a = 1", "output": "[2]"}, {"input": "a = 3", "output": "None"}]'
    rows = spark.createDataFrame([("same", "leetcode2k", "function", "f", "", calls)] * 3, "id string, dataset string, mode string, entry_point string, starter_code string, input_output string")
    got = admission.admitted(rows).collect()
    assert len(got) == 3
    for r in got:
        assert [json.loads(t) for t in r["tests"]] == [{"kwargs": {"a": 1}, "output": [2]}, {"kwargs": {"a": 3}, "output": None}]


def test_tags_without_a_category_stop_a_run(spark):
    dim = classify.dimension(spark, classify.EXACT_TAGS)
    rows = spark.createDataFrame([(["Array", "Trie"],), (["Poetry"],)], "tags array<string>")
    assert classify.all_mapped_or_raise(rows.limit(1), "tags", dim).count() == 1
    with pytest.raises(ValueError, match="Poetry"):
        classify.all_mapped_or_raise(rows, "tags", dim)
    assert dim.filter("tag = 'Trie'").first()["note"].startswith("Trie is a concrete data structure")


def test_audit_precedence(spark):
    lit = lambda v: F.lit(v).cast("boolean")
    ask = lambda **k: spark.range(1).select(
        dedup.audit_status(lit(k.get("src", True)), F.lit(k.get("why")).cast("string"), lit(k.get("ok", False)), lit(k.get("fixed", False)), lit(k.get("tried", False)), lit(k.get("dup", False)), k.get("on", True)).alias("x")
    ).first()["x"]
    assert ask(src=False, why="x") == "not_in_rl_dedup_source"
    assert ask(why="taco_stdin_bad_io_type", ok=True) == "taco_stdin_bad_io_type"
    assert ask(ok=True) == "kept_verified" and ask(ok=True, dup=True) == "exact_prompt_answer_duplicate"
    assert ask(fixed=True, tried=True) == "repaired_verified" and ask(tried=True) == "all_simple_repairs_failed"
    assert ask() == "canonical_failed_no_safe_mechanical_repair" and ask(on=False) == "canonical_not_execution_verified"


def test_rewards(spark):
    tests = [("a", i, "passed") for i in range(2)] + [("b", 0, "passed"), ("b", 1, "wrong_answer"), ("c", 0, "timeout")]
    got = {r["id"]: r for r in rewards.verdicts(spark.createDataFrame(tests, "id string, pos int, outcome string"), "id", "outcome").collect()}
    assert [(got[k]["score"], got[k]["strict_score"], got[k]["status"]) for k in "abc"] == [(1.0, 1.0, "passed"), (0.4, 0.0, "wrong_answer"), (0.0, 0.0, "timeout")]
    late = [("x", i, o) for i, o in enumerate(["timeout", "passed", "timeout", "timeout", "passed", "passed"])]
    seen = rewards.stopped_early(spark.createDataFrame(late, "id string, pos int, outcome string"), "id", "pos", "outcome")
    assert [r["outcome"] for r in seen.orderBy("pos").collect()] == ["timeout", "passed", "timeout", "timeout", "timeout", "timeout"]


def test_selection(spark):
    rows = spark.createDataFrame([(1, 0.5, 1.0, 0.5), (2, 0.5, 1.0, 0.5), (3, 0.4, 1.0, 0.9)], "step long, pass_frac double, passed double, score double")
    assert select.best_step(rows).first()["step"] == 2
    assert select.best_complete_step(rows, 1).first()["step"] == 3
    assert select.best_complete_step(rows, 5).count() == 0
    assert select.best_complete_step(rows, 5, latest_if_none=True).first()["step"] == 3


def test_contracts(spark):
    say = lambda *x: [{"role": r, "content": c} for r, c in x]
    rows = spark.createDataFrame(
        [
            ("1", "p", "a", say(("user", "p"), ("assistant", "a")), ""),
            ("2", None, "a", [], ""),
            ("3", "p", "a", say(("user", "q"), ("assistant", "a")), ""),
            ("4", "p assert 1", "a", say(("user", "p assert 1"), ("assistant", "a")), "assert 1"),
        ],
        f"id string, prompt string, answer string, messages {schemas.MESSAGES}, test_code string",
    )
    bad = {r["id"]: r["reason"] for r in contracts.row_violations(rows, ["id", "prompt", "answer"]).collect()}
    assert bad == {"2": "missing prompt", "3": "messages are not the prompt and the answer", "4": "prompt holds the tests"}
    records = spark.createDataFrame([("t", 0, "x", True)], "task string, ord int, id string, passed boolean")
    truth = spark.createDataFrame([("t", 0, "x")], "task string, ord int, id string")
    for n, ok in ((1, True), (2, False)):
        metrics = spark.createDataFrame([("t", n, 1, 1.0)], "task string, n long, correct long, accuracy double")
        assert (contracts.evaluation_differences(records, truth, metrics).count() == 0) is ok
    with pytest.raises(ValueError):
        contracts.resume_or_raise({"seed": 1}, {"seed": 2}, ("seed",))
    with pytest.raises(ValueError):
        contracts.outside_or_raise("/root/repo/x", "/root/repo")


def test_prompts(spark):
    row = spark.createDataFrame(
        [("1", "taco", "Add.", None, "", '{"fn_name": "f"}', "return 1 "), ("2", "leetcode2k", "", "Name", "class Solution:", "[]", "x")],
        "id string, dataset string, question string, name string, starter_code string, input_output string, canonical_solution string",
    )
    got = [r["x"] for r in row.orderBy("id").select(prompts.sft_prompt().alias("x")).collect()]
    assert got[0] == "Write a Python function named `f` that solves the programming problem.\nReturn only valid Python code, with no explanation.\n\nProblem:\nAdd.\n\nPython code:"
    assert got[1].endswith("Problem:\nName\n\nStarter code and helper definitions:\nclass Solution:\n\nPython code:")
    q = spark.createDataFrame([("Why?", ["x", "y"], "h")], "question string, choices array<string>, hint string")
    assert q.select(prompts.scienceqa_prompt().alias("x")).first()["x"] == "Answer the science question.\nHint: h\n\nWhy?\nA. x\nB. y\n\nAnswer:"
    g = spark.createDataFrame([("q", "so\n#### 1,234", 3)], "question string, answer string, ord int")
    assert prompts.gsm8k(g, "ord").select("id", "answer").first() == ("gsm8k_00003", "1234")


def test_stream_counts_each_record_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"id": i, "dataset": "d", "status": s}) for i, s in (("1", "passed"), ("2", "timeout"), ("1", "passed"))]
    (tmp_path / "in/a.jsonl").write_text("\n".join(lines))
    counts = status.status_counts(status.records(spark, str(tmp_path / "in")))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {("d", "passed", 1), ("d", "timeout", 1)}


def test_stream_forgets_ids_of_old_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for day in range(8):  # each file repeats half of the one before it
        rows = [{"id": str(i), "dataset": "d", "status": "passed"} for i in range(day * 50, day * 50 + 100)]
        path = folder / f"{day}.jsonl"
        path.write_text("\n".join(map(json.dumps, rows)))
        os.utime(path, (1_700_000_000 + day * 86_400,) * 2)
    counts = status.status_counts(status.records(spark, str(folder), files_per_batch=1), late="36 hours")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("forgetting").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("forgetting").collect()] == [("d", "passed", 450)]
    kept = [next(o["numRowsTotal"] for o in p["stateOperators"] if "dedupe" in o["operatorName"].lower()) for p in query.recentProgress]
    assert max(kept) <= 250 and kept[-1] <= kept[3]  # flat, while 450 ids have passed


def test_medians_of_hot_groups(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.choice([rng.gauss(0, 1), rng.randint(0, 5), 7.0]))) for _ in range(4001)]
    rows += [("even", float(i * i)) for i in range(300)] + [(None, 1.5), (None, 2.5), ("one", 4.0), ("same", 2.0)] + [("same", 2.0)] * 500 + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    want = {g: statistics.median(v for h, v in rows if h == g) for g in ("hot", "even", None, "one", "same")}
    for most in (1 << 16, 50, 3):
        assert {r["g"]: r["median"] for r in histograms.medians(df, "v", "g", most=most).collect()} == want
    assert histograms.medians(df, "v", most=20).first()["median"] == statistics.median(v for _, v in rows if v is not None)
    assert {r["g"]: (r["n"], r["median"]) for r in histograms.summary(df, "v", "g").collect()}["none"] == (0, None)
    assert histograms.medians(df.filter("false"), "v", "g").collect() == []


def test_digests_of_files_in_pieces(spark, tmp_path, monkeypatch):
    content = {"a": b"", "b": b"x\ny", "c": b"line\n" * 500_000, "d e": b"\n"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): tuple(r)[1:] for r in readers.file_digests(spark, str(tmp_path / "*")).collect()}
    lines = {"a": 0, "b": 2, "c": 500_000, "d e": 1}
    assert got == {k: (lines[k], len(v), hashlib.sha256(v).hexdigest()) for k, v in content.items()}


def test_artifacts_are_as_recorded(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one\ntwo\n")
    (tmp_path / "b").write_bytes(b"three\n")
    read = lambda: readers.file_digests(spark, str(tmp_path / "*"))
    recorded = spark.createDataFrame(read().collect())
    contracts.artifacts_or_raise(recorded, read())
    (tmp_path / "a").write_bytes(b"one\ntwO\n")
    with pytest.raises(ValueError, match=r"a \(sha256\)"):
        contracts.artifacts_or_raise(recorded, read())
    (tmp_path / "b").unlink()
    assert {r["reason"] for r in contracts.artifact_differences(recorded, read()).collect()} == {"sha256", "missing"}


def test_guards_stop_as_rows_pass(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (3, "d")], "id int, name string")
    with pytest.raises(Exception, match='name: {"id":2}'):
        contracts.guarded(df, name=F.col("name").isNotNull()).collect()
    with pytest.raises(Exception, match="repeated id"):
        contracts.guarded_unique(df, "id").collect()
    with pytest.raises(Exception, match="missing name"):
        contracts.guarded_unique(df, "name").collect()
    kept = contracts.guarded_unique(contracts.guarded(df.filter("id = 1"), name=F.col("name").isNotNull()), "id")
    assert kept.collect() == [(1, "a")]
    assert contracts.guarded(df, positive=F.col("id") > 0).count() == 4


def test_a_killed_batch_is_appended_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"id": i * 10 + k}) + "\n" for k in range(10)))
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out, state, seen = str(tmp_path / "out"), str(tmp_path / "state"), []

    def kill(number):
        seen.append(number)
        if number == 1 and seen.count(1) < 3:
            raise InterruptedError("killed")

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            appends.append(stream(), out, state, kill).awaitTermination()
        assert appends.read(spark, out, "id long").count() == 10
    appends.append(stream(), out, state, kill).awaitTermination()
    assert sorted(r["id"] for r in appends.read(spark, out, "id long").collect()) == list(range(30))
    assert seen == [0, 1, 1, 1, 2]
    appends.committed(out)(spark.createDataFrame([(99,)], "id long"), 2)  # a batch that is done stays as it is
    assert appends.read(spark, out, "id long").count() == 30


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"id": i}) + "\n" for i in range(3000)) + "\n[1]\n")
    (tmp_path / "b.jsonl").write_text('{"id": 7}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = readers.numbered_lines(spark, str(tmp_path / "*.jsonl"))
        assert lines.rdd.getNumPartitions() > 0 and spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 5
        got = {(r["file"], r["line"]): r["value"] for r in lines.collect()}
        assert len(got) == 3003 and all(got["a.jsonl", i + 1] == json.dumps({"id": i}) for i in range(3000))
        assert got["b.jsonl", 1] == '{"id": 7}'
        with pytest.raises(ValueError, match="a.jsonl:3002"):
            readers.strict_jsonl(spark, str(tmp_path / "a.jsonl"), "id long")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(FileNotFoundError):
        readers.ordered(spark, str(tmp_path / "none*"), "id long")
    assert [r["id"] for r in readers.numbered(readers.ordered(spark, str(tmp_path / "b*"), "id long")).collect()] == [7]


def test_set_digests_stream_over_batches(spark):
    rows = [(g, i) for g in ("a", "b", None) for i in range(0, 3000, len(str(g)))] + [("a", None), ("c", 1)]
    df = spark.createDataFrame(rows, "g string, id long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r["g"]: r["digest"] for r in hashing.set_digests(df, "id", "g").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {g: hashlib.sha256("".join(f"{x}\n" for x in sorted(str(i) for h, i in rows if h == g and i is not None)).encode()).hexdigest() for g in ("a", "b", None, "c")}
    assert got == want
    one, two = (df.repartition(n).agg(hashing.set_fingerprint("id").alias("f")).first()["f"] for n in (1, 4))
    assert one == two


def test_a_larger_stream_has_more_files_and_no_more_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io_queries, "FILE_BYTES", 50_000, raising=False)
    monkeypatch.setattr(io_queries, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    got = io_queries.ledgered_append(spark, "/root/testdata/sf0.001").collect()
    sizes = [x.stat().st_size for x in (tmp_path / "ledgered/in").glob("part-*")]
    assert len(sizes) > 4 and max(sizes) < sum(sizes) / 4
    assert sorted(x.name for x in (tmp_path / "ledgered/out").glob("batch=*")) == [f"batch={i}" for i in range(4)]
    docs = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs) and {(r["doc_id"], r["killed_after"]) for r in got} == {(i, 0) for i in docs}
