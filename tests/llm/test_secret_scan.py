import hashlib
import random
import re
import time

from millrace.llm import op9_secret_scan as op

ASSIGN = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")) + "_?[kK][eE][yY]"
RULES = [
    ("assign", re.compile(rf"""({ASSIGN})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text):
    spans, n = [], [0, 0, 0]
    for k, (_, rule, group, least) in enumerate(RULES):
        for m in rule.finditer(text or ""):
            if len(m.group(group)) >= least:
                spans.append((m.start(), k, m.end()))
                n[k] += 1
    listed = ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*n, hashlib.sha256(listed.encode()).hexdigest())


def texts():
    rng = random.Random(3)
    parts = ["password", "Token", '"', "'", " ", ":", "=", "==", "abc", "abcdef12", "AKIA", "AKIA" + "A1" * 8, "0a" * 12, "é", "漢😀", "\n", "api_key", "APIKEY", "secret"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [None, "", "x" * 50000 + "password=hunter22"]


def table(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)


def test_base_spans(spark, tmp_path):
    rows = texts()
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op.op9_secret_scan(spark, str(tmp_path)).collect():
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute(rows[r["doc_id"]])


def test_a_blob_is_scanned_once_for_each_rule_version(spark):
    docs = table(spark, ["token = abcdef", "token = abcdef", "clean"])
    first, ledger = op.scan_paths(docs)
    assert ledger.count() == 2
    assert [len(r["spans"]) for r in first.orderBy("doc_id").collect()] == [1, 1, 0]
    more = docs.union(table(spark, ["new", "secret: 123456"]))
    second, unseen = op.scan_paths(more, ledger=ledger)
    assert unseen.count() == 2
    assert sorted(len(r["spans"]) for r in second.collect()) == [0, 0, 1, 1, 1]
    assert op.scan_paths(more, ledger=ledger, version="2")[1].count() == 4


def test_a_changed_rule_scans_known_blobs_alone(spark):
    docs = table(spark, ["token = abcdef and ghp_" + "A1" * 18, "clean"])
    first, ledger = op.scan_paths(docs)
    again, new = op.scan_paths(docs.union(table(spark, ["token = abcdef and ghp_" + "A1" * 18, "AKIA" + "A1" * 8])), ledger=ledger, version={"hook": "2"})
    scanned = {tuple(r["rule_versions"]): len(r["spans"]) for r in new.collect()}
    assert scanned[("hook:2",)] in (0, 1) and scanned[tuple(op.rule_versions({"hook": "2"}))] == 1
    assert new.count() == 3
    spans = sorted([(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in again.collect())
    old = sorted([(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in first.collect())
    assert spans == sorted([*old, old[-1], [(1, 0, 20)]])


def test_plan_has_no_python(spark, sf_dir):
    plan = op.op9_secret_scan(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_stage_masks_secrets_and_keeps_documents(spark):
    docs = table(spark, ["a token = abcdef12 b", "clean", None]).selectExpr("*", "cast(length(text) as long) as n_chars")
    got = {r["doc_id"]: r for r in op.stage(spark, docs, "").collect()}
    assert got[0]["text"] == f"a {op.MASK} b" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == "clean" and got[2]["text"] is None


def test_whole_private_keys_are_masked(spark):
    rng = random.Random(4)
    line = lambda n=64: "".join(rng.choice("ABCXYZabcxyz0189+/") for _ in range(n))
    body = "\n".join([line(), line(), line(), line(30) + "=="])
    block = lambda name, inside=body: f"-----BEGIN {name}-----\n{inside}\n-----END {name}-----"
    rows = [f"see\n{block(n)}\nafter it" for n in ("PRIVATE KEY", "RSA PRIVATE KEY", "PGP PRIVATE KEY BLOCK", "X25519 PRIVATE KEY", "ENCRYPTED PRIVATE KEY")]
    rows.append(f"see\n{block('RSA PRIVATE KEY', 'Proc-Type: 4,ENCRYPTED' + chr(10) + 'DEK-Info: AES-128-CBC,00FF' + chr(10) * 2 + body)}\nafter it")
    rows.append(f"see\n{block('PRIVATE KEY').replace(chr(10), chr(92) + 'n')}\nafter it")
    rows.append(f"see\n-----BEGIN RSA PRIVATE KEY-----\n{body}\nafter it")
    rows.append(f"see\n{block('PRIVATE KEY')}\nand\n{block('EC PRIVATE KEY', line(100_000))}\nafter it")
    rows.append(f"see\n{block('PUBLIC KEY')}\nafter it")
    got = {r["doc_id"]: r["text"] for r in op.stage(spark, table(spark, rows), "").collect()}
    for i in range(8):
        assert got[i] == f"see\n{op.MASK}\nafter it"
    assert got[8] == f"see\n{op.MASK}\nand\n{op.MASK}\nafter it"
    assert "BEGIN PUBLIC KEY" in got[9]


def test_very_many_matches_of_one_text(spark, tmp_path):
    rows = ["token=abcdef1 " * 60_000 + "password=hunter22", "secret: 123456 " * 64, "secret: 123456 " * 65, "secret: 123456 " * 129]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    for r in op.op9_secret_scan(spark, str(tmp_path)).collect():
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute(rows[r["doc_id"]])
    assert time.time() - began < 60  # a fold that copies all spans for each takes minutes


def test_running_sums(spark):
    rng = random.Random(8)
    for n in (0, 1, 2, 63, 64, 65, 127, 128, 4095, 4096, 4097, 9000):
        values = [rng.randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(values,)], "x array<int>").selectExpr(f"{op.running('x')} AS s").first()["s"]
        assert got[:n] == [sum(values[:i]) for i in range(n)]
