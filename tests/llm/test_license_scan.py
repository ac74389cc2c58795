import random
import re

from millrace.llm import op10_license_scan as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]


def brute(text):
    words, hits = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)})), []
    for label, phrase in PHRASES:
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_places(spark, tmp_path):
    rng = random.Random(3)
    parts = ["CC", "by", "BY", "all", "rights", "reserved", "general", "public", "license", "é", "漢", "x", "under", "the", "mit"]
    rows = [rng.choice([" ", "-", ", "]).join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None, ""]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op.op10_license_scan(spark, str(tmp_path)).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(rows[r["doc_id"]])
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_notices_hold_with_words_added_or_left_out(spark):
    rows = [
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "licensed under terms of the apache license version 2.0",
        "Permission is hereby granted, free of charge, to every person obtaining a copy of this software",
        "the apache tribe has a license",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in op.summarise(*op.scan(docs)).collect()}
    assert got == {0: "apache", 1: "apache", 2: "mit", 3: ""}
