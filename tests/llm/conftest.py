import random

import pytest

LANGS = {
    "en": "the of and to in that was for on with his they have this from by not are but had".split(),
    "fr": "le la les de des et un une que qui dans pour sur avec est pas plus nous vous élève".split(),
    "de": "der die das und ist nicht ein eine für mit auf dem den von zu über wird sich auch schön".split(),
}


def sentence(rng, lang, n=9):
    words = LANGS[lang]
    return " ".join(rng.choice(words) + rng.choice(["", "", rng.choice(words)]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared lines, nulls, empties, a long text and ties."""
    rng = random.Random(7)
    rows, shared = [], [sentence(rng, "en", 14) for _ in range(6)]
    for i in range(260):
        lang = ("en", "fr", "de")[i % 3]
        lines = [sentence(rng, lang) for _ in range(rng.randint(1, 9))]
        if i % 7 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = shared[:4]
        text = "\n".join(lines)
        if i % 11 == 0 and rows:
            text = rows[i // 2][1]
        if i % 13 == 0 and rows:
            text = rows[i // 3][1] + " again"
        if i % 17 == 0:
            text += '\napi_key = "' + "".join(rng.choice("0123456789abcdef") for _ in range(32)) + '"'
        rows.append((i, text, lang, f"src{i % 5}"))
    rows += [
        (260, None, "en", "src0"),
        (261, "", None, None),
        (262, "  \n\t ", "de", "src1"),
        (263, "1234 5678 !!", "fr", "src1"),
        (264, " ".join(sentence(rng, "en") for _ in range(4000)), "en", "src2"),
        (None, "a row without an id", "en", "src2"),
        (265, rows[4][1].upper(), "fr", "src3"),
        (5, rows[5][1], rows[5][2], "src0"),
        (5, rows[5][1], rows[5][2], "src0"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


LABELS = [(i % 270, (1, 0, None)[i % 3], (0, 1)[i % 2]) for i in range(0, 500, 3)] + [(None, 1, None), (6, 1, 0), (6, 1, 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def sf_dir(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


#: Names that operators use inside; documents may have columns of these names too.
CLASHES = ("row", "key", "blob", "spans", "fp", "score", "lang_pred", "kept", "ids", "shard", "names", "gone", "total", "sha256", "c0", "n", "id", "form", "output", "base", "shifts", "parts", "event", "p0", "u0")


@pytest.fixture(scope="session")
def clashing_dir(spark, docs, tmp_path_factory):
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("clash"))
    docs.select("*", *[F.lit("x").alias(c) for c in CLASHES]).write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    labels.select("*", *[F.lit("x").alias(c) for c in CLASHES]).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path
