"""License scanning by diagonal voting over rolling word k-grams.

Every text becomes lower-case words, and the hashes of all its rolling k-grams are joined to the positions
of the same k-grams in the templates; a match at word i of the text and word j of a template votes for
the diagonal i - j. Votes are summed by text, template and diagonal, diagonals that lie next to each
other (a word was added or left out) are merged, and a span holds if enough of the template's k-grams
are among its verified votes. Verification compares the words of each k-gram, not only its hash. A merged
span that is more than twice as long as its template counts its best diagonal alone.

Templates are few and fixed, so their k-gram table has a size that no data can raise; it goes to every
executor, and no k-gram of a text moves. The votes move, by text.

A phrase is a template whose k-grams must all be present on one diagonal, without neighbours: each
place where it stands counts. A notice or a licence's whole body holds from a share of its k-grams.

Null and empty texts have no words, no labels and score 0. Texts of any length are read whole. Repeated
rows and null ids keep their rows. An empty table gives an empty result. Only the id and text columns are
read, so others may have any names. A text full of license words gives at most one vote a word and
template position.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, read

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """least: share of the k-grams that must be found; slack: diagonals that may lie apart."""

    label: str
    words: str
    k: int = 2
    least: float = 1.0
    slack: int = 0
    base: bool = False


TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("mit", "released under the mit license", 2, 0.75, 2),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 3, 0.6, 3),
    Template("apache", "licensed under the apache license version 2 0", 3, 0.6, 2),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 3, 0.6, 3),
    Template("gpl", "licensed under the gnu general public license version", 3, 0.6, 3),
    Template("mpl", "subject to the terms of the mozilla public license", 3, 0.6, 2),
    Template("cc-by", "licensed under a creative commons attribution license", 3, 0.6, 2),
    Template("cc0", "dedicated to the public domain under cc0", 3, 0.6, 2),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software",
        3, 0.6, 3,
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with "
        "the distribution",
        3, 0.6, 3,
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        3, 0.6, 3,
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language "
        "governing permissions and limitations under the license",
        3, 0.6, 3,
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for "
        "more details",
        3, 0.6, 3,
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at https mozilla org mpl 2 0",
        3, 0.6, 3,
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
        "commercial or non commercial and by any means",
        3, 0.6, 3,
    ),
)


def _grams_of(templates: tuple[Template, ...]) -> list[tuple[int, int, str, int]]:
    """(template, position, gram, hash) of every template k-gram; the hash is Spark's xxhash64."""
    out = []
    for t, x in enumerate(templates):
        words = x.words.split()
        for j in range(len(words) - x.k + 1):
            h = xxhash.xxh64_intdigest(g := " ".join(words[j : j + x.k]), 42)
            out.append((t, j, g, h - (1 << 64) if h >> 63 else h))
    return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has row, doc_id, n_words; spans has row, template, label, base, first, last, votes, share."""
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [
            (h, g, t, j, x.label, x.base, len(x.words.split()) - x.k + 1, len(x.words.split()), x.k, x.least, x.slack)
            for t, j, g, h in _grams_of(templates)
            for x in [templates[t]]
        ],
        "h long, gram string, template int, j long, label string, base boolean, grams int, words int, k int, least double, slack int",
    )
    ks = sorted({x.k for x in templates})
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = own.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)).alias("w")
    )
    ahead = [F.slice("w", n + 1, F.greatest(F.size("w"), F.lit(1))).alias(f"w{n}") for n in range(max(ks))]
    # a row at every word and one more, at -1, which carries what is known of the text
    start = F.array(F.struct(*[F.lit(None).cast("string").alias(f"w{n}") for n in range(max(ks))]))
    at = words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(start, F.arrays_zip(*ahead))).alias("pos", "x"))
    of_text = F.col("pos") == 0
    one = lambda k: F.struct(F.concat_ws(" ", *[F.col(f"x.w{n}") for n in range(k)]).alias("gram"))
    grams = at.select(
        "row", F.when(of_text, F.col("doc_id")).alias("doc_id"), F.when(of_text, F.col("n_words")).alias("n_words"), (F.col("pos") - 1).cast("long").alias("i"),
        F.explode(F.when(of_text, F.array(one(1))).otherwise(F.array(*[one(k) for k in ks]))).alias("g"),
    )
    hashed = grams.select("row", "doc_id", "n_words", "i", F.xxhash64("g.gram").alias("h"), F.col("g.gram").alias("gram"))
    # the templates' table is fixed, so it may be sent to every executor; gram equality verifies the words
    joined = cut(hashed.join(F.broadcast(table), ["h", "gram"], "left").filter((F.col("i") < 0) | F.col("template").isNotNull()).drop("h", "gram"))
    texts = joined.filter("i < 0").select("row", "doc_id", "n_words")
    votes = joined.filter("i >= 0").drop("doc_id", "n_words")
    by = ["row", "template", "label", "base", "grams", "words", "k", "least", "slack"]
    diagonals = votes.groupBy(*by, (F.col("i") - F.col("j")).alias("diagonal")).agg(
        F.collect_set("j").alias("at"), F.min("i").alias("first"), F.max("i").alias("last")
    )  # at most one entry a template position
    apart = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(apart) <= F.col("slack")
    group = F.sum(F.when(near, 0).otherwise(1)).over(apart)
    spans = (
        diagonals.withColumn("span", group)
        .groupBy(*by, "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("merged"),
            F.max(F.struct(F.size("at").alias("votes"), (-F.col("first")).alias("before"), (F.col("last") + F.col("k") - 1).alias("last"))).alias("best"),
            F.min("first").alias("first"),
            F.max(F.col("last") + F.col("k") - 1).alias("last"),
        )
        .withColumn("long", F.col("last") - F.col("first") >= 2 * F.col("words"))
        .withColumns({
            "votes": F.when(F.col("long"), F.col("best.votes")).otherwise(F.col("merged")),
            "first": F.when(F.col("long"), -F.col("best.before")).otherwise(F.col("first")),
            "last": F.when(F.col("long"), F.col("best.last")).otherwise(F.col("last")),
        })
        .withColumn("share", F.col("votes") / F.col("grams"))
        .filter(F.col("share") >= F.col("least"))
        .select("row", "template", "label", "base", "first", "last", "votes", "share")
    )
    return texts, spans


def summarise(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per text: counts, places and labels; score is the largest verified share of a template."""
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    of = cut(
        spans.groupBy("row").agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined("label").alias("labels"),
            F.max("share").alias("score"),
        )
    )
    return texts.join(of, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(*scan(read(spark, sf_dir, "documents")))
