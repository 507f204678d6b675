"""Licence scan by diagonal voting.

Every rolling word 2-gram of every text is joined by its hash to the positions of
the same 2-gram in the licence templates (a broadcast table whose size is fixed by
`TEMPLATES`), and the join's condition compares the words themselves. Each hit
votes for the diagonal `word position - template position`, the place where the
template would start. Votes of a diagonal are bit masks of template positions, 64 in
each, so templates may have any length and one aggregate with map-side combining
gathers the votes. A diagonal with all its votes
is the template's words standing consecutively: a verified span. Neighbouring
diagonals (a word inserted or lost) are merged, and a merged span gives its template's
label if its votes cover enough of the template and one of them is for a 2-gram that
no template of another label has.

Only DataFrame functions run. Words are runs of ASCII digits, ASCII letters (A-Z
lower-cased) and non-ASCII characters.

Defined results: a null or empty text has no words and no labels; rows equal in id
and text get equal results, one row each (votes are sets, so they do not add up);
other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bytegrain.llm._shared import stored

# Phrase or sentence of a licence, label, whether it is a base phrase.
TEMPLATES = [
    ("cc by", "cc-by", True),
    ("general public license", "gpl", True),
    ("all rights reserved", "reserved", True),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", False),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", False),
    ("licensed under the apache license version 2 0", "apache-2.0", False),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", False),
    ("gnu lesser general public license version 3", "lgpl-3.0", False),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", False),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", False),
    ("mozilla public license version 2 0", "mpl-2.0", False),
    ("released into the public domain", "public-domain", False),
]
# The whole texts of short licences.
FULL_TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
]
TEMPLATES += [(" ".join(re.findall("[a-z0-9]+", text.lower())), label, False) for label, text in FULL_TEXTS]
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Lower-cased words. The Kelvin sign, the one non-ASCII character that lower() turns into an ASCII letter by itself, is first made another letter."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("κ"))), NOT_WORD), "")


def template_grams(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """gram, first, second, template, at, own: the 2-grams of all templates; own ones are in no template of another label."""
    labels: dict[tuple[str, str], set[str]] = {}
    grams = []
    for t, (phrase, label, _) in enumerate(templates):
        w = phrase.split()
        for i, pair in enumerate(zip(w, w[1:], strict=False)):
            grams.append((*pair, t, i, label))
            labels.setdefault(pair, set()).add(label)
    rows = [(a, b, t, i, labels[a, b] == {label}) for a, b, t, i, label in grams]
    told = spark.createDataFrame(rows, "first string, second string, template int, at int, own boolean")
    return told.select(F.xxhash64("first", "second").alias("gram"), "first", "second", "template", "at", "own")


def license_spans(documents: DataFrame, *, id: str = "doc_id", text: str = "text", templates: list[tuple[str, str, bool]] = TEMPLATES, neighbours: int = 2, cover: float = 0.6, least_votes: int = 3) -> DataFrame:
    """id, key (a hash of the text), template, label, base, first (word where it starts), score (votes a template position), exact: one row per verified span."""
    spark = documents.sparkSession
    if any(len(p.split()) < 2 or base and len(p.split()) > 65 for p, _, base in templates):
        raise ValueError("a template has two words or more, a base phrase at most 65")
    words = documents.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("key"), word_list(F.col(text)).alias("words"))
    grams = words.select("id", "key", "words", F.posexplode("words").alias("pos", "word")).withColumn("next", F.get("words", F.col("pos") + 1)).select("id", "key", "pos", "word", "next", F.xxhash64("word", "next").alias("gram"))
    hits = grams.join(F.broadcast(template_grams(spark, templates)), "gram").where((F.col("word") == F.col("first")) & (F.col("next") == F.col("second")))
    # stored: both kinds of templates are judged from it, and the texts are cut into words once
    chunk = F.floor(F.col("at") / 64).cast("int")
    diagonals = stored(hits.groupBy("id", "key", "template", (F.col("pos") - F.col("at")).alias("diagonal"), chunk.alias("chunk")).agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("votes"), F.bool_or("own").alias("own")), "license-diagonals")

    size = F.element_at(F.array(*(F.lit(len(p.split()) - 1) for p, _, _ in templates)), F.col("template") + 1)
    label = F.element_at(F.array(*(F.lit(x) for _, x, _ in templates)), F.col("template") + 1)
    base = F.element_at(F.array(*(F.lit(b) for _, _, b in templates)), F.col("template") + 1)
    told = diagonals.withColumns({"size": size, "base": base})
    exact = told.where("base and bit_count(votes) = size").select("id", "key", "template", F.col("diagonal").alias("first"), F.lit(1.0).alias("score"), F.lit(True).alias("exact"))

    w = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    begins = (F.col("diagonal") - F.lag("diagonal").over(w) > neighbours).cast("int")
    merged = (
        told.where("not base").withColumn("begins", F.coalesce(begins, F.lit(1))).withColumn("span", F.sum("begins").over(w))
        .groupBy("id", "key", "template", "span", "chunk").agg(F.max(F.struct(F.bit_count("votes").alias("votes"), (-F.col("diagonal")).alias("back"))).alias("best"), F.bit_or("votes").alias("votes"), F.bool_or("own").alias("own"), F.first("size").alias("size"))
        .groupBy("id", "key", "template", "span").agg((-F.max("best")["back"]).alias("first"), F.sum(F.bit_count("votes")).alias("n"), F.bool_or("own").alias("own"), F.first("size").alias("size"))
        .withColumn("score", F.col("n") / F.col("size"))
        .where((F.col("score") >= cover) & (F.col("n") >= least_votes) & F.col("own"))
        .select("id", "key", "template", "first", "score", (F.col("score") == 1).alias("exact"))
    )
    return exact.unionByName(merged).select("id", "key", "template", label.alias("label"), base.alias("base"), "first", "score", "exact")


def license_scan(documents: DataFrame, *, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score (of the best span, else 0)."""
    spans = license_spans(documents, id=id, text=text, **how)
    base = F.col("base")
    found = spans.groupBy("id", "key").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set("label")).alias("labels"), F.max("score").alias("score"),
    )
    whole = documents.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("key"), F.size(word_list(F.col(text))).cast("long").alias("n_words")).alias("d")
    found = found.alias("f")
    return whole.join(found, F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.key") == F.col("f.key")), "left").select(
        "d.id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast(T.LongType()).alias("first_word"), F.col("last_word").cast(T.LongType()).alias("last_word"),
        F.array_join(F.coalesce("base_labels", F.array().cast("array<string>")), ",").alias("base_labels"), F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
