"""License scans by a trained paragraph classifier (operator 9).

A paragraph is a line with a word; its features are the word 1- and 2-grams that occur in
licence templates and are not common in ordinary text. A multinomial logistic regression
with an L1 penalty tells licence families and ``unknown`` apart. It is trained on windows of
the template sentences and on a bounded sample of the corpus' own distinct paragraphs (of
documents with the smallest hashes; none that holds a whole template sentence) as ``unknown``; its temperature is
calibrated on a part kept from training. A prediction counts as confirmed when the paragraph
also holds enough of the 2-word shingles of one of the family's template sentences.

Only DataFrame functions and Spark's own regression are used. A paragraph without any feature
word gets the same scores as the empty one, which is ``unknown``; so only paragraphs with a
feature word are taken apart, and each distinct one once. The weights and template shingles
that are broadcast are bounded by the templates, not by the data.

Edge cases: null and empty texts have no paragraphs, repeated rows and null ids are reported
row by row, an empty corpus trains against the templates alone and gives an empty result,
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

UNKNOWN = "unknown"

# Sentences of public licences by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer.",
    ],
    "creative-commons": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ],
    "reserved": [
        "All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), "[^a-z0-9]+"), "")


def bigrams_of(words: Column) -> Column:
    pairs = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def grams_of(words: Column) -> Column:
    return F.array_distinct(F.concat(words, bigrams_of(words)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, line, w): every line with a word."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("paragraph", "line"))
    return lines.withColumn("w", words_of(F.col("line"))).where(F.size("w") > 0)


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    rows = [(family, i, s) for family, sentences in sorted(templates.items()) for i, s in enumerate(sentences)]
    return spark.createDataFrame(rows, "family string, sentence int, line string").withColumn("w", words_of(F.col("line")))


def training_rows(docs: DataFrame, templates: DataFrame, unknown: int) -> DataFrame:
    """(family, w, held): windows of at least 60 % of a template sentence, and sampled paragraphs."""
    size = F.size("w")
    least = F.ceil(0.6 * size).cast("int")
    windows = templates.select("family", "w", F.explode(F.sequence(least, size)).alias("n"))
    windows = windows.select("family", "w", "n", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)).alias("at"))
    windows = windows.select("family", F.slice("w", F.col("at"), F.col("n")).alias("w")).distinct()
    # Documents with the smallest hashes of their texts, so many that they are some ``unknown``;
    # of their distinct paragraphs as many. Only these are compared with the templates.
    below = ((1 << 63) - 1) * unknown // max(unknown, docs.count(), 1)
    drawn = docs.where(F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1)) <= below)
    lines = paragraphs(drawn).select("w").where(F.size("w") >= 3).distinct()
    lines = materialize(lines.orderBy(F.xxhash64("w"), "w").limit(unknown), "licence-sample")
    whole = templates.agg(F.collect_set(F.array_join("w", " ")).alias("s"))
    sentences = whole.first()["s"]  # bounded by the templates
    text = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    holds = F.exists(F.lit(sentences), lambda s: text.contains(F.concat(F.lit(" "), s, F.lit(" "))))
    sample = lines.where(~holds).select(F.lit(UNKNOWN).alias("family"), "w")
    held = (F.pmod(F.xxhash64("w", F.lit("held")), F.lit(5)) == 0).alias("held")
    return windows.union(sample).select("family", "w", held)


def train(docs: DataFrame, templates: DataFrame, unknown: int = 2000, common: float = 0.01) -> tuple[DataFrame, list[str]]:
    """Weights (gram, family, weight; the intercept is the gram "") and the feature words."""
    spark = docs.sparkSession
    rows = materialize(training_rows(docs, templates, unknown), "licence-training")
    ordinary = rows.where(F.col("family") == UNKNOWN)
    total = ordinary.count()
    seen = ordinary.select(F.explode(grams_of(F.col("w"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = templates.select(F.explode(grams_of(F.col("w"))).alias("gram")).distinct()
    rare = own.join(seen, "gram", "left").where(F.coalesce("n", F.lit(0)) <= common * total).select("gram")
    grams = sorted(r["gram"] for r in rare.collect())  # bounded by the templates
    feature_words = {g for g in grams if " " not in g}
    grams = [g for g in grams if " " not in g or set(g.split()) & feature_words]
    families = sorted({r["family"] for r in templates.select("family").distinct().collect()} | {UNKNOWN})
    number = F.coalesce(*[F.when(F.col("family") == f, F.lit(float(i))) for i, f in enumerate(families)])
    vectors = CountVectorizerModel.from_vocabulary(sorted(grams), inputCol="g", outputCol="x", minTF=1.0)
    data = vectors.transform(rows.select("held", grams_of(F.col("w")).alias("g"), number.alias("y"), (1 + F.lit(0.0)).alias("c")))
    learn = data.where(~F.col("held")).coalesce(2)  # a few thousand rows
    model = LogisticRegression(
        featuresCol="x", labelCol="y", family="multinomial", regParam=5e-4, elasticNetParam=1.0, maxIter=60, standardization=False
    ).fit(learn)
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    present = range(matrix.shape[0])  # classes up to the largest label seen
    weights = [(g, families[k], float(matrix[k, j])) for k in present for j, g in enumerate(vectors.vocabulary)]
    weights = [w for w in weights if w[2]] + [("", families[k], float(intercepts[k])) for k in present]
    table = spark.createDataFrame(weights, "gram string, family string, weight double")
    table = _calibrated(table, rows.where("held"), families[: matrix.shape[0]])
    return table, sorted({w for g, _, _ in weights for w in g.split()} & feature_words)


def _calibrated(weights: DataFrame, held: DataFrame, families: list[str]) -> DataFrame:
    """Weights divided by the temperature under which the held rows are likeliest."""
    truth = held.select(F.col("family").alias("true"), "w").distinct()
    scores = family_scores(truth.select("w").distinct(), weights, families)
    joined = scores.join(truth, "w")
    grid = [0.25, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0]
    loss = lambda t: -F.avg(F.log(F.greatest(_softmax(families, t).getItem(F.col("true")), F.lit(1e-12))))
    found = joined.agg(*[loss(t).alias(str(i)) for i, t in enumerate(grid)]).first()
    losses = [v if v is not None and not math.isnan(v) else math.inf for v in found]
    best = grid[min(range(len(grid)), key=lambda i: (losses[i], abs(math.log(grid[i]))))]
    return weights.withColumn("weight", F.col("weight") / best)


def _softmax(families: list[str], temperature: float = 1.0) -> Column:
    """map(family -> probability) from the score columns.

    Written over an array, so that the expression stays short: spelled out for each family it
    repeats all scores for every one of them, which costs the driver memory to plan and compile.
    """
    scores = F.array(*[F.col(f"`s_{f}`") / temperature for f in families])
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, p: a + p)
    named = F.array(*[F.lit(f) for f in families])
    return F.map_from_arrays(named, F.transform(powers, lambda p: p / total))


def family_scores(lines: DataFrame, weights: DataFrame, families: list[str]) -> DataFrame:
    """``lines`` (distinct word lists w) with a score column s_<family> for each family."""
    grams = lines.select("w", F.explode(F.concat(F.array(F.lit("")), grams_of(F.col("w")))).alias("gram"))
    sums = [
        F.sum(F.when(F.col("family") == f, F.col("weight")).otherwise(0.0)).alias(f"s_{f}") for f in families
    ]
    return grams.join(F.broadcast(weights), "gram").groupBy("w").agg(*sums)


def scan(
    docs: DataFrame, templates: dict[str, list[str]] | None = None, unknown: int = 2000, probability: float = 0.5, confirm: float = 0.6
) -> DataFrame:
    """doc_id, paragraph, family, probability, containment and confirmed of every paragraph that a family claims."""
    table = template_table(docs.sparkSession, templates or TEMPLATES)
    weights, feature_words = train(docs, table, unknown)
    weights = materialize(weights, "licence-weights")
    families = sorted(r["family"] for r in weights.select("family").distinct().collect())
    with_word = paragraphs(docs).where(F.arrays_overlap("w", F.lit(feature_words)) if feature_words else F.lit(False))
    with_word = materialize(with_word.select("doc_id", "paragraph", F.array_join("w", " ").alias("text")), "licence-paragraphs")
    lines = with_word.select("text").distinct().select(F.split("text", " ").alias("w"))

    shares = _softmax(families)
    best = F.array_max(F.transform(F.map_entries(shares), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("f"))))
    judged = family_scores(lines, weights, families).select("w", best.alias("b"))
    judged = judged.select("w", F.col("b.f").alias("family"), F.col("b.p").alias("probability"))
    judged = materialize(judged.where((F.col("family") != UNKNOWN) & (F.col("probability") >= probability)), "licence-families")

    shingles = table.select("family", "sentence", F.size(bigrams_of(F.col("w"))).alias("needed"), F.explode(F.array_distinct(bigrams_of(F.col("w")))).alias("gram"))
    shingles = shingles.join(shingles.groupBy("family", "sentence").agg(F.count(F.lit(1)).alias("distinct")), ["family", "sentence"])
    matched = (
        judged.select("w", "family", F.explode(F.array_distinct(bigrams_of(F.col("w")))).alias("gram"))
        .join(F.broadcast(shingles), ["family", "gram"])  # as many rows as the templates have words
        .groupBy("w", "sentence").agg((F.count(F.lit(1)) / F.first("distinct")).alias("share"))
        .groupBy("w").agg(F.max("share").alias("containment"))
    )
    verdicts = judged.join(matched, "w", "left").select(
        F.array_join("w", " ").alias("text"), "family", "probability", F.coalesce("containment", F.lit(0.0)).alias("containment")
    )
    return with_word.join(verdicts, "text").select(
        "doc_id", "paragraph", "family", "probability", "containment", (F.col("containment") >= confirm).alias("confirmed")
    )
