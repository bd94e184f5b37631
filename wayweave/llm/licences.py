"""Licence scan: a trained paragraph classifier and template comparison, in DataFrame operations only.

Paragraphs are lines, and also blocks of lines of at most WRAP characters between blank lines,
as notices are often wrapped; of such a block and its lines the lines are reported if any is of a
family. A paragraph's word 1-, 2- and 3-grams (of A-Z lower-cased words; at
least one word of an n-gram is no stop word) feed a multinomial logistic
regression with an elastic-net penalty, so most weights are 0. It is trained here
on paragraphs made from the notices below and, as class `unknown`, on sentences
that use the same words otherwise, on notices of other licences, and on at most SAMPLE_ROWS
paragraphs of the corpus that don't mention a licence, the first ones by a hash of doc_id and text.
Held back from training are a quarter of the rows and every notice of half of the other licences.
On these a temperature is fitted, and the least probability is the lowest one at which
PRECISION of the paragraphs said to be of a family are; `report` has what came of it.

Scoring reads whole texts. Only n-grams with a weight above the unknown
class's can lift a family over it, as the unknown class's bias is kept above every
family's; paragraphs without any word of such n-grams are unknown without scoring.
A prediction is confirmed if the paragraph has all telling words of a name of its
family (those that no frame has), or CONFIRM of a longer notice's word pairs.

Null and empty texts have no paragraphs; very long texts are scored whole, line by line; repeated rows are scored
like all others, and rows of equal doc_id (null is one) and text are reported once. Of families of equal
probability the alphabetically last one is taken. An empty table gives no rows. Extra columns are ignored.
Only paragraphs of a known family are returned.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import small, stash
from .winnow import words_sql

SAMPLE_ROWS = 2000
CONFIRM, PRECISION = 0.5, 0.99
WRAP = 100
UNKNOWN = "unknown"

# Names of licence families as notices write them.
NAMES = {
    "MIT": ["the MIT License", "the MIT licence", "an MIT-style license", "MIT", "the Expat License"],
    "Apache": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0", "the Apache Software License", "the Apache License"],
    "GPL": ["the GNU General Public License, version 3", "the GNU General Public License version 2", "the GPL", "GPLv3", "GPL-2.0-or-later", "the GNU GPL"],
    "LGPL": ["the GNU Lesser General Public License", "the LGPL", "LGPL-2.1", "the GNU Library General Public License"],
    "AGPL": ["the GNU Affero General Public License", "AGPL-3.0", "the AGPL"],
    "BSD": ["the BSD License", "a 3-clause BSD license", "BSD-2-Clause", "the simplified BSD license", "a BSD-style license"],
    "MPL": ["the Mozilla Public License, v. 2.0", "MPL-2.0", "the Mozilla Public License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC BY-NC-ND 3.0"],
    "CC-BY": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike License"],
    "CC0": ["CC0 1.0", "the Creative Commons CC0 1.0 Universal Public Domain Dedication", "the public domain", "the Unlicense"],
}
# Frames around a name.
FRAMES = [
    "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This software is released under {}.",
    "This project is distributed under the terms of {}.", "Available under {}.", "Published under {}; see the LICENSE file for details.",
    "You may use, copy and modify this file under {}.", "License: {}", "The source code is made available under {}.",
    "Dual-licensed, at your option, under {}.", "All content of this page is covered by {}.", "SPDX-License-Identifier: {}",
]
# Titles of licence texts.
TITLES = {
    "MIT": ["MIT License", "The MIT License (MIT)", "Expat License"], "Apache": ["Apache License Version 2.0, January 2004", "Apache License 2.0", "Apache License"],
    "GPL": ["GNU General Public License Version 3, 29 June 2007", "GNU General Public License", "GNU GPL v3"], "LGPL": ["GNU Lesser General Public License Version 3", "GNU Lesser General Public License"],
    "AGPL": ["GNU Affero General Public License Version 3", "GNU Affero General Public License"], "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "The BSD License"],
    "MPL": ["Mozilla Public License Version 2.0", "Mozilla Public License"], "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0"],
    "CC-BY": ["Creative Commons Attribution 4.0 International", "CC BY 4.0"], "CC0": ["CC0 1.0 Universal", "Creative Commons CC0", "The Unlicense"],
}
# Names of other licences, which are unknown here.
OTHER_NAMES = [
    "the Artistic License 2.0", "the Eclipse Public License - v 2.0", "the Boost Software License 1.0", "the Microsoft Public License (Ms-PL)", "the European Union Public Licence 1.2", "the zlib License",
    "the ISC License", "the WTFPL", "the SIL Open Font License 1.1", "the CDDL", "the Python Software Foundation License", "the PHP License 3.01", "the Q Public License", "the Common Public License",
    "the Academic Free License", "the Open Database License", "the Server Side Public License", "the Business Source License 1.1", "the Sleepycat License", "the PostgreSQL License",
    "a commercial license", "a proprietary license", "the vendor's own terms", "the LaTeX Project Public License", "the NASA Open Source Agreement", "the Ruby License", "the Zope Public License", "the OpenSSL License",
]
# Longer notices of families.
NOTICES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache": ["You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
}
# Sentences that are no licence notices.
OTHERS = [
    "He lost his driving license on the way to the general store.", "The license plate was found in the public library.", "A fishing license is required under the new law.",
    "The Apache helicopter landed near the school.", "Students at MIT built the source of the code.", "The Apache people lived in the region.",
    "Terms and conditions of the sale are covered by the contract.", "A public domain name was released under the new version.", "This work is the version of 2020.",
    "The software was released in version 2.0.", "This project is distributed over four countries.", "Please see the file for details.", "You may use this copy of the page.",
    "Released under the bridge, the birds flew away.", "The creative commons room is open.", "The Mozilla team published the new version.", "The committee licensed the film.",
    "Permission was granted to the person obtaining the documents.", "Under the terms of the agreement, all content is yours.", "The content of this page is available.",
]
# Stop words.
STOP = sorted({"the", "a", "an", "of", "to", "is", "are", "at", "in", "and", "or", "under", "this", "by", "your", "you", "may", "as", "it", "for", "be", "can", "with", "on", "see", "all", "that", "has"})


def _rows() -> list[tuple[str, str, bool]]:
    """(family, text, never trained on) of all made paragraphs."""
    made = [(f, t.format(n)) for f, names in NAMES.items() for n, t in product(names, FRAMES)]
    made += [(f, t) for f, notices in NOTICES.items() for t in notices for _ in range(3)] + [(f, t) for f, titles in TITLES.items() for t in titles for t in (t, f"{t}.", f"# {t}", f"{t}:", f"= {t} =")]
    made += [(f, f"{a} {b}") for f, names in NAMES.items() for n in names for a, b in (("Copyright 2021 the authors.", FRAMES[0].format(n)), (FRAMES[1].format(n), "All rights reserved."))]
    made += [(UNKNOWN, t) for t in OTHERS for _ in range(3)] + [(UNKNOWN, f"{a} {b}") for a, b in zip(OTHERS, OTHERS[1:], strict=False)]
    others = [(UNKNOWN, t, i % 2 == 1) for i, n in enumerate(OTHER_NAMES) for t in (n.removeprefix("the "), *(f.format(n) for f in FRAMES))]
    return [(f, t, False) for f, t in made] + others


def words_of(text: str) -> set[str]:
    return set(re.findall("[a-z0-9]+", text.lower()))


def templates() -> list[tuple[str, list[str], list[str], float]]:
    """(family, words, word pairs, share of them that confirms): the telling words of names and titles, the pairs of longer notices."""
    frames = set().union(*map(words_of, FRAMES)) | set(STOP) | {"style", "clause", "version", "licence", "international", "universal", "january", "june"}
    tell = lambda t: sorted(w for w in words_of(t) - frames if not re.fullmatch("v?[0-9]+", w))
    short = [(f, tell(t), [], 1.0) for made in (NAMES, TITLES) for f, names in made.items() for t in names]
    long = [(f, [], sorted({" ".join(x) for x in zip(w, w[1:])}), CONFIRM) for f, ts in NOTICES.items() for t in ts for w in [re.findall("[a-z0-9]+", t.lower())]]
    return [t for t in short + long if t[1] or t[2]]


def _runs(n: int) -> str:
    return f"if(size(w) >= {n}, transform(sequence(1, size(w) - {n - 1}), i -> array_join(slice(w, i, {n}), ' ')), cast(array() as array<string>))"


def grams_of(words: str) -> str:
    """Distinct 1-, 2- and 3-grams of a word array."""
    return f"transform(array({words}), w -> array_distinct(concat(w, {_runs(2)}, {_runs(3)})))[0]"


def telling(gram: str) -> str:
    """Whether an n-gram has a word that is no stop word."""
    return f"size(array_except(split({gram}, ' '), array({', '.join(repr(w) for w in STOP)}))) > 0"


def pairs_of(words: str) -> str:
    return f"transform(array({words}), w -> array_distinct({_runs(2)}))[0]"


class LicenceModel:
    """Weights by n-gram, biases, temperature, least probability, and a report of the calibration."""

    def __init__(self, classes: list[str], vocabulary: list[str], weights: list[list[float]], biases: list[float]):
        self.classes, self.vocabulary, self.weights, self.biases = classes, vocabulary, weights, list(biases)
        self.temperature, self.least, self.report = 1.0, 0.5, {}
        u = classes.index(UNKNOWN)
        self.biases[u] = max(biases[u], max(b for i, b in enumerate(biases) if i != u) + 1e-6)  # no word, no licence

    def triggers(self) -> list[str]:
        """Words without which no paragraph leaves the unknown class."""
        u = self.classes.index(UNKNOWN)
        lifts = [g for j, g in enumerate(self.vocabulary) if max(w[j] for w in self.weights) > self.weights[u][j]]
        return sorted({w for g in lifts for w in g.split(" ")} - set(STOP))

    def scored(self, paragraphs: DataFrame, keys: list[str]) -> DataFrame:
        """keys and the class's logits (z0, z1, ...), of paragraphs with an array column grams."""
        spark = paragraphs.sparkSession
        used = [(g, *[float(w[j]) for w in self.weights]) for j, g in enumerate(self.vocabulary) if any(w[j] for w in self.weights)]
        cols = [f"w{i}" for i in range(len(self.classes))]
        table = spark.createDataFrame(used, "gram string, " + ", ".join(f"{c} double" for c in cols))
        hits = paragraphs.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")  # at most the vocabulary
        return hits.groupBy(*keys).agg(*[(F.sum(c) + F.lit(b)).alias(f"z{i}") for i, (c, b) in enumerate(zip(cols, self.biases, strict=True))])

    def predicted(self, scored: DataFrame) -> DataFrame:
        z = [F.col(f"z{i}") / F.lit(self.temperature) for i in range(len(self.classes))]
        top = F.greatest(*z)
        total = sum((F.exp(x - top) for x in z), F.lit(0.0))
        name = F.lit(None).cast("string")
        for c, x in zip(self.classes, z, strict=True):
            name = F.when(x == top, F.lit(c)).otherwise(name)
        return scored.withColumn("family", name).withColumn("probability", F.lit(1.0) / total)


def _paragraphs(text: str) -> str:
    """SQL: structs (paragraph: number of the block, line: its number there, null for the whole block, body) of a text."""
    lines = "split(block, '\\n')"
    own = f"transform({lines}, (l, j) -> named_struct('paragraph', i, 'line', j, 'body', l))"
    wrapped = f"size({lines}) > 1 and array_max(transform({lines}, l -> length(l))) <= {WRAP}"
    whole = f"if({wrapped}, array(named_struct('paragraph', i, 'line', cast(null as int), 'body', replace(block, '\\n', ' '))), cast(array() as array<struct<paragraph: int, line: int, body: string>>))"
    return f"flatten(transform(split({text}, '\\r?\\n[ \\t]*\\r?\\n'), (block, i) -> concat({own}, {whole})))"


def train(spark: SparkSession, documents: DataFrame | None = None, rows: int = SAMPLE_ROWS) -> LicenceModel:
    made = spark.createDataFrame(_rows(), "family string, text string, apart boolean")
    fixed = made.where("not apart")
    if documents is not None:
        n = documents.count()
        share = min(1.0, rows / max(n, 1))
        picked = documents.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < share * 1e6).select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
        picked = picked.where("text <> '' and not lower(text) rlike 'licen[sc]|copyright|public domain|creative commons'").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(rows)
        made = made.unionByName(picked.select(F.lit(UNKNOWN).alias("family"), "text", F.lit(False).alias("apart")))
    gram_list = lambda df: df.selectExpr("family", "text", f"{grams_of(words_sql('text'))} as grams", "apart or xxhash64(family, text) % 4 = 0 as held")
    made = stash(gram_list(made).orderBy("family", "text").coalesce(1))
    vocabulary = [r.gram for r in gram_list(fixed).select(F.explode("grams").alias("gram")).where(telling("gram"))
                  .groupBy("gram").count().where("count >= 3").orderBy("gram").select("gram").collect()]  # bounded by the fixed notices
    classes = [*sorted(NAMES), UNKNOWN]
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("double") - 1
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features")
    vectors.setBinary(True)
    data = vectors.transform(made.withColumn("label", label)).select("label", "features", "held")
    fitted = LogisticRegression(family="multinomial", maxIter=60, regParam=0.001, elasticNetParam=0.5, standardization=False).fit(data.where("not held").coalesce(1))
    model = LicenceModel(classes, vocabulary, fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist())

    # calibration on what was held back: temperature by likelihood, least probability by precision
    held = made.where("held").withColumn("row", F.monotonically_increasing_id())
    z = stash(held.select("row", "family").join(model.scored(held.select("row", "grams"), ["row"]), "row", "left").fillna(
        {f"z{i}": b for i, b in enumerate(model.biases)}))
    grid = [2.0 ** (i / 4) for i in range(-16, 17)]
    losses = []
    for t in grid:
        parts = [F.col(f"z{i}") / t for i in range(len(classes))]
        top = F.greatest(*parts)
        own = sum((F.when(F.col("family") == c, x).otherwise(0.0) for c, x in zip(classes, parts, strict=True)), F.lit(0.0))
        losses.append(F.avg(top + F.log(sum((F.exp(x - top) for x in parts), F.lit(0.0))) - own).alias(f"t{len(losses)}"))
    loss, model.temperature = min(zip(z.agg(*losses).first(), grid, strict=True))
    judged = stash(model.predicted(z.withColumnRenamed("family", "truth")).select("truth", "family", "probability"))
    level = F.floor(F.col("probability") * 100) / 100
    levels = judged.where(F.col("family") != UNKNOWN).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("family") == F.col("truth")).alias("right")).orderBy("level").collect()
    passing = [(r.level, sum(x.right for x in levels if x.level >= r.level) / sum(x.n for x in levels if x.level >= r.level)) for r in levels]
    model.least = next((p for p, share in passing if share >= PRECISION), 1.0)
    known = F.when((F.col("family") != UNKNOWN) & (F.col("probability") >= model.least), F.col("family")).otherwise(F.lit(UNKNOWN))
    ends = judged.withColumn("said", known).agg(
        F.count("*").alias("held_back"), F.try_divide(F.count_if((F.col("said") == F.col("truth")) & (F.col("said") != UNKNOWN)), F.count_if(F.col("said") != UNKNOWN)).alias("precision"),
        F.try_divide(F.count_if((F.col("said") == F.col("truth")) & (F.col("said") != UNKNOWN)), F.count_if(F.col("truth") != UNKNOWN)).alias("recall"),
        F.try_divide(F.count_if((F.col("said") == UNKNOWN) & (F.col("truth") == UNKNOWN)), F.count_if(F.col("truth") == UNKNOWN)).alias("unknown_recall")).first()
    tenth = judged.groupBy(F.floor(F.col("probability") * 10).alias("t")).agg(F.count("*").alias("n"), F.abs(F.sum("probability") - F.count_if(F.col("family") == F.col("truth"))).alias("off"))
    error = tenth.agg(F.sum("off") / F.sum("n")).first()[0]
    model.report = {**ends.asDict(), "log_loss": loss, "temperature": model.temperature, "least": model.least, "calibration_error": error, "interior": grid[0] < model.temperature < grid[-1]}
    return model


def scan(documents: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """Paragraphs of a known licence family: doc_id, paragraph (number of the block from 0), line (in it, from 0; null: the whole block), family, probability, similarity, confirmed."""
    spark = documents.sparkSession
    model = model or train(spark, documents)
    triggers = "array(" + ", ".join(f"'{w}'" for w in model.triggers()) + ")"
    hit = documents.select("doc_id", "text").where(f"arrays_overlap({words_sql('text')}, {triggers})")
    units = hit.selectExpr("doc_id", "xxhash64(text) as version", f"explode({_paragraphs('text')}) as u").selectExpr("doc_id", "version", "u.paragraph", "u.line", "u.body")
    cand = stash(units.where(f"arrays_overlap({words_sql('body')}, {triggers})").dropDuplicates(["doc_id", "version", "paragraph", "line"])
                 .selectExpr("doc_id", "version", "paragraph", "coalesce(line, -1) as line", "coalesce(cast(doc_id as bigint), -9223372036854775808L) as doc", "body"))
    keys = ["doc", "version", "paragraph", "line"]
    grams = cand.selectExpr(*keys, f"{grams_of(words_sql('body'))} as grams")
    known = stash(model.predicted(model.scored(grams, keys)).where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.least)).select(*keys, "family", "probability"))
    lines = known.where("line >= 0").select("doc", "version", "paragraph").distinct()
    known = known.where("line >= 0").unionByName(known.where("line < 0").join(lines, ["doc", "version", "paragraph"], "left_anti"))
    fixed = spark.createDataFrame(templates(), "family string, ws array<string>, ps array<string>, need double").groupBy("family").agg(
        F.collect_list(F.struct("ws", "ps", "need")).alias("ts"))  # fixed notices
    share = "(size(array_intersect(t.ws, lw)) + size(array_intersect(t.ps, lp))) / (size(t.ws) + size(t.ps))"
    joined = cand.join(small(stash(known)), keys).selectExpr("doc_id", "paragraph", "line", "family", "probability", f"{words_sql('body')} as lw", f"{pairs_of(words_sql('body'))} as lp")
    return joined.join(F.broadcast(fixed), "family", "left").selectExpr(
        "doc_id", "paragraph", "nullif(line, -1) as line", "family", "probability", f"coalesce(array_max(transform(ts, t -> {share})), 0D) as similarity",
        f"coalesce(exists(ts, t -> {share} >= t.need), false) as confirmed")
