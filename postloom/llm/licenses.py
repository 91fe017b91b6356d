"""Licence families of paragraphs: a trained n-gram classifier that templates confirm.

A line is read by its sentences, a sentence of more than ``SPAN`` words by windows
that overlap by ``LAP``, so a notice at the end of a long line of prose stands alone or
with few other words. Windows of the templates below, notices set between words
of the corpus, and ordinary sentences of the corpus, from at most ``OTHER_LINES`` lines, some
with the bare name of a licence in them, train a multinomial logistic regression on hashed
word one- and two-grams. On rows it has not seen, a second regression with one feature,
the log-odds of the best family against the unknown class, is fitted: the
calibrated probability that a paragraph is a licence at all. What passes must
also share most of its two-grams with a template of the predicted family, or
hold most of the template's; a notice made of a phrase and a name needs the whole name.

Everything runs in the JVM: Spark ML and column expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.quality import let
from postloom.llm.store import stored

#: Lines of the corpus that stand for the unknown class in training.
OTHER_LINES = 2000
#: Documents they come from, those with the smallest hash of the text.
OTHER_DOCS = 400
FEATURES = 1 << 13
#: Shared two-grams that confirm a family, as a share of the paragraph's or the template's.
OVERLAP = 0.6
UNKNOWN = "unknown"
#: Words of a window, and words that neighbouring windows share: no notice of up to LAP words is cut.
SPAN, LAP = 48, 14

# Notices and openings of public licences.
TEMPLATES = {
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "This project is released under the Apache License 2.0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
}
# Names of licences, and phrases that grant under a name.
NAMES = {
    "agpl-3.0": ("GNU Affero General Public License", "AGPL"),
    "apache-2.0": ("Apache License", "Apache 2.0 License"),
    "bsd": ("BSD License", "BSD 2-Clause License", "BSD 3-Clause License"),
    "bsl-1.0": ("Boost Software License",),
    "cc-by": ("Creative Commons Attribution 4.0",),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial",),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike",),
    "cc0-1.0": ("CC0 1.0 Universal",),
    "epl-2.0": ("Eclipse Public License",),
    "gpl": ("GNU General Public License", "GPL"),
    "isc": ("ISC License",),
    "lgpl": ("GNU Lesser General Public License", "LGPL"),
    "mit": ("MIT License",),
    "mpl-2.0": ("Mozilla Public License",),
    "unlicense": ("Unlicense",),
    "zlib": ("zlib License",),
}
PHRASES = ("Released under the", "Released under", "Licensed under the", "Licensed under", "Distributed under the terms of the", "Available under the")
# Identifiers of licences after the tag SPDX-License-Identifier.
SPDX = {
    "agpl-3.0": ("AGPL-3.0",),
    "apache-2.0": ("Apache-2.0",),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "bsl-1.0": ("BSL-1.0",),
    "cc-by": ("CC-BY-4.0",),
    "cc-by-nc": ("CC-BY-NC-4.0",),
    "cc-by-sa": ("CC-BY-SA-4.0",),
    "cc0-1.0": ("CC0-1.0",),
    "epl-2.0": ("EPL-2.0",),
    "gpl": ("GPL-2.0", "GPL-3.0"),
    "isc": ("ISC",),
    "lgpl": ("LGPL-2.1", "LGPL-3.0"),
    "mit": ("MIT",),
    "mpl-2.0": ("MPL-2.0",),
    "unlicense": ("Unlicense",),
    "zlib": ("Zlib",),
}
# What stands between the words of a paragraph, the end of a sentence, the British spelling, and the tag of an identifier.
_BETWEEN = r"(?:[^\p{L}\p{N}.]|\.(?![\p{L}\p{N}])|\.(?<![\p{L}\p{N}]\.))+"
_SENTENCE = r"(?<=[.!?])\s+(?=[\"'(]?\p{Lu})"
_BRITISH = ("licence", "license")
_TAG = ("spdx-license-identifier:", "spdx ")


def terms(text: Column) -> Column:
    """Lower-case words of letters, digits and dots between two of them; licence is license, an identifier's tag one word."""
    plain = F.lower(text)
    for old, new in (_BRITISH, _TAG):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.filter(F.split(plain, _BETWEEN), lambda w: w != "")


def pieces(line: Column) -> Column:
    """The terms of a line's sentences, those of more than ``SPAN`` words in windows; all words are in one or two."""

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - LAP - 1, F.lit(SPAN - LAP))
        return F.when(F.size(w) <= SPAN, F.array(w)).otherwise(F.transform(starts, lambda i: F.slice(w, i + 1, SPAN)))

    every = F.flatten(F.transform(F.split(line, _SENTENCE), lambda s: let(terms(s), windows)))
    return F.filter(every, lambda w: F.size(w) > 0)


def _pairs(words: Column) -> Column:
    """Distinct two-grams; a single word is one."""
    both = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return let(words, lambda w: F.array_distinct(F.when(F.size(w) < 2, w).otherwise(both(w))))


def _notices() -> list[tuple[str, str, str]]:
    """(family, text, name): templates without a name, then phrases and tags with the name that must be there whole."""
    out = [(f, t, "") for f, texts in TEMPLATES.items() for t in texts]
    out += [(f, f"{p} {n}", n) for f, names in NAMES.items() for n in names for p in PHRASES]
    return out + [(f, f"SPDX-License-Identifier: {n}", f"SPDX-License-Identifier: {n}") for f, names in SPDX.items() for n in names]


def _windows() -> list[tuple[str, str, int]]:
    """(family, text, part): notices, whole and in windows, dealt into five parts by turns."""
    out = []
    for family, text, name in _notices():
        words = text.split()
        out += [(family, text)] * 5
        for size in () if name else (6, 10, 16, 24):
            out += [(family, " ".join(words[i : i + size])) for i in range(0, len(words) - size + 1, 2)]
    return [(f, t, i % 5) for i, (f, t) in enumerate(out)]


@dataclass
class Detector:
    """Fitted stages and what is needed to read their probabilities."""

    stages: PipelineModel
    families: list[str]
    slope: float
    intercept: float


def _templates(spark: SparkSession) -> list[list[dict[str, list[str]]]]:
    """The two-grams of each family's notices and of the names in them, families in order; a constant of the module."""
    rows = [(i, j, t, n) for i, f in enumerate(sorted(TEMPLATES)) for j, (g, t, n) in enumerate(_notices()) if g == f]
    made = spark.createDataFrame(rows, "i int, j int, text string, name string")
    own = made.select("i", "j", _pairs(terms(F.col("text"))).alias("pairs"), _pairs(terms(F.col("name"))).alias("name")).orderBy("i", "j").collect()
    return [[{"pairs": r["pairs"], "name": r["name"]} for r in own if r["i"] == i] for i in range(len(TEMPLATES))]


_NOTICE = "struct<pairs: array<string>, name: array<string>>"


def _constant(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _overlap(paragraph: Column, templates: Column) -> Column:
    """The largest share of two-grams in common, of the shorter side; templates whose name is not there whole have none.

    A name of one word counts as there with any two-gram that holds it; a paragraph as short as
    a name's first words is not a notice, so phrases are held against their own length.
    """

    def share(p: Column, t: Column) -> Column:
        named = F.forall(t["name"], lambda n: F.array_contains(p, n) | (~F.contains(n, F.lit(" ")) & F.exists(p, lambda x: F.contains(F.concat(F.lit(" "), x, F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" "))))))
        both = F.size(F.array_intersect(p, t["pairs"]))
        return F.when(F.size(t["name"]) == 0, both / F.least(F.size(p), F.size(t["pairs"]))).when(named, both / F.size(t["pairs"])).otherwise(0.0)

    def best(p: Column) -> Column:
        return F.array_max(F.transform(templates, lambda t: share(p, t)))

    return let(paragraph, best)


def fit(docs: DataFrame) -> Detector:
    """Train on the templates and on lines of ``docs`` (text string) that resemble none of them.

    With no such line the unknown class is trained on one made of the word "unknown".
    """
    spark = docs.sparkSession
    own = docs.select("text", F.xxhash64("text").alias("h")).where("text is not null")
    lowest = own.select("h").distinct().orderBy("h").limit(OTHER_DOCS)
    some = own.join(F.broadcast(lowest), "h")  # OTHER_DOCS numbers
    lines = some.select(F.explode(F.split("text", "\n")).alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]")).distinct()
    known = _constant([t for family in _templates(spark) for t in family], f"array<{_NOTICE}>")
    others = lines.where(_overlap(_pairs(terms(F.col("text"))), known) < OVERLAP)
    others = others.orderBy(F.xxhash64("text"), "text").limit(OTHER_LINES)
    # Each sentence goes plain, with a notice between its words, and with the bare name of a licence there.
    said = others.select(F.explode(pieces(F.col("text"))).alias("w")).distinct().withColumn("h", F.xxhash64("w"))
    notes = [(f, t, n) for f, t, n in _notices() if n and not t.startswith("SPDX")]
    dealt = spark.createDataFrame([(i, *x) for i, x in enumerate(notes)], "i int, family string, notice string, name string")
    met = said.withColumn("i", F.pmod("h", F.lit(len(notes))).cast("int")).join(F.broadcast(dealt), "i")  # a constant of the module
    inside = lambda c: F.concat(F.slice("w", 1, LAP), terms(F.col(c)), F.slice("w", LAP + 1, LAP))
    kinds = F.array(
        F.struct(F.lit(UNKNOWN).alias("family"), F.col("w").alias("w")),
        F.struct(F.col("family"), inside("notice").alias("w")),
        F.struct(F.lit(UNKNOWN).alias("family"), inside("name").alias("w")),
    )
    prose = met.select(F.pmod("h", F.lit(5)).cast("int").alias("part"), F.inline(kinds)).select("family", "w", "part")
    families = [UNKNOWN, *sorted(TEMPLATES)]
    made = spark.createDataFrame([*_windows(), *((UNKNOWN, UNKNOWN, i) for i in range(5))], "family string, text string, part int")
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    every = made.select("family", terms(F.col("text")).alias("w"), "part").union(prose)
    rows = stored(every.select(label.cast("double").alias("label"), "w", "part").coalesce(4), "licence-training")
    learner = Pipeline(
        stages=[
            NGram(n=2, inputCol="w", outputCol="pairs"),
            SQLTransformer(statement="SELECT *, concat(w, pairs) AS grams FROM __THIS__"),
            HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol="label", regParam=0.001, maxIter=40, family="multinomial"),
        ]
    )
    stages = learner.fit(rows.where("part > 0"))
    # Seen windows stay in too few families to calibrate on; part 0 has not been trained on.
    held = stages.transform(rows.where("part = 0")).select((F.col("label") > 0).cast("double").alias("licence"), vector_to_array("probability").alias("p"))
    held = held.select("licence", _odds(F.col("p")).alias("odds"))
    one = VectorAssembler(inputCols=["odds"], outputCol="x").transform(held)
    curve = LogisticRegression(featuresCol="x", labelCol="licence", regParam=0.01).fit(one)
    return Detector(stages, families, float(curve.coefficients[0]), float(curve.intercept))


def _odds(p: Column) -> Column:
    """Log-odds of the best family against the unknown class, which is the first."""
    best = F.array_max(F.slice(p, 2, 1 + len(TEMPLATES)))
    return F.log(F.greatest(best, F.lit(1e-12))) - F.log(F.greatest(p[0], F.lit(1e-12)))


def paragraphs(docs: DataFrame, detector: Detector) -> DataFrame:
    """(doc_id, t, at, family, probability, overlap): the pieces of the lines of ``docs`` that are licence paragraphs.

    family is the classifier's best; probability the calibrated one that the
    piece is a licence, at least one half; overlap with the family's templates at
    least ``OVERLAP``. t is xxhash64(text), at the line's number from 0; a line has a
    row for each of its pieces that is one. Null and empty texts and no rows give none; long
    lines are read whole, by windows.
    """
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.where(F.col("line").rlike(r"[\p{L}\p{N}]")).select("doc_id", "t", "at", F.explode(pieces(F.col("line"))).alias("w"))
    p = vector_to_array("probability")
    scored = detector.stages.transform(lines).select("doc_id", "t", "at", "w", p.alias("p")).withColumn("odds", _odds(F.col("p")))
    calibrated = 1 / (1 + F.exp(-(detector.slope * F.col("odds") + detector.intercept)))
    known = F.slice("p", 2, len(detector.families) - 1)
    best = F.array_position(known, F.array_max(known)).cast("int")
    scored = scored.withColumn("probability", calibrated).where("probability >= 0.5").withColumn("best", best)
    templates = F.element_at(_constant(_templates(docs.sparkSession), f"array<array<{_NOTICE}>>"), F.col("best"))
    met = scored.withColumn("overlap", _overlap(_pairs(F.col("w")), templates)).withColumn("family", F.element_at(F.array(*map(F.lit, sorted(TEMPLATES))), F.col("best")))
    return met.where(F.col("overlap") >= OVERLAP).select("doc_id", "t", "at", "family", "probability", "overlap")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, families, n_paragraphs, best_family, best_probability), one row per row of ``docs``.

    docs: doc_id bigint, text string; other columns are not read. families is
    sorted and comma-joined, n_paragraphs the lines that hold one; the best family is that of the most probable
    paragraph, the smaller name first. Documents without a licence paragraph,
    null and empty texts have '', 0 and nulls. Rows alike in id and text get
    equal answers.
    """
    found = paragraphs(docs, fit(docs)).groupBy("doc_id", "t", "at", "family").agg(F.max("probability").alias("probability"))
    order = F.min(F.struct((-F.col("probability")).alias("p"), F.col("family").alias("f")))
    per_doc = found.groupBy(F.col("doc_id").alias("_doc"), F.col("t").alias("_t")).agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count_distinct("at").alias("n_paragraphs"), order.alias("top")
    )
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"))
    return own.join(per_doc, (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select(
        "doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).cast("bigint").alias("n_paragraphs"),
        F.col("top.f").alias("best_family"), (-F.col("top.p")).alias("best_probability"),
    )
