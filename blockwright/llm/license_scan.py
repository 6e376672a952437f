"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates. Built-in functions only.

Paragraphs are lines, and blocks of several lines without a blank one between (a wrapped licence), joined. They are
classified by a logistic regression over word 1- and 2-grams (common words alone excepted), made sparse by an L1 penalty, into licence families and
"unknown". It is trained on the templates below, their sentences and halves, on usual notices (every name of a family in
every phrase), and on sentences about licences that license nothing. A family counts if its probability passes a
threshold calibrated on such unknown sentences kept out of training as the templates would confirm, and if the paragraph shares enough of its words' pairs
with a template or notice of the family.

Only paragraphs to which the model can give a family reach it: a family's score exceeds that of "unknown" only by grams
whose weight for it is greater. Grams are set aside while all of them together cannot lift any family that far; a paragraph
without any of the rest is unknown, and a pattern made of the rest, read off the fitted model, finds the others. It drops
nothing that the model would not call unknown.

Defined cases: null and empty texts have no licence; n_paragraphs counts the lines that hold one, repeated ones each time,
or, in a text without such a line, the blocks; a paragraph is classified once for all texts that hold it; ties go to the greater probability, then to the family later by code
point; repeated rows each get their result; null ids come through; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.llm._store import stored, table

#: Sentences of well-known licences and the usual notices for them, by family; fixed values.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license. See the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL, version 2.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; CC BY-SA 3.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available for non-commercial use under CC BY-NC-SA 4.0.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
        "SPDX-License-Identifier: Unlicense",
        "This work has been dedicated to the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright, all rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the copyright holder.",
        "Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited; proprietary and confidential.",
    ],
}
UNKNOWN = [
    "Er ging mit ihr durch den Wald.", "Mit der Zeit wurde es still.", "Das Haus mit dem roten Dach steht leer.", "Komm mit.", "Wer nicht mit mir ist.", "mit",
    "His driver's license was revoked after the third accident.", "She applied for a fishing license at the county office.", "The band released their second album under the new label.",
    "Poetic license allows an author to depart from the facts.", "The warranty on the dishwasher expired last month.", "The general public was not allowed to enter the building.",
    "The Apache helicopter landed near the village before dawn.", "Students at MIT built a bridge out of spaghetti.", "The software was free of charge during the trial and then cost ten dollars.",
    "The council gave permission to build a copy of the old tower.", "Public domain films are shown on the wall of the library each Friday.", "The court heard arguments about copyright law and the history of the printing press.",
    "Creative people and the commons of the city met in June.", "Version 2.0 of the game adds a new map.", "The foundation of the house was laid in 1903.",
    "A license plate was found on the road to the lake.", "You may obtain a copy of the menu at the bar.", "The terms of the peace were discussed for many weeks.",
    "They redistributed the land among the farmers of the valley.", "All rights of way across the field were closed for the season.", "The wildebeest, or gnu, crossed the river at night.",
]
#: Kept out of training; they calibrate the threshold.
CALIBRATION = [
    "Sie kam mit dem Zug aus Wien.",
    "The pilot lost her license and sued the airline.", "The museum published a catalogue with permission of the family.", "A general warranty covers the engine and the gearbox.",
    "The Apache and the Navajo are peoples of the southwest.", "The lecture on copyright was distributed to all students.", "The pub has a license to sell wine and beer.",
    "He works at MIT on the theory of free software.", "The commons voted on version three of the bill.", "Conditions in the mine are not provided for by law.",
]
#: Names that notices use; every name of a family stands in every phrase.
NAMES = {
    "mit": ["the MIT License", "the MIT license", "MIT", "the Expat License"],
    "apache": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "the Apache 2.0 license"],
    "bsd": ["the BSD License", "the 3-clause BSD license", "a BSD-style license", "BSD-2-Clause", "BSD-3-Clause"],
    "gpl": ["the GNU General Public License", "the GNU General Public License, version 3", "the GNU General Public License, version 2 or later", "the GNU GPL v3", "GPL-3.0-or-later", "GPL-2.0-only", "the GPL, version 2"],
    "lgpl": ["the GNU Lesser General Public License", "the GNU Lesser General Public License, version 2.1", "the GNU LGPL", "LGPL-2.1-only", "LGPL-3.0-or-later"],
    "mpl": ["the Mozilla Public License", "the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0", "MPL-2.0", "the MPL 2.0"],
    "cc-by": ["a Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY-SA 4.0", "CC BY-SA 3.0", "the Creative Commons Attribution-ShareAlike License", "CC-BY-4.0"],
    "cc-by-nc": ["a Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-4.0"],
    "public-domain": ["CC0 1.0 Universal", "the Unlicense", "CC0-1.0", "a public domain dedication"],
}
PHRASES = (
    "Released under {}.", "Licensed under {}.", "This work is licensed under {}.", "This project is licensed under the terms of {}.", "This library is released under {}, see LICENSE.",
    "The source code is distributed under {}.", "All content is available under {}.", "License: {}", "SPDX-License-Identifier: {}", "This file may be used under the terms of {}; see the file COPYING for details.",
    "Copyright the authors. Licensed under {}.",
)
#: Words that tell no family from anything; grams of these alone are no features.
COMMON = (
    "a all also an and any are as at be been but by can do for from had has have he his if in into is it its may must no not of on one or other our shall she should so such than that the their them there these "
    "they this those to under used was we were what when which who will with without would you your"
).split()
#: Least share of the shorter one's word pairs that paragraph and template have in common.
SHARED = 0.5
#: Distinct paragraphs that one task classifies, about.
PER_TASK = 4000


def _words(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"[\p{L}\p{N}]+(?:[.+'-][\p{L}\p{N}]+)*"), F.lit(0))


def grams(paragraph: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    w = _words(paragraph)
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(w, pairs))


def features(paragraph: Column) -> Column:
    """The grams that the model sees: those with a word that says something."""
    common = "|".join(COMMON)
    return F.filter(grams(paragraph), lambda g: ~g.rlike(f"^(?:{common})(?: (?:{common}))?$"))


def _sentences(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """A literal table (family, paragraph)."""
    kind = "array<struct<family string, paragraph string>>"
    made = F.explode(F.from_json(F.lit(json.dumps([{"family": f, "paragraph": p} for f, p in rows])), kind))
    return spark.range(1).select(made.alias("r")).select("r.*")


def notices() -> list[tuple[str, str]]:
    """(family, text) of the templates, and of every name in every phrase."""
    made = [(f, phrase.format(name)) for f, names in NAMES.items() for name in names for phrase in PHRASES]
    return [(f, p) for f, ps in TEMPLATES.items() for p in ps] + made


def _training(spark: SparkSession) -> DataFrame:
    """Templates and notices whole, templates as sentences, and as first and second halves; unknown sentences whole, twice
    for each family, since whatever names no licence must weigh more than any family."""
    rows = notices()
    for family, paragraphs in TEMPLATES.items():
        for p in paragraphs:
            w = p.split()
            parts = {s.strip() for s in p.replace(";", ".").split(". ") if len(s.split()) > 3} - {p}
            if len(w) > 12:
                parts |= {" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])}
            rows += [(family, x) for x in sorted(parts)]
    return _sentences(spark, rows + [("unknown", p) for p in UNKNOWN] * (2 * len(TEMPLATES)))


def _one_of(grams: list[str]) -> str:
    """A pattern for texts that hold one of the grams; words that begin alike share their beginning in it."""
    trie: dict = {}
    for g in grams:
        node = trie
        for c in g:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [("[^\\p{L}\\p{N}]+" if c == " " else re.sub(r"([^\w])", r"\\\1", c)) + pattern(below) for c, below in sorted(node.items()) if c]
        body = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""
        return f"(?:{body})?" if "" in node and body else body

    return r"(?iu)(?<![\p{L}\p{N}])" + pattern(trie) + r"(?![\p{L}\p{N}])"


class LicenceModel:
    """The fitted regression: a vectoriser, coefficients, and the calibrated threshold. Its size is that of the templates."""

    def __init__(self, spark: SparkSession):
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import CountVectorizer, StringIndexer

        train = _training(spark).withColumn("grams", features(F.col("paragraph"))).coalesce(1)
        self._vector = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(train)
        index = StringIndexer(inputCol="family", outputCol="y", stringOrderType="alphabetAsc").fit(train)
        fit = LogisticRegression(labelCol="y", family="multinomial", regParam=0.0005, elasticNetParam=1.0, maxIter=60, standardization=False)
        self._model = fit.fit(index.transform(self._vector.transform(train)))
        self.families = index.labels
        self.gate = self._gate()
        away = _sentences(spark, [("unknown", p) for p in CALIBRATION])
        worst = compared(self.predicted(away)).where((F.col("family") != "unknown") & (F.col("likeness") >= SHARED)).agg(F.max("probability")).first()[0]
        self.threshold = min(0.9, max(0.5, worst or 0.0))

    def _gate(self) -> str | None:
        """The pattern of paragraphs that may score higher for a family than for "unknown"; None if all may."""
        weight, base = self._model.coefficientMatrix.toArray(), self._model.interceptVector.toArray()
        u = self.families.index("unknown")
        if (np.delete(base, u) >= base[u]).any():
            return None
        gain, room = np.maximum(weight - weight[u], 0), base[u] - base
        needed, silent = [], np.zeros(len(base))
        # Grams that not even all together lift a family over "unknown" need not be looked for: the shortest go first.
        for g, i in sorted(((g, i) for i, g in enumerate(self._vector.vocabulary)), key=lambda x: (x[0].count(" "), len(x[0]), x[0])):
            with_it = silent + gain[:, i]
            if (np.delete(with_it, u) < np.delete(room, u) - 1e-6).all():
                silent = with_it
            else:
                needed.append(g)
        return _one_of(needed)

    def predicted(self, paragraphs: DataFrame) -> DataFrame:
        """``paragraphs`` with family and probability, the best class before threshold and templates."""
        from pyspark.ml.functions import vector_to_array

        seen = self._vector.transform(paragraphs.drop("family").withColumn("grams", grams(F.col("paragraph"))))
        p = F.array([F.element_at(vector_to_array(F.col("_p")), i + 1) for i in range(len(self.families))])
        out = self._model.setProbabilityCol("_p").setPredictionCol("_y").setRawPredictionCol("_r").transform(seen)
        label = F.element_at(F.array(*map(F.lit, self.families)), F.col("_y").cast("int") + 1)
        return out.withColumn("probability", F.array_max(p)).withColumn("family", label).drop("_p", "_y", "_r", "features")


def compared(seen: DataFrame) -> DataFrame:
    """``seen`` (paragraph, family) with likeness, the share of word pairs in common with the family's closest template or notice."""
    templates = _sentences(seen.sparkSession, notices()).select("family", F.filter(grams(F.col("paragraph")), lambda g: g.contains(" ")).alias("t"))
    templates = templates.groupBy("family").agg(F.collect_list("t").alias("templates"))  # fixed, a few hundred
    seen = seen.join(F.broadcast(templates), "family", "left").withColumn("pairs", F.filter(grams(F.col("paragraph")), lambda g: g.contains(" ")))
    share = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, "pairs")) / F.greatest(F.least(F.size(t), F.size("pairs")), F.lit(1))))
    return seen.withColumn("likeness", F.coalesce(share, F.lit(0.0))).drop("pairs", "templates")


def classified(paragraphs: DataFrame, model: LicenceModel) -> DataFrame:
    """``paragraphs`` (paragraph) with family ("unknown" where nothing is confirmed), probability and likeness to the closest template."""
    seen = compared(model.predicted(paragraphs))
    sure = (F.col("family") != "unknown") & (F.col("probability") >= model.threshold) & (F.col("likeness") >= SHARED)
    return seen.withColumn("family", F.when(sure, F.col("family")).otherwise(F.lit("unknown"))).drop("grams")


def _units(text: Column) -> Column:
    """array<struct<line, p>>: lines, and blocks of several lines as one."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), F.trim), lambda p: p.contains("\n"))
    joined = F.transform(blocks, lambda p: F.struct(F.lit(False).alias("line"), F.regexp_replace(p, r"\s*\n\s*", " ").alias("p")))
    return F.concat(F.transform(F.split(text, r"\r?\n"), lambda p: F.struct(F.lit(True).alias("line"), p.alias("p"))), joined)


def licence_paragraphs(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """(doc_id, hash, line, paragraph, n, family, probability, likeness): the distinct paragraphs of each text that the model may give a family, classified."""
    model = model or LicenceModel(docs.sparkSession)
    may = (lambda c: c.rlike(model.gate)) if model.gate else (lambda c: F.trim(c) != "")
    cued = docs.where(may(F.col("text"))).select("doc_id", F.xxhash64("text").alias("hash"), F.explode(F.filter(_units(F.col("text")), lambda u: may(u["p"]))).alias("u"))
    cued = stored(cued.groupBy("doc_id", "hash", F.col("u.line").alias("line"), F.col("u.p").alias("paragraph")).agg(F.count("*").alias("n")), "cued-paragraphs")
    # The model's work is by row, not by byte: every task gets as many.
    distinct = stored(cued.select("paragraph").distinct(), "distinct-paragraphs")
    parts = max(1, math.ceil(distinct.count() / PER_TASK))
    known = stored(classified(distinct.repartition(parts), model), "classified-paragraphs")
    return cued.join(known, "paragraph")


def scanned(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row per document: doc_id, family (of the likeliest confirmed paragraph, else null), families, probability, n_paragraphs."""
    found = licence_paragraphs(docs, model).where("family <> 'unknown'").groupBy("doc_id", "hash").agg(
        F.max(F.struct("probability", "family")).alias("best"), F.array_sort(F.collect_set("family")).alias("families"), F.coalesce(F.sum(F.when(F.col("line"), F.col("n"))), F.sum("n")).alias("n"),
    )
    found = found.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "best", "families", "n")
    narrow = docs.select("doc_id", F.xxhash64("text").alias("hash"))
    out = narrow.join(found, narrow["doc_id"].eqNullSafe(found["_id"]) & (narrow["hash"] == found["_hash"]), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", F.col("best.family").alias("family"), F.coalesce("families", none).alias("families"), F.col("best.probability").alias("probability"), F.coalesce("n", F.lit(0)).alias("n_paragraphs"))


def op7_license_scan(spark, sf_dir):
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
