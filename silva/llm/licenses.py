"""Licence scan: a trained paragraph classifier and a comparison with templates, in DataFrame functions alone.

A multinomial logistic regression over word n-grams (1 to 3) tells licence families from each other and from unknown
paragraphs. It is fitted on the driver to the templates below (whole, in parts as a line break leaves them, and with words left out), to plain
sentences, and to a bounded sample of the corpus's own lines: those that hold most of a template count as its family, all others
as unknown. An absolute penalty makes the weights sparse. The temperature that fits held-out rows of all three kinds best
calibrates the probabilities; a paragraph whose best family has less than CONFIDENT is unknown. A prediction is confirmed if
the paragraph holds enough of one of the family's templates.

Every paragraph is judged, whatever its words. N-grams of common words alone are no features, and the intercepts favour unknown, which
some more features don't outweigh all together; so a paragraph with no other word of a feature is unknown for certain. Those
other words are looked up first, which leaves few paragraphs to score.

A notice may stand on one line or be wrapped over several. So each line is judged, and so is each run of lines without
a blank line between, joined by spaces; a run is reported if it is confirmed as a family that none of its lines is confirmed as.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

UNKNOWN = "unknown"
GRAMS = 3
CONFIDENT = 0.6
CONFIRMED = 0.6
#: Variants of each template and of each plain sentence in the training rows; texts and lines of the corpus sampled at most; its features' absolute penalty.
VARIANTS, PLAIN_VARIANTS, SAMPLED_TEXTS, SAMPLED_LINES, SAMPLED_CHARS, PENALTY = 16, 4, 300, 2000, 5000, 5e-5
#: A word that so large a share of the sampled unknown lines hold is common: an n-gram of common words alone is no feature.
COMMON = 0.01

# Public notices by licence family, a paragraph each.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program",
        "GNU Affero General Public License", "Released under the AGPLv3", "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "See the License for the specific language governing permissions and limitations under the License",
        "Apache License Version 2.0, January 2004", "License: Apache 2.0", "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
        "Licensed under the BSD 3-Clause License", "BSD License", "License: BSD", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 3.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "You may not use the material for commercial purposes", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 3.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 3.0", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "either version 3 of the License, or (at your option) any later version",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
        "You should have received a copy of the GNU General Public License along with this program",
        "GNU General Public License", "License: GPL", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GPLv3",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Released under the ISC License", "ISC License", "SPDX-License-Identifier: ISC"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "GNU Lesser General Public License", "Released under the LGPLv2.1", "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
        "The MIT License (MIT)", "License: MIT", "MIT licensed", "SPDX-License-Identifier: MIT",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": [
        "All rights reserved", "This document is confidential and proprietary; all rights reserved",
        "No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential",
        "Alle Rechte vorbehalten", "Tous droits réservés", "Todos los derechos reservados", "Tutti i diritti riservati",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        "This work is dedicated to the public domain under CC0 1.0 Universal",
    ],
}
# Sentences that hold words of licences but state none.
OTHER = [
    "He lost his driving license last year", "The bar has a liquor license", "She asked for permission to leave the room", "You need a fishing license here", "The public gathered in the square", "An apache helicopter flew over",
    "He studied at mit and later at the university", "They fought for equal rights", "The bill of rights was read aloud", "The table was reserved for six guests", "A copyright lawsuit was filed in court", "The source of the river is in the hills",
    "Redistribution of land was promised", "The domain name was sold", "The public library opens at nine", "A gnu grazed on the plain", "The warranty of the car ran out", "Licensed doctors may practice", "The common people praised the creative work", "The general spoke in public",
    "Er kam mit dem Zug", "mit der Zeit wurde es besser", "und mit den anderen", "sie ging mit", "ein Haus mit Garten", "das mit dem Hund", "Er hatte alle Rechte verloren", "License plates are made there", "Commercial traffic may use the road", "It is not permitted to smoke", "The terms of the treaty were met",
    "Free entry for any person", "The software was sold to a firm", "cc the whole team by email", "The license fee rose by four percent", "You can obtain a copy of the report at the desk", "Anyone is free to come to the meeting", "The author published a book of letters", "The conditions are met by all of them", "All seats are reserved", "A copy of the file was found in the archive", "They may not use the road without a permit",
    "Les droits de douane ont augmenté", "Los derechos humanos son universales",
]

#: The v between a name and its version number.
VERSION = r"([a-z])v(?=\.?[0-9])"


def word_list(text: str) -> list[str]:
    """Runs of letters and of digits, lower case, a version's v apart (gplv3: gpl v 3); the DataFrame side splits alike."""
    return re.findall(r"[^\W\d_]+|[0-9]+", re.sub(VERSION, r"\1 v ", text.lower()))


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


def _pairs(words: list[str]) -> set[str]:
    return {" ".join(x) for x in zip(words, words[1:])}


class Classifier:
    """weights (features x classes), intercepts, the temperature that calibrates them, and how many of the sampled unknown lines hold each word; classes end with unknown."""

    def __init__(self, classes: list[str], features: list[str], weights: np.ndarray, intercepts: np.ndarray, temperature: float, common: dict[str, int]):
        self.classes, self.features, self.weights, self.intercepts, self.temperature, self.common = classes, features, weights, intercepts, temperature, common

    def probabilities(self, text: str) -> dict[str, float]:
        own = grams(word_list(text))
        at = [k for k, f in enumerate(self.features) if f in own]
        z = (self.weights[at].sum(axis=0) + self.intercepts) / self.temperature
        p = np.exp(z - z.max())
        return dict(zip(self.classes, p / p.sum()))

    def telling_words(self) -> list[str]:
        """Words of which every paragraph that isn't unknown has one: without them, all other features that speak for a family can't outweigh the intercepts."""
        room = self.intercepts[-1] - self.intercepts[:-1]
        gain = np.maximum(self.weights[:, :-1] - self.weights[:, -1:], 0)
        holding: dict[str, list[int]] = {}
        for k, feature in enumerate(self.features):
            for word in set(feature.split(" ")):
                holding.setdefault(word, []).append(k)
        left = np.array([len(set(f.split(" "))) for f in self.features])  # words of each feature that are still looked up
        telling = set(holding)
        for word in sorted(holding, key=lambda w: (-self.common.get(w, 0), w)):
            own = [k for k in holding[word] if left[k] == 1]
            if self.common.get(word, 0) and (room - gain[own].sum(axis=0) > 0).all():
                room = room - gain[own].sum(axis=0)
                left[holding[word]] -= 1
                telling.discard(word)
        if (room <= 0).any():
            raise ValueError("a paragraph without features isn't unknown: fit with more unknown rows")
        return sorted(telling)


def sample_lines(docs: DataFrame, text_col: str = "text", texts: int = SAMPLED_TEXTS, lines: int = SAMPLED_LINES) -> list[str]:
    """A bounded sample to fit on: lines, by hash, of distinct texts, by hash; null and empty ones left out. A line gives its first SAMPLED_CHARS characters at most."""
    keyed = docs.select(F.col(text_col).alias("text")).where(F.length("text") > 0).withColumn("h", F.xxhash64("text"))
    chosen = [r.h for r in keyed.select("h").distinct().orderBy("h").limit(texts).collect()]  # numbers, so that no text moves
    each = keyed.where(F.col("h").isin(chosen)).select(F.explode(F.split("text", "\n")).alias("line")).select(F.substring("line", 1, SAMPLED_CHARS).alias("line")).where(F.trim("line") != "").distinct()
    return [r.line for r in each.orderBy(F.xxhash64("line"), "line").limit(lines).collect()]


def _variants(words: list[str], rng: random.Random, n: int) -> list[list[str]]:
    """The words; parts of them, as line breaks leave; with words left out or a plain sentence before them."""
    out = [words]
    for k in range(n):
        own = words
        if k % 2 and len(words) > 8:
            size = rng.randint(6, len(words))
            start = rng.randint(0, len(words) - size)
            own = words[start : start + size]
        own = [w for w in own if rng.random() > 0.1]
        out.append(own if rng.random() < 0.6 else word_list(rng.choice(OTHER)) + own)
    return out


def family_of(words: list[str], templates: dict[str, list[str]], least: float = CONFIRMED) -> str:
    """The family with the largest share of one of its templates' word pairs in ``words``, if that is ``least`` or more; else unknown."""
    own = _pairs(words)
    share, family = max((len(own & p) / len(p), k) for k, texts in templates.items() for t in texts if (p := _pairs(word_list(t))))
    return family if share >= least else UNKNOWN


def fit(lines: list[str] = (), templates: dict[str, list[str]] = TEMPLATES, other: list[str] = OTHER, seed: int = 3, steps: int = 250) -> Classifier:
    """Proximal gradient steps with an absolute penalty; every fourth training row is held out for the temperature. ``lines``: of :func:`sample_lines`."""
    rng = random.Random(seed)
    classes = [*sorted(templates), UNKNOWN]
    unknown = len(classes) - 1
    rows: list[tuple[set[str], int]] = []
    for k, family in enumerate(classes[:-1]):
        for text in templates[family]:
            rows += [(grams(v), k) for v in _variants(word_list(text), rng, VARIANTS)]
    plain = [(grams(v), unknown) for text in other for v in [word_list(text), *([w for w in word_list(text) if rng.random() > 0.1] for _ in range(PLAIN_VARIANTS))]]
    real = [(grams(own), classes.index(family_of(own, templates))) for own in map(word_list, lines)]
    rows += plain + real
    rows += [(set(), unknown)] * (len(rows) // 10)  # most paragraphs hold no feature at all
    common = Counter(w for own, (_, k) in zip(map(word_list, lines), real) if k == unknown for w in set(own))
    often = {w for w, n in common.items() if n >= max(2, COMMON * len(lines))}
    features = sorted({g for texts in templates.values() for t in texts for g in grams(word_list(t)) if not often.issuperset(g.split(" "))})
    index = {f: i for i, f in enumerate(features)}
    x, y = np.zeros((len(rows), len(features)), dtype=np.float32), np.zeros((len(rows), len(classes)), dtype=np.float32)
    for r, (own, k) in enumerate(rows):
        x[r, [index[g] for g in own if g in index]] = 1
        y[r, k] = 1
    held = np.arange(len(rows)) % 4 == 3

    def soft(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    a, b = x[~held], y[~held]
    # n-grams overlap, so a row's features move together: the step is bounded by the mean of the squared count of features
    rate = 2.0 / (1.0 + float((a.sum(axis=1) ** 2).mean()) ** 0.5 / 8)
    weights, intercepts = np.zeros((len(features), len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)
    ahead, before = weights, weights
    for step in range(steps):
        ahead = weights + (step / (step + 3)) * (weights - before)  # with momentum
        gap = b - soft(a @ ahead + intercepts)
        before = weights
        moved = ahead + rate * (a.T @ gap / len(a))
        weights = np.sign(moved) * np.maximum(np.abs(moved) - rate * PENALTY, 0)
        intercepts = intercepts + rate * gap.mean(axis=0)
    z = x[held] @ weights + intercepts
    loss = {t: -np.log(np.maximum((soft(z / t) * y[held]).sum(axis=1), 1e-12)).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    used = np.flatnonzero(np.abs(weights).max(axis=1))
    return Classifier(classes, [features[k] for k in used], weights[used].astype(float), intercepts.astype(float), min(loss, key=loss.get), common)


def _tables(spark: SparkSession, model: Classifier, templates: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Weights by n-gram, and templates as sets of neighbouring word pairs; the templates bound both."""
    scaled = model.weights / model.temperature
    weights = spark.createDataFrame([(f, [float(v) for v in w]) for f, w in zip(model.features, scaled)], "gram string, w array<double>")
    rows = [(family, sorted(_pairs(word_list(t)))) for family, texts in templates.items() for t in texts]
    return weights, spark.createDataFrame([r for r in rows if r[1]], "family string, pairs array<string>")


def _needed(templates: dict[str, list[str]], confirmed: float, telling: list[str]) -> list[str]:
    """Word pairs of which every text has one that holds ``confirmed`` of a template's: of each template so many that the others don't suffice, telling and long ones first."""
    found, words = set(), set(telling)
    for own in (word_list(t) for texts in templates.values() for t in texts):
        pairs = sorted(_pairs(own), key=lambda x: (words.isdisjoint(x.split(" ")), -len(x), x))
        found.update(pairs[: len(pairs) - math.ceil(confirmed * len(pairs) - 1e-9) + 1])
    return sorted(found)


def scan(docs: DataFrame, model: Classifier, templates: dict[str, list[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", confident: float = CONFIDENT, confirmed: float = CONFIRMED) -> DataFrame:
    """One row per paragraph that has a feature speaking for a family: doc_id, paragraph (the number of its first line, from 0), lines, family, probability, template_share, confirmed.

    All other paragraphs are unknown. Paragraphs are lines, and those runs of lines without a blank one that are confirmed as a family that none of their lines is confirmed as. family is ``unknown`` if unknown is likeliest or the likeliest family has less than ``confident``; probability is
    that of the likeliest class, the first by name of equal ones. template_share is the greatest share of a template's word pairs that the
    paragraph holds, of the predicted family; confirmed if it is ``confirmed`` or more (never for unknown). Null or empty texts
    have no paragraph. Rows that share an id and a paragraph number are reported each. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    weights, pairs = _tables(spark, model, templates)
    telling = model.telling_words()
    gate = F.array(*[F.lit(w) for w in telling])

    def words(text: Column) -> Column:
        apart = F.regexp_replace(F.lower(text), VERSION, "$1 v ")
        return F.array_remove(F.split(apart, r"[^\p{L}0-9]+|(?<=\p{L})(?=[0-9])|(?<=[0-9])(?=\p{L})"), "")

    def runs(n: int) -> Column:
        last = F.size("words") - n
        made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", F.slice("words", i + 1, n)))
        return F.when(last >= 0, made).otherwise(F.array().cast("array<string>"))

    def once(df: DataFrame, name: str, value: Column) -> DataFrame:
        """``value`` made once per row, however often it is named later."""
        return df.select(*df.columns, F.explode(F.array(value)).alias(name))

    # a part is a run of lines, after a blank line at most
    blank = r"\A[^\S\n]*\n"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col(text_col).alias("text"))
    texts = stage(texts.where(F.arrays_overlap(words(F.col("text")), gate)), "texts")  # written, so that both readings number the copies alike
    lines = texts.select("doc_id", "copy", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    lines = once(lines, "words", words(F.col("line"))).where(F.arrays_overlap("words", gate)).select("doc_id", "copy", "paragraph", F.lit(1).alias("lines"), "words")
    parts = F.split("text", r"\n(?=[^\S\n]*(?:\n|\z))")
    ends = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    wrapped = F.filter(F.transform("parts", lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, blank, "").alias("run"), F.rlike(x, F.lit(blank)).cast("int").alias("skip"))), lambda x: F.contains(x["run"], F.lit("\n")))
    folded = texts.where(F.contains("text", F.lit("\n"))).select("doc_id", "copy", parts.alias("parts")).select("doc_id", "copy", F.transform("parts", lambda x: ends(x) + 1).alias("sizes"), F.explode(wrapped).alias("x"))
    folded = once(folded, "words", words(F.col("x.run"))).where(F.arrays_overlap("words", gate))
    # most runs have too little of any template: only those that may be confirmed are scored
    folded = folded.where(F.arrays_overlap(runs(2), F.array(*[F.lit(x) for x in _needed(templates, confirmed, telling)])))
    first = F.aggregate(F.slice("sizes", F.lit(1), F.col("x.i")), F.lit(0), lambda a, b: a + b) + F.col("x.skip")
    folded = folded.select("doc_id", "copy", first.alias("paragraph"), (ends(F.col("x.run")) + 1).alias("lines"), "words")
    found = lines.unionByName(folded).withColumns({"k1": F.xxhash64("words"), "k2": F.xxhash64(F.lit(1), "words")})
    found = stage(found, "paragraphs")

    # one score per distinct paragraph: a notice that a third of all documents repeat is scored once; 128 bits stand for its words
    # the paragraph that stands for its like is chosen by numbers alone: whole pages may be paragraphs
    place = ["copy", "paragraph", "lines"]
    lead = found.groupBy("k1", "k2").agg(F.min(F.struct(*place)).alias("x")).select("k1", "k2", "x.*")
    bodies = found.join(lead, ["k1", "k2", *place], "left_semi").select("k1", "k2", "words")
    features = bodies.select("k1", "k2", F.explode(F.array_distinct(F.concat(*[runs(n) for n in range(1, GRAMS + 1)]))).alias("gram"))
    classes = range(len(model.classes))
    scores = features.join(F.broadcast(weights), "gram", "left").groupBy("k1", "k2").agg(*[F.coalesce(F.sum(F.get("w", F.lit(k))), F.lit(0.0)).alias(f"z{k}") for k in classes])
    z = [F.col(f"z{k}") + float(model.intercepts[k] / model.temperature) for k in classes]
    top = F.greatest(*z)
    mass = sum((F.exp(v - top) for v in z[1:]), F.exp(z[0] - top))
    likeliest = F.coalesce(*[F.when(v == top, F.lit(name)) for v, name in zip(z, model.classes)])
    scored = scores.select("k1", "k2", likeliest.alias("best"), (1 / mass).alias("probability"))
    scored = scored.withColumn("family", F.when(F.col("probability") >= confident, F.col("best")).otherwise(UNKNOWN)).drop("best")
    own = once(bodies, "own", F.array_distinct(runs(2))).select("k1", "k2", "own").join(scored, ["k1", "k2"])
    held = own.join(F.broadcast(pairs), "family", "left").withColumn("share", F.size(F.array_intersect("pairs", "own")) / F.size("pairs"))
    held = held.groupBy("k1", "k2", "family", "probability").agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("template_share"))
    out = found.drop("words").join(held, ["k1", "k2"]).select("doc_id", "copy", F.col("paragraph").cast("long").alias("paragraph"), F.col("lines").cast("long").alias("lines"), "family", "probability", "template_share", (F.col("template_share") >= confirmed).alias("confirmed"))
    alone = F.collect_list(F.when(F.col("confirmed") & (F.col("lines") == 1), F.col("paragraph"))).over(Window.partitionBy("copy", "family"))
    covered = F.exists("alone", lambda p: (p >= F.col("paragraph")) & (p < F.col("paragraph") + F.col("lines")))
    out = out.withColumn("alone", alone).where((F.col("lines") == 1) | (F.col("confirmed") & ~covered))
    return out.drop("copy", "alone")
