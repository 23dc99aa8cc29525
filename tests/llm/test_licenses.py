"""The licence scan against its own model row by row, on real notices that it wasn't fitted on, and on hostile rows."""

import random

import pytest
from pyspark.sql import functions as F

from silva.llm import licenses

# Passages of public licences and plain sentences that the templates don't hold, with their families.
REAL = [
    ("mit", "Copyright (c) 2020 Jane Doe. Permission is hereby granted, free of charge, to any person"), ("mit", "This project is MIT licensed."), ("mit", "Unless stated otherwise this code is available under the MIT license"),
    ("mit", "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"), ("bsd", "Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."), ("bsd", "Redistributions of source code must retain the above copyright notice."), ("apache", "This library is distributed under the terms of the Apache License 2.0."),
    ("apache", "Distributed under the Apache 2.0 license"), ("apache", "limitations under the License. You may obtain a copy of the License at"), ("gpl", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("gpl", "This file is part of Foo and may be used under the GNU General Public License version 2"),
    ("gpl", "License: GPL-2.0"), ("lgpl", "Foo is released under the terms of the GNU Lesser General Public License (LGPL)."), ("agpl", "Covered by the GNU Affero General Public License, version 3 or later."), ("mpl", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License"), ("cc-by", "This article is distributed under the terms of the Creative Commons Attribution License"), ("cc-by-nc", "Images: CC BY-NC 2.5"), ("proprietary", "© 2019 Acme Corp. All rights reserved."),
    ("proprietary", "© Le Monde. Tous droits réservés"), ("proprietary", "(C) 2011 Verlag GmbH, alle Rechte vorbehalten."), ("public-domain", "I hereby release this work into the public domain"), ("public-domain", "Anyone is free to copy, modify, publish, use, compile, sell or distribute"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"), ("apache", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."),
    ("unknown", "The committee reserved all rooms for the public meeting on software."), ("unknown", "She lost her license and the right to drive."), ("unknown", "mit dem Auto nach Hause"), ("unknown", "The source code of the game leaked last week."),
    ("unknown", "You need written permission from your teacher."), ("unknown", "the quick brown fox"), ("unknown", "Alle Rechte und Pflichten wurden besprochen"), ("unknown", "Public transport is free for persons over seventy."),
]


def corpus():
    rng = random.Random(5)
    words = "the of and is it by this as tion her wh an er on with for all any may not".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(300)]


@pytest.fixture(scope="module")
def model():
    return licenses.fit(corpus())


def family(model, text):
    p = model.probabilities(text)
    best = max(sorted(p), key=p.get)
    return best if p[best] >= licenses.CONFIDENT else licenses.UNKNOWN


def test_real_notices_of_every_family(model):
    right = [family(model, t) == f for f, t in REAL]
    assert sum(right) >= 0.9 * len(REAL)
    assert all(family(model, t) == f for f, t in REAL if f == "unknown")


def test_scan_equals_the_model_on_every_paragraph(spark, model):
    rng = random.Random(6)
    plain = corpus()
    pool = [t for _, t in REAL] + [t for own in licenses.TEMPLATES.values() for t in own] + plain
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    got = {(r.doc_id, r.paragraph): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).where("lines = 1").collect()}
    known = 0
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            want, row = family(model, line), got.get((i, k))
            known += want != "unknown"
            if row is None:
                assert want == "unknown"
            else:
                words = licenses.word_list(line)
                share = max((len(licenses._pairs(words) & licenses._pairs(licenses.word_list(t))) / len(licenses._pairs(licenses.word_list(t))) for t in licenses.TEMPLATES.get(want, []) if licenses._pairs(licenses.word_list(t))), default=0.0)
                assert row.family == want and row.probability == pytest.approx(max(model.probabilities(line).values()), abs=1e-9)
                assert row.template_share == pytest.approx(share) and row.confirmed == (share >= licenses.CONFIRMED)
    assert known > 80 and len(got) < sum(t.count("\n") + 1 for _, t in rows) - 50  # most plain lines need no score


def test_hostile_rows_and_long_lines(spark, model):
    notice = "Released under the MIT License."
    rows = [(1, notice), (1, notice), (None, notice), (2, None), (3, ""), (4, "\n\n"), (5, "license software terms " * 7000), (6, notice + "\n" + notice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "copy": F.lit("x"), "k1": F.lit(2), "lines": F.lit(0)})
    got = [r for r in licenses.scan(docs, model).collect() if r.family == "mit"]
    assert sorted((str(r.doc_id), r.paragraph) for r in got) == [("1", 0), ("1", 0), ("6", 0), ("6", 1), ("None", 0)]
    assert licenses.scan(docs.limit(0), model).count() == 0
    lines = licenses.sample_lines(docs)
    assert notice in lines and len(lines) == 2 and licenses.sample_lines(docs.limit(0)) == []


def test_the_fit_sample_is_bounded_and_of_distinct_texts(spark):
    rows = [("common text\nof two lines",)] * 300 + [(f"text {k}\nits own line {k}",) for k in range(40)] + [("long " * 2_000_000,), (None,), ("",), (" \n ",)]
    lines = licenses.sample_lines(spark.createDataFrame(rows, "text string"))
    assert len(lines) == 2 + 80 + 1 and max(map(len, lines)) == licenses.SAMPLED_CHARS
