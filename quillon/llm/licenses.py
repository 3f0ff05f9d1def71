"""Licence paragraphs by a sparse word n-gram logistic regression (operator 6), with Spark expressions only.

A paragraph is a line, with the lines after it as long as each but the last is a wrapped one: at most ``WRAP`` letters
long, without a mark of a sentence's end, and followed by a line with text. It is judged sentence by sentence. Features are n-grams of one to three
words, the sentence's begin and end among them, with weights in the model, which is multinomial with "unknown" as a class of its own. The model is trained on
``training_rows``: notices, and statements made of sentence patterns and licence names, against sentences that use the same words otherwise, and
against ``MENTIONS``: sentences that name a licence and give none (questions, denials, comparisons, talk about it). So a name alone is
no notice unless it is the whole sentence, as in a heading. Every fifth pattern and notice, and every fifth name, is left out of the fit as a whole and sets the temperature; another
fifth of both is left out where figures for wordings and names that were never seen are wanted (``held_out``). The penalty leaves few n-grams a weight; ``marks`` is a set of words such that each
n-gram that speaks for a family has one. A paragraph without a mark can't be judged other than unknown, so only texts and paragraphs
with a mark are cut into words. A prediction counts if the class is a family, its probability is at least ``SURE``, and one template of that family
confirms it both ways: at least ``ALIKE`` of the template's word pairs are in the sentence, and at least ``OWN`` of the sentence's in the template.

Null and empty texts have no paragraphs. Each row of ``documents`` has one result row (rows that repeat an id share
findings); null ids stay, without findings. Equal probabilities: the first family by name. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import spread_join, table

#: A notice counts as much as so many other rows, of which there are more.
NOTICE_WEIGHT = 1.5
SURE, ALIKE, OWN, UNKNOWN, WRAP = 0.5, 0.4, 0.2, "unknown", 120
#: Where a sentence ends, and the words that stand for a sentence's begin and end.
SENTENCES = r"(?<=[.!?;][\"')\]]?)\s+(?=[\"'(\[]*[A-Z])"
BEGIN, END = "^", "$"
#: Short public notices of licence families, and plain sentences that use words of theirs.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This software is distributed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the two-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GPL version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL v3.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the LGPL version 3 or later.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Free and unencumbered software released into the public domain by its authors.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
    ],
    "Proprietary": [
        "Copyright. All rights reserved.",
        "All rights reserved.",
        "Copyright 2019 by the authors. All rights reserved worldwide.",
        "This material is proprietary and confidential. All rights reserved.",
        "No part of this document may be reproduced without prior written permission of the publisher.",
        "All rights reserved. No part of this publication may be reproduced or transmitted in any form without prior written permission.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
    UNKNOWN: [
        "He renewed his driving license last week and paid the fee.",
        "The apache helicopter landed near the public road.",
        "She asked for permission to use the software at work.",
        "The court found that the copyright had expired.",
        "Students at MIT published a paper on version control.",
        "The general said the public would not accept the terms.",
        "The bar lost its license after a complaint.",
        "Free software is the subject of this chapter.",
        "The author reserved a table for two.",
        "A creative team works in the commons building.",
        "The foundation gave a grant to the library.",
        "All rights and duties follow from the contract.",
        "Please include the following conditions in the notice.",
        "The source of the river is hard to obtain.",
        "This version of the story is distributed by mail.",
        "The term license can mean many things.",
        "We discussed attribution of the painting to the artist.",
        "The new release of the album sold well.",
        "Use the left lane without restriction after eight.",
        "A person may copy the list for any purpose.",
    ],
}


#: Names and identifiers of the families' licences.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache Software License", "Apache-2.0", "Apache License"],
    "MIT": ["MIT License", "MIT", "MIT license (MIT)", "MIT/X11 license", "Expat License", "MIT-style license"],
    "BSD": ["BSD 3-Clause License", "BSD license", "two-clause BSD license", "New BSD License", "Simplified BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD-style license"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3", "GNU GPL v3", "GPL version 2 or later", "GPLv3", "GPLv2", "GPL", "GPL-3.0-or-later", "GPL-2.0-only"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL version 3 or later", "LGPLv3", "LGPL", "LGPL-2.1-or-later", "GNU Library General Public License"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL version 3", "AGPLv3", "AGPL", "AGPL-3.0-or-later", "AGPL-3.0-only"],
    "MPL-2.0": ["Mozilla Public License", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0", "MPL"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0": ["CC0 1.0 Universal", "CC0", "CC0-1.0", "Creative Commons Zero", "CC0 public domain dedication"],
    "ISC": ["ISC License", "ISC", "ISC license (ISC)"],
    "Unlicense": ["Unlicense", "Unlicense license"],
}
#: Licences of no family, which are unknown.
OTHERS = [
    "Eclipse Public License", "EPL-2.0", "zlib License", "Artistic License 2.0", "Boost Software License", "EUPL-1.2", "CDDL-1.0", "PostgreSQL License", "WTFPL", "Python license",
    "Microsoft Public License", "SIL Open Font License", "Open Data Commons license", "driving license", "house rules", "contract", "treaty", "city license", "fishing license",
]
#: What is said of a licence.
PATTERNS = [
    "{}", "Licensed under the {}.", "Released under {}.", "This software is distributed under the terms of the {}.", "Available under the {}.",
    "{}.", "License: {}", "This project is released under the {} license.", "Available under {}", "Distributed under the {}.",
    "SPDX-License-Identifier: {}", "Released under the {}.", "Published under {}.", "This library is covered by the {}.", "You may use this file under the terms of the {}.",
    "Licensed under {}", "The {}", "This work is licensed under the {}.", "All content is provided under {}.", "This program is free software under the {}.",
    "Its source is licensed under the {} unless stated otherwise.", "License {}", "The code is made available under the {}, see LICENSE for details.", "License :: {}", "Code license: {}",
    "SPDX-License-Identifier: ({})", "Licensed {}", "Subject to the terms and conditions of the {}.", "license = {}", "SPDX identifier {} in this file",
    "License identifier: {}", "For terms see the {}.", "We put all of this under the {}, so go ahead.", "See the {} for what you may do.", "This file is part of a project that is licensed under the {}, and so are its tests.",
    "Shared by us under {}",
]
#: Sentences that name a licence and give none.
MENTIONS = [
    "Do not use the {} for this work.", "Our talk explains why the {} matters to courts.", "This code is not licensed under the {}.", "The {} movement", "What does the {} require?",
    "We compared the {} with other licenses.", "Is it released under the {}?", "Students read the {} in class.", "A lawyer explained the {} to us.", "It was once under the {} but no longer is.",
    "She wrote a book about the {}.", "The {} was written in those years.", "Few people understand the {}.", "He asked whether it is licensed under the {}.", "Unlike the {} this one has no such clause.",
    "The history of the {} is long.", "This is not released under the {}.", "Never licensed under the {}.", "Should we choose the {} for the project?", "They moved away from the {} last year.",
    "Why is the {} so popular?", "The {} is often confused with others.", "Nobody here likes the {}.", "An article on the {} appeared today.", "The court read the {} in another way.",
    "Some say that the {} is too strict.", "Code under the {} cannot be used here.", "We refuse to accept the {}.", "The talk on {} begins at nine.", "{} explained in five minutes",
    "Let us discuss {} and its problems.", "You can't combine it with the {}.", "The difference between the {} and another one", "Nothing in this file is under the {}.", "It isn't distributed under the {}.",
    "The authors of the {} met in spring.", "Our company bans the {}.", "Have you read the {}?", "I would rather have the {} than this.", "The text of the {} has many words.",
    "Before 2010 it was distributed under the {}.", "No part of it is covered by the {}.", "They considered the {} and chose something else.", "Critics of the {} disagree.", "If it were under the {} we could use it.",
    "That is against the {}.", "This guide teaches the {} step by step.", "The {} and you", "News about the {}", "He never heard of the {}.",
    "This is not under the {}.", "It is not under the {}.", "Not licensed under the {}.", "We love the {}", "I like the {} a lot.", "This work is not licensed under the {}.", "The {} rules", "Our lawyers dislike the {}.",
    "This does not fall under the {}.", "No code here is under the {}.",
]
#: The same for statements of rights.
CLAIMS = [
    "All rights reserved by the {} were lost.", "The {} reserved all rights to the land.", "Not all rights are reserved to the {}.", "The {} is proprietary and nobody knows why.",
    "A confidential letter reached the {}.", "Copying of the {} was prohibited in those days.", "Are all rights reserved for the {}?", "The {} gave written permission to the visitors.",
]
OWNERS = ["queen", "king", "crown", "church", "village", "state", "family", "museum", "guild", "bank"]
#: Words that stand in most English texts, and a German one. N-grams of these alone are no features.
COMMON = frozenset([BEGIN, END]) | frozenset("a all an and any are as at be by for from in is it may not of on or see that the this to under use was with you your".split())
#: Sentences for any word.
PLAIN = [
    "They talked about the {} again.", "A {} was seen near the road.", "The old {} is gone and nobody asked.", "Some {} and other things.", "In the {} of the year it is that.",
    "Er kommt {} dem Zug und bleibt.", "We are under the {} for this.", "The {} is not the same as the first.", "It was the {} of the house.", "{}",
]
#: Between words; dots stay inside words only.
BETWEEN = r"\.*+[^a-z0-9.]++\.*+|^\.++|\.++$"


def words(text: Column) -> Column:
    """Words of a sentence between its begin and its end; none if it has no word."""
    own = F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")
    return F.when(F.size(own) > 0, F.concat(F.array(F.lit(BEGIN)), own, F.array(F.lit(END)))).otherwise(own)


def ngrams(words: str) -> Column:
    """N-grams of one to three words, each once."""
    parts = [words] + [
        f"if(size({words}) >= {n}, transform(sequence(0, size({words}) - {n}), i -> concat_ws(' ', slice({words}, i + 1, {n}))), cast(array() as array<string>))" for n in (2, 3)
    ]
    return F.expr(f"array_distinct(concat({', '.join(parts)}))")


def _cut(text: str) -> set[str]:
    return {w for w in re.split(BETWEEN, text.lower()) if w}


def plain_sentences() -> list[str]:
    """Sentences of the unknown class that aren't about a family's licence: with every word of notices that isn't part of one family's name alone."""
    said = [t for f, ts in NOTICES.items() if f != UNKNOWN for t in ts] + [p.format(n) for names in NAMES.values() for p in PATTERNS for n in names]
    named = {f: {w for n in names for w in _cut(n)} for f, names in NAMES.items()}
    own = {w for f, ws in named.items() for w in ws if not any(w in other for g, other in named.items() if g != f)}
    words = sorted({w for t in said for w in _cut(t)} - own | {"mit", "apache", "expat", "universal", "zero"})
    return [p.format(w) for p in PLAIN for w in words] + NOTICES[UNKNOWN] + [p.format(n) for p in PATTERNS for n in OTHERS]


def training_rows() -> list[tuple[str, str, str]]:
    """(family, text, use); use is fit, temperature, test, or mixed where only one of pattern and name is left out."""
    turn = lambda i: {3: "temperature", 4: "test"}.get(i % 5, "fit")

    def use(i: int, k: int) -> str:
        pattern, name = turn(i), turn(k + 1)
        return pattern if pattern == name else pattern if name == "fit" and pattern != "test" else "mixed"

    rows = [(f, t, turn(i)) for f, ts in NOTICES.items() for i, t in enumerate(ts)]
    rows += [(f, p.format(n), use(i, k)) for f, names in {**NAMES, UNKNOWN: OTHERS}.items() for i, p in enumerate(PATTERNS) for k, n in enumerate(names)]
    # each mention with every third name
    rows += [(UNKNOWN, p.format(n), use(i, k)) for names in [*NAMES.values(), OTHERS] for i, p in enumerate(MENTIONS) for k, n in enumerate(names) if (i + k) % 3 == 0]
    rows += [(UNKNOWN, p.format(n), use(i, k)) for i, p in enumerate(CLAIMS) for k, n in enumerate(OWNERS)]
    done = {t for _, t, _ in rows}
    more = [t for t in plain_sentences() if t not in done]
    return rows + [(UNKNOWN, t, turn(i * len(PLAIN) // len(more))) for i, t in enumerate(more)]


def model_rows(spark: SparkSession) -> DataFrame:
    """``training_rows`` with their n-grams and the number of their class."""
    classes = sorted(NOTICES)
    rows = json.dumps([{"family": f, "text": t, "use": u, "label": classes.index(f)} for f, t, u in training_rows()])
    made = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<family:string,text:string,use:string,label:double>>")))
    grams = F.filter(ngrams("w"), lambda g: F.size(F.array_except(F.split(g, " "), F.array(*map(F.lit, sorted(COMMON))))) > 0)
    return made.withColumn("w", words(F.col("text"))).withColumn("grams", grams)


def train(spark: SparkSession, held_out: bool = False, rows: DataFrame | None = None) -> tuple[list[tuple[str, list[float]]], dict[str, float], float]:
    """The n-grams with weights (one for each class, by name), the classes' offsets, and the temperature.

    With ``held_out`` patterns and names of the test rows are left out of the fit. ``rows`` are ``model_rows``, if they are written already.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    classes = sorted(NOTICES)
    data = (rows if rows is not None else model_rows(spark)).coalesce(1).cache()
    fit = data.where("use = 'fit'" if held_out else "use <> 'temperature'")
    counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0, vocabSize=16384).fit(fit)
    fitted = LogisticRegression(family="multinomial", regParam=0.0001, elasticNetParam=0.5, maxIter=80, standardization=False, weightCol="weight").fit(
        counts.transform(fit).select("features", "label", F.when(F.col("family") == UNKNOWN, 1.0).otherwise(NOTICE_WEIGHT).alias("weight"))
    )
    # a few hundred rows, all from this file
    left = counts.transform(data.where("use = 'temperature'")).select("features", "label")
    raw = [(list(r["rawPrediction"]), int(r["label"])) for r in fitted.transform(left).select("rawPrediction", "label").collect()]
    data.unpersist()

    def loss(t: float) -> float:
        total = 0.0
        for z, y in raw:
            top = max(z)
            total += math.log(sum(math.exp((v - top) / t) for v in z)) - (z[y] - top) / t
        return total

    temperature = min((0.04 * 1.25**k for k in range(24)), key=loss)
    matrix = fitted.coefficientMatrix.toArray()
    offsets = dict(zip(classes, map(float, fitted.interceptVector.toArray()), strict=True))
    grams = [(g, [round(float(x), 9) for x in matrix[:, j]]) for j, g in enumerate(counts.vocabulary) if abs(matrix[:, j]).max() > 1e-9]
    return grams, offsets, temperature


def marks(grams: list[tuple[str, list[float]]], offsets: dict[str, float]) -> list[str]:
    """Words without which no text is judged other than unknown.

    For each family, all n-grams without such a word, had a text them all, don't add up to what unknown is ahead by.
    """
    classes = sorted(offsets)
    of = classes.index(UNKNOWN)
    ahead = [offsets[UNKNOWN] - offsets[c] for c in classes]
    if any(a <= 0 for i, a in enumerate(ahead) if i != of):
        raise ValueError("a text without features has to be unknown")
    open_ = [(set(g.split(" ")), [max(x - w[of], 0.0) for x in w]) for g, w in grams]
    found: list[str] = []
    while True:
        total = [sum(m[i] for _, m in open_) for i in range(len(classes))]
        short = [i for i in range(len(classes)) if i != of and total[i] >= ahead[i]]
        if not short:
            return sorted(found)
        gain: dict[str, float] = {}
        for ws, m in open_:
            for w in ws:
                gain[w] = gain.get(w, 0.0) + sum(m[i] for i in short) * (1e-6 if w in COMMON else 1)
        best = max(sorted(gain), key=lambda w: gain[w])
        found.append(best)
        open_ = [x for x in open_ if best not in x[0]]


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, line, family, probability, alike) of every paragraph that is a licence notice; ``line`` is its first line."""
    spark = docs.sparkSession
    # written once, so that no later plan holds them all
    rows = table(model_rows(spark), "licence-rows")
    grams, offsets, temperature = train(spark, rows=rows)
    told = marks(grams, offsets)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def marked(text: Column) -> Column:
        return text.rlike(rf"(?i)(?<![a-z0-9])(?:{'|'.join(map(re.escape, told))})(?![a-z0-9])")

    # a wrapped line is joined to the next by \x1f, so that lines can still be counted
    wrapped = F.regexp_replace("text", rf"(?m)(?<=^|\x1f)([^\n]{{1,{WRAP - 1}}}+(?<![.:;!?\s])[ \t\r]*+)\n(?=[^\n]*+\S)", "$1\x1f")
    lines = texts.where(marked(F.col("text"))).select("doc_id", F.posexplode_outer(F.split(wrapped, "\n")).alias("number", "paragraph"))
    sentences = lines.where(marked(F.col("paragraph"))).select("doc_id", "number", F.explode(F.split("paragraph", SENTENCES)).alias("sentence"))
    found = sentences.where(marked(F.col("sentence"))).withColumn("w", words(F.col("sentence"))).where(F.arrays_overlap("w", F.array(*map(F.lit, told))))
    found = table(found.select("doc_id", F.col("number").alias("line"), "w", F.xxhash64("w").alias("key")), "licence-lines")
    # what many documents have is judged once
    confirmed = table(judge(found.groupBy("key", "w").agg(F.lit(1).alias("one")), grams, offsets, temperature, rows), "licence-paragraphs")
    met = spread_join(found, confirmed, ["key", "w"])
    best = met.groupBy("doc_id", "line").agg(F.max(F.struct("probability", "alike", "family")).alias("b"))
    return best.select("doc_id", "line", "b.family", F.round("b.probability", 6).alias("probability"), F.round("b.alike", 6).alias("alike"))


def judge(sentences: DataFrame, grams: list[tuple[str, list[float]]], offsets: dict[str, float], temperature: float, rows: DataFrame) -> DataFrame:
    """(key, w, family, probability, alike) of those of distinct sentences (key, w) that are notices."""
    spark, classes = sentences.sparkSession, sorted(offsets)
    # as many entries as the training rows have n-grams that matter
    weights = table(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"gram": g, "w": w} for g, w in grams])), "array<struct<gram:string,w:array<double>>>"))), "licence-weights")
    features = sentences.select("key", "w", F.explode(ngrams("w")).alias("gram"))
    z = F.array(*[(F.sum(F.col("weight")[i]) + offsets[c]) / temperature for i, c in enumerate(classes)])
    logits = features.join(F.broadcast(weights.withColumnRenamed("w", "weight")), "gram").groupBy("key", "w").agg(z.alias("z"))
    names = ", ".join(f"'{c}'" for c in classes)
    judged = logits.select(
        "key", "w",
        F.expr(f"element_at(array({names}), cast(array_position(z, array_max(z)) as int))").alias("family"),
        F.expr("1 / aggregate(z, 0D, (acc, x) -> acc + exp(x - array_max(z)))").alias("probability"),
    ).where((F.col("family") != UNKNOWN) & (F.col("probability") >= SURE))
    pairs = lambda w: F.expr(f"array_distinct(transform(sequence(0, size({w}) - 2), i -> concat_ws(' ', {w}[i], {w}[i + 1])))")
    known = rows.where(f"family <> '{UNKNOWN}' and size(w) > 1").select("family", pairs("w").alias("template")).distinct()
    shared = judged.withColumn("own", pairs("w")).join(F.broadcast(known), "family")
    both = F.size(F.array_intersect("own", "template"))
    shared = shared.withColumn("both", both).where((F.col("both") >= ALIKE * F.size("template")) & (F.col("both") >= OWN * F.size("own")))
    return shared.groupBy("key", "w", "family", "probability").agg(F.max(2 * F.col("both") / (F.size("own") + F.size("template"))).alias("alike"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, family, probability, n_notices, families) of every row; family is null where no notice was found."""
    got = paragraphs(docs)
    best = got.groupBy(F.col("doc_id").alias("id")).agg(
        F.max_by("family", F.struct("probability", "alike", (-F.col("line")).alias("back"))).alias("family"),
        F.max("probability").alias("probability"),
        F.count("*").alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
    )
    best = table(best, "licences")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(best, rows["doc_id"] == best["id"], "left").select("doc_id", "family", "probability", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), "families")
