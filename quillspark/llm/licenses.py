"""Licence notices in texts: a trained paragraph classifier, scored with DataFrame functions only.

A multinomial logistic regression over word n-grams (one and two words) of a paragraph is trained on the driver, from the
templates below (whole, in pieces, and with words dropped and added) against ordinary sentences; the data never enter the training, so the model is a
constant. An L1 penalty keeps it sparse. Its temperature is fitted on variants that the training did not see. Weights are multiples of 2**-10, so that
sums don't depend on their order. A paragraph is scored by joining its n-grams with the weights (a broadcast table of fixed size). The most likely
family must be confirmed by its templates' word pairs, with an n-gram among them that no other family's templates have; a notice that isn't, or that
no family is likely enough for, is ``unknown``.

A paragraph is a line, or a run of lines, as in a hard-wrapped licence text. Only lines with an n-gram for which some family has more weight than "no notice" are
scored: without one the model itself says "no notice", so nothing is lost. A run counts as one notice where it is confirmed and its lines say nothing else.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, text_or_empty

TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Released under the Apache License 2.0",
        "This project is licensed under the terms of the Apache 2.0 license",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
    ],
    "isc": [
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "SPDX-License-Identifier: ISC",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License version 2",
        "Released under the GNU GPL version 3 or later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "Released under the GNU LGPL version 3",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "SPDX-License-Identifier: LGPL-2.1",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3",
        "Released under the GNU AGPL version 3",
        "You should have received a copy of the GNU Affero General Public License along with this program",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ],
    "epl": [
        "Licensed under the Eclipse Public License 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Available under the Creative Commons Attribution License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc0": ["Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0", "Dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication"],
    "proprietary": [
        "Copyright, all rights reserved",
        "All rights reserved",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher",
        "No part of this work may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the copyright owner",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential",
    ],
}
FAMILIES = tuple(TEMPLATES)
#: Sentences with words of notices that are none.
NEGATIVES = [
    "she got her driving licence last summer", "the licensed premises were closed by the council", "a license to print money", "copyright law is taught in the third year",
    "the apache helicopter landed on the field", "the mozilla community met in the hall", "he teaches at MIT and likes it there", "free software was handed out at the fair",
    "the warranty of the car had run out", "redistribution of wealth is a matter of politics", "the commons were creative with the budget", "they asked for permission to leave the room",
    "the eclipse was seen from the public square", "the general public was free to attend without charge", "any person may obtain a copy of the report from the office", "the source of the river is in the north",
    "this program of work is subject to the terms agreed with the union", "conditions of any kind were met and the names of all persons are in the file", "the version of events that he gave was not the one in the document",
    "the foundation published a notice that the library is closed", "the distribution of the materials to the schools was made available by the city", "the project is under way and the work is done by any means",
    "the code of conduct was released by the author of the text", "the international attribution of the painting is uncertain", "commercial use of the land was strictly prohibited by law", "the universal domain of the function is the whole of the line",
]
_WORD = r"[^a-z0-9]+"
#: Probability from which a family is named, and the share of word pairs that its templates must confirm.
LIKELY, CONFIRMED = 0.5, 0.5
_VARIANTS, _STEPS, _RATE, _SPARSE, _NONE = 24, 400, 4.0, 1e-3, 6


#: Function words: n-grams of these and of digits alone are no features.
_FUNCTION = frozenset(
    "a above all along an and any are as at be but by can do either for from has have if in into is it its may more must no nor not of on one or other our should so than that the their these this those to under up upon used via was were which whom will with without you your".split()
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def grams(text: str) -> set[str]:
    words = words_of(text)
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def _variants(rng: random.Random, n: int) -> list[tuple[str, int]]:
    """Notices and ordinary sentences with labels; the last label is none of the families."""
    fill = "the of and to in is it for on with as at by this that from are was page site text article blog document content code data work our your more than".split()
    out = []
    for label, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            for i in range(n):
                words = template.split()
                if i:
                    if len(words) > 24 and rng.random() < 0.5:  # some lines of a long text
                        size = rng.randint(16, len(words))
                        at = rng.randint(0, len(words) - size)
                        words = words[at : at + size]
                    words = [w for w in words if len(words) < 5 or rng.random() > 0.08]
                    for _ in range(rng.randint(0, 4)):
                        words.insert(rng.choice([0, len(words)]), rng.choice(fill))
                out.append((" ".join(words), label))
    for sentence in NEGATIVES:
        out += [(" ".join([*rng.sample(fill, rng.randint(0, 4)), sentence]), len(FAMILIES)) for _ in range(n // 2)]
    anchors = "license licence licensed copyright rights public free software permission version terms".split()
    for _ in range(n * 12):
        words = rng.choices(fill, k=rng.randint(4, 20)) + rng.sample(anchors, rng.randint(0, 2))
        rng.shuffle(words)
        out.append((" ".join(words), len(FAMILIES)))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(1)
def model() -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(n-grams, weights by n-gram and class, biases, inverse temperature); the same at every call."""
    rng = random.Random(17)
    train, held = _variants(rng, _VARIANTS), _variants(rng, 6)
    every = {g for family in TEMPLATES.values() for t in family for g in grams(t)} | {g for s in NEGATIVES for g in grams(s)}
    vocabulary = sorted(g for g in every if any(w not in _FUNCTION and not w.isdigit() for w in g.split()))
    number = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
        for i, (text, _) in enumerate(rows):
            x[i, [number[g] for g in grams(text) if g in number]] = 1
        return x, np.array([label for _, label in rows])

    x, y = matrix(train)
    classes = len(FAMILIES) + 1
    target, weights, bias = np.eye(classes, dtype=np.float32)[y], np.zeros((len(vocabulary), classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    bias[-1] = 1.0
    share = (1 / np.maximum(np.bincount(y, minlength=classes), 1)[y] / classes).astype(np.float32)[:, None]  # every class counts the same
    share[y == len(FAMILIES)] *= _NONE
    for _ in range(_STEPS):
        slope = (softmax(x @ weights + bias) - target) * share
        weights = weights - _RATE * (x.T @ slope)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - _RATE * _SPARSE, 0)
        bias = bias - slope.sum(axis=0)
    weights, bias = np.rint(weights.astype(np.float64) * 1024) / 1024, np.rint(bias.astype(np.float64) * 1024) / 1024
    hx, hy = matrix(held)
    loss = {t: -np.log(softmax((hx @ weights + bias) * t)[np.arange(len(hy)), hy] + 1e-12).mean() for t in (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0)}
    return vocabulary, weights, bias, min(loss, key=loss.get)


@lru_cache(1)
def evidence() -> str:
    """A pattern of the n-grams for which a family has more weight than "no notice" (words apart by what separates words)."""
    vocabulary, weights, bias, _ = model()
    if (bias[:-1] >= bias[-1]).any():  # then a paragraph without evidence might still be a notice
        raise ValueError("the model favours a family without evidence")
    found = [g for i, g in enumerate(vocabulary) if (weights[i, :-1] > weights[i, -1]).any()]
    single = {g for g in found if " " not in g}
    parts = [*sorted(single), *sorted(g.replace(" ", _WORD) for g in found if " " in g and not single & set(g.split()))]
    return f"(?<![A-Za-z0-9])(?i:{'|'.join(parts)})(?![A-Za-z0-9])"


def _weights(spark) -> DataFrame:
    """gram, one weight for each class, whether each family's templates hold the pair, and the number of the only family that has the n-gram (else null).

    At most a few thousand rows, whatever the data; they are unpacked from one literal."""
    vocabulary, weights, _, _ = model()
    held = [{g for t in TEMPLATES[f] for g in grams(t)} for f in FAMILIES]
    owners = [[c for c, h in enumerate(held) if g in h] for g in vocabulary]
    useful = [i for i, g in enumerate(vocabulary) if weights[i].any() or owners[i]]
    lines = ["\t".join([vocabulary[i], ",".join(str(float(w)) for w in weights[i]), ",".join(str(int(" " in vocabulary[i] and c in owners[i])) for c in range(len(FAMILIES))), str(owners[i][0]) if len(owners[i]) == 1 else ""]) for i in useful]
    part = lambda n: F.get(F.split("line", "\t"), F.lit(n))
    rows = spark.range(1).select(F.explode(F.split(F.lit("\n".join(lines)), "\n")).alias("line"))
    return rows.select(part(0).alias("gram"), F.split(part(1), ",").cast("array<double>").alias("w"), F.split(part(2), ",").cast("array<int>").alias("h"), part(3).try_cast("int").alias("own"))


def _grams(paragraph: Column) -> Column:
    words = F.filter(F.split(F.translate(paragraph, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _WORD), lambda w: w != "")
    pairs = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat_ws(" ", F.get(ws, i - 1), F.get(ws, i)))
    both = lambda ws: F.array_distinct(F.concat(ws, F.when(F.size(ws) > 1, pairs(ws)).otherwise(F.array().cast("array<string>"))))
    return F.element_at(F.transform(F.array(words), both), 1)


def _paragraphs(text: Column) -> Column:
    """The paragraphs to be scored, as (run, n, block, p): every line with evidence, and every run of two or more of them as a block."""
    lines = F.transform(F.split(F.replace(text, F.lit("\x00"), F.lit(" ")), "\n"), lambda p, i: F.when(p.rlike(evidence()), F.concat(i.cast("string"), F.lit(" "), p)).otherwise("\x00"))
    runs = F.filter(F.split(F.array_join(lines, "\n"), "\n?\x00[\x00\n]*"), lambda r: r != "")
    number, body = lambda x: F.regexp_extract(x, "^[0-9]+", 0).cast("int"), lambda x: F.regexp_replace(x, "^[0-9]+ ", "")

    def of(run: Column) -> Column:
        each = F.split(run, "\n")
        first = number(F.get(each, F.lit(0)))
        own = F.transform(each, lambda x: F.struct(first.alias("run"), number(x).alias("n"), F.lit(False).alias("block"), body(x).alias("p")))
        whole = F.struct(first.alias("run"), first.alias("n"), F.lit(True).alias("block"), F.array_join(F.transform(each, body), "\n").alias("p"))
        return F.when(F.size(each) > 1, F.concat(own, F.array(whole))).otherwise(own)

    none = F.array().cast("array<struct<run:int,n:int,block:boolean,p:string>>")
    return F.when(text.rlike(evidence()), F.flatten(F.transform(runs, of))).otherwise(none)


def notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, notices): ``rows`` has _id and uid of each row; ``notices`` has uid, paragraph (its first line), family, probability, confirmed."""
    spark, (_, _, bias, sharp) = docs.sparkSession, model()
    rows, _ = materialize(docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("uid"), _paragraphs(text_or_empty(text_col)).alias("found")), "licenses")
    each = rows.select("uid", F.explode("found").alias("s")).select("uid", F.col("s.run").alias("run"), F.col("s.n").alias("paragraph"), F.col("s.block").alias("block"), _grams(F.col("s.p")).alias("grams"))
    each = each.withColumn("pairs", F.size(F.filter("grams", lambda g: g.contains(" ")))).select("uid", "run", "paragraph", "block", "pairs", F.explode("grams").alias("gram"))
    sums = [F.sum(F.get("w", F.lit(c))).alias(f"w{c}") for c in range(len(bias))] + [F.sum(F.get("h", F.lit(c))).alias(f"h{c}") for c in range(len(FAMILIES))]
    sums.append(F.collect_set("own").alias("owners"))  # no more numbers than families
    scored = each.join(F.broadcast(_weights(spark)), "gram").groupBy("uid", "run", "paragraph", "block", "pairs").agg(*sums)
    logits = [(F.col(f"w{c}") + F.lit(float(b))) * sharp for c, b in enumerate(bias)]
    top = F.greatest(*logits[:-1])
    total = sum((F.exp(z - F.greatest(*logits)) for z in logits), F.lit(0.0))
    best = F.coalesce(*(F.when(z == top, F.lit(f)) for f, z in zip(FAMILIES, logits)))
    shortest = {f: max(1, min(len([g for g in grams(t) if " " in g]) for t in TEMPLATES[f])) for f in FAMILIES}
    match = F.coalesce(*(F.when(z == top, F.greatest(F.col(f"h{c}") / F.greatest(F.col("pairs"), F.lit(1)), F.least(F.col(f"h{c}") / F.lit(shortest[f]), F.lit(1.0)))) for c, (f, z) in enumerate(zip(FAMILIES, logits))))
    own = F.array_contains("owners", F.coalesce(*(F.when(z == top, F.lit(c)) for c, z in enumerate(logits[:-1]))))
    out = scored.select("uid", "run", "paragraph", "block", best.alias("best"), F.round(F.exp(top - F.greatest(*logits)) / total, 6).alias("probability"), F.round(F.exp(logits[-1] - F.greatest(*logits)) / total, 6).alias("none"), ((match >= CONFIRMED) & own).alias("confirmed"))
    out = out.where(f"none < {LIKELY}")
    family = F.when((F.col("probability") >= LIKELY) & F.col("confirmed"), F.col("best")).otherwise("unknown")
    out = out.select("uid", "run", "paragraph", "block", family.alias("family"), "probability", "confirmed")
    # a run is one notice where it is confirmed and its lines name no other family
    named = F.col("family") != "unknown"
    runs = out.groupBy("uid", "run").agg(F.max(F.when(F.col("block") & named, F.col("family"))).alias("whole"), F.array_sort(F.collect_set(F.when(~F.col("block") & named, F.col("family")))).alias("lines"))
    as_one = runs.select("uid", "run", (F.col("whole").isNotNull() & (F.size(F.array_remove("lines", F.col("whole"))) == 0)).alias("as_one"))
    out = out.join(as_one, ["uid", "run"]).where("block = as_one")
    return rows.select("_id", "uid"), out.select("uid", "paragraph", "family", "probability", "confirmed")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, probability, confirmed, n_notices, licenses): one row for each row of ``docs``.

    license is the family of the likeliest notice, a named one before an unknown one and then the earlier one; null without a notice. licenses
    lists all different families. Null and empty texts have none; very long texts are read whole; of families that are equally likely the first in FAMILIES is
    taken; null and repeated ids keep their rows; other columns are ignored; an empty table gives an empty result.
    """
    rows, found = notices(docs, id_col, text_col)
    named = F.struct((F.col("family") != "unknown").alias("named"), F.col("probability"), (-F.col("paragraph")).alias("at"), F.col("family"), F.col("confirmed"))
    by = found.groupBy("uid").agg(F.max(named).alias("b"), F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licenses"))
    return rows.join(by, "uid", "left").select(F.col("_id").alias(id_col), F.col("b.family").alias("license"), F.col("b.probability").alias("probability"), F.coalesce("b.confirmed", F.lit(False)).alias("confirmed"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("licenses", F.lit("")).alias("licenses"))
