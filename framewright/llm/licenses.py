"""Licence scans by a trained paragraph classifier, in DataFrame operations alone."""

from __future__ import annotations

import functools
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import keep, table

UNKNOWN = "unknown"
COPIES = 25  # training paragraphs made of each template
SIMILAR = 0.6  # share of a template's n-grams that confirms a prediction

# How licences name themselves, and the sentences that their texts and notices consist of.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-NonCommercial License.",
    ],
    "public-domain": [
        "This work has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the author. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
}
# Ordinary sentences that share words with licences.
ORDINARY = [
    "The driver showed his license to the officer before the city released him.",
    "He was granted permission to leave, free of charge, by the general.",
    "All seats for the show are reserved for the public.",
    "The version that we published last year was a copy of the original work.",
    "Human rights and the general public interest were the terms of the debate.",
    "A reserved young man asked for all the rights to the story.",
    "The foundation distributed food under the conditions of war.",
    "Creative people and the commons of the village, by attribution of tradition.",
    "The software is available in the shop at any time.",
    "Notice the list of the following items in the documentation of the museum.",
    "Under the apache helicopter the public gathered in the domain of the king.",
    "The source of the river and the form of the mountain, with or without snow.",
]
# Words too common to tell anything alone.
STOP = frozenset("a an and any are as at be been by can for from has have he if in into is it its may must not of on or shall she should that the this to was we were will with you".split())
_WORD = "[a-z0-9]+"
SENTENCE_END = r"[.!?:][\"')\]]*\s*$"


def ngrams(text: str) -> list[str]:
    """Words and pairs of neighbours, without those that only common words make up; words are runs of a-z and 0-9."""
    w = re.findall(_WORD, text.translate({c: c + 32 for c in range(65, 91)}))
    return [x for x in w if x not in STOP] + [f"{a} {b}" for a, b in zip(w, w[1:]) if a not in STOP or b not in STOP]


@dataclass(frozen=True)
class Classifier:
    families: tuple[str, ...]  # the last is unknown
    vocabulary: tuple[str, ...]
    weights: np.ndarray  # n-grams x families
    bias: np.ndarray
    threshold: float


def _variants(rng: random.Random, text: str, n: int) -> list[str]:
    """The text with words left out, others put in, and ordinary words around it."""
    noise = lambda k: ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, k))]
    out = [text]
    for _ in range(n - 1):
        words = [w for w in text.split() if rng.random() > rng.choice([0, 0, 0.1, 0.2])]
        for x in noise(2):
            words.insert(rng.randint(0, len(words)), x)
        out.append(" ".join(noise(6) + words + noise(6)))
    return out


def _parts(rng: random.Random, text: str, n: int) -> list[str]:
    """Parts of the text such as a line break after a sentence leaves."""
    words, out = text.split(), []
    for _ in range(n if len(words) >= 16 else 0):
        size = rng.randint(8, len(words) - 1)
        at = rng.choice([0, len(words) - size, rng.randint(0, len(words) - size)])
        out.append(" ".join(words[at : at + size]))
    return out


@functools.lru_cache(maxsize=2)
def trained(copies: int = COPIES, seed: int = 5, penalty: float = 2e-4, rounds: int = 250) -> Classifier:
    """Multinomial logistic regression with an L1 penalty (proximal gradient), on paragraphs made of the templates.

    The probability that a family must reach is set on held-out paragraphs: so high that at most one in
    500 ordinary ones does, and at least 0.5.  What falls short is unknown.
    """
    rng = random.Random(seed)
    families = (*TEMPLATES, UNKNOWN)
    texts = [(t, k) for k, f in enumerate(TEMPLATES) for x in TEMPLATES[f] for t in (*_variants(rng, x, copies), *_parts(rng, x, copies // 2))]
    words = [w for f in TEMPLATES for x in TEMPLATES[f] for w in x.split()] + [w for x in ORDINARY for w in x.split()]
    other = [t for x in ORDINARY for t in _variants(rng, x, copies)]
    other += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(20 * copies)]
    texts += [(t, len(families) - 1) for t in [*other, *[""] * copies]]
    rng.shuffle(texts)
    vocabulary = tuple(sorted({g for f in TEMPLATES for x in TEMPLATES[f] for g in ngrams(x)}))
    index = {g: i for i, g in enumerate(vocabulary)}
    x, y = np.zeros((len(texts), len(vocabulary))), np.array([k for _, k in texts])
    for i, (t, _) in enumerate(texts):
        x[i, [index[g] for g in set(ngrams(t)) if g in index]] = 1
    cut = len(texts) * 4 // 5
    hot = np.eye(len(families))[y]
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    step = 4.0 / np.mean((x[:cut] ** 2).sum(1) + 1)
    for _ in range(rounds):
        p = _softmax(x[:cut] @ w + b)
        d = (p - hot[:cut]) / cut * len(families)
        w -= step * (x[:cut].T @ d)
        b -= step * d.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
    p = _softmax(x[cut:] @ w + b)[:, :-1].max(1)[y[cut:] == len(families) - 1]
    return Classifier(families, vocabulary, w, b, float(max(0.5, np.quantile(p, 0.998))))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(f"({_WORD})"), F.lit(1))


def _predicted(z: Column, families: int, threshold: float) -> Column:
    """(k, probability) of the likeliest of all families but the last, unknown; null if that is likelier or the threshold isn't reached."""
    top = F.array_max(z)
    odds = 1 / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    k = F.array_position(z, top) - 1
    return F.when((k < families - 1) & (odds >= threshold), F.struct(k.alias("k"), odds.alias("probability")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int = COPIES, similar: float = SIMILAR) -> DataFrame:
    """One row per paragraph that carries a licence: doc_id, line_no, last_line_no, family, probability, template, similarity, confirmed.

    A sparse word n-gram logistic regression predicts a licence family, or unknown, for the paragraphs of the whole text; those
    predicted unknown have no row.  A paragraph is a run of lines, none blank, of which only the last ends as a sentence does, so a
    wrapped licence is one; but if lines of it are predicted on their own and not all as the run is, each such line is.
    Paragraphs of one family that follow each other are one.  confirmed: the paragraph has at least the share `similar` of
    the n-grams of some template of that family; template is the one of these that it has most n-grams of, or else the one of
    which it has the largest share, of ties the first; line_no and last_line_no (from 0) are its first and last line that has any of them.  Lines without an n-gram
    that the model knows are unknown by training and part paragraphs.  Null and empty texts have no rows; null ids and repeated
    rows are scanned like others; an empty table gives an empty result; other columns are ignored.

    The model (about a thousand n-grams, whatever the input) is the only thing sent to the tasks.
    """
    spark = docs.sparkSession
    model = trained(copies)
    names, n = model.families[:-1], len(model.families)
    vectors = spark.createDataFrame(
        [(g, [float(v) for v in row]) for g, row in zip(model.vocabulary, model.weights)], "gram string, w array<double>"
    )
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    single = [g for g in model.vocabulary if " " not in g]
    lines = text.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.select("row", "doc_id", "line_no", _words(F.col("line")).alias("words"), F.col("line").rlike(SENTENCE_END).alias("ends"))
    # every n-gram of the model holds a word that it knows alone, or the line has none of them
    lines = lines.filter(F.arrays_overlap("words", F.array(*map(F.lit, single))))
    pairs = F.expr("transform(sequence(1, size(words) - 1), i -> concat_ws(' ', words[i - 1], words[i]))")
    grams = F.array_distinct(F.when(F.size("words") > 1, F.concat("words", pairs)).otherwise(F.col("words")))
    known = lines.select("row", "doc_id", "line_no", "ends", F.explode(grams).alias("gram")).join(F.broadcast(vectors), "gram")
    sums = [F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(n)]
    found = known.groupBy("row", "doc_id", "line_no", "ends").agg(*sums, F.collect_set("gram").alias("grams"))
    biased = lambda z: F.array(*(z(k) + F.lit(float(model.bias[k])) for k in range(n)))
    found = found.withColumn("alone", _predicted(biased(lambda k: F.col(f"z{k}")), n, model.threshold))
    order = Window.partitionBy("row").orderBy("line_no")
    begins = F.coalesce((F.col("line_no") > F.lag("line_no").over(order) + 1) | F.lag("ends").over(order), F.lit(True))
    found = found.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order))
    runs = found.groupBy("row", "doc_id", "run").agg(
        *(F.sum(f"z{k}").alias(f"z{k}") for k in range(n)), F.collect_set("alone.k").alias("kinds"), F.collect_list(F.struct("line_no", "grams", "alone")).alias("lines")
    )
    runs = runs.withColumn("whole", _predicted(biased(lambda k: F.col(f"z{k}")), n, model.threshold))
    fits = F.col("whole").isNotNull() & (F.size(F.array_except("kinds", F.array("whole.k"))) == 0)
    apart = F.transform(F.filter("lines", lambda x: x["alone"].isNotNull()), lambda x: F.struct(x["alone"].alias("as"), F.array(F.struct(x["line_no"], x["grams"])).alias("lines")))
    whole = F.array(F.struct(F.col("whole").alias("as"), F.transform("lines", lambda x: F.struct(x["line_no"], x["grams"])).alias("lines")))
    # few paragraphs are left: what follows is worked out on them alone
    units = keep(runs.select("row", "doc_id", F.explode(F.when(fits, whole).otherwise(apart)).alias("u")).select("row", "doc_id", "u.as.k", "u.as.probability", "u.lines"))
    units = units.withColumn("first", F.array_min("lines.line_no")).withColumn("last", F.array_max("lines.line_no"))
    order = Window.partitionBy("row").orderBy("first")
    begins = F.coalesce((F.col("first") > F.lag("last").over(order) + 1) | (F.col("k") != F.lag("k").over(order)), F.lit(True))
    units = units.withColumn("begins", begins.cast("int")).withColumn("unit", F.sum("begins").over(order))
    units = units.groupBy("row", "doc_id", "unit", "k").agg(F.max("probability").alias("probability"), F.flatten(F.collect_list("lines")).alias("lines"))
    units = units.withColumn("grams", F.array_distinct(F.flatten("lines.grams")))
    rows = [(k, f, i, x, sorted(set(ngrams(x)))) for k, f in enumerate(names) for i, x in enumerate(TEMPLATES[f])]
    templates = spark.createDataFrame(rows, "k long, family string, n int, template string, own array<string>")
    common = F.size(F.array_intersect("grams", "own"))
    share = common / F.size("own")
    near = F.transform(F.filter("lines", lambda x: F.arrays_overlap(x["grams"], F.col("own"))), lambda x: x["line_no"])
    best = F.struct((share >= similar).alias("ok"), F.when(share >= similar, common).alias("common"), share.alias("share"), (-F.col("n")).alias("n"), "template", F.array_min(near).alias("first"), F.array_max(near).alias("last"), "family")
    held = units.join(F.broadcast(templates), "k").groupBy("row", "doc_id", "unit", "probability").agg(F.max(best).alias("best"), F.min(F.array_min("lines.line_no")).alias("first"))
    return held.select(
        "doc_id", F.coalesce("best.first", "first").alias("line_no"), F.coalesce("best.last", "first").alias("last_line_no"), "best.family",
        F.round("probability", 6).alias("probability"), "best.template", F.round("best.share", 6).alias("similarity"), F.col("best.ok").alias("confirmed"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
