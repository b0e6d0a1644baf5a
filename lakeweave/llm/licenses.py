"""Licence scan: a trained paragraph classifier, in DataFrame functions only.

A paragraph ends at a blank line, or where a line ends a sentence, so that wrapped
notices are one.  Its distinct word uni-, bi- and trigrams are scored by a sparse
multinomial logistic regression over the licence families, ``unknown`` (licence
language of no family here) and ``none`` (anything else).  Probabilities are
calibrated by a temperature fitted on notices left out; ``confirmed`` says that the
paragraph covers one of the family's template notices too.

Every paragraph is classified, and those of class ``none`` have no row.  The trained
weights bound what the words of a text can add (see ``potentials``); texts and paragraphs
whose words can't bring them out of class ``none`` are not cut into n-grams.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.bottomk import let

UNKNOWN, NONE = "unknown", "none"
#: Notices by family: what licences ask to be put into a work, and common short forms.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0.",
    ),
    "mit": (
        "Released under the MIT License.",
        "MIT License",
        "This code is MIT licensed.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software")',
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU General Public License version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GNU GPL v3.",
        "Distributed under GPLv3.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "Licensed under CC0 1.0.",
        "This work is dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Inc. All rights reserved.",
        "Confidential and proprietary. All rights reserved.",
    ),
}
#: Licence language of no family above.
UNLISTED = (
    "Licensed under the Eclipse Public License v2.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "SPDX-License-Identifier: EPL-2.0",
    "Distributed under the Boost Software License, Version 1.0.",
    "SPDX-License-Identifier: BSL-1.0",
    "This software is provided 'as-is', without any express or implied warranty.",
    'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
    "in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
    "Released under the Artistic License 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "Released under a custom license.",
    "Licensed under the terms in the file LICENSE.",
    "See the LICENSE file for details.",
    "Use of this source code is governed by a license that can be found in the LICENSE file.",
    "Distributed under the license agreement that comes with the package.",
)
#: Paragraphs that use the terms, or words of licence names, and grant nothing.
OTHER = (
    "He renewed his driving licence at the office in the city.",
    "A new licence plate was put on the car.",
    "The lecture treats the history of copyright law in three countries.",
    "The shop lost its liquor licence after the inspection.",
    "Many pictures of the museum are said to be in the public domain by now, others are not.",
    "The company licenses music to broadcasters and collects the fees.",
    "The copyright office answered the letter after a year.",
    "Without a license nobody may fish in the lake.",
    "An article on the gnu and other animals of the savanna.",
    "Software licensing costs rose in the last year.",
    "The creative commons of the village were a meadow and a well.",
    "She asked which license the package has, and nobody knew.",
    "The driver had no license with him, and the pilot's license was renewed later.",
    "Er fuhr mit dem Zug und kam mit dem Bus zurück.",
    "The house by the lake was sold by the owner.",
    "Version 2.0 of the plan was published by the city, and version 3 follows.",
    "All seats are reserved for the members.",
    "The public was asked for permission.",
    "The program is free for all persons under the age of ten.",
    "Apache tribes lived in the public lands, and the Mozilla browser was not known.",
    "Redistribution of income is the subject of the general debate.",
    "International work on a common source of the data goes on under new terms.",
)
#: Unlabelled paragraphs of the corpus that are fitted as ``none``, at most, from as many documents as
#: a quarter of it, chosen by hash; those with one of ``TERMS`` are left out.
MAX_NEGATIVES = 400
TERMS = ("licens", "licenc", "copyright", "reserved", "public domain", "creative commons", "permission", "redistribut", "spdx", "gnu ", "warrant")
CONFIRMED = 0.6
#: N-grams of the vocabulary that a paragraph counts as having at least: fewer are little evidence.
LEAST_NORM = 4
#: Words in more than this share of the sampled corpus paragraphs are common.
COMMON = 0.003
PROBABLE = 0.5
#: Ends of paragraphs: a blank line, or a line end after a sentence.
PARAGRAPH = r"(?:(?<=[.!?])[ \t\r]*\n|\n[ \t\r]*\n)\s*"


def tokens(paragraph: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), "")


def grams(words: Column, most: int = 3) -> Column:
    """The distinct n-grams of a word array up to ``most`` words, joined by spaces."""

    def several(n: int) -> Column:
        if n == 1:
            return words
        at = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))
        return F.when(F.size(words) >= n, at).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[several(n) for n in range(1, most + 1)]))


def notice_grams(notice: str, most: int = 2) -> list[str]:
    """The n-grams of a template, as ``grams`` gives them."""
    import re

    words = re.findall(r"[^\W_]+", notice.lower())
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)))


@dataclass
class Model:
    """Classes (families, unknown, none), the n-grams with a weight, weights by n-gram (the last
    row is the intercept) and class, the temperature, and the words' potentials."""

    classes: list[str]
    vocabulary: list[str]
    weights: np.ndarray
    temperature: float
    potentials: dict[str, float]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 400, rate: float = 4.0, l1: float = 2e-4) -> np.ndarray:
    """Multinomial logistic regression by proximal gradient steps; the L1 penalty leaves few
    weights.  Classes weigh the same.  The last column of ``x`` is the intercept."""
    own, out = np.ascontiguousarray(x, np.float32), np.zeros((x.shape[1], classes), np.float32)
    weight = ((1 / np.bincount(y, minlength=classes).clip(1))[y][:, None] / classes).astype(np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    for _ in range(rounds):
        out -= rate * (own.T @ (weight * (softmax(own @ out) - target)))
        out[:-1] = np.sign(out[:-1]) * np.maximum(np.abs(out[:-1]) - rate * l1, 0)
    return out.astype(float)


def potentials(vocabulary: list[str], weights: np.ndarray, rarity: dict[str, int]) -> dict[str, float]:
    """What each word can add to a paragraph's way out of class ``none`` (the last); below 1 in
    sum, a paragraph is of that class.

    A class beats ``none`` only if its n-grams' weights above those of ``none`` sum up to what
    ``none`` has more as intercept, times the root of ``LEAST_NORM``, which sums are divided by
    at least.  An n-gram's weight is put on its rarest word, without which it can't be there.
    Empty, for no filter, where an intercept alone suffices.
    """
    need = (weights[-1, -1] - weights[-1, :-1]) * np.sqrt(LEAST_NORM)
    if (need <= 1e-6).any():
        return {}
    above, own = np.maximum(weights[:-1, :-1] - weights[:-1, -1:], 0), {}
    for i, g in enumerate(vocabulary):
        word = min(g.split(), key=lambda w: (rarity.get(w, 0), -len(w), w))
        own[word] = own.get(word, 0) + above[i]
    out = {w: float(np.ceil((v / need).max() * 1e6 + 1) / 1e6) for w, v in own.items()}
    return {w: v for w, v in sorted(out.items()) if v > 2e-6} or {"": 0.0}


def examples(plain: list[str]) -> list[tuple[str, str, int]]:
    """``(paragraph, class, group)``: the notices, alone and amid words of the corpus, and as ``none``
    the other uses, the paragraphs ``plain``, and loose words of notices amid words of the corpus."""
    notices = [(t, f) for f, ts in TEMPLATES.items() for t in ts] + [(t, UNKNOWN) for t in UNLISTED] + [(t, NONE) for t in OTHER]
    fill = [" ".join(p.split()[:6]) for p in plain][:40] or ["the work of the year", "see the other page"]
    rows = [(t, f, i) for i, (t, f) in enumerate(notices)]
    rows += [(f"{fill[(i + 11 * k) % len(fill)]} {t} {fill[(7 * i + k + 3) % len(fill)]}", f, i) for i, (t, f) in enumerate(notices) for k in (0, 1)]
    words = sorted({w for t, _ in notices for w in notice_grams(t, 1)})
    loose = [[words[i], *(words[(k * i + 3) % len(words)] for k in range(5, 5 + i % 3))] for i in range(len(words))]
    rows += [(f" {fill[i % len(fill)]} ".join(w), NONE, len(rows) + i) for i, w in enumerate(loose)]
    return rows + [(p, NONE, len(rows) + i) for i, p in enumerate(["", *plain])]


def fit_model(rows: list[tuple[str, str, int]], found: list[list[str]], plain: int) -> Model:
    """The model of ``examples`` with the n-grams ``found`` in them, the last ``plain`` of the corpus."""
    classes = [*TEMPLATES, UNKNOWN, NONE]
    # n-grams of the notices, but for those of common words alone; the corpus' own words are not features
    rarity = Counter(g for own in found[len(found) - plain :] for g in own)
    notices = [*(t for ts in TEMPLATES.values() for t in ts), *UNLISTED, *OTHER]
    vocabulary = sorted({g for t in notices for g in notice_grams(t, 3) if any(rarity[w] <= COMMON * plain for w in g.split())})
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
    for i, own in enumerate(found):
        known = [place[g] for g in own if g in place]
        x[i, known] = 1 / np.sqrt(max(LEAST_NORM, len(known)))
        x[i, -1] = 1
    y, group = np.array([classes.index(f) for _, f, _ in rows]), np.array([g for _, _, g in rows])
    out = np.zeros((len(y), len(classes)))
    for k in range(4):
        fold = group % 4 == k
        out[fold] = x[fold] @ fit(x[~fold], y[~fold], len(classes))
    loss = {t: -np.log(softmax(out / t)[np.arange(len(y)), y] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8)}
    weights = np.round(fit(x, y, len(classes)), 6)
    used = np.flatnonzero(weights[:-1].any(1))
    kept = [vocabulary[i] for i in used]
    weights = np.concatenate([weights[used], weights[-1:]])
    return Model(classes, kept, weights, min(loss, key=loss.get), potentials(kept, weights, rarity))


def train(spark: SparkSession, docs: DataFrame | None = None, text: str = "text") -> Model:
    """Fits on ``examples`` with up to ``MAX_NEGATIVES`` corpus paragraphs without a term.  A notice's
    variants are left out together for the temperature."""
    plain: list[str] = []
    if docs is not None:
        few = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).orderBy(F.xxhash64("text")).limit(MAX_NEGATIVES // 4)
        rows = few.select(F.explode(F.split("text", PARAGRAPH)).alias("p")).where((F.trim("p") != "") & ~contains_any(F.lower("p"), TERMS))
        plain = [r[0] for r in rows.distinct().orderBy(F.xxhash64("p"), "p").limit(MAX_NEGATIVES).collect()]
    every = examples(plain)
    frame = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(every)], "i int, t string").coalesce(1)
    found = [r[1] for r in sorted(frame.select("i", let(tokens(F.col("t")), lambda w: grams(w))).collect())]
    return fit_model(every, found, len(plain))


def constant(values, kind: str = "string", between: str = "\n") -> Column:
    """A literal array, parsed once when the plan is made."""
    return F.split(F.lit(between.join(map(str, values))), between).cast(f"array<{kind}>")


def contains_any(column: Column, words) -> Column:
    found = F.lit(False)
    for word in reversed(words):
        found = F.contains(column, F.lit(word)) | found
    return found


def scored(paragraphs: DataFrame, model: Model) -> DataFrame:
    """Adds ``best, probability, similarity`` to ``paragraphs(paragraph)``: the most probable class,
    its probability, and the largest share of a template of it that the paragraph covers."""
    n = len(model.classes)
    vocabulary, weights = constant(model.vocabulary), constant([f"{v:.6f}" for v in model.weights[:-1].ravel()], "double")
    base = F.array(*[F.lit(float(v)) for v in model.weights[-1]])
    names = constant(model.classes)

    def scores(places: Column, table: Column) -> Column:
        norm = F.sqrt(F.greatest(F.size(places), F.lit(LEAST_NORM)).cast("double"))
        return F.transform(base, lambda b, k: (F.aggregate(places, F.lit(0.0), lambda s, i: s + F.get(table, i * n + k)) / norm + b) / F.lit(model.temperature))

    def best(s: Column) -> Column:
        top = F.array_max(s)
        share = let(top, lambda m: F.aggregate(s, F.lit(0.0), lambda t, v: t + F.exp(v - m)))
        return F.struct(F.element_at(names, F.array_position(s, top).cast("int")).alias("best"), (F.lit(1.0) / share).alias("probability"))

    def covered(own: Column, name: Column) -> Column:
        out = F.lit(0.0)
        for family, notices in TEMPLATES.items():
            shares = [F.size(F.array_intersect(constant(g), own)) / F.lit(float(len(g))) for g in map(notice_grams, notices)]
            out = F.when(name == family, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(out)
        return out

    def verdict(own: Column) -> Column:
        places = let(vocabulary, lambda v: F.transform(F.array_intersect(own, v), lambda g: (F.array_position(v, g) - 1).cast("int")))
        found = let(places, lambda p: let(weights, lambda t: let(scores(p, t), best)))
        return let(found, lambda v: F.struct(v["best"].alias("best"), v["probability"].alias("probability"), covered(own, v["best"]).alias("similarity")))

    # bound step by step, so that the expression doesn't grow where a later filter is pushed into it
    df = paragraphs.withColumn("_v", let(let(tokens(F.col("paragraph")), lambda w: grams(w)), verdict))
    return df.select(*paragraphs.columns, "_v.*")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None, filtered: bool = True) -> DataFrame:
    """Licence paragraphs of ``docs``: ``key, position, family, probability, similarity, confirmed``.

    One row for each paragraph that is not of class ``none``; ``position`` counts a text's
    paragraphs from 0.  ``family`` is ``unknown`` where no family has a probability of
    ``PROBABLE``; of classes that score alike the first counts.  Null, empty and blank
    texts have no rows, an empty table none; null and repeated keys are kept, each row for
    itself; paragraphs of any length are scored whole; other columns are not read.
    Nothing is shuffled.  ``filtered=False`` scores all paragraphs by their n-grams, to the
    same result.
    """
    model = model or train(docs.sparkSession, docs, text)

    def may(column: str) -> Column:
        if not filtered or not model.potentials:
            return F.length(column) > 0
        names, values = constant(model.potentials), constant(model.potentials.values(), "double")
        known = F.array_intersect(tokens(F.col(column)), names)
        return F.aggregate(known, F.lit(0.0), lambda s, w: s + F.get(values, (F.array_position(names, w) - 1).cast("int"))) >= 1

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(may("text"))
    paragraphs = rows.select("key", F.posexplode(F.split("text", PARAGRAPH)).alias("position", "paragraph")).where(may("paragraph"))
    found = scored(paragraphs, model).where(F.col("best") != NONE)
    known = (F.col("best") != UNKNOWN) & (F.col("probability") >= PROBABLE)
    return found.select(
        F.col("key").alias(key),
        "position",
        F.when(known, F.col("best")).otherwise(UNKNOWN).alias("family"),
        F.round("probability", 6).alias("probability"),
        F.round("similarity", 6).alias("similarity"),
        (known & (F.col("similarity") >= CONFIRMED)).alias("confirmed"),
    )
