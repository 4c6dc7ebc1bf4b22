"""Licence notices in documents: a trained window classifier, confirmed by templates.

Paragraphs are lines. Their words and pairs of neighbouring words are counted into a
sparse vector, and a multinomial logistic regression gives the probability of every
kind of licence and of "unknown". It learns kinds from windows of the templates below
and "unknown" from a bounded sample of the corpus's own distinct paragraphs that are
unlike all templates. On a part held back, the scale of the scores is fitted, so that
a probability means what it says.

A paragraph is scored whole and, where a notice can be, in windows of the lengths that
templates have and of lengths between, so a notice is found inside a longer line. A
window that is confirmed has most pairs of a template, so it has one of any part of
them that is large enough: of each template the pairs with the longest words are its
anchors, and only windows with an anchor are looked at. Lines are cut into overlapping
segments first, so the work grows with a line's length. A kind that wins is
compared with its templates in both directions: the share of the window's word pairs
that the kind's templates have, and the share of a template's that the window has.
Names, versions and variants (nc, nd, sa, lesser, affero, 2 or 3) must be the same in
both, and none may stand right outside the window.

Everything runs on DataFrame functions and Spark ML.
"""

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fieldspark.llm.common import ids_and_texts, let
from fieldspark.storage import cut_lineage

UNKNOWN = "unknown"
# Ways to name a licence in a notice.
PATTERNS = [
    "{}",
    "Licensed under {}.",
    "Licensed under the {}.",
    "Released under the {}.",
    "Available under the {}.",
    "This work is licensed under the {}.",
    "This project is licensed under the terms of the {}.",
    "This software is distributed under the terms of the {}.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the {}",
]


def _creative_commons():
    """Names of the six licences in the versions 2.0 to 4.0."""
    variants = {
        "by": "Attribution",
        "by-nc": "Attribution-NonCommercial",
        "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
        "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
        "by-nd": "Attribution-NoDerivatives",
        "by-sa": "Attribution-ShareAlike",
    }
    for code, name in variants.items():
        for version, port in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            yield f"cc-{code}-{version}", (
                "cc",
                [f"Creative Commons {name} {version} {port} License", f"CC {code.upper()} {version}"],
                [
                    f"This work is licensed under a Creative Commons {name} {version} {port} License.",
                    f"This work is licensed under a Creative Commons {name} {version} License.",
                    f"http://creativecommons.org/licenses/{code}/{version}/",
                ],
            )


def _gnu():
    """Names and notices of the general, lesser and affero licences."""
    for code, name, versions in (
        ("gpl", "General", ("2", "3")),
        ("lgpl", "Lesser General", ("2.1", "3")),
        ("agpl", "Affero General", ("3",)),
    ):
        for version in versions:
            full = f"GNU {name} Public License"
            spdx = f"{code.upper()}-{version if '.' in version else version + '.0'}"
            yield spdx.lower(), (
                "gnu",
                [
                    f"{full}, version {version}",
                    f"{full} v{version}",
                    f"{code.upper()} v{version}",
                    f"{code.upper()}v{version}",
                    f"GNU {code.upper()} version {version}",
                    spdx,
                ],
                [
                    *(
                        f"This {thing} is free software: you can redistribute it and/or modify it under the terms "
                        f"of the {full} as published by the Free Software Foundation, either version {version} of "
                        "the License, or (at your option) any later version."
                        for thing in ("program", "library")
                    ),
                    f"under the terms of the {full} version {version} as published by the Free Software Foundation",
                    *(f"SPDX-License-Identifier: {spdx}{end}" for end in ("", "-or-later", "-only")),
                ],
            )


# Kind, names and notices of public licences: fixed values.
LICENCES = {
    "apache-1.1": ("apache", ["Apache License, Version 1.1", "Apache Software License, Version 1.1"], []),
    "apache-2.0": (
        "apache",
        ["Apache License, Version 2.0", "Apache 2.0 License", "Apache License 2.0", "Apache-2.0"],
        [
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
            "except in compliance with the License. You may obtain a copy of the License at "
            "http://www.apache.org/licenses/LICENSE-2.0",
            "Unless required by applicable law or agreed to in writing, software distributed under the "
            "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
            "either express or implied.",
            "SPDX-License-Identifier: Apache-2.0",
        ],
    ),
    "artistic-2.0": ("artistic", ["Artistic License 2.0", "Artistic-2.0"], ["SPDX-License-Identifier: Artistic-2.0"]),
    # The sentence that the two, three and four clause licences share.
    "bsd": (
        "bsd",
        [],
        [
            "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions "
            "and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
            "and the following disclaimer in the documentation and/or other materials provided with the "
            "distribution.",
        ],
    ),
    "bsd-2-clause": (
        "bsd",
        ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
        ["SPDX-License-Identifier: BSD-2-Clause"],
    ),
    "bsd-3-clause": (
        "bsd",
        ["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"],
        [
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
            "or promote products derived from this software without specific prior written permission.",
            "SPDX-License-Identifier: BSD-3-Clause",
        ],
    ),
    "bsl-1.0": (
        "boost",
        ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
        [
            "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt "
            "or copy at http://www.boost.org/LICENSE_1_0.txt)",
            "SPDX-License-Identifier: BSL-1.0",
        ],
    ),
    **dict(_creative_commons()),
    "cc0-1.0": (
        "cc0",
        ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0", "CC0-1.0"],
        [
            "To the extent possible under law, the author has waived all copyright and related or neighboring "
            "rights to this work.",
            "https://creativecommons.org/publicdomain/zero/1.0/",
            "SPDX-License-Identifier: CC0-1.0",
        ],
    ),
    "epl-1.0": ("eclipse", ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL-1.0"], []),
    "epl-2.0": (
        "eclipse",
        ["Eclipse Public License 2.0", "Eclipse Public License v. 2.0", "Eclipse Public License v2.0", "EPL-2.0"],
        [
            "This program and the accompanying materials are made available under the terms of the Eclipse "
            "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
            "SPDX-License-Identifier: EPL-2.0",
        ],
    ),
    **dict(_gnu()),
    "isc": (
        "isc",
        ["ISC License"],
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
            "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
            "in all copies.",
            "SPDX-License-Identifier: ISC",
        ],
    ),
    "mit": (
        "mit",
        ["MIT License", "MIT License (MIT)"],
        [
            "Licensed under MIT.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files (the \"Software\"), to deal in the Software without "
            "restriction",
            "The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software.",
            "SPDX-License-Identifier: MIT",
        ],
    ),
    "mit-0": ("mit", ["MIT No Attribution License", "MIT-0 License"], ["SPDX-License-Identifier: MIT-0"]),
    "mpl-1.1": (
        "mozilla",
        ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL-1.1"],
        ["SPDX-License-Identifier: MPL-1.1"],
    ),
    "mpl-2.0": (
        "mozilla",
        ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
        [
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at "
            "https://mozilla.org/MPL/2.0/.",
            "SPDX-License-Identifier: MPL-2.0",
        ],
    ),
    "unlicense": (
        "unlicense",
        ["The Unlicense"],
        [
            "This is free and unencumbered software released into the public domain.",
            "SPDX-License-Identifier: Unlicense",
        ],
    ),
    "zlib": (
        "zlib",
        ["zlib License"],
        [
            "This software is provided 'as-is', without any express or implied warranty. In no event will the "
            "authors be held liable for any damages arising from the use of this software.",
            "SPDX-License-Identifier: Zlib",
        ],
    ),
}
TEMPLATES = {
    family: [*(p.format(name) for name in names for p in PATTERNS), *notices]
    for family, (_, names, notices) in LICENCES.items()
}
KINDS = [UNKNOWN, *sorted({kind for kind, _, _ in LICENCES.values()})]
# Words, and pairs of words, that name a licence or its variant, and what they stand
# for. A version's ".0" is left out: "version 2" and "2.0" are the same.
QUALIFIERS = {
    "nc": ["nc"],
    "noncommercial": ["nc"],
    "non commercial": ["nc"],
    "nd": ["nd"],
    "noderivatives": ["nd"],
    "noderivs": ["nd"],
    "no derivatives": ["nd"],
    "sa": ["sa"],
    "sharealike": ["sa"],
    "share alike": ["sa"],
    "lesser": ["lesser"],
    "affero": ["affero"],
    "no attribution": ["mit-0"],
    "mit 0": ["mit-0"],
    **{str(n): [str(n)] for n in range(1, 10)},
    **{f"v{n}": [str(n)] for n in range(1, 10)},
}
MARKS = {
    **QUALIFIERS,
    "simplified bsd": ["2"],
    "new bsd": ["3"],
    "general public": ["gpl"],
    "gpl": ["gpl"],
    "lgpl": ["gpl", "lesser"],
    "agpl": ["gpl", "affero"],
    **{f"gplv{n}": ["gpl", str(n)] for n in (1, 2, 3)},
    "lgplv2": ["gpl", "lesser", "2"],
    "lgplv3": ["gpl", "lesser", "3"],
    "agplv3": ["gpl", "affero", "3"],
    "creative commons": ["cc"],
    "creativecommons org": ["cc"],
    "cc": ["cc"],
    "cc0": ["cc", "zero", "1"],
    "zero": ["zero"],
    "mpl": ["mozilla"],
    "epl": ["eclipse"],
    "bsl": ["boost"],
    **{n: [n] for n in "apache artistic boost bsd eclipse isc mit mozilla unlicense zlib".split()},
}
FEATURES = 1 << 14
# "Unknown" is learned from at most so many paragraphs.
SAMPLE_PARAGRAPHS = 20_000
HASH_PARTS = 1 << 16
TRAINING_WORDS = (4, 6, 9, 14, 24)
# Lengths of windows besides those of the templates.
WINDOW_WORDS = (3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 24, 30, 36, 45, 55)
# Windows of a segment begin at so many words; words around are there to be seen.
SEGMENT_WORDS = 160
BEFORE_WORDS, AFTER_WORDS = 3, 2
CONFIRMED = 0.6
# A kind less likely than this stays unknown.
LEAST_PROBABILITY = 0.5
SCALES = [0.1, 0.15, 0.25, 0.4, 0.6, 0.8, 1.0, 1.25, 1.6, 2.0]


def words_of(text):
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def pairs_of(words):
    def neighbours(w):
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))

    return let(words, neighbours)


def paragraphs(docs):
    """``doc_id, paragraph, text`` of every line that is not blank, numbered from 0."""
    return (
        ids_and_texts(docs)
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
        .where(F.trim("text") != "")
    )


def template_words(text):
    """What ``words_of`` gives for a template, in Python."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def template_pairs(words):
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def marks_of(words):
    """Names, versions and variants among ``words``, in order of the alphabet."""
    grams = words + template_pairs(words)
    return sorted({m for g in grams for m in MARKS.get(g, [])})


def _templates():
    """Distinct templates as (kind, family, words)."""
    rows = {(LICENCES[f][0], f, tuple(template_words(t))) for f in TEMPLATES for t in TEMPLATES[f]}
    return [(k, f, list(w)) for k, f, w in sorted(rows)]


def _known_pairs(kind=None):
    return sorted({p for k, _, w in _templates() if kind in (None, k) for p in template_pairs(w)})


def _strings(values):
    return F.array(*map(F.lit, values)).cast("array<string>")


def _share(words, pairs):
    """Share of a paragraph's word pairs that ``pairs`` (an array) has."""

    def share(own):
        return F.when(F.size(own) > 0, F.size(F.array_intersect(own, pairs)) / F.size(own)).otherwise(0.0)

    return let(F.array_distinct(pairs_of(words)), share)


def _vectors(rows):
    """Rows with ``words`` get ``features``."""
    grams = rows.withColumn("grams", let(F.col("words"), lambda w: F.concat(w, pairs_of(w))))
    counted = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    return counted.transform(grams).drop("grams")


def unlike_templates(docs, sample=SAMPLE_PARAGRAPHS):
    """``words`` of at most ``sample`` distinct paragraphs that are unlike all templates:
    those with the smallest hashes."""
    lines = paragraphs(docs).select("text", F.xxhash64("text").alias("hash"))
    part = F.shiftrightunsigned("hash", 48)
    counts = dict(lines.select("hash").distinct().groupBy(part.alias("part")).count().collect())
    every = F.array(*map(F.lit, _known_pairs()))
    wanted, below, rows = sample, 0, None
    # Twice as many distinct texts as long as too many of them are template-like.
    while below < HASH_PARTS:
        have = 0
        while below < HASH_PARTS and have < wanted:
            have += counts.get(below, 0)
            below += 1
        words = words_of(F.col("text"))
        rows = cut_lineage(
            lines.where(part < below)
            .dropDuplicates(["hash", "text"])
            .withColumn("words", words)
            .where((F.size("words") > 0) & (_share(F.col("words"), every) < 0.3))
            .select("words", "hash", "text")
        )
        if rows.count() >= sample:
            break
        if have >= sum(counts.values()):
            break
        wanted, below = 2 * max(wanted, have), 0
    return rows.orderBy(part, "hash", "text").limit(sample).select("words")


def training_rows(docs, sample=SAMPLE_PARAGRAPHS):
    """``words, label``: template windows of their kinds, sampled paragraphs of none."""
    kinds = {}
    for kind, _, words in _templates():
        kinds.setdefault(tuple(words), set()).add(kind)
        for size in TRAINING_WORDS:
            for at in range(len(words) - size + 1):
                kinds.setdefault(tuple(words[at : at + size]), set()).add(kind)
    # A window that several kinds have tells nothing.
    known = [(list(w), float(KINDS.index(min(k)))) for w, k in sorted(kinds.items()) if len(k) == 1]
    known = docs.sparkSession.createDataFrame(known, "words array<string>, label double")
    return known.unionByName(unlike_templates(docs, sample).select("words", F.lit(0.0).alias("label")))


class Model:
    """Coefficients of the regression, and the scale that calibrates its scores."""

    def __init__(self, regression, scale):
        self.regression, self.scale = regression, scale

    def best(self, vectors):
        """``vectors`` with ``best``: the place of the likeliest kind among ``KINDS``,
        from 1, and its probability."""

        def choose(raw):
            return let(
                F.array_max(raw),
                lambda top: let(
                    F.aggregate(raw, F.lit(0.0), lambda t, x: t + F.exp((x - top) * self.scale)),
                    lambda total: F.struct(
                        F.array_position(raw, top).cast("int").alias("place"),
                        (1 / total).alias("probability"),
                    ),
                ),
            )

        raw = vector_to_array("rawPrediction")
        scored = self.regression.transform(vectors)
        return scored.withColumn("best", let(raw, choose)).drop(
            "rawPrediction", "probability", "prediction", "features"
        )


def train(docs, sample=SAMPLE_PARAGRAPHS):
    """A model for the corpus ``docs``; the templates alone if it is empty."""
    # A bounded sample: in two tasks, so that a step of the solver sums two gradients.
    rows = cut_lineage(_vectors(training_rows(docs, sample)).coalesce(2))
    fold = F.pmod(F.xxhash64(F.array_join("words", " ")), F.lit(5))
    weights = F.when(F.col("label") == 0, 0.2).otherwise(1.0)
    regression = LogisticRegression(
        family="multinomial", maxIter=60, regParam=1e-4, elasticNetParam=0.0, weightCol="weight"
    ).fit(rows.where(fold > 0).withColumn("weight", weights))
    held = regression.transform(rows.where(fold == 0))
    raw = vector_to_array("rawPrediction")

    def loss(scale):
        def of(x):
            return let(
                F.array_max(x),
                lambda top: F.log(F.aggregate(x, F.lit(0.0), lambda t, v: t + F.exp((v - top) * scale)))
                + (top - F.get(x, F.col("label").cast("int"))) * scale,
            )

        return F.avg(let(raw, of)).alias(f"s{scale}".replace(".", "_"))

    losses = held.agg(*[loss(s) for s in SCALES]).first()
    known = [(v, s) for v, s in zip(losses, SCALES, strict=True) if v is not None]
    return Model(regression, min(known)[1] if known else 1.0)


def window_sizes():
    lengths = {len(w) for _, _, w in _templates() if len(w) > 1}
    return sorted({*lengths, *(n for n in WINDOW_WORDS if n < max(lengths))})


def anchors():
    """Pairs of which every window that is confirmed has one: of each template more than
    the share that a window may lack, those with the longest words."""
    chosen = set()
    for _, _, words in _templates():
        pairs = sorted(set(template_pairs(words)), key=lambda p: (-max(map(len, p.split())), p))
        # A window that has none of these has less than CONFIRMED of the template.
        chosen.update(pairs[: len(pairs) - math.ceil(CONFIRMED * len(pairs)) + 1])
    return sorted(chosen)


# Words that any text has.
COMMON = "a an and any as at be by for from in is it no not of on or that the this to with".split()


def telling_words(pairs):
    """A word of each pair, the longest that is not common: without one of these words
    there is no such pair."""
    return sorted({max(p.split(), key=lambda w: (w not in COMMON, len(w), w)) for p in pairs})


def _segments(line):
    """The line as a whole, and where it has an anchor's word, its segments: ``words``,
    the place ``first`` of the first window in them, and the number ``starts`` of places
    at which windows begin, 0 for the whole line."""
    widest = window_sizes()[-1]
    entry = lambda words, first, starts: F.struct(
        words.alias("words"), first.cast("int").alias("first"), starts.cast("int").alias("starts")
    )

    def segment(at):
        low = F.greatest(at - BEFORE_WORDS, F.lit(1))
        high = F.least(at + SEGMENT_WORDS + widest + AFTER_WORDS, F.size(line) + 1)
        return entry(F.slice(line, low, high - low), at - low + 1, F.least(F.lit(SEGMENT_WORDS), F.size(line) - at + 1))

    whole = F.array(entry(line, F.lit(1), F.lit(0)))
    ats = F.sequence(F.lit(1), F.size(line), F.lit(SEGMENT_WORDS))
    may_hold = F.exists(line, lambda w: w.isin(telling_words(anchors())))
    return F.when(may_hold, F.concat(whole, F.transform(ats, segment))).otherwise(whole)


def _windows(segment):
    """Windows to score as structs of ``words``, whether the line is ``whole`` and whether
    a name or version is ``cut`` at an edge: the line itself, or the windows of a segment
    that have an anchor and enough pairs in all templates to be confirmed."""
    sizes, known, anchored = window_sizes(), _known_pairs(), anchors()
    qualifiers = _strings(list(QUALIFIERS))
    words = segment["words"]

    def cut(at, n):
        low = F.greatest(at - 2, F.lit(1))
        before = F.filter(F.slice(words, low, at - low), lambda w: ~w.rlike("^v?[0-9]$"))
        after = F.slice(words, at + n, 1)
        # Pairs that begin or end outside.
        joint = F.transform(
            F.array(at - 3, at - 2, at + n - 2, at + n - 1),
            lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)),
        )
        return F.coalesce(F.arrays_overlap(F.concat(before, after, joint), qualifiers), F.lit(False))

    def window(at, n):
        return F.struct(
            F.slice(words, at, n).alias("words"), F.lit(False).alias("whole"), cut(at, n).alias("cut")
        )

    def around(flags):
        """``flags``: 2 for an anchor, 1 for another known pair."""
        total = F.size(words)
        last = segment["first"] + segment["starts"]
        begins = F.filter(
            F.sequence(segment["first"], last),
            lambda i: (i < last)
            & (F.get(flags, i - 1) > 0)
            & F.exists(F.slice(flags, i, sizes[-1] - 1), lambda x: x == 2),
        )

        def sized(at):
            fitting = F.filter(F.array(*map(F.lit, sizes)), lambda n: at + n - 1 <= total)
            enough = F.filter(fitting, lambda n: let(F.slice(flags, at, n - 1), lambda own: holds(own, n)))
            return F.transform(enough, lambda n: window(at, n))

        def holds(own, n):
            return F.exists(own, lambda x: x == 2) & (F.size(F.filter(own, lambda x: x > 0)) >= CONFIRMED * (n - 1))

        return F.flatten(F.transform(begins, sized))

    flag = lambda p: F.when(p.isin(anchored), 2).when(p.isin(known), 1).otherwise(0)
    itself = F.array(F.struct(words.alias("words"), F.lit(True).alias("whole"), F.lit(False).alias("cut")))
    return F.when(segment["starts"] == 0, itself).otherwise(let(F.transform(pairs_of(words), flag), around))


def _marks(words):
    """``marks_of`` as an expression."""
    marks = F.create_map(*[x for k, v in MARKS.items() for x in (F.lit(k), _strings(v))])
    grams = F.filter(F.concat(words, pairs_of(words)), lambda g: g.isin(list(MARKS)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(grams, lambda g: marks[g]))))


def scan(docs, model):
    """Paragraphs that the classifier takes for a licence notice.

    ``doc_id, paragraph, kind, family, probability, similarity, confirmed``. A paragraph
    with confirmed notices has a row for each licence they name; one that is taken
    for a notice as a whole and has none confirmed has one row, with the ``kind`` most
    like it and no family. A null or blank text has no paragraph; null ids and repeated rows are
    reported row by row; an empty table gives an empty result. Only what the
    classifier found is shuffled.
    """
    spark = docs.sparkSession
    rows = (
        paragraphs(docs)
        .withColumn("line", words_of(F.col("text")))
        .where(F.size("line") > 0)
        .select("doc_id", "paragraph", "line", F.monotonically_increasing_id().alias("row"))
        .select("doc_id", "paragraph", "row", F.explode(_segments(F.col("line"))).alias("segment"))
        .select("doc_id", "paragraph", "row", F.explode(_windows(F.col("segment"))).alias("window"))
        .select("doc_id", "paragraph", "row", "window.*")
    )
    found = (F.col("best.place") > 1) & (F.col("best.probability") >= LEAST_PROBABILITY)
    kinds = F.array(*map(F.lit, KINDS))
    named = (
        model.best(_vectors(rows))
        .where(found)
        .withColumn("kind", F.element_at(kinds, F.col("best.place")))
        .withColumn("marks", _marks(F.col("words")))
        .withColumn("pairs", F.array_distinct(pairs_of(F.col("words"))))
    )
    templates = spark.createDataFrame(
        [(k, f, sorted(set(template_pairs(w))), marks_of(w)) for k, f, w in _templates() if len(w) > 1],
        "kind string, family string, template array<string>, template_marks array<string>",
    )
    has = spark.createDataFrame([(k, _known_pairs(k)) for k in KINDS[1:]], "kind string, known array<string>")
    own = F.size(F.array_intersect("pairs", "known")) / F.greatest(F.size("pairs"), F.lit(1))
    measured = (
        named.join(F.broadcast(has), "kind")
        .withColumn("own", own)
        .where((F.col("own") >= CONFIRMED) & ~F.col("cut") | F.col("whole"))
        .drop("known")
    )
    # Only a whole paragraph is compared with templates of other marks.
    same = F.col("marks") == F.col("template_marks")
    templates = templates.withColumnRenamed("kind", "template_kind")
    pairs_with = (F.col("kind") == F.col("template_kind")) & (same | F.col("whole"))
    common = F.size(F.array_intersect("pairs", "template"))
    compared = (
        measured.join(F.broadcast(templates), pairs_with)
        .withColumn("similarity", F.least(F.col("own"), common / F.size("template")))
        .withColumn("confirmed", (F.col("similarity") >= CONFIRMED) & same & ~F.col("cut"))
        .where("confirmed OR whole")
    )
    rank = F.struct("confirmed", "similarity", "best.probability", "family", "kind")
    per_licence = compared.groupBy("row", "doc_id", "paragraph", F.when(F.col("confirmed"), F.col("marks")).alias("marks"))
    best = per_licence.agg(F.max(rank).alias("top"))
    several = best.groupBy("row", "doc_id", "paragraph").agg(F.collect_list("top").alias("all"))
    confirmed = F.filter("all", lambda t: t["confirmed"])
    return several.select(
        "doc_id",
        F.col("paragraph").cast("long").alias("paragraph"),
        F.explode(F.when(F.size(confirmed) > 0, confirmed).otherwise(F.col("all"))).alias("top"),
    ).select(
        "doc_id",
        "paragraph",
        "top.kind",
        F.when(F.col("top.confirmed"), F.col("top.family")).alias("family"),
        "top.probability",
        "top.similarity",
        "top.confirmed",
    )


def document_licences(docs, model):
    """One row per row of ``docs``: ``doc_id, n_notices, families``, the confirmed
    notices' families in alphabetical order. Rows that repeat an id share theirs."""
    found = (
        scan(docs, model)
        .where("confirmed")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n_notices"), F.sort_array(F.collect_set("family")).alias("families"))
    )
    ids = ids_and_texts(docs).select("doc_id")
    joined = ids.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select(
        "doc_id",
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
    )
