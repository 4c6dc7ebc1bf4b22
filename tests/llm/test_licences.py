"""Licence notices: neighbours told apart, notices inside lines, distinct sample."""

import random
import time

import pytest
from cases import documents, prose
from pyspark.sql import functions as F

from fieldspark.llm import licenses

NOTICES = {
    "This work is licensed under the GNU General Public License, version 2.": {"gpl-2.0"},
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": {"lgpl-2.1"},
    "This work is licensed under the GNU Affero General Public License, version 3.": {"agpl-3.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"cc-by-sa-4.0"},
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": {"cc-by-3.0"},
    "Licensed under CC BY-NC-SA 4.0.": {"cc-by-nc-sa-4.0"},
    "Licensed under CC BY 4.0.": {"cc-by-4.0"},
    "Released under the MIT License or the Apache License, Version 2.0.": {"mit", "apache-2.0"},
    "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
    "Licensed under the Apache License, Version 9.0.": set(),
    "This work is licensed under the GNU General Public License, version 7.": set(),
    "SPDX-License-Identifier: ISC": {"isc"},
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:": {"bsd"},
}


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(documents(spark, [(i, prose(i, 60)) for i in range(40)]))


def confirmed(docs, model):
    found = {}
    for r in licenses.scan(docs, model).where("confirmed").collect():
        found.setdefault(r.doc_id, set()).add(r.family)
    return found


def test_neighbours_are_told_apart(spark, model):
    docs = documents(spark, list(enumerate(NOTICES)))
    got = confirmed(docs, model)
    assert {t: got.get(i, set()) for i, t in enumerate(NOTICES)} == NOTICES


def test_notices_inside_longer_lines(spark, model):
    around = [prose(500 + i, 80).replace("\n", " ") for i in range(2 * len(NOTICES))]
    rows = [(i, f"{around[2 * i]} {t} {around[2 * i + 1]}") for i, t in enumerate(NOTICES)]
    got = confirmed(documents(spark, rows), model)
    assert {t: got.get(i, set()) for i, t in enumerate(NOTICES)} == NOTICES


def test_each_family_is_found_by_its_templates(spark, model):
    rows = [(f, t) for f in licenses.TEMPLATES for t in licenses.TEMPLATES[f] if len(licenses.template_words(t)) > 3]
    docs = documents(spark, [(i, t) for i, (_, t) in enumerate(rows)])
    got = confirmed(docs, model)
    assert [(f, t, got.get(i)) for i, (f, t) in enumerate(rows) if got.get(i) != {f}] == []


def test_unknown_is_learned_from_distinct_lines(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(i, f"stone river{i % 30}\n-----\n{notice}") for i in range(1200)]
    learned = licenses.training_rows(documents(spark, rows), sample=20).where("label = 0").collect()
    assert len(learned) == len({tuple(r.words) for r in learned}) == 20


def windows_by_hand(line):
    """Windows of a list of words that have an anchor and enough known pairs."""
    known, anchored = set(licenses._known_pairs()), set(licenses.anchors())
    pairs = licenses.template_pairs(line)
    out = []
    for at in range(len(line)):
        for n in licenses.window_sizes():
            own = pairs[at : at + n - 1]
            if at + n <= len(line) and own and own[0] in known and anchored & set(own):
                if sum(p in known for p in own) >= licenses.CONFIRMED * (n - 1):
                    out.append(tuple(line[at : at + n]))
    return sorted(out)


def test_windows_equal_those_by_hand(spark):
    rng = random.Random(4)
    vocabulary = sorted({w for _, _, words in licenses._templates() for w in words})
    texts = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(3)]
    notice = " ".join(f"{t} {prose(i, 20)}" for i, t in enumerate(NOTICES)).replace("\n", " ")
    texts += [notice * 3, prose(7, 50).replace("\n", " "), "mit license"]
    df = documents(spark, list(enumerate(texts)))
    lines = licenses.paragraphs(df).withColumn("line", licenses.words_of(F.col("text")))
    found = lines.select("doc_id", F.explode(licenses._segments(F.col("line"))).alias("s"))
    found = found.select("doc_id", F.explode(licenses._windows(F.col("s"))).alias("w"))
    got = {}
    for r in found.where("NOT w.whole").collect():
        got.setdefault(r["doc_id"], []).append(tuple(r["w"]["words"]))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == windows_by_hand(licenses.template_words(text))


def test_a_confirmed_window_has_an_anchor():
    chosen = set(licenses.anchors())
    for _, _, words in licenses._templates():
        pairs = set(licenses.template_pairs(words))
        assert len(pairs - chosen) < licenses.CONFIRMED * len(pairs) or not pairs


def test_a_long_line_takes_time_in_proportion(spark, model):
    rng = random.Random(5)
    vocabulary = sorted({w for _, _, words in licenses._templates() for w in words})
    line = " ".join(rng.choices(vocabulary, k=20_000))
    notice = "Licensed under the Apache License, Version 2.0."
    start = time.time()
    found = licenses.scan(documents(spark, [(1, f"{line} {notice} {line}")]), model).collect()
    assert "apache-2.0" in {r["family"] for r in found}
    assert time.time() - start < 60


def test_marks_and_shares_by_hand(spark):
    texts = list(NOTICES) + [prose(1, 30), "GNU GPL v2 or later, cc by nc 4 0 license"]
    rows = [(t, licenses.template_words(t)) for t in texts]
    df = spark.createDataFrame(rows, "text string, words array<string>")
    known = licenses._known_pairs("gnu")
    shares = df.select(
        licenses.words_of(F.col("text")).alias("w"), licenses._marks(F.col("words")).alias("marks"),
        licenses._share(F.col("words"), F.array(*map(F.lit, known))).alias("share"),
    ).collect()
    for (text, words), r in zip(rows, shares, strict=True):
        pairs = set(licenses.template_pairs(words))
        assert (r["w"], r["marks"]) == (words, licenses.marks_of(words))
        assert r["share"] == pytest.approx(len(pairs & set(known)) / len(pairs) if pairs else 0.0)


def test_no_family_where_none_is_confirmed(spark, model):
    texts = ["This file is licensed under the GNU GPL.", "Licensed under the Apache License, Version 9.0."]
    for r in licenses.scan(documents(spark, list(enumerate(texts))), model).collect():
        assert not r["confirmed"] and r["family"] is None and r["kind"] in licenses.KINDS
