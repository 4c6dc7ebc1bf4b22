"""Spot signatures and licence scans, and that both stay on DataFrame functions."""

import hashlib
import re

import pytest
from cases import awkward, documents, empty, prose

from fieldspark.llm import licenses, queries, spotsigs

SF_DIR = "/root/testdata/sf0.001"


def sets_of(text):
    return {text[i : i + 8] for i in range(0, len(text), 8)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def compared(spark, rows):
    found = spotsigs.compare_with_edit(documents(spark, rows))
    return found.select(
        "doc_id",
        "n_chars",
        "edited",
        spotsigs.as_text("signatures").alias("f"),
        spotsigs.as_text("edited_signatures").alias("e"),
        "near_edited",
        "near_next",
    ).collect()


def test_edits_and_likeness(spark):
    rows = [(k, t) for k, t in awkward() if k != 13]
    rows = list(dict.fromkeys(rows))
    got = {(r.doc_id, hashlib.md5(r.edited.encode()).hexdigest()): r for r in compared(spark, rows)}
    # Null ids come first; rows of one id in an order of their own.
    named = sorted((k, t or "") for k, t in rows if k is not None)
    assert len(got) == len(rows)
    prints = {}
    for i, (key, text) in enumerate(named[:-1]):
        following, cut = named[i + 1][1], len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = got[key, hashlib.md5(edited.encode()).hexdigest()]
        assert r.n_chars == len(text)
        assert r.near_edited == pytest.approx(jaccard(sets_of(r.f), sets_of(r.e)))
        prints[key] = r.f
    for i, (key, _) in enumerate(named[:-2]):
        r = next(r for r in got.values() if r.doc_id == key)
        assert r.near_next == pytest.approx(jaccard(sets_of(prints[key]), sets_of(prints[named[i + 1][0]])))
    assert prints[5] == prints[6] and prints[3] == prints[4] == ""


def test_repeated_and_few_rows(spark):
    rows = compared(spark, awkward())
    assert len(rows) == len(set((k, t or "") for k, t in awkward()))
    alone = compared(spark, [(4, "the river and the stone of light")])
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert compared(spark, []) == []


def test_signatures_skip_anchors(spark):
    docs = spark.createDataFrame([("the big river of cold stone",), ("The big, river of COLD stone!",)], "text string")
    first, second = [r[0] for r in docs.select(spotsigs.signatures(docs["text"])).collect()]
    assert first == second and first


def test_similar_sets_by_brute_force(spark):
    base = [prose(40, 150), prose(41, 300)]
    rows = [(i, base[i % 2][: len(base[i % 2]) - 7 * i]) for i in range(24)] + awkward()
    docs = documents(spark, rows)
    sets = {}
    for r in docs.where("doc_id is not null").select("doc_id", spotsigs.signatures(docs["text"]).alias("s")).collect():
        if r.s:
            key = frozenset(r.s)
            sets[key] = min(r.doc_id, sets.get(key, r.doc_id))
    want = set()
    for a, i in sets.items():
        for b, j in sets.items():
            if i < j and jaccard(a, b) >= 0.8:
                want.add((i, j))
    got = {tuple(sorted((r.a, r.b))) for r in spotsigs.similar_sets(docs).collect()}
    assert want and got == want


def test_licence_notices(spark):
    notices = {
        "mit": "Released under the MIT License.",
        "apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    }
    rows = [(100 + i, f"{prose(i, 40)}\n{t}\n{prose(i + 50, 30)}") for i, t in enumerate(notices.values())]
    rows += awkward()
    docs = documents(spark, rows)
    model = licenses.train(docs)
    found = licenses.scan(docs, model).collect()
    by_id = {r.doc_id: r for r in found if r.confirmed}
    assert {k: r.family for k, r in by_id.items()} == {100 + i: f for i, f in enumerate(notices)}
    for key, r in by_id.items():
        text = dict(rows)[key]
        assert text.split("\n")[r.paragraph] in notices.values()
        assert r.probability > 0.9 and r.similarity == 1.0
    per_row = licenses.document_licences(docs, model).collect()
    assert len(per_row) == len(rows)
    assert {r.doc_id: r.families for r in per_row if r.families} == {k: [r.family] for k, r in by_id.items()}
    assert licenses.scan(empty(spark), model).count() == 0


def test_licences_of_nothing(spark):
    assert licenses.scan(empty(spark), licenses.train(empty(spark))).count() == 0


def test_every_notice_of_the_documents_is_found(spark):
    found = queries.QUERIES["op4_license_scan"](spark, SF_DIR).where("confirmed").collect()
    want = set()
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        for i, line in enumerate((r.text or "").split("\n")):
            if re.search("licensed? under|Released under the MIT", line, re.I):
                want.add((r.doc_id, i))
    assert {(r.doc_id, r.paragraph) for r in found} == want


@pytest.mark.parametrize("name", ["op2_spot_signatures", "op4_license_scan"])
def test_no_python_on_the_main_path(spark, name):
    plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
