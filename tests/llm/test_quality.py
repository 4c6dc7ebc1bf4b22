"""The line field against enumeration, and quality on held-out documents."""

import itertools
import os

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, documents, empty
from pyspark.sql import functions as F

import corpus_pipeline
from fieldspark.llm import line_quality as lq
from fieldspark.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    per_text = np.array([3, 1, 5, 2])
    votes = np.stack([np.zeros(11), rng.normal(size=11)], axis=1)
    pair = rng.normal(size=(2, 2))
    _, _, marginal, norm = lq.Chains(per_text).sums(votes, pair)
    at = 0
    for n in per_text.tolist():
        weights = np.zeros((n, 2))
        total = 0
        for labels in itertools.product((0, 1), repeat=n):
            score = sum(votes[at + i, x] for i, x in enumerate(labels))
            score += sum(pair[a, b] for a, b in itertools.pairwise(labels))
            total += np.exp(score)
            for i, x in enumerate(labels):
                weights[i, x] += np.exp(score)
        assert np.allclose(np.exp(marginal[at : at + n]), weights / total)
        assert np.allclose(norm[at : at + n], np.log(total))
        at += n


def test_lines_and_repeats():
    texts = ["One two two.\n\nA | b |", "", "x\n", "no feed"]
    features, per_text, size, text = lq.line_features(pa.array(texts))
    assert per_text.tolist() == [3, 1, 2, 1]
    assert size.tolist() == [12, 0, 7, 0, 1, 0, 7]
    assert text.tolist() == [0, 0, 0, 1, 2, 2, 3]
    column = {f: features[:, i] for i, f in enumerate(lq.FEATURES)}
    assert column["lone"][2] == 0.5
    assert column["repeat"][0] == 0 and column["ending"].tolist() == [1, 0, 0, 0, 0, 0, 0]
    again, _, _, _ = lq.line_features(pa.array(["go go go stop"]))
    assert again[0, lq.FEATURES.index("repeat")] == 0.5


def test_neighbours_stay_in_their_text():
    features = np.arange(1, 6, dtype=float)[:, None]
    got = lq.with_neighbours(features, np.array([2, 3]))
    assert got.tolist() == [[1, 0, 2], [2, 1, 0], [3, 0, 4], [4, 3, 5], [5, 4, 0]]


def test_held_out_documents_and_what_stays(spark):
    scored = queries.QUERIES["op8_line_quality"](spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark):
    labels = spark.createDataFrame(
        [(1, 1), (5, 1), (10, 0), (12, 0), (12, 1), (None, 1), (2, None), (99, 1), (13, 7)], "doc_id long, quality int"
    )
    model = lq.train(documents(spark), labels, steps=20)
    rows = lq.score(documents(spark), model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(k) for k, _ in awkward())
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert lq.score(empty(spark), model).count() == 0
    kept = lq.keep_good(documents(spark), model)
    assert kept.columns == documents(spark).columns
    good = sorted(str(r.doc_id) for r in rows if r.score >= 0.5)
    assert sorted(str(r.doc_id) for r in kept.collect()) == good
    lines = lq.line_labels(documents(spark, [(1, "a\nb"), (2, None)]), model).collect()
    assert sorted((r.doc_id, r.line) for r in lines) == [(1, 0), (1, 1), (2, 0)]


def test_without_labels_nothing_is_known(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = lq.train(documents(spark), none)
    assert model is None
    assert {r.score for r in lq.score(documents(spark), model).collect()} == {0.5}
    one_sided = spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, quality int")
    scores = [r.score for r in lq.score(documents(spark), lq.train(documents(spark), one_sided, steps=10)).collect()]
    assert np.isfinite(scores).all()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    out = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF_DIR).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_pipeline_stages(spark, stages):
    raw, good, single, clean, packed = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeated_passages", "packing"]
    for docs in (good, single, clean):
        assert docs.columns == raw.columns and docs.dtypes == raw.dtypes
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    assert good.join(labels.where("quality = 1"), "doc_id").count() == raw.join(labels.where("quality = 1"), "doc_id").count()
    assert good.join(labels.where("quality = 0"), "doc_id").count() == 0
    assert single.count() < good.count() and clean.count() == single.count()
    assert clean.where("n_chars <> length(text)").count() == 0
    assert packed.select("doc_id").distinct().count() == clean.count()


def test_pipeline_takes_awkward_rows(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels = spark.createDataFrame([(1, 1), (5, 1), (10, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    labels.where(F.lit(False)).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_one_row_of_a_labelled_id_is_learned_from(spark, monkeypatch):
    rows = [(1, f"Good line {i} of prose.\nAnother one.") for i in range(3000)] + [(2, "xx || ##\n" * 500), (3, "Fine text.")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(lq, "fit", lambda f, n, t, s, old=lq.fit: (seen.append((n.tolist(), t.tolist())), old(f, n, t, s))[1])
    assert lq.train(documents(spark, rows), labels) is not None
    # All 500 lines of the second text, and one text of the first id.
    assert seen == [([2, 501, 1], [1, 0, 0])]
