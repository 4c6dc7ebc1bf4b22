"""Sparse inputs, kernels over day series, text of any number of values."""

import datetime

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from test_jobs import SCHEMA, random_inspections, weather

from fieldspark.operators import model, perceptron
from fieldspark.plans import training
from fieldspark.plans.combined import build_combined


def table(spark, n=150):
    rows = random_inspections(41, n)
    return build_combined(spark.createDataFrame(rows, SCHEMA), weather(spark, range(0, 30, 2)), "seq")


def test_kernels_by_hand(spark):
    combined = table(spark)
    rows, columns = training.day_series(combined, 5, kernels=True)
    assert len(columns) == 3 * (4 + 3 * (3 + 2))
    known = {r["Date"]: r["Temperature"] for r in combined.collect() if r["Temperature"] is not None}
    for r in rows.collect():
        days = [known.get(r["Date"] - datetime.timedelta(days=b), 0.0) for b in range(4, -1, -1)]
        for name, weights in training.KERNELS.items():
            got = [r[f"Temperature_{name}_{2 - at}"] for at in range(3)]
            want = [max(0.0, sum(w * x for w, x in zip(weights, days[at : at + 3]))) for at in range(3)]
            assert np.allclose(got, want)
            assert np.isclose(r[f"Temperature_{name}_max"], max(want))
            assert np.isclose(r[f"Temperature_{name}_avg"], np.mean(want))
    short, few = training.day_series(combined, 2, kernels=True)
    assert len(few) == 3 and short.count() == combined.count()


def test_sparse_and_dense_inputs_tell_the_same(spark):
    combined = table(spark)
    dense = training.matrices(combined)
    sparse = training.sparse_matrices(combined)
    names = {r["position"]: r["name"] for r in sparse.names.collect()}
    by_key = {(r["SiteID"], r["Date"]): r for r in dense.rows.collect()}
    flags = dense.weather_columns + dense.site_columns
    rows = sparse.rows.withColumn("x", vector_to_array("features")).collect()
    assert len(rows) == len(by_key)
    for r in rows:
        own = dict(zip(flags, by_key[r["SiteID"], r["Date"]]["features"]))
        for position, name in names.items():
            if position < len(sparse.dense_columns):
                assert np.isclose(r["x"][position], own[name])
            else:
                # A flag that is set is above the mean; one that is not is exactly 0.
                assert (r["x"][position] > 0) == (own[name] > 0) or own[name] == 0
    train = np.array([r["x"] for r in rows if r["split"] == "train"])
    spread = train.std(axis=0, ddof=1)[len(sparse.dense_columns) :]
    assert np.all(np.isclose(spread, 1) | np.isclose(spread, 0))


def test_a_text_with_a_value_a_row_trains(spark):
    rows = spark.range(30_000).select(
        F.format_string("s%d", F.col("id") % 200).alias("SiteID"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 200).cast("int")).alias("Date"),
        F.lit(None).cast("string").alias("TreatedBy"),
        *[F.lit("x").alias(c) for c in ("MosquitoRank", "CattailMosquito", "CulexFound", "Action", "Material")],
        F.lit(1.0).alias("WetlandType"), (F.col("id") % 7).cast("double").alias("Wetness"),
        (F.col("id") % 7 > 3).cast("double").alias("DipCount"),
        *[F.lit(5.0).alias(c) for c in ("Temperature", "Precipitation", "CloudCoverage")],
        F.concat(F.lit("note "), F.col("id").cast("string")).alias("Notes"),
    )
    m = training.sparse_matrices(rows, most_values=256)
    assert m.width < 256 + 60
    assert m.names.where("name LIKE 'Notes#%'").count() == 256
    first = m.rows.first()["features"]
    assert len(first) == m.width and len(first.indices) < 30
    landed = m.rows.checkpoint()
    fitted = model.train_classifier(landed.where("split = 'train'"), hidden=(8,), max_iter=30)
    scored = model.score_classifier(fitted, landed.where("split = 'test'"))
    n = scored.count()
    assert scored.where("predicted = label").count() > 0.95 * n


def test_a_value_unknown_to_training_has_no_column(spark):
    combined = table(spark).withColumn("Notes", F.lit("usual"))
    split = training.sparse_matrices(combined).rows.select("SiteID", "Date", "split")
    late = combined.join(split, ["SiteID", "Date"]).withColumn(
        "Notes", F.when(F.col("split") == "test", "late").otherwise("usual")
    )
    m = training.sparse_matrices(late.drop("split"))
    names = [r["name"] for r in m.names.collect()]
    assert "Notes_usual" in names and "Notes_late" not in names
    assert m.rows.count() == combined.count()


def test_series_are_made_once_per_date(spark):
    days = [datetime.date(2024, 1, d) for d in (1, 2, 5)]
    rows = [("s", days[i % 3], 1.0 + i % 3, 2.0, 3.0) for i in range(30)] + [(None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "SiteID string, Date date, Temperature double, Precipitation double, CloudCoverage double")
    found, columns = training.day_series(df, 5, kernels=True)
    # The kernels are in the table of dates: nothing is convolved for each row.
    assert "lambda" not in found._jdf.queryExecution().toString()
    got = found.collect()
    assert len(got) == 32
    last = [r for r in got if r["Date"] == days[2]]
    assert len(last) == 10 and {(r["Temperature_4"], r["Temperature_3"], r["Temperature_1"]) for r in last} == {(1.0, 2.0, 0.0)}
    # 1, 2, 0, 0 and 3 degrees: rises of -1, -2 and 3.
    assert {tuple(r[f"Temperature_rise_{b}"] for b in (2, 1, 0)) for r in last} == {(0.0, 0.0, 3.0)}
    blank = [r for r in got if r["Date"] is None]
    assert len(blank) == 2 and {(r["Temperature_1"], r["Temperature_rise_0"]) for r in blank} == {(0.0, None)}


def test_rows_are_dealt_evenly_over_the_cores(spark):
    combined = table(spark, 600).coalesce(1).checkpoint()
    rows = training.sparse_matrices(combined, days=5, kernels=True).rows.checkpoint()
    sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    cores = spark.sparkContext.defaultParallelism
    assert len(sizes) == cores * training.TURNS and sum(sizes) == combined.count()
    assert max(sizes) - min(sizes) <= 2
    twice = training.spread(combined.union(combined))
    assert twice.exceptAll(combined).exceptAll(combined).count() == 0 and twice.count() == 2 * sum(sizes)


def labelled_vectors(spark, n=300):
    rnd = np.random.default_rng(8)
    xs = rnd.normal(size=(n, 6))
    vectors = [Vectors.dense(x) if i % 3 else Vectors.sparse(6, [0, 4], [x[0], x[4]]) for i, x in enumerate(xs)]
    rows = [(v, float(v[0] + v[4] > 0)) for v in vectors]
    return spark.createDataFrame(rows, ["features", "label"])


def test_loss_and_gradient_are_those_of_spark_ml(spark, monkeypatch):
    df, layers = labelled_vectors(spark), [6, 5, 4, 2]
    trainer = MultilayerPerceptronClassifier(layers=layers, seed=3, maxIter=0, blockSize=300)
    fitted = trainer.fit(df.coalesce(1))
    weights = fitted.weights.toArray()
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 70)
    monkeypatch.setattr(perceptron, "CHUNK_ROWS", 16)
    blocks = perceptron.pack(df.repartition(3), 6, 2)
    assert blocks.agg(F.sum("n")).first()[0] == 300
    loss, gradient = perceptron.mean_loss(blocks, layers, weights)
    assert np.isclose(loss / 300, fitted.summary().objectiveHistory[0], rtol=1e-12)
    for i in (0, 7, 33, 40, 50, len(weights) - 1):
        near = np.zeros(len(weights))
        near[i] = 1e-6
        up, down = (perceptron.mean_loss(blocks, layers, weights + d)[0] for d in (near, -near))
        assert np.isclose((up - down) / 2e-6, gradient[i], rtol=1e-4, atol=1e-4)
    # Where the folder is not mounted, blocks come with the rows; many results are added up by tasks.
    monkeypatch.setattr(perceptron, "MOST_RESULTS", 2)
    as_array = df.select(vector_to_array("features").alias("features"), "label")
    monkeypatch.setattr(perceptron, "new_path", lambda *a: "store://folder/packed")
    sent = perceptron.pack(as_array.repartition(5), 6, 2)
    assert sent.where("path IS NOT NULL OR data IS NULL").count() == 0
    other, same = perceptron.mean_loss(sent, layers, weights)
    assert np.isclose(other, loss, rtol=1e-12) and np.allclose(same, gradient)


def test_epochs_go_on_with_one_solver(spark):
    df = labelled_vectors(spark)
    whole = model.train_classifier(df, hidden=(5,), max_iter=20).summary()
    assert len(whole.objectiveHistory) == 21
    assert all(b < a for a, b in zip(whole.objectiveHistory, whole.objectiveHistory[1:]))
    fitted, history = model.train_with_history(df, df, hidden=(5,), epochs=5, iterations=4)
    assert np.allclose([h[1] for h in history], whole.objectiveHistory[4::4])
    # The rows are packed once, and an iteration seldom takes more than a pass over them.
    assert fitted.summary().solver.passes <= 40
    assert np.isclose(history[-1][1], history[-1][2], rtol=1e-6)


def test_rows_that_cannot_be_trained_on(spark):
    good = [([1.0, 2.0], 0.0), ([2.0, 1.0], 1.0)]
    for bad in (([1.0, float("nan")], 0.0), ([1.0], 0.0), ([1.0, 2.0], 2.0), ([1.0, 2.0], None)):
        df = spark.createDataFrame([*good, bad], "features array<double>, label double")
        with pytest.raises(Exception, match="train on"):
            model.train_classifier(df, hidden=(2,), max_iter=1)
