"""Array functions against numpy, statistics against their definitions."""

import datetime
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fieldspark import catalog
from fieldspark.functions import vectors
from fieldspark.operators import evaluate, features, stats
from fieldspark.operators.boxplot import boxplot_stats, exact_quantiles

NAN, INF = float("nan"), float("inf")


def arrays(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<double>")


def out(df, col="v"):
    return [r[col] for r in df.orderBy("i").collect()]


def test_softmax_is_stable(spark):
    rows = [[1000.0, 1001.0], [0.0], [-5.0, 2.0, 2.0]]
    for got, row in zip(out(features.softmax(arrays(spark, rows), "v")), rows):
        e = np.exp(np.array(row) - max(row))
        assert np.allclose(got, e / e.sum())


def test_layer_norm(spark):
    rows = [[1.0, 2.0, 4.0], [3.0, 3.0], [NAN, 1.0]]
    got = out(features.layer_norm(arrays(spark, rows), "v"))
    x = np.array(rows[0])
    assert np.allclose(got[0], (x - x.mean()) / math.sqrt(x.var() + 1e-6))
    assert got[1] == [0.0, 0.0] and got[2] == [0.0, 0.0]


def test_clip_clamp_repair_rectify(spark):
    df = arrays(spark, [[3.0, 4.0], [0.1, 0.1]])
    assert np.allclose(out(features.clip_l2(df, "v", 1.0)), [[0.6, 0.8], [0.1, 0.1]])
    broken = arrays(spark, [[NAN, INF, -INF, 0.5, -2.0]])
    assert out(features.clamp(broken, "v")) == [[0.0, 1.0, -1.0, 0.5, -1.0]]
    assert out(features.repair_invalid(broken, ["v"])) == [[0.0, 0.0, 0.0, 0.5, -2.0]]
    assert out(features.rectify(arrays(spark, [[-2.0, 0.0, 3.0]]), "v")) == [[0.0, 0.0, 3.0]]
    assert out(features.rectify(arrays(spark, [[-2.0, 3.0]]), "v", 0.01)) == [[-0.02, 3.0]]


def test_scalar_forms(spark):
    df = spark.createDataFrame([(0, NAN), (1, 9.0), (2, -9.0)], "i int, v double")
    assert out(features.clamp(df, "v", -1, 1)) == [0.0, 1.0, -1.0]
    assert out(features.repair_invalid(df, ["v"])) == [0.0, 9.0, -9.0]


GRID = [[float(5 * r + c + 1) for c in range(5)] for r in range(5)]


@pytest.mark.parametrize("pad", [0, 1, 2])
def test_convolve_rows_of_a_grid(spark, pad):
    kernel = [1.0, 0.0, -2.0]
    got = out(arrays(spark, GRID + [[1.0]]).withColumn("v", vectors.convolve(F.col("v"), kernel, pad)))
    for g, row in zip(got, GRID + [[1.0]]):
        padded = [0.0] * pad + row + [0.0] * pad
        want = [sum(k * x for k, x in zip(kernel, padded[i:])) for i in range(len(padded) - 2)]
        assert g == want


def test_assemble_and_split(spark):
    df = spark.createDataFrame([(1, [2.0, 3.0], [[4.0], [5.0, 6.0]])], "a int, b array<double>, c array<array<double>>")
    row = features.split_vector(features.assemble_vector(df, ["a", "b", "c"], "x"), "x", 2).first()
    assert (row["x"], row["left"], row["right"]) == ([1, 2, 3, 4, 5, 6], [1, 2], [3, 4, 5, 6])


def test_one_hot_forms(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "new")], "i int, c string")
    codes = stats.fit_dictionary(df.where("i < 3"), "c")
    flags = features.one_hot_columns(df, ["c"], codes).orderBy("i").collect()
    assert [(r["c_a"], r["c_b"]) for r in flags] == [(0, 1), (1, 0), (0, 0), (0, 0)]
    coded = features.one_hot_vectors(df, ["c"], codes)
    dense = coded.select("i", vector_to_array("c_vector").alias("v"))
    assert [v[:2] for v in out(dense)] == [[0, 1], [1, 0], [0, 0], [0, 0]]
    with pytest.raises(ValueError, match="one_hot_vectors"):
        features.one_hot_columns(df, ["c"], codes, max_card=1)
    assert out(features.one_hot_label(spark.createDataFrame([(0, 1)], "i int, y int"), "y", 3), "label_vector") == [[0, 1, 0]]


def test_sparse_entries_do_not_grow_with_the_width(spark):
    # Written out, these rows hold 40 GB of zeros.
    codes = spark.range(100_000).select(
        F.lit("c").alias("column"), F.format_string("v%06d", "id").alias("value"), F.col("id").cast("int").alias("code")
    )
    df = spark.range(50_000).select("id", F.format_string("v%06d", F.col("id") * 2 + 1).alias("c"))
    coded = features.one_hot_vectors(df, ["c"], codes)
    entries = coded.select("id", vectors.sparse_entries("c_vector").alias("e"))
    right = (F.col("e.indices") == F.array((F.col("id") * 2 + 1).cast("int"))) & (F.col("e.values") == F.array(F.lit(1.0)))
    assert entries.where(right).count() == 50_000


def test_the_one_hot_query_reads_what_is_set(spark, tmp_path):
    n = 20_000
    events = spark.range(n).select(
        F.col("id").alias("event_id"), F.lit(datetime.datetime(2024, 1, 1)).alias("ts"), (F.col("id") + n).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("k1").alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    hot = catalog.QUERIES["one_hot_vectors"](spark, str(tmp_path))
    assert hot.where((F.col("hot") == F.col("seq")) & (F.col("flag") == 1.0)).count() == n
    # No search through the zeros of a row.
    assert "array_position" not in hot._jdf.queryExecution().toString()


def test_dictionary_orders(spark):
    df = spark.createDataFrame([(5, "b"), (2, "c"), (9, "a"), (1, "b"), (3, None)], "seq int, v string")
    ordered = {r["value"]: r["code"] for r in stats.fit_dictionary(df, "v").collect()}
    assert ordered == {"a": 0, "b": 1, "c": 2}
    seen = {r["value"]: r["code"] for r in stats.fit_dictionary(df, "v", "first_seen", "seq").collect()}
    assert seen == {"b": 0, "c": 1, "a": 2}


def test_numbers_are_coded_in_number_order(spark):
    df = spark.createDataFrame([(10,), (9,), (100,)], "site int")
    codes = stats.fit_dictionary(df, "site")
    assert sorted((r["code"], r["value"]) for r in codes.collect()) == [(0, "9"), (1, "10"), (2, "100")]
    assert sorted(r["c"] for r in features.apply_dictionary(df, codes, "site", "c").collect()) == [0, 1, 2]


def test_standardizer_uses_population_std_and_skips_missing(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 5.0), (2, None, 5.0), (3, NAN, 5.0)], "i int, a double, b double")
    fitted = stats.fit_standardizer(df, ["a", "b"])
    assert sorted(tuple(r) for r in fitted.collect()) == [("a", 2.0, 1.0), ("b", 5.0, 1.0)]
    scaled = features.standardize(df.where("i < 2"), fitted)
    assert out(scaled, "a") == [-1.0, 1.0] and out(scaled, "b") == [0.0, 0.0]


def test_correlation_is_pairwise_complete_and_survives_constants(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=200)
    rows = [
        (float(a) if i % 5 else None, float(a * 2 + rnd.normal()) if i % 7 else NAN, 4.0) for i, a in enumerate(x)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    r = {(m["x"], m["y"]): m["r"] for m in stats.correlation_matrix(df, ["a", "b", "c"]).collect()}
    both = np.array([(p, q) for p, q, _ in rows if p is not None and not math.isnan(q)])
    assert math.isclose(r["a", "b"], np.corrcoef(both.T)[0, 1], rel_tol=1e-9)
    assert r["b", "a"] == r["a", "b"] and r["a", "a"] == 1.0
    assert r["a", "c"] is None and r["c", "c"] is None


def test_audits(spark):
    df = spark.createDataFrame([(7, [1.0, NAN], INF), (8, [INF, -INF], 1.0)], "i int, v array<double>, s double")
    counts = {r["column"]: (r["nan_count"], r["inf_count"]) for r in stats.invalid_audit(df, ["v", "s"]).collect()}
    assert counts == {"v": (1, 2), "s": (0, 1)}
    spots = sorted((r["i"], r["pos"]) for r in stats.invalid_positions(df, "i", "v").collect())
    assert spots == [(7, 1), (8, 0), (8, 1)]


def test_loss_floor_and_accuracy_over_all_rows(spark):
    df = spark.createDataFrame(
        [("a", [0.25, 0.75], 1), ("a", [1.0, 0.0], 1), ("b", [0.5, 0.5], 0)], "split string, probability array<double>, label int"
    )
    losses = [-math.log(0.75), -math.log(1e-8), -math.log(0.5)]
    assert math.isclose(evaluate.log_loss(df).first()["log_loss"], sum(losses) / 3)
    by = {r["split"]: r for r in evaluate.evaluate(df).collect()}
    assert by["a"]["accuracy"] == 0.5 and by["b"]["accuracy"] == 1.0
    assert math.isclose(by["a"]["loss"], sum(losses[:2]) / 2)


def numpy_box(values):
    q1, q2, q3 = np.percentile(values, [25, 50, 75])
    reach = 1.5 * (q3 - q1)
    inside = [v for v in values if q1 - reach <= v <= q3 + reach]
    return len(values), q1, q2, q3, min(inside), max(inside), len(values) - len(inside)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, 2.0])), min_size=1, max_size=60))
def test_boxplot_is_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (NAN,)], "v double")
    assert np.allclose([float(x) for x in boxplot_stats(df, "v").first()], numpy_box(values), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("cuts", [2, 16, 256])
def test_quantiles_do_not_depend_on_the_cuts(spark, cuts):
    rnd = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rnd.exponential(size=900)] + [("k", float(x)) for x in range(10)]
    got = {r["k"]: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "v", "k", cuts=cuts).collect()}
    for key in ("hot", "k"):
        values = [v for k, v in rows if k == key]
        assert np.allclose([got[key][f"q{i}"] for i in range(3)], np.percentile(values, [25, 50, 75]))


def test_boxplot_of_nothing(spark):
    row = boxplot_stats(spark.createDataFrame([(None,)], "v double"), "v").first()
    assert row["n"] == 0 and row["median"] is None and row["outliers"] == 0
