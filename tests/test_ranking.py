"""Exact ranks, splits, shuffles and batches."""

import datetime
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import order, sequence
from fieldspark.operators.ranking import bucketed_rank, hash_rank, sorted_rank


def md5(seed, key):
    return hashlib.md5(f"{seed}-{key}".encode()).hexdigest()


def test_sorted_rank_over_many_partitions_and_text(spark):
    words = [f"Site-{i * 7919 % 1000:06d}" for i in range(1000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(13)
    got = {r["w"]: (r["rank"], r["n"]) for r in sorted_rank(df, ["w"], total="n").collect()}
    assert got == {w: (i, 1000) for i, w in enumerate(sorted(words))}


def test_sorted_rank_of_nothing(spark):
    assert sorted_rank(spark.range(0), ["id"]).collect() == []


def test_bucketed_rank_spreads_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id"
    )
    ranked = bucketed_rank(df.withColumn("b", F.floor(F.col("id") / 64)), ["k"], "b", ["id"], "r", "n")
    seen = {}
    for r in sorted(ranked.collect(), key=lambda r: r["id"]):
        seen.setdefault(r["k"], []).append((r["r"], r["n"]))
    for rows in seen.values():
        assert rows == [(i, len(rows)) for i in range(len(rows))]


@pytest.mark.parametrize("digits", [1, 4])
def test_hash_rank_is_the_md5_order(spark, digits):
    got = [r["id"] for r in hash_rank(spark.range(500), "id", 9, digits=digits).orderBy("rank").collect()]
    assert got == sorted(range(500), key=lambda k: md5(9, k))


@pytest.mark.parametrize("n", [0, 1, 7, 20, 999])
def test_exact_split_sizes(spark, n):
    parts = {r["split"]: r["count"] for r in sequence.exact_split(spark.range(n), "id").groupBy("split").count().collect()}
    first, second = n * 70 // 100, n * 85 // 100
    want = {"train": first, "validation": second - first, "test": n - second}
    assert parts == {k: v for k, v in want.items() if v}


def test_hash_split_does_not_move_when_rows_are_added(spark):
    small = dict(order.hash_split(spark.range(300), "id").collect())
    large = dict(order.hash_split(spark.range(3000), "id").collect())
    assert all(large[k] == v for k, v in small.items())
    assert dict(order.hash_split(spark.range(300), "id", seed=1).collect()) != small
    for k, v in small.items():
        draw = int(md5(42, k)[:8], 16) % 100
        assert v == ("train" if draw < 70 else "validation" if draw < 85 else "test")


def test_seeded_shuffle(spark):
    want = sorted(range(200), key=lambda k: md5(42, k))
    assert [r["id"] for r in order.seeded_shuffle(spark.range(200), "id").collect()] == want
    placed = order.seeded_shuffle(spark.range(200), "id", position="at").collect()
    assert sorted((r["at"], r["id"]) for r in placed) == list(enumerate(want))


@pytest.mark.parametrize("drop", [True, False])
def test_batches(spark, drop):
    df = spark.range(103).repartition(9)
    got = {r["id"]: r["batch"] for r in sequence.assign_batches(df, "id", 10, drop).collect()}
    assert got == {i: i // 10 for i in range(100 if drop else 103)}


def test_preview_and_argmax(spark):
    assert [r["id"] for r in order.preview(spark.range(50), F.desc("id"), 3).collect()] == [49, 48, 47]
    nan = float("nan")
    rows = spark.createDataFrame([([1.0, 3.0, 3.0],), ([nan, 2.0, 1.0],), ([-5.0],)], "s array<double>")
    assert [r["predicted"] for r in order.argmax_class(rows, "s").collect()] == [1, 1, 0]


def test_scatter_bins_cover_every_pair(spark):
    rows = spark.createDataFrame(
        [(float(i % 11), float(i % 7)) for i in range(500)] + [(None, 1.0), (float("nan"), 1.0)], "x double, y double"
    )
    bins = order.scatter_bins(rows, "x", "y", 5, 3).collect()
    assert sum(r["n"] for r in bins) == 500
    assert {r["x_bin"] for r in bins} == set(range(5)) and {r["y_bin"] for r in bins} == set(range(3))
    flat = spark.createDataFrame([(1.0, 2.0)] * 4, "x double, y double")
    assert order.scatter_bins(flat, "x", "y").collect() == [(0, 0, 4)]


def series(spark, days):
    start = datetime.date(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(days=d), float(v)) for k, d, v in days]
    return spark.createDataFrame(rows, "k string, Date date, v double").repartition(5), start


def test_moving_kernel_across_chunks_and_gaps(spark):
    days = [("a", d, d * d % 17) for d in range(300) if d % 29 != 3] + [("b", 5, 2)]
    df, start = series(spark, days)
    lookup = {(k, d): float(v) for k, d, v in days}
    weights = [1.0, -2.0, 0.5, 3.0]
    for pad in (True, False):
        got = {(r["k"], (r["Date"] - start).days): r["kernel"] for r in sequence.moving_kernel(df, "k", "Date", "v", weights, pad=pad).collect()}
        want = {}
        for k, d in lookup:
            near = [lookup.get((k, d + j - 1)) for j in range(4)]
            if pad or None not in near:
                want[k, d] = sum(w * (x or 0.0) for w, x in zip(weights, near))
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_pool_windows_number_rows_not_days(spark):
    days = [("a", d, d) for d in range(200) if d % 3] + [("b", 0, 1)]
    df, _ = series(spark, days)
    values = [v for k, d, v in days if k == "a"]
    got = {(r["k"], r["block"]): r["pooled"] for r in sequence.pool_windows(df, "k", "Date", "v", 4).collect()}
    assert got == {("a", i // 4): max(values[i : i + 4]) for i in range(0, len(values) - 3, 4)}
    tail = sequence.pool_windows(df, "k", "Date", "v", 4, "mean", keep_tail=True).collect()
    assert ("b", 0, 1.0) in [tuple(r) for r in tail]
