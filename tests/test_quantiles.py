"""Quartiles through buckets that are cut until they are small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import boxplot


def skewed(n, seed=5):
    rng = np.random.default_rng(seed)
    x = np.exp(rng.normal(0, 40, n))  # from 1e-70 to 1e70
    x[: n // 5] = 1.0 + rng.random(n // 5) * 1e-12
    x[n // 5 : n // 4] = 7.0
    return x


@pytest.mark.parametrize("cuts", [2, 16])
def test_quartiles_with_small_buckets(spark, cuts):
    x = skewed(6000)
    rows = [(k, float(v)) for i, v in enumerate(x) for k in (["all"] if i % 9 else ["all", None])]
    df = spark.createDataFrame(rows, "k string, x double")
    got = boxplot.exact_quantiles(df, "x", "k", cuts=cuts, most=40).collect()
    assert len(got) == 2
    for r in got:
        own = [v for k, v in rows if k == r["k"]]
        assert r["n"] == len(own)
        for i, p in enumerate(boxplot.QUARTILES):
            assert r[f"q{i}"] == pytest.approx(np.quantile(own, p), rel=1e-12)


def test_no_bucket_stays_large(spark, monkeypatch):
    most, seen = 500, []
    narrow = boxplot._narrow

    def watched(counted, wanted, key, limit):
        before = counted.count()
        counted, wanted = narrow(counted, wanted, key, limit)
        sizes = counted.groupBy(key, "_bucket").count().agg(F.max("count")).first()[0]
        seen.append((before, sizes))
        return counted, wanted

    monkeypatch.setattr(boxplot, "_narrow", watched)
    df = spark.range(300_000).select(F.lit(1).alias("k"), F.exp(F.randn(3) * 30).alias("x"))
    got = boxplot.exact_quantiles(df, "x", "k", cuts=4, most=most).first()
    (before, largest), = seen
    assert before > 100_000 and largest <= most
    assert [got["q0"], got["q1"], got["q2"]] == pytest.approx(
        list(np.quantile([r["x"] for r in df.select("x").collect()], boxplot.QUARTILES)), rel=1e-12
    )
