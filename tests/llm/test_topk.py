"""The bit-sliced index against exact inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import topk


@pytest.mark.parametrize("seed", range(5))
def test_sums_of_bitmaps(seed):
    rng = np.random.default_rng(seed)
    numbers = rng.integers(0, 50, (9, 200))
    columns = [[topk.bitmap((row >> b & 1).astype(bool)) for row in numbers] for b in range(6)]
    digits = topk.add_all(columns)
    total = numbers.sum(axis=0)
    got = np.zeros(200, dtype=int)
    for p, d in enumerate(digits):
        if d is not None:
            got[topk.rows_of(d, 200)] += 1 << p
    assert (got == total).all()
    everything = topk.bitmap(np.ones(200, bool))
    for k in (1, 7, 200):
        assert topk.kth_largest(digits, everything, k) == np.sort(total)[-k]
    assert topk.kth_largest(digits, everything, 201) == 0
    for value in (0, 1, int(np.median(total)), int(total.max()), int(total.max()) + 1, 10**6):
        found = topk.rows_of(topk.at_least(digits, everything, value), 200)
        assert found.tolist() == np.flatnonzero(total >= value).tolist()


@pytest.mark.parametrize("drop", [0, 1, 3, 8, 20])
def test_blocks_are_exact_whatever_is_dropped(drop):
    rng = np.random.default_rng(drop)
    matrix = rng.integers(-300, 300, (150, 12))
    matrix[:, 3] = 5
    ids = rng.permutation(150)
    block = topk.Block(ids, matrix, drop)
    packed = block.pack()
    block = topk.Block.unpack(*(packed[c] for c in ("ids", "numbers", "width", "slices", "bits", "low")), drop)
    for q in range(20):
        weights = matrix[q] if q else np.zeros(12, dtype=int)
        scores = matrix @ weights
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != ids[q])[:5]
        got_ids, got_scores = block.top(ids[q], weights, 5)
        assert [(-s, i) for s, i in zip(got_scores.tolist(), got_ids.tolist(), strict=True)] == want


def expected(rows, step, k):
    whole = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    queries = {}
    for i, v in whole:
        if i % step == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        scored = [(-sum(map(int.__mul__, v, w)), i) for i, w in whole if i != q and len(w) == len(v)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def search(spark, rows, step, k):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table = table.withColumns({c: F.lit(1) for c in ("id", "block", "score", "rank", "label", "numbers")})
    found = topk.search(table, lambda key: key % step == 0, k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


def test_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(200)]
    rows += [(500 + i, rows[i % 3][1]) for i in range(9)]
    rows += [(10, rows[10][1]), (20, rows[4][1]), (None, rows[1][1]), (700, None), (710, [])]
    rows += [(720, [None] * 8), (730, [float("nan")] * 8), (740, [float("inf")] + [0.0] * 7)]
    rows += [(750, [0.5, 0.25]), (751, [-0.5, 1.0]), (760, [0.0] * 8), (770, [100.0] * 8)]
    assert search(spark, rows, 10, 5) == expected(rows, 10, 5)


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.0, 1.0])]
    assert search(spark, rows, 50, 5) == expected(rows, 50, 5)
    assert search(spark, [], 50, 5) == []
