"""The Kneser-Ney model against one of plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, documents, empty, prose

from fieldspark.llm import hash_arrays, kneser_ney
from fieldspark.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER)) + [None]


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 1


def lost(counts):
    n = Counter(min(c, 5) for c in counts)
    n1, n2, n3, n4 = (n[i] for i in range(1, 5))
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        if all(0 < x < i + 1 for i, x in enumerate(d)):
            return [0, *d]
    return [0, 0.5, 1.0, 1.5]


class Plain:
    def __init__(self, texts):
        self.known = Counter(w for t in texts for w in words(t))
        self.triples, starts = Counter(), Counter()
        for t in texts:
            own = ["<s>", *words(t)]
            starts[own[0], own[1]] += 1
            self.triples.update(zip(own, own[1:], own[2:]))
        fronts = defaultdict(set)
        for u, v, w in self.triples:
            fronts[v, w].add(u)
        self.pairs = Counter({p: len(f) for p, f in fronts.items()})
        self.pairs.update(starts)
        self.follows = Counter(w for _, w in self.pairs)
        self.lost = [lost(c.values()) for c in (self.triples, self.pairs, self.follows)]
        self.by3, self.by2 = defaultdict(list), defaultdict(list)
        for (u, v, w), c in self.triples.items():
            self.by3[u, v].append(c)
        for (v, w), c in self.pairs.items():
            self.by2[v].append(c)

    @staticmethod
    def mix(count, counts, lost, lower):
        if not counts:
            return lower
        left = sum(lost[min(c, 3)] for c in counts) / sum(counts)
        return (count - lost[min(count, 3)]) / sum(counts) + left * lower

    def p(self, u, v, w):
        p = self.mix(self.follows[w], list(self.follows.values()), self.lost[2], 1 / (len(self.known) + 1))
        p = self.mix(self.pairs[v, w], self.by2.get(v, []), self.lost[1], p)
        return self.mix(self.triples[u, v, w], self.by3.get((u, v), []), self.lost[0], p)

    def score(self, text):
        own = [0, "<s>", *words(text)]
        return sum(math.log10(self.p(*x)) for x in zip(own, own[1:], own[2:]))

    def base(self, text):
        n, v = sum(self.known.values()), len(self.known)
        return sum(math.log10((self.known[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(text))


def expected(rows):
    model = Plain([t for i, t in rows if not held_out(i)])
    return [
        (i, held_out(i), len(words(t)), sum(model.known[w] > 0 for w in words(t)), sum(model.known.values()), model.base(t), model.score(t))
        for i, t in rows
    ]


def check(found, rows):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    got = sorted([tuple(r) for r in found.collect()], key=order)
    want = sorted(expected(rows), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_awkward_documents(spark):
    found = kneser_ney.score_documents(documents(spark))
    assert found.columns == COLUMNS
    check(found, awkward())


def test_split_words_and_many_files(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SPLIT_TOKENS", 40)
    monkeypatch.setattr(kneser_ney, "BUCKET_TOKENS", 300)
    monkeypatch.setattr(kneser_ney, "PART_WORDS", 16)
    monkeypatch.setattr(kneser_ney, "FLUSH", 700)
    rows = [(i, prose(i, 80) + (" the of" * 150 if i % 7 == 0 else "")) for i in range(40)] + awkward()
    check(kneser_ney.score_documents(documents(spark, rows).repartition(3)), rows)


def test_each_file_is_looked_into_a_few_times_for_many_texts(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SPLIT_TOKENS", 10)
    monkeypatch.setattr(kneser_ney, "BUCKET_TOKENS", 100)
    rows = [(i, prose(i, 80) + " the of" * 50) for i in range(40)]
    model = kneser_ney.train(documents(spark, rows).select("text"))
    n = model.buckets.n
    assert n > 60 and len(model.pairs) > n / 2
    looked, find = [], kneser_ney.find
    monkeypatch.setattr(kneser_ney, "find", lambda *x: looked.append(1) or find(*x))
    batch = pa.record_batch([pa.array([t for _, t in rows])], ["text"])
    u, v, w, v_count, _, _ = kneser_ney._sequences(batch, model.vocabulary, model.n_texts)
    whole = model.probabilities(u, v, w, v_count)
    # Contexts and pairs of split and of other words, then what a trigram needs.
    assert len(looked) <= 7 * n
    monkeypatch.setattr(kneser_ney, "SCORE_TOKENS", 999)
    assert (model.probabilities(u, v, w, v_count) == whole).all()


def test_batches_are_scored_together(spark, monkeypatch):
    rows = [(i, prose(i, 80)) for i in range(40)] + awkward()
    df = documents(spark, rows).repartition(2)
    monkeypatch.setattr(kneser_ney, "BATCH", 300)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    check(kneser_ney.score_documents(df), rows)
    monkeypatch.setattr(kneser_ney, "SCORE_TOKENS", 500)
    check(kneser_ney.score_documents(df), rows)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_probabilities_sum_to_one(spark):
    rows = [(i, prose(i, 60)) for i in range(12)]
    model = kneser_ney.train(documents(spark, rows).select("text"))
    size = model.vocabulary.size
    w = np.arange(size + 1)
    for u, v in ((0, 1), (size + 2, size + 1), (size + 1, 3), (size, size), (2, size), (5, 2)):
        count = np.full(size + 1, 12 if v == size + 1 else 1)
        p = model.probabilities(np.full(size + 1, u), np.full(size + 1, v), w, count)
        assert p.min() > 0 and p.sum() == pytest.approx(1, abs=1e-9)


def test_nothing_to_learn_from(spark):
    assert kneser_ney.score_documents(empty(spark)).collect() == []
    check(kneser_ney.score_documents(documents(spark, [(None, "a b"), (None, None)])), [(None, "a b"), (None, None)])


def test_held_out_texts_beat_the_base(spark):
    rows = kneser_ney.score_documents(table(spark, "/root/testdata/sf0.001", "documents")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_blocks_and_tables_round_trip(tmp_path):
    rng = np.random.default_rng(0)
    columns = [np.sort(rng.integers(0, 1 << 40, 500)), rng.integers(0, 300, 500), np.zeros(500, np.int64)]
    assert all((a == b).all() for a, b in zip(columns, kneser_ney.decode(kneser_ney.encode(*columns))))
    assert [len(c) for c in kneser_ney.decode(kneser_ney.encode(columns[0][:0], columns[0][:0]))] == [0, 0]
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    counts = np.where(rng.random(5000) < 0.1, rng.integers(200, 90000, 5000), 1)
    path = hash_arrays.write_arrays(str(tmp_path), "t", hash_arrays.hash_table("x", keys, counts, counts * 2))
    arrays = hash_arrays.read_arrays(path)
    place = hash_arrays.find(arrays, "x", keys)
    assert (hash_arrays.counts_at(arrays, "x", place) == counts).all()
    assert (hash_arrays.counts_at(arrays, "x", place, 1) == 2 * counts).all()
    assert (hash_arrays.find(arrays, "x", ~keys) < 0).all()
