"""Ranked search against scores of all documents."""

import math
import random
import re

import numpy as np
import pytest
from cases import awkward, documents, empty, prose

from fieldspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_brute_force(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, ws) for i, ws in held if ws]
    n_docs, total = len(held), sum(len(ws) for _, ws in held)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        wanted = terms(text)
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(w in ws for _, ws in held) + 1))) for w in set(wanted)}
        for i, ws in held:
            m = 100 - 75 + (75 * len(ws) * n_docs) // total
            score = sum(weight[w] * ((10**9 * ws.count(w)) // (1000 * ws.count(w) + 8 * m)) for w in wanted)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if null else i, -score))
    return sorted(out, key=repr)


def ranked(docs, items, **kw):
    rows = lexical.rank_documents(docs, items, **kw).collect()
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows], key=repr)


ITEMS = [(1, "river stone the"), (2, "ÉNORME Énorme énorme lights"), (3, "absent"), (4, ""), (5, None), (6, "日本語のテキスト x"),
         (7, "no no no no wind casa"), (7, "no no no no wind casa"), (7, "casa"), (None, "endoftext 12 5"), (9, prose(2, 120))]


def items_of(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "q", 1) for r in rows], "item_id long, text string, query string, score int")


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 40)))) for i in range(n)]
    return docs + [(i + n, docs[0][1]) for i in range(n // 3)]


def test_awkward_documents(spark):
    rows = awkward()
    assert ranked(documents(spark), items_of(spark)) == by_brute_force(rows, ITEMS)


def test_small_shards_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 40)
    monkeypatch.setattr(lexical, "SEED_SHARDS", 2)
    monkeypatch.setattr(lexical.cluster, "__defaults__", (5,))
    monkeypatch.setattr(lexical.groups_of, "__defaults__", (4,))
    rows = corpus(300)
    items = [(i, " ".join(random.Random(i).choices([f"w{j}" for j in range(62)], k=6))) for i in range(8)]
    items += [(100, "w0"), (101, rows[0][1])]
    got = ranked(documents(spark, rows).repartition(3), items_of(spark, items), k=7)
    assert got == by_brute_force(rows, items, 7)


def test_bounds_hold_and_skip(monkeypatch):
    rng = np.random.default_rng(1)
    n_docs, n_terms = 400, 30
    values = np.where(rng.random((n_docs, n_terms)) < 0.3, rng.integers(1, 999_999, (n_docs, n_terms)), 0)
    values[100:200] = values[100]
    doc, place = np.nonzero(values)
    index = lexical.build_shard(doc, place, values[doc, place], n_docs, n_terms)
    starts = np.append(0, index["ends"][:-1])
    for term in range(n_terms):
        members = []
        for b in range(index["first_block"][term], index["first_block"][term + 1]):
            own = index["members"][starts[b] : index["ends"][b]]
            assert 0 < len(own) <= lexical.BLOCK
            row = index["summary"][b]
            assert (row >= 0) == (np.count_nonzero(values[:, term]) > lexical.SHORT)
            if row >= 0:
                assert (index["maxima"][row].astype(int) * lexical.STEP >= values[own].max(axis=0)).all()
            members.extend(own.tolist())
        assert sorted(members) == np.flatnonzero(values[:, term]).tolist()
    index |= {"doc": doc, "place": place, "value": values[doc, place], "id": np.arange(n_docs), "null": np.zeros(n_docs, bool)}
    wanted = [(np.array([1, 2, 3]), np.array([5000, 70, 900])), (np.array([7]), np.array([3]))]
    scores = [values[:, t].astype(np.int64) @ w for t, w in wanted]
    best = [[], []]
    lexical.search_shard(index, wanted, [1, 1], best, 5)
    for own, score in zip(best, scores):
        expected = sorted((-int(s), i) for i, s in enumerate(score) if s > 0)[:5]
        assert [(-s, i) for s, _, i in own] == expected
    again = [[], []]
    seen, scored = lexical.search_shard(index, wanted, [own[-1][0] for own in best], again, 5)
    assert again == best and scored < seen


@pytest.mark.parametrize("what", ["documents", "items"])
def test_empty(spark, what):
    docs = empty(spark) if what == "documents" else documents(spark)
    items = items_of(spark, [] if what == "items" else ITEMS)
    assert ranked(docs, items) == []
