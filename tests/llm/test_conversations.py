"""The trie of conversations against a plain trie of all prefixes."""

import hashlib
import random
import re
import zlib

import pytest
from cases import collected

from fieldspark.llm import conversation_trie as ct

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string, depth string, words long, batch int, ha string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def by_brute_force(rows):
    convs = rebuilt(rows)
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    words = lambda key: len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[:-1] == k for x in below)]
        ends = sorted(c for c in members if len(convs[c]) == len(key))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children), len(leaves),
            sum((len(nodes[k]) - 1) * words(k) for k in below),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def random_rows(seed, n, length, alphabet=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), n):
        for t in range(rng.randint(1, length)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", " ".join("ab"[: rng.randint(1, 2)] * rng.randint(1, alphabet))))
    return rows


CASES = {
    "shared": random_rows(1, 60, 6),
    "copies": [(c, t, "user", f"x{t} y") for c in range(100, 160) for t in range(3)] + random_rows(3, 20, 5),
    "nulls": [(None, 0, "user", "lost"), (5, None, None, None), (5, None, "user", "  "), (5, 1, "u", "a b"), (5, 1, "u", "a b"),
              (7, 2, None, "x"), (7, 1, "r", None), (27, 3, "u", "w " * 3000), (40, 1, "u", "é ü\x0b ö"), (45, 1, "u", "é ü\x0b ö")],
}


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)
    return collected(ct.conversation_nodes(df, **kw), *COLUMNS)


def key(row):
    return tuple((x is None, 0 if x is None else x) for x in row)


@pytest.mark.parametrize("name", sorted(CASES))
def test_nodes_equal_those_of_all_prefixes(spark, name):
    assert sorted(found(spark, CASES[name]), key=key) == sorted(by_brute_force(CASES[name]), key=key)


@pytest.mark.parametrize("batches", [5])
def test_batches_do_not_matter(spark, batches):
    rows = CASES["shared"]
    assert sorted(found(spark, rows, batches=batches), key=key) == sorted(by_brute_force(rows), key=key)


def test_chunks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK", 3)
    monkeypatch.setattr(ct, "IDS", 7)
    rows = random_rows(2, 25, 40, 1) + [(c, t, "user", f"x{t} y") for c in range(1100, 1160) for t in range(3)]
    assert sorted(found(spark, rows), key=key) == sorted(by_brute_force(rows), key=key)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a long, b long").selectExpr("a", "b", ct.two_fattest("a", "b") + " AS f")
    for a, b, f in df.collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_prefixes_are_not_shuffled_to_meet_probes(spark):
    rows = spark.range(3000).selectExpr("id % 50 AS conv_id", "id div 50 AS depth", "id AS ha", "id AS hb", "0L AS batch")
    table = ct.write_prefixes(rows, 3000)
    assert table.count() == 3000
    probes = spark.createDataFrame([(1, 5), (2, 9)], "conv_id long, f long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ct._at(table, probes, "f", ha="ha")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert sorted((r["conv_id"], r["ha"]) for r in found.collect()) == [(1, 251), (2, 452)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
