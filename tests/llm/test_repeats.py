"""Repeat removal and the Jaccard join against brute force."""

import re

import numpy as np
import pytest
from cases import awkward, documents, empty, prose

from pyspark.sql import functions as F

import corpus_pipeline
from fieldspark.llm import jaccard_join, repeats
from fieldspark.llm.graph import components

LAST = 2**63 - 1


def covered(rows, length=50):
    """Flags of the bytes to remove, per row."""
    raw = [(LAST if k is None else k, (t or "").encode()) for k, t in rows]
    first = {}
    for key, data in raw:
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            first[s] = min(key, first.get(s, key))
    out = []
    for key, data in raw:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < key:
                gone[i : i + length] = True
        out.append(gone)
    return out


def test_removed_bytes(spark):
    rows = awkward() + [
        (20, "q" + awkward()[0][1][30:200] + "z"),
        (21, "ab" * 200),
        (22, "b" + "ab" * 300),
        (23, awkward()[4][1][100:149]),
    ]
    cleaned = repeats.remove_repeats(documents(spark, rows))
    assert cleaned.columns[:2] == ["doc_id", "text"]
    got = sorted((str(r.doc_id), r.text or "", r.n_bytes, r.n_removed, bytes(r.kept), list(r.removed)) for r in cleaned.collect())
    want = []
    for (key, text), gone in zip(rows, covered(rows), strict=True):
        data = (text or "").encode()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).tolist()
        kept = bytes(b for b, g in zip(data, gone.tolist(), strict=True) if not g)
        want.append((str(key), text or "", len(data), int(gone.sum()), kept, edges))
    assert got == sorted(want)


def test_no_documents(spark):
    assert repeats.remove_repeats(empty(spark)).count() == 0


SHARED = "a passage of more than fifty bytes that two documents share word by word"


def cleaned_texts(spark, rows, **columns):
    docs = documents(spark, rows, clashes=False).withColumns(columns)
    return docs, corpus_pipeline.repeated_passages(spark, docs, None)


def test_signs_of_the_input_stay(spark):
    """A run that cuts one character leaves the U+FFFD that the text itself has."""
    # The run ends between the two bytes of a character: both texts have its first byte.
    rows = [(1, SHARED + "\u00e9 first"), (2, "bad \ufffd sign here \ufffd" + SHARED + "\u00e8 two \ufffd end")]
    _, clean = cleaned_texts(spark, rows)
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert got == {1: rows[0][1], 2: "bad \ufffd sign here \ufffd two \ufffd end"}


def test_halves_of_two_characters_make_no_third(spark):
    rows = [(1, "x\u0129" + SHARED + "\u00c4y"), (2, "start \u00e9" + SHARED + "\u00e4 end")]
    raw = [t.encode() for _, t in rows]
    # Both texts have the last byte of the character in front and the first of the one behind.
    assert raw[0][2:3] == raw[1][7:8] == b"\xa9" and b"\xc3" in raw[0][-4:]
    _, clean = cleaned_texts(spark, rows)
    assert {r["doc_id"]: r["text"] for r in clean.collect()}[2] == "start  end"


def test_columns_named_like_the_operators_stay(spark):
    rows = [(1, SHARED + " one"), (2, "two " + SHARED)]
    docs, clean = cleaned_texts(
        spark, rows, kept=F.lit("mine"), n_bytes=F.lit("b"), n_removed=F.lit(2.5), removed=F.array(F.lit(1)), n_chars=F.lit(9)
    )
    assert clean.dtypes == docs.dtypes
    for r in clean.collect():
        assert (r["kept"], r["n_bytes"], r["n_removed"], r["removed"]) == ("mine", "b", 2.5, [1])
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("length", [4, 8, 11])
@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats(seed, length):
    """All repeats that cannot grow, with all their places."""
    rng = np.random.default_rng(seed)
    strings = [bytes(rng.integers(97, 99 + seed % 3, rng.integers(0, 60)).astype(np.uint8)) for _ in range(6)]
    strings += [strings[i][3:40] for i in range(4)]
    places = {}
    for w, s in enumerate(strings):
        for i in range(len(s)):
            for size in range(length, len(s) - i + 1):
                places.setdefault(s[i : i + size], set()).add((w, i))
    want = set()
    for text, found in places.items():
        left = {strings[w][i - 1] if i else ("start", w, i) for w, i in found}
        right = {
            strings[w][i + len(text)] if i + len(text) < len(strings[w]) else ("end", w, i) for w, i in found
        }
        starts = any(i == 0 for _, i in found)
        if len(found) > 1 and (len(left) > 1 or starts) and len(right) > 1:
            want.add((text, tuple(sorted(found))))
    got = {
        (strings[o[0][0]][o[0][1] : o[0][1] + size], tuple(sorted(o)))
        for size, o in repeats.maximal_repeats(strings, length)
    }
    assert got == want


# -- Jaccard join --------------------------------------------------------------


def shingles(text, words):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def by_brute_force(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = label[i], label[j]
                    label = [b if x == a else x for x in label]
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        own = key if not sets[i] else (min(keys) if keys else None)
        out.append((str(key), len(sets[i]), str(own)))
    return sorted(out)


def edited(text, every, seed):
    rng = np.random.default_rng(seed)
    words = text.split()
    for i in rng.choice(len(words), max(1, len(words) // every), replace=False).tolist():
        words[i] = f"w{seed}x{i}"
    return " ".join(words)


def many_copies():
    rows = list(awkward())
    base = [prose(40, 150), prose(41, 40), prose(42, 700)]
    for k in range(90):
        rows.append((100 + k, edited(base[k % 3], [25, 45, 70, 110][k % 4], k)))
    shared = prose(50, 60)
    rows += [(300 + k, prose(60 + k, 30) + shared) for k in range(25)]
    rows += [(400 + k, "UPPER case " + "One two Three"[: 5 + k]) for k in range(8)]
    return rows


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_components_of_links(spark, words, percent):
    rows = many_copies()
    found = jaccard_join.jaccard_components(documents(spark, rows), words, percent)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect())
    assert got == by_brute_force(rows, words, percent)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = many_copies()
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard_join, "SKETCHES", 9)
    found = jaccard_join.jaccard_components(documents(spark, rows), 4, 85)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect())
    assert got == by_brute_force(rows, 4, 85)


def test_nothing_to_join(spark):
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0
    alone = documents(spark, [(1, "one text here now"), (2, "another one over there")])
    assert sorted(r.component_id for r in jaccard_join.jaccard_components(alone).collect()) == [1, 2]


def test_keep_smallest(spark):
    rows = many_copies()
    kept = jaccard_join.keep_smallest(documents(spark, rows), 4, 85)
    gone = {k for k, _, c in by_brute_force(rows, 4, 85) if k not in ("None", c)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, _ in rows if str(k) not in gone)
    assert kept.columns == documents(spark, rows).columns


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {labels[i] for i in range(41)} == {0}
    assert {labels[i] for i in range(100, 400)} == {100}
