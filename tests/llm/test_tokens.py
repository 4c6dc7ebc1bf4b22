"""Encoding, counting and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import awkward, documents, empty, prose
from tokenizers import Tokenizer

from fieldspark.llm import bpe, packing, token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


def strange(n, seed=5):
    rng = random.Random(seed)
    letters = "abcdeé 's<|endoftext|>12\n!?ßΣİ漢🙂́ſǅ\x1c\x85\xa0 "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_trie_encodes_as_the_library(word):
    trie = bpe.Trie(WORD)
    texts = [t or "" for _, t in awkward()] + strange(1500) + ["ab" * 400, "é" * 300]
    ids, at = trie.encode_batch(texts)
    for i, text in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == word.encode(text, add_special_tokens=False).ids
        assert trie.decode(own) == word.decode(own, skip_special_tokens=False)


def test_forgetting_changes_nothing(word, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 40)
    trie = bpe.Trie(WORD)
    for seed in range(4):
        texts = [prose(seed, 150), prose(seed + 1, 150)]
        ids, at = trie.encode_batch(texts)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == word.encode(text, add_special_tokens=False).ids
        assert len(trie.index) <= 40


def test_encode_decode_rows(spark, word):
    rows = bpe.encode_decode(documents(spark), WORD).collect()
    got = sorted(((r.doc_id or -1, r.ids, r.decoded) for r in rows), key=str)
    want = []
    for key, text in awkward():
        ids = word.encode(text or "", add_special_tokens=False).ids
        want.append((key or -1, ids, word.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(empty(spark), WORD).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(144, 70), (300, 80), (1 << 16, 256)])
def test_spliced_counts(byte, chunk, overlap):
    encoder = token_counts.Encoder(BYTE)
    texts = [t or "" for _, t in awkward()] + strange(400)
    texts += ["a" * 1000, "é" * 500, " " * 700, "\n\n " * 200, "<|endoftext|>" * 60, "漢字" * 400]
    want = [len(byte.encode(t, add_special_tokens=False)) for t in texts]
    assert token_counts.count_batch(encoder, texts, chunk, overlap).tolist() == want


def test_widening_reaches_back_to_what_is_settled(byte):
    encoder = token_counts.Encoder(BYTE)
    text = "word " * 30 + "ab" * 2000 + " word" * 30
    assert token_counts.count_tokens(encoder, text, 200, 70) == len(byte.encode(text))


def test_count_rows(spark, byte):
    rows = token_counts.token_counts(documents(spark), BYTE, limit=100).collect()
    assert len(rows) == len(awkward())
    want = sorted(
        (key or -1, len((t or "").encode()), len(byte.encode(t or "", add_special_tokens=False)))
        for key, t in awkward()
    )
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert token_counts.token_counts(empty(spark), BYTE).count() == 0


# -- packing -------------------------------------------------------------------


def test_least_squares_meets_the_conditions():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2, (12, 30)).astype(float)
    b = rng.integers(0, 50, 12).astype(float)
    x = packing.non_negative_least_squares(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all()
    assert slope.max() < 1e-6
    assert np.abs(slope[x > 0]).max() < 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length_once(seed):
    rng = np.random.default_rng(seed)
    n = [0, 1, 3, 40, 500, 5000][seed]
    lengths = np.minimum(512, rng.lognormal(4.5, 1, n).astype(int) + 1)
    histogram = dict(zip(*(c.tolist() for c in np.unique(lengths, return_counts=True)), strict=True))
    patterns = packing.plan(histogram, window=512, grain=8, shortest=64)
    used = {}
    for part, copies in patterns:
        assert sum(part) <= 512 and copies > 0
        for size in part:
            used[size] = used.get(size, 0) + copies
    assert used == histogram
    if n == 5000:
        full = sum(c for _, c in patterns) * 512
        assert lengths.sum() / full > 0.98


def test_pieces_hold_every_token_once(spark, word):
    rows = packing.pack_documents(documents(spark), WORD, window=256).collect()
    by_sequence, total = {}, 0
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    want = []
    for key, text in awkward():
        ids = np.array([*word.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for start in range(0, len(ids), 256):
            part = ids[start : start + 256]
            want.append((key or -1, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
    got = [(r.doc_id or -1, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows]
    assert sorted(got) == sorted(want)
    assert packing.pack_documents(empty(spark), WORD).count() == 0
