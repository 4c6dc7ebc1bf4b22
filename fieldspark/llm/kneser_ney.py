"""Interpolated modified Kneser-Ney model of word trigrams, counted over a whole corpus.

Words are counted first and numbered by the order of their hashes. Trigrams are counted
by bucket of their middle word: the contexts that end in it and the pairs that start
with it lie in one bucket. A frequent middle word is split over as many buckets as its
count asks for, by the word before it; its pairs are then added up by a second job.

Each bucket is a file of sorted hash arrays with counts, not probabilities, so no file is
written twice and every discount comes from the counts of the whole corpus. Workers that
score texts map the files into memory.

Probabilities are those of Chen and Goodman: three discounts an order, lower orders from
the numbers of different words in front, the lowest mixed with an even share of all
training words and one unknown word. Pairs at the start of a text have no word in front
and are counted as they occur.
"""

from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from fieldspark.llm.common import iterate_batches, mix
from fieldspark.llm.hash_arrays import counts_at, find, hash_table, read_arrays, small_counts, write_arrays
from fieldspark.llm.words import word_hashes
from fieldspark.storage import new_path

BATCH = 1 << 20
# The end of a text as a token.
END = np.uint64(0x51ED270B7F1C4A63)
PART_WORDS = 1 << 20
BUCKET_TOKENS = 1 << 21
# A middle word is split once for so many occurrences.
SPLIT_TOKENS = 1 << 20
SPLIT_WORDS = 16
FLUSH = 3 << 20
# Tokens that are scored at once: each file is looked into once for all of them.
SCORE_TOKENS = 1 << 20
ODD1, ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# -- words -----------------------------------------------------------------------


class Vocabulary:
    """The training words: files of sorted hashes with counts, each file one range."""

    def __init__(self, paths, sizes, tokens):
        self.paths, self.tokens = paths, tokens
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.size = int(self.starts[-1])
        # Numbers of what is not a word of the training texts.
        self.unknown, self.begin, self.none = self.size, self.size + 1, self.size + 2

    def look_up(self, hashes):
        """The number of each word, and its count in training."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids = np.full(len(distinct), self.unknown, np.int64)
        counts = np.zeros(len(distinct), np.int64)
        shift = np.uint64(65 - len(self.paths).bit_length())
        part = distinct >> shift if len(self.paths) > 1 else np.zeros(len(distinct), np.uint64)
        paths = dict(enumerate(self.paths)) if self.size else {}
        for own, path in _runs(part, paths):
            arrays = read_arrays(path)
            place = np.minimum(np.searchsorted(arrays["words"], distinct[own]), len(arrays["words"]) - 1)
            known = np.flatnonzero(arrays["words"][place] == distinct[own])
            ids[own.start + known] = place[known] + self.starts[int(part[own.start])]
            counts[own.start + known] = arrays["counts"][place[known]]
        return ids[back], counts[back]


def _with_ends(column):
    """Hashes of the words of all texts, an end behind each text, and their numbers."""
    hashes, counts = word_hashes(column)
    return np.insert(hashes, np.cumsum(counts), END), counts + 1


def count_words(texts, folder):
    """Count the words of ``texts`` (a column ``text``) and write the vocabulary."""
    spark = texts.sparkSession

    def count(batches):
        held, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for batch in batches:
            held.append(np.unique(_with_ends(batch.column("text"))[0], return_counts=True))
            size += len(held[-1][0])
            if size > 2 * PART_WORDS:
                held = [_add_up(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > PART_WORDS:
                    yield {"word": held[0][0].view(np.int64), "n": held[0][1]}
                    held, size = [tuple(c[:0] for c in held[0])], 0
        words, counts = _add_up(*map(np.concatenate, zip(*held)))
        yield {"word": words.view(np.int64), "n": counts}

    partial = iterate_batches(texts.select("text"), count, "word long, n long", BATCH)
    path = new_path(spark, "words")
    partial.groupBy("word").agg(F.sum("n").alias("n")).write.parquet(path)
    counted = spark.read.schema("word long, n long").parquet(path)
    size, tokens = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = int(-(-size // PART_WORDS) - 1).bit_length() if size else 0
    # The leading bits of the hash as an unsigned number.
    part = F.expr(f"shiftrightunsigned(word, {64 - bits})") if bits else F.lit(0).cast("long")
    placed = counted.select(part.alias("part"), "word", "n")
    placed = placed.repartition(1 << bits, "part").sortWithinPartitions("part", "word")

    def write(batches):
        held = {}
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for p in np.unique(parts).tolist():
                own = batch.filter(pa.array(parts == p))
                held.setdefault(p, []).append((own.column("word").to_numpy().view(np.uint64), own.column("n").to_numpy()))
            for p in sorted(held)[:-1]:
                yield store(p, held.pop(p))
        for p in sorted(held):
            yield store(p, held[p])

    def store(p, pieces):
        words = np.concatenate([w for w, _ in pieces])
        order = np.argsort(words)
        arrays = {"words": words[order], "counts": np.concatenate([n for _, n in pieces])[order]}
        return {"part": [p], "path": [write_arrays(folder, f"words-{p}", arrays)], "size": [len(words)]}

    paths, sizes = [None] * (1 << bits), [0] * (1 << bits)
    for row in iterate_batches(placed, write, "part long, path string, size long").collect():
        paths[row["part"]], sizes[row["part"]] = row["path"], row["size"]
    return Vocabulary(paths, sizes, tokens)


def _add_up(keys, counts):
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = _first_of(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _first_of(*columns):
    """Rows at which one of the sorted columns changes."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(columns[0]), dtype=bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


# -- trigrams --------------------------------------------------------------------


def _pair_hash(a, b):
    return mix(mix(np.asarray(a).astype(np.uint64) * ODD1 + np.uint64(1)) + np.asarray(b).astype(np.uint64) * ODD2)


def _triple_hash(u, v, w):
    return mix(_pair_hash(u, v) + np.asarray(w).astype(np.uint64) * ODD1)


class Buckets:
    """Where counts are kept: by middle word, frequent ones by the word before too."""

    def __init__(self, tokens):
        self.n = int(max(1, -(-tokens // BUCKET_TOKENS)))
        # For the contexts of split words alone: they are at most twice as many as buckets.
        self.n_split = -(-self.n // SPLIT_WORDS)
        self.split_tokens = SPLIT_TOKENS

    def is_split(self, v_count):
        return v_count >= self.split_tokens

    def of(self, u, v, v_count):
        shares = 1 + v_count // self.split_tokens
        share = mix(np.asarray(u).astype(np.uint64) + ODD2) % shares.astype(np.uint64)
        return (_pair_hash(v, share) % np.uint64(self.n)).astype(np.int64)

    def of_pair(self, v, w):
        return (_pair_hash(v, w) % np.uint64(self.n)).astype(np.int64)

    def of_word(self, v):
        return (mix(np.asarray(v).astype(np.uint64) + ODD1) % np.uint64(self.n_split)).astype(np.int64)


def _sequences(batch, vocabulary, texts_known):
    """For every token: its number and count, and those of the two words before it in
    its text (``begin`` before the first, ``none`` before that)."""
    hashes, lengths = _with_ends(batch.column("text"))
    ids, counts = vocabulary.look_up(hashes)
    first = np.cumsum(lengths) - lengths
    v, u = np.roll(ids, 1), np.roll(ids, 2)
    v_count = np.roll(counts, 1)
    v[first], v_count[first] = vocabulary.begin, texts_known
    u[first] = vocabulary.none
    second = first[lengths > 1] + 1
    u[second] = vocabulary.begin
    return u, v, ids, v_count, counts, lengths


def _order(first, second):
    """The order of rows by two columns of non-negative numbers; of equal ones any."""
    if max((int(x.max()) for x in (first, second) if len(x)), default=0) < 1 << 32:
        return np.argsort(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64))
    return np.lexsort((second, first))


def _sorted_rows(u, v, w, *columns):
    """Rows in the order of v, w, u."""
    order = _order(v, w)
    pair = np.zeros(len(order), np.int64)
    pair[_first_of(v[order], w[order])] = 1
    order = order[_order(np.cumsum(pair), u[order])]
    return [x[order] for x in (u, v, w, *columns)]


def encode(*columns):
    """Columns of non-negative numbers as compressed bytes; the first one is sorted."""
    columns = [np.diff(columns[0], prepend=0), *columns[1:]]
    raw = [np.array([len(columns[0])], np.int64).tobytes()]
    for c in columns:
        width = next(x for x in (1, 2, 4, 8) if not len(c) or int(c.max()) < 1 << (8 * x - (x == 8)))
        kind = np.dtype(f"u{width}")
        raw.append(bytes([width]) + c.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes())
    return zstandard.compress(b"".join(raw), 1)


def decode(block):
    data = np.frombuffer(zstandard.decompress(block), np.uint8)
    n, at, columns = int(data[:8].view(np.int64)[0]), 8, []
    while at < len(data):
        width = int(data[at])
        planes = data[at + 1 : at + 1 + n * width].reshape(width, n)
        columns.append(np.ascontiguousarray(planes.T).view(f"u{width}").reshape(n).astype(np.int64))
        at += 1 + n * width
    columns[0] = np.cumsum(columns[0])
    return columns


def _blocks(bucket, *columns):
    """A compressed block of rows for each bucket; rows keep their order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
    start = 0
    for end in ends.tolist() if len(bucket) else []:
        yield int(bucket[start]), encode(*[c[start:end] for c in columns])
        start = end


def count_trigrams(texts, vocabulary, n_texts, buckets):
    """``bucket, block`` of the trigrams of a column ``text``, added up before they are
    shuffled."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.stack(_sequences(batch, vocabulary, n_texts)[:4]))
            size += held[-1].shape[1]
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def flush(held):
        columns = np.concatenate(held, axis=1)
        held.clear()
        u, v, w, v_count = _sorted_rows(*columns)
        first = _first_of(v, w, u)
        times = np.diff(np.append(first, len(u)))
        u, v, w, v_count = u[first], v[first], w[first], v_count[first]
        split = buckets.is_split(v_count).astype(np.int64)
        rows = list(_blocks(buckets.of(u, v, v_count), v, w, u, times, split))
        return {"bucket": [b for b, _ in rows], "block": [x for _, x in rows]}

    return iterate_batches(texts.select("text"), count, "bucket long, block binary", BATCH)


def _by_bucket(batches):
    """The columns of each bucket from rows sorted by bucket."""
    rows = ((b, x) for batch in batches for b, x in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()))
    for bucket, own in groupby(rows, key=lambda r: r[0]):
        yield bucket, [np.concatenate(c) for c in zip(*[decode(x) for _, x in own])]


def count_of_counts(counts):
    return np.bincount(np.minimum(counts, 5), minlength=5)[1:5].tolist()


def _contexts(keys, counts):
    """Distinct sorted ``keys`` with the sum of counts and how many are 1, 2 and more."""
    first = _first_of(*keys)
    sums = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return first, (sums(counts), sums(counts == 1), sums(counts == 2), sums(counts >= 3))


def _fingerprint(w):
    return (mix(np.asarray(w).astype(np.uint64) + ODD1) >> np.uint64(48)).astype(np.uint16)


def context_tables(u, v, w, times):
    """Tables of trigrams and their contexts. Most contexts are seen once: those keep a
    mark of their one word and have no trigram of their own."""
    key = _pair_hash(u, v)
    order = np.argsort(key)
    key, u, v, w, times = key[order], u[order], v[order], w[order], times[order]
    first, sums = _contexts((key,), times)
    once = np.repeat(sums[0] == 1, np.diff(np.append(first, len(u))))
    lone, many = first[sums[0] == 1], first[sums[0] > 1]
    out = hash_table("once", key[lone], extra=_fingerprint(w[lone]))
    out |= hash_table("context", key[many], *[s[sums[0] > 1] for s in sums])
    return out | hash_table("triple", _triple_hash(u[~once], v[~once], w[~once]), times[~once])


def pair_tables(v, w, counts):
    """Tables of pairs sorted by v and of their contexts."""
    first, sums = _contexts((v,), counts)
    out = hash_table("pair", _pair_hash(v, w), counts)
    return out | hash_table("before", mix(v[first].astype(np.uint64)), *sums)


OUT = "kind string, bucket long, path string, numbers array<long>, block binary"


def _out(kind, bucket, path=None, numbers=None, block=None):
    return {"kind": [kind], "bucket": [bucket], "path": [path], "numbers": [numbers], "block": [block]}


def _placed(blocks, n):
    return blocks.repartition(n, "bucket").sortWithinPartitions("bucket")


def store_trigrams(blocks, vocabulary, buckets, folder):
    """Write a file for each bucket. The result has their paths with counts of counts,
    what was counted of the pairs of split words (``pairs``), and of how many different
    words each word follows (``follows``)."""
    begin, none = vocabulary.begin, vocabulary.none

    def store(batches):
        for bucket, (v, w, u, times, split) in _by_bucket(batches):
            u, v, w, times, split = _sorted_rows(u, v, w, times, split)
            first = _first_of(v, w, u)
            u, v, w, split = u[first], v[first], w[first], split[first] > 0
            times = np.add.reduceat(times, first)
            full = u != none
            arrays = context_tables(u[full], v[full], w[full], times[full])
            first = _first_of(v, w)
            # Different words in front; how often at the start of a text, which has none.
            fronts = np.diff(np.append(first, len(v)))
            fronts = np.where(v[first] == begin, times[first], fronts)
            v, w, split = v[first], w[first], split[first]
            whole = ~split
            arrays |= pair_tables(v[whole], w[whole], fronts[whole])
            numbers = count_of_counts(times[full]) + count_of_counts(fronts[whole])
            yield _out("file", bucket, write_arrays(folder, f"trigrams-{bucket}", arrays), numbers)
            for kind, to, columns in (
                ("pairs", buckets.of_pair(v[split], w[split]), (v[split], w[split], fronts[split])),
                ("follows", *_word_counts(w[whole], vocabulary)),
            ):
                for place, block in _blocks(to, *columns):
                    yield _out(kind, place, block=block)

    return iterate_batches(_placed(blocks, buckets.n), store, OUT)


def _word_counts(w, vocabulary):
    words, counts = np.unique(w, return_counts=True)
    return np.searchsorted(vocabulary.starts, words, side="right") - 1, (words, counts)


def store_split_pairs(blocks, vocabulary, buckets, folder):
    """Add up the pairs of split words and write them; results like ``store_trigrams``,
    with ``before`` for the sums of the words' contexts."""

    def store(batches):
        for bucket, (v, w, fronts) in _by_bucket(batches):
            order = np.lexsort((w, v))
            v, w, fronts = v[order], w[order], fronts[order]
            first = _first_of(v, w)
            fronts = np.add.reduceat(fronts, first)
            v, w = v[first], w[first]
            arrays = hash_table("pair", _pair_hash(v, w), fronts)
            yield _out("file", bucket, write_arrays(folder, f"pairs-{bucket}", arrays), count_of_counts(fronts))
            first, sums = _contexts((v,), fronts)
            for place, block in _blocks(buckets.of_word(v[first]), v[first], *sums):
                yield _out("before", place, block=block)
            to, columns = _word_counts(w, vocabulary)
            for place, block in _blocks(to, *columns):
                yield _out("follows", place, block=block)

    return iterate_batches(_placed(blocks, buckets.n), store, OUT)


def store_split_contexts(blocks, buckets, folder):
    def store(batches):
        for bucket, (v, *sums) in _by_bucket(batches):
            order = np.argsort(v, kind="stable")
            v, sums = v[order], [s[order] for s in sums]
            first = _first_of(v)
            arrays = hash_table("before", mix(v[first].astype(np.uint64)), *[np.add.reduceat(s, first) for s in sums])
            yield _out("file", bucket, write_arrays(folder, f"before-{bucket}", arrays))

    return iterate_batches(_placed(blocks, buckets.n_split), store, OUT)


def store_follows(blocks, vocabulary, folder):
    """For every training word, after how many different words it comes."""

    def store(batches):
        for part, (w, counts) in _by_bucket(batches):
            low = int(vocabulary.starts[part])
            follows = np.zeros(int(vocabulary.starts[part + 1]) - low, np.int64)
            np.add.at(follows, w - low, counts)
            numbers = [*count_of_counts(follows), int(follows.sum()), *[int(x.sum()) for x in (follows == 1, follows == 2, follows > 2)]]
            yield _out("file", part, write_arrays(folder, f"follows-{part}", small_counts("follows", follows)), numbers)

    return iterate_batches(_placed(blocks, len(vocabulary.paths)), store, OUT)


# -- the model -------------------------------------------------------------------


def discounts(n):
    """What counts of 1, 2 and more lose, from the numbers of counts 1 to 4. Where
    those are too few to tell, half of the count up to three."""
    n1, n2, n3, n4 = n
    if min(n) > 0:
        y = n1 / (n1 + 2 * n2)
        found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        if all(0 < d < i for i, d in enumerate(found, 1)):
            return np.array([0.0, *found])
    return np.array([0.0, 0.5, 1.0, 1.5])


class Model:
    """Paths of the files by bucket and the discounts; small, sent to every task."""

    def __init__(self, vocabulary, buckets, n_texts, trigrams, pairs, before, follows):
        self.vocabulary, self.buckets, self.n_texts = vocabulary, buckets, n_texts
        paths = lambda rows: {r["bucket"]: r["path"] for r in rows}
        self.trigrams, self.pairs, self.before, self.follows = map(paths, (trigrams, pairs, before, follows))
        total = lambda rows, a, b: np.sum([r["numbers"][a:b] for r in rows] or [[0] * (b - a)], axis=0)
        self.lost3 = discounts(total(trigrams, 0, 4).tolist())
        self.lost2 = discounts((total(trigrams, 4, 8) + total(pairs, 0, 4)).tolist())
        numbers = total(follows, 0, 8).tolist()
        self.lost1, self.all_follows = discounts(numbers[:4]), numbers[4]
        spread = sum(d * n for d, n in zip(self.lost1[1:], numbers[5:]))
        self.even = (spread / self.all_follows if self.all_follows else 1.0) / (vocabulary.size + 1)

    def probabilities(self, u, v, w, v_count):
        """Of each word ``w`` after ``u, v``, given as numbers."""
        p = np.empty(len(w))
        for start in range(0, len(w), SCORE_TOKENS):
            own = slice(start, start + SCORE_TOKENS)
            p[own] = self._probabilities(u[own], v[own], w[own], v_count[own])
        return p

    def _probabilities(self, u, v, w, v_count):
        """Each pair and each word is looked up once, and all that is wanted of a file at
        a time."""
        order = _order(v, w)
        u, v, w, v_count = u[order], v[order], w[order], v_count[order]
        first = _first_of(v, w)
        times = np.diff(np.append(first, len(w)))
        p = np.repeat(self._pairs(v[first], w[first], v_count[first]), times)
        self._mix_triples(p, u, v, w, v_count)
        out = np.empty(len(p))
        out[order] = p
        return out

    def _words(self, w):
        """Of the words themselves."""
        words = self.vocabulary
        distinct, back = np.unique(w, return_inverse=True)
        p = np.full(len(distinct), self.even)
        known = distinct[: np.searchsorted(distinct, words.size)]
        part = np.searchsorted(words.starts, known, side="right") - 1
        for own, path in _runs(part, self.follows):
            a = counts_at(read_arrays(path), "follows", known[own] - words.starts[part[own.start]])
            p[own] += (a - self.lost1[np.minimum(a, 3)]) / self.all_follows
        return p[back]

    def _pairs(self, v, w, v_count):
        """Of ``w`` after ``v``: distinct pairs in this order."""
        p, buckets = self._words(w), self.buckets
        count, told = np.zeros(len(v), np.int64), v != self.vocabulary.unknown
        split = buckets.is_split(v_count)
        first = _first_of(v)
        sums = np.zeros((4, len(first)), np.int64)
        # Pairs of words that are not split stand beside their trigrams, wherever their u.
        home = buckets.of(np.zeros(len(v), np.int64), v, v_count)
        for of, at, paths in ((~split, home, self.trigrams), (split, buckets.of_word(v), self.before)):
            rows = np.flatnonzero((told & of)[first])
            for own, path in _groups(rows, at[first[rows]], paths):
                arrays = read_arrays(path)
                place = find(arrays, "before", mix(v[first[own]].astype(np.uint64)))
                sums[:, own] = [counts_at(arrays, "before", place, i) for i in range(4)]
        sums = np.repeat(sums, np.diff(np.append(first, len(v))), axis=1)
        key = _pair_hash(v, w)
        for of, at, paths in ((~split, home, self.trigrams), (split, buckets.of_pair(v, w), self.pairs)):
            rows = np.flatnonzero(told & of & (sums[0] > 0))
            for own, path in _groups(rows, at[rows], paths):
                arrays = read_arrays(path)
                count[own] = counts_at(arrays, "pair", find(arrays, "pair", key[own]))
        there = np.flatnonzero(sums[0])
        self._mix(p, there, count[there], sums[:, there], self.lost2)
        return p

    def _mix_triples(self, p, u, v, w, v_count):
        words = self.vocabulary
        rows = np.flatnonzero((v != words.unknown) & (u != words.unknown) & (u != words.none))
        key = _pair_hash(u, v)
        for own, path in _groups(rows, self.buckets.of(u[rows], v[rows], v_count[rows]), self.trigrams):
            arrays = read_arrays(path)
            place = find(arrays, "once", key[own])
            lone, at = own[place >= 0], place[place >= 0]
            if len(lone):
                same = arrays["once_extra"][at] == _fingerprint(w[lone])
                p[lone] = self.lost3[1] * p[lone] + np.where(same, 1 - self.lost3[1], 0.0)
                own = own[place < 0]
            place = find(arrays, "context", key[own])
            own, place = own[place >= 0], place[place >= 0]
            count = counts_at(arrays, "triple", find(arrays, "triple", _triple_hash(u[own], v[own], w[own])))
            self._mix(p, own, count, [counts_at(arrays, "context", place, i) for i in range(4)], self.lost3)

    @staticmethod
    def _mix(p, own, count, sums, lost):
        total, ones, twos, more = sums
        left = (lost[1] * ones + lost[2] * twos + lost[3] * more) / total
        p[own] = (count - lost[np.minimum(count, 3)]) / total + left * p[own]


def _runs(bucket, paths):
    """Slices of equal sorted ``bucket`` with the path of its file; those without a file
    are left out."""
    first = _first_of(bucket).tolist()
    for start, end in zip(first, [*first[1:], len(bucket)]):
        path = paths.get(int(bucket[start]))
        if path is not None:
            yield slice(start, end), path


def _groups(rows, bucket, paths):
    """Rows by bucket with the path of its file; buckets without a file are left out."""
    order = np.argsort(bucket, kind="stable")
    rows = rows[order]
    for own, path in _runs(bucket[order], paths):
        yield rows[own], path


def train(texts):
    """The model of a table with a column ``text`` (no nulls)."""
    spark = texts.sparkSession
    folder = new_path(spark, "kneser-ney")
    vocabulary = count_words(texts, folder)
    n_texts = texts.count()
    buckets = Buckets(vocabulary.tokens)

    def run(name, out):
        path = new_path(spark, name)
        out.write.parquet(path)
        out = spark.read.schema(OUT).parquet(path)
        # One row a file.
        return out, out.where("kind = 'file'").select("bucket", "path", "numbers").collect()

    blocks = count_trigrams(texts, vocabulary, n_texts, buckets)
    first, trigrams = run("trigrams", store_trigrams(blocks, vocabulary, buckets, folder))
    part = lambda out, kind: out.where(F.col("kind") == kind).select("bucket", "block")
    second, pairs = run("pairs", store_split_pairs(part(first, "pairs"), vocabulary, buckets, folder))
    _, before = run("before", store_split_contexts(part(second, "before"), buckets, folder))
    follows = part(first, "follows").union(part(second, "follows"))
    _, follows = run("follows", store_follows(follows, vocabulary, folder))
    return Model(vocabulary, buckets, n_texts, trigrams, pairs, before, follows)


def score(docs, model):
    """The columns of ``docs`` but ``text``, and ``n_tokens, n_known, train_tokens,
    base_score, score`` of each text, log10 probabilities."""
    vocabulary = model.vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in docs.schema if f.name != "text")
    base = vocabulary.tokens + 0.5 * (vocabulary.size + 1)

    def several(batches):
        model, held, size = shared.value, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            others = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            held.append((others, *_sequences(batch, model.vocabulary, model.n_texts)))
            size += len(held[-1][1])
            if size >= SCORE_TOKENS:
                yield scored(model, held)
                held, size = [], 0
        if held:
            yield scored(model, held)

    def scored(model, held):
        others, *columns = zip(*held)
        u, v, w, v_count, counts, lengths = map(np.concatenate, columns)
        first = np.cumsum(lengths) - lengths
        sums = lambda x: np.add.reduceat(x, first)
        return {
            **{c: pa.chunked_array([o[c] for o in others]) for c in others[0]},
            "n_tokens": lengths,
            "n_known": sums((counts > 0).astype(np.int64)),
            "train_tokens": np.full(len(lengths), model.vocabulary.tokens),
            "base_score": sums(np.log10((counts + 0.5) / base)),
            "score": sums(np.log10(model.probabilities(u, v, w, v_count))),
        }

    return iterate_batches(docs, several, f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double", BATCH)


def score_documents(docs, fold=5, left_out=1, id_col="doc_id", text_col="text"):
    """Every document scored by a model of those whose id's crc32 modulo ``fold`` is not
    ``left_out``.

    A null text is empty: it has its end as the only token. A document without an id is
    held out. Repeated rows are documents like others. Without training texts every
    token is the unknown word, of probability 1. Other columns are ignored.
    """
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % fold
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(remainder == left_out, F.lit(True)).alias("held_out"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return score(docs, train(docs.where("NOT held_out").select("text")))
