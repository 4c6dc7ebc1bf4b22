"""Encoding and decoding with a word-level BPE vocabulary through a prefix trie.

Words of the pre-tokenizer never share a token, and white space yields none, so a
text is the sequence of its words. The distinct words of a batch of texts go into
a trie. Walking it depth first, each node gets the last token of the encoding of
its prefix; the rest of that encoding is the state of the node where that token
begins. A token fits behind a state if merging cannot cross the border between
the state's last token and it, and exactly one token that ends a prefix fits. So a
prefix that many words share is encoded once, and a word's ids are read back from
its last node through the nodes its tokens begin at.

Merging works by rank, the leftmost pair first. Of two neighbouring tokens, the
pieces that ever touch the border are the right edge of the first and the left
edge of the second, each alive until its own next merge. The border holds if no
pair of pieces that are alive together merges before either of them is gone.
"""

import json
import re
import unicodedata
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from fieldspark.llm.common import ids_and_texts, map_batches, mix

# Chunks of text between white space, and borders, kept per worker; emptied when full.
CACHED_CHUNKS = 500_000
MOST_BORDERS = 200_000
BATCH = 4 << 20
PAIR_BITS = 20
# Words of more bytes than this are walked alone, byte by byte.
LONG_WORD = 100
FOREVER = 1 << 60
BASE = np.uint64(0x9E3779B97F4A7C15)
# Marks the symbol that ends a word.
FINAL = np.uint64(1 << 20)

# All of these are white space for the vocabulary's normalizer as well.
WHITE = re.compile(r"[ \n\t\r]+")
# Python would split at these separators, the vocabulary does not.
SPLIT_TOO_MUCH = re.compile("[\x1c-\x1f]")
# Up to here a letter's lower case stays in the range and nothing is composed.
LATIN_END, DOTTED_I = "\u0180", "\u0130"


def _latin_class(group):
    return "".join(
        re.escape(chr(c))
        for c in range(ord(LATIN_END))
        if unicodedata.category(chr(c))[0] == group
    )


# What the vocabulary's pattern means for lower-case text of that range.
LATIN_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^{0}{1}{2}]+".format(
        _latin_class("L"), _latin_class("N"), "\\t-\\r \x85\xa0"
    )
)


def _byte_letters():
    """The letter that byte-level vocabularies write for each byte: printable
    Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: 256 + i for i, b in enumerate(others)}


LETTER_BYTES = {chr(letter): byte for byte, letter in _byte_letters().items()}


def _bytes(letters):
    """The bytes that byte letters stand for."""
    return bytes([LETTER_BYTES.get(c) if c in LETTER_BYTES else ord(c) for c in letters])


def _chunks(text):
    """What stands between white space."""
    if SPLIT_TOO_MUCH.search(text):
        return [c for c in WHITE.split(text) if c]
    return text.split()


def _prefix_hashes(symbols):
    """Polynomial hashes of all prefixes; arithmetic wraps at 64 bits."""
    powers = np.cumprod(np.full(len(symbols) + 1, BASE, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * powers[:-1])])
    return sums, powers


def _hash(prefixes, begin, end):
    """Hash of the symbols from ``begin`` to ``end``, the same wherever they stand:
    the sum of a stretch is brought down by the inverse of the power it starts at."""
    sums, _ = prefixes
    return mix((sums[end] - sums[begin]) * _inverse_power(begin))


_INVERSE = np.ones(1, dtype=np.uint64)


def _inverse_power(at):
    global _INVERSE
    most = int(at.max()) + 1 if len(at) else 1
    if most > len(_INVERSE):
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        grown = np.full(max(most, 2 * len(_INVERSE)), inverse, dtype=np.uint64)
        grown[0] = 1
        _INVERSE = np.cumprod(grown)
    return _INVERSE[at]


def _gather(flat, offsets, rows):
    """The runs of ``rows`` one after the other, and where each begins."""
    begin = offsets[rows]
    lengths = offsets[rows + 1] - begin
    before = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(before[-1]) + np.repeat(begin - before[:-1], lengths)
    return flat[index], before


class Trie:
    """Encodes words of one vocabulary; what it learns outlives a batch.

    A word is a sequence of symbols: its bytes, the last one marked as the word's
    end, so that it never shares a node with the same byte inside a word.
    """

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.names = [""] * size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.names[i] = token
        self.library = Tokenizer.from_file(path)
        self.rank, self.parts = {}, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (self.ids[p] for p in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[left, right] = rank
            self.parts.setdefault(self.ids[self.names[left] + self.names[right]], (rank, left, right))
        self.edges, self.borders = {}, {}
        self.reachable = np.zeros(size, dtype=bool)
        for token in sorted(self.ids.values(), key=lambda t: len(self.names[t])):
            self.reachable[token] = self._reaches(token)
        self._index_tokens()
        self.pair_keys = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.pair_holds = np.zeros(1 << PAIR_BITS, dtype=bool)
        # Forgotten between batches but never inside one.
        self.index, self.seen = {}, np.zeros(0, dtype=np.int64)
        self.flat, self.offsets = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.edges = {}

    # -- borders -----------------------------------------------------------

    def _edge(self, token, side):
        """The pieces at one end of a token, each with the rank that ends it."""
        key = (token, side)
        if key not in self.edges:
            pieces, ends = [], FOREVER
            while True:
                pieces.append((token, ends))
                if token not in self.parts:
                    break
                ends, *both = self.parts[token]
                token = both[side]
            self.edges[key] = pieces
        return self.edges[key]

    def _crossings(self, left, right):
        """Pairs of pieces that merge across the border while both are alive."""
        for a, a_ends in self._edge(left, 1):
            for b, b_ends in self._edge(right, 0):
                r = self.rank.get((a, b))
                # An equal rank means the same rule: the leftmost pair goes first.
                if r is not None and r < a_ends and r <= b_ends:
                    yield a, b

    def holds(self, left, right):
        """Whether no merge crosses the border between two neighbouring tokens."""
        key = left << 20 | right
        known = self.borders.get(key)
        if known is None:
            if len(self.borders) >= MOST_BORDERS:
                self.borders.clear()
            known = self.borders[key] = next(self._crossings(left, right), None) is None
        return known

    def _reaches(self, token):
        """Whether the token's own string is encoded as this one token."""
        if token not in self.parts:
            return True
        _, left, right = self.parts[token]
        crossing = list(self._crossings(left, right))
        return bool(self.reachable[left] and self.reachable[right]) and crossing == [(left, right)]

    # -- symbols -----------------------------------------------------------

    def _symbols(self, words):
        """Symbols of all words in one array, and where each word starts."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        return np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1), starts

    def _index_tokens(self):
        """For each token length a table from a hash of the symbols to the token."""
        by_length = {}
        for token, i in self.ids.items():
            if self.reachable[i]:
                final = token.endswith(self.suffix) and token != self.suffix
                letters = token[: -len(self.suffix)] if final else token
                letters = _bytes(letters)
                by_length.setdefault(len(letters), []).append((letters, final, i))
        self.by_bytes = {(b, f): i for tokens in by_length.values() for b, f, i in tokens}
        self.longest = max(by_length)
        self.tables = []
        for length, tokens in sorted(by_length.items(), reverse=True):
            symbols, starts = self._symbols([t[0] for t in tokens])
            symbols[starts[1:] - 1] += np.where([t[1] for t in tokens], FINAL, np.uint64(0))
            hashes = _hash(_prefix_hashes(symbols), starts[:-1], starts[1:])
            order = np.argsort(hashes)
            ids = np.array([t[2] for t in tokens])[order]
            bits = max(8, int(len(tokens)).bit_length() + 3)
            first = np.searchsorted(hashes[order] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            deepest = int(np.max(np.diff(first)))
            self.tables.append((length, bits, first, hashes[order], ids, deepest))

    def _lookup(self, table, hashes):
        """The token of each hash, -1 where there is none."""
        _, bits, first, known, ids, deepest = table
        slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        begin, end = first[slot], first[slot + 1]
        found = np.full(len(hashes), -1, dtype=np.int64)
        for step in range(deepest):
            at = begin + step
            hit = at < end
            if not hit.any():
                break
            at = np.where(hit, at, 0)
            hit &= known[at] == hashes
            found[hit] = ids[at[hit]]
        return found

    # -- the trie ----------------------------------------------------------

    def encode_words(self, words):
        """Ids of distinct words: one flat array, and where each word's begin.

        ``words`` must be sorted: then words with a common prefix are neighbours,
        and a node of depth d is a run of neighbours that agree in d symbols. All
        nodes of a depth get their state in one go, from the states above them.
        """
        symbols, starts = self._symbols(words)
        lengths = np.diff(starts)
        symbols[starts[1:] - 1] += FINAL
        hashes = _prefix_hashes(symbols)
        # The state of every prefix: its last token, and that token's length.
        token = np.zeros(len(symbols), dtype=np.int64)
        width = np.zeros(len(symbols), dtype=np.int64)
        for long in np.flatnonzero(lengths > LONG_WORD):
            self._walk(symbols, starts[long], starts[long + 1], token, width)
        rows = np.flatnonzero(lengths <= LONG_WORD)
        node = np.zeros(len(rows), dtype=np.int64)
        for depth in range(int(lengths[rows].max()) if len(rows) else 0):
            deep = lengths[rows] > depth
            rows, node = rows[deep], node[deep]
            here = starts[rows] + depth
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (symbols[here[1:]] != symbols[here[:-1]])
            node = np.cumsum(new) - 1
            place = here[new]
            found, size = self._last_tokens(place, depth + 1, hashes, token)
            token[here], width[here] = found[node], size[node]
        return self._read_back(starts, lengths, token, width)

    def _walk(self, symbols, start, end, token, width):
        """The states of one long word, which shares its deep nodes with no other."""
        word = bytes((symbols[start:end] - np.uint64(1)).astype(np.uint8)[:-1])
        last = bytes([int(symbols[end - 1] - np.uint64(1) - FINAL)])
        for depth in range(1, len(word) + 2):
            final = depth == len(word) + 1
            text = word[max(0, depth - self.longest) : depth] + (last if final else b"")
            for length in range(len(text), 0, -1):
                candidate = self.by_bytes.get((text[len(text) - length :], final))
                if candidate is not None and (
                    length == depth or self.holds(int(token[start + depth - length - 1]), candidate)
                ):
                    token[start + depth - 1], width[start + depth - 1] = candidate, length
                    break
            else:
                raise ValueError("a word has a symbol that the vocabulary lacks")

    def _last_tokens(self, place, depth, hashes, token):
        """The last token of prefixes of ``depth`` symbols that end at ``place``."""
        found = np.full(len(place), -1, dtype=np.int64)
        size = np.zeros(len(place), dtype=np.int64)
        open_ = np.arange(len(place))
        for table in self.tables:
            length = table[0]
            if length > depth:
                continue
            end = place[open_] + 1
            candidate = self._lookup(table, _hash(hashes, end - length, end))
            hit = np.flatnonzero(candidate >= 0)
            if length < depth and len(hit):
                before = token[end[hit] - length - 1]
                hit = hit[self._hold(before, candidate[hit])]
            found[open_[hit]], size[open_[hit]] = candidate[hit], length
            rest = np.ones(len(open_), dtype=bool)
            rest[hit] = False
            open_ = open_[rest]
            if not len(open_):
                return found, size
        raise ValueError("a word has a symbol that the vocabulary lacks")

    def _hold(self, left, right):
        """``holds`` for arrays: a direct-mapped store in front of the memory."""
        keys = (left << 20) | right
        slot = (mix(keys.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        unknown = np.flatnonzero(self.pair_keys[slot] != keys)
        out = self.pair_holds[slot]
        if len(unknown):
            distinct, inverse = np.unique(keys[unknown], return_inverse=True)
            answers = np.fromiter(
                (self.holds(k >> 20, k & 0xFFFFF) for k in distinct.tolist()), bool, len(distinct)
            )
            out[unknown] = answers[inverse]
            self.pair_keys[slot[unknown]] = keys[unknown]
            # Two pairs may want one slot: the value must be that of the key kept.
            kept = self.pair_keys[slot[unknown]] == keys[unknown]
            self.pair_holds[slot[unknown][kept]] = answers[inverse][kept]
        return out

    @staticmethod
    def _read_back(starts, lengths, token, width):
        """Follow each word's tokens from its end to its start."""
        at = starts[1:] - 1
        alive = np.arange(len(at))
        steps = []
        while len(alive):
            position = at[alive]
            steps.append((alive, token[position]))
            at[alive] = position - width[position]
            alive = alive[at[alive] >= starts[alive]]
        n = np.zeros(len(lengths), dtype=np.int64)
        for rows, _ in steps:
            n[rows] += 1
        offsets = np.concatenate([[0], np.cumsum(n)])
        flat = np.zeros(offsets[-1], dtype=np.uint32)
        for step, (rows, tokens) in enumerate(steps):
            flat[offsets[rows + 1] - 1 - step] = tokens
        return flat, offsets

    # -- texts -------------------------------------------------------------

    def thin_out(self):
        """Keep the chunks seen most, at most half of the room; most words are rare."""
        least = max(2, int(np.sort(self.seen)[-(CACHED_CHUNKS // 2)]) + 1)
        kept = np.flatnonzero(self.seen >= least)
        chunks = list(self.index)
        self.index = {chunks[i]: n for n, i in enumerate(kept.tolist())}
        self.flat, self.offsets = _gather(self.flat, self.offsets, kept)
        self.seen = self.seen[kept]

    def words_of(self, chunk):
        """The words, in bytes, of a piece of text without special strings."""
        if chunk.isascii() or (max(chunk) < LATIN_END and DOTTED_I not in chunk):
            chunk = chunk.lower()
            if chunk.isalpha():
                return [chunk.encode("utf-8")]
            return [w.encode("utf-8") for w in LATIN_WORDS.findall(chunk)]
        normal = self.library.normalizer.normalize_str(chunk)
        return [_bytes(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def parts_of(self, chunk):
        """Words, and special tokens by their number."""
        parts, at = [], 0
        for hit in self.special_pattern.finditer(chunk):
            parts += [*self.words_of(chunk[at : hit.start()]), self.special[hit.group()]]
            at = hit.end()
        return [*parts, *self.words_of(chunk[at:])]

    def learn(self, chunks, special):
        """Encode chunks of text between white space and remember them."""
        parts = list(map(self.parts_of if special else self.words_of, chunks))
        distinct = set(chain.from_iterable(parts))
        special = sorted(p for p in distinct if isinstance(p, int))
        words = sorted(p for p in distinct if not isinstance(p, int))
        flat, offsets = self.encode_words(words)
        flat = np.concatenate([flat, np.array(special, dtype=np.uint32)])
        offsets = np.concatenate([offsets, offsets[-1] + 1 + np.arange(len(special))])
        number = {p: i for i, p in enumerate([*words, *special])}
        every = list(chain.from_iterable(parts))
        of_chunk = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
        ids, _ = _gather(flat, offsets, of_chunk)
        tokens = np.diff(offsets)[of_chunk]
        ends = np.cumsum([0, *map(len, parts)])
        tokens_before = np.concatenate([[0], np.cumsum(tokens)])
        begin = len(self.flat)
        self.seen = np.concatenate([self.seen, np.zeros(len(chunks), dtype=np.int64)])
        self.index.update(zip(chunks, range(len(self.offsets) - 1, len(self.offsets) - 1 + len(chunks))))
        self.flat = np.concatenate([self.flat, ids])
        self.offsets = np.concatenate([self.offsets, begin + tokens_before[ends[1:]]])

    def _rows(self, chunks):
        """Where each chunk's ids are, -1 for those not learned."""
        return np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))

    def encode_batch(self, texts):
        """Ids of all texts in one flat array, and where each text's begin."""
        chunks = list(map(_chunks, texts))
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        flat = list(chain.from_iterable(chunks))
        del chunks
        rows = self._rows(flat)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = {flat[i] for i in missing.tolist()}
            special = any(map(self.special_pattern.search, texts))
            self.learn(list(new), special)
            rows[missing] = self._rows([flat[i] for i in missing.tolist()])
        self.seen += np.bincount(rows, minlength=len(self.seen))
        ids, before = _gather(self.flat, self.offsets, rows)
        if len(self.index) > CACHED_CHUNKS:
            self.thin_out()
        return ids, before[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids):
        """The text of ids, special tokens included: without a decoder in the
        vocabulary file the library joins the tokens with a space."""
        names = self.names
        return " ".join([names[i] for i in ids])


_TRIES = {}


def trie_for(path):
    """One trie per worker and vocabulary file."""
    if path not in _TRIES:
        _TRIES[path] = Trie(path)
    return _TRIES[path]


def encode_decode(docs, vocabulary):
    """``doc_id, ids, decoded`` for every row of ``docs``.

    ``vocabulary`` is the path of a tokenizers file with a word-level BPE model,
    the same on every executor. ``ids`` are those of the whole text without added
    special tokens (special strings inside a text count as the special tokens
    they name), ``decoded`` is what they decode to with special tokens kept.

    One pass over the rows, no shuffle. A null text is an empty one: no ids, an
    empty text. Null ids and repeated rows stay as they are, an empty table gives
    an empty result.
    """

    def run(batch):
        trie = trie_for(vocabulary)
        ids, offsets = trie.encode_batch(batch.column(1).to_pylist())
        texts = (ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True))
        return {
            "doc_id": batch.column(0),
            "ids": pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))
            ),
            "decoded": [trie.decode(t) for t in texts],
        }

    return map_batches(
        ids_and_texts(docs), run, "doc_id long, ids array<int>, decoded string", BATCH
    )
