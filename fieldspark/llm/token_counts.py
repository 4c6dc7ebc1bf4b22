"""Token counts of texts of any length, without encoding a long text in one piece.

A long text is read in overlapping chunks. Each chunk is encoded on its own into
words of the tokenizer's pre-tokenizer with their offsets and token counts. Two
neighbouring encodings are spliced at a word start that both of them have inside
the overlap. The pre-tokenizer reads from left to right and keeps no state but
its position, so from a common start on both encodings agree with the encoding of
the whole text, as long as the left chunk reaches far enough beyond that start to
have seen everything a word may look at (``MARGIN``). Where the overlap holds no
such start, it is widened to the left until it does, at last to the whole of what
is not yet settled.

Inside a chunk the text is cut before every space or line break that follows
something other than white space. No word of a byte-level pre-tokenizer crosses
such a cut, so pieces that repeat are encoded once per worker.
"""

import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldspark.llm.common import ids_and_texts, map_batches

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256
# More than the longest special string and the one character a word looks ahead.
MARGIN = 64
# Pieces kept per worker; the store is emptied when full.
CACHED_PIECES = 500_000
LONGEST_CACHED = 48
CUT = re.compile(r"(?<=\S)(?=[ \n])")
# Where there is none of these, every space begins a word.
LOOSE_SPACE = re.compile(r" (?:\s|$)|^\Z")


class Encoder:
    """Encodes pieces with the tokenizers library and remembers short ones."""

    def __init__(self, path):
        self.library = Tokenizer.from_file(path)
        self.known = {}

    def n_tokens(self, piece):
        return len(self.library.encode(piece, add_special_tokens=False))

    def counts(self, pieces):
        """Number of tokens of each piece."""
        known = self.known
        found = list(map(known.get, pieces))
        if None in found:
            missing = list({p for p, n in zip(pieces, found, strict=True) if n is None})
            encoded = self.library.encode_batch_fast(missing, add_special_tokens=False)
            new = dict(zip(missing, map(len, encoded), strict=True))
            found = [new[p] if n is None else n for p, n in zip(pieces, found, strict=True)]
            if len(known) >= CACHED_PIECES:
                known.clear()
            known.update((p, n) for p, n in new.items() if len(p) <= LONGEST_CACHED)
        return found

    def words(self, piece):
        """Starts of the words in ``piece`` and the tokens of each."""
        encoding = self.library.encode(piece, add_special_tokens=False)
        starts, counts, last = [], [], None
        for (start, _), word in zip(encoding.offsets, encoding.word_ids, strict=True):
            if word is None or word != last or not starts:
                starts.append(start)
                counts.append(1)
            else:
                counts[-1] += 1
            last = word
        return starts, counts

    def chunk(self, text, begin):
        """Word starts in the whole text, and the tokens from each to the next.

        Short pieces count as one word: fewer starts to splice at, all of them true.
        """
        starts, counts = [], []
        pieces = pieces_of(text)
        for piece, n in zip(pieces, self.counts(pieces), strict=True):
            if len(piece) <= LONGEST_CACHED:
                starts.append(begin)
                counts.append(n)
            else:
                inner, tokens = self.words(piece)
                starts.extend(begin + s for s in inner)
                counts.extend(tokens)
            begin += len(piece)
        return starts, counts


def pieces_of(text):
    """The text cut where a word always starts."""
    if LOOSE_SPACE.search(text):
        return [p for p in CUT.split(text) if p]
    first, *others = text.split(" ")
    return [first, *[" " + p for p in others]] if first else [" " + p for p in others]


def count_batch(encoder, texts, chunk=CHUNK_CHARS, overlap=OVERLAP_CHARS):
    """Tokens of each text: short ones share one look at the known pieces."""
    out = np.zeros(len(texts), dtype=np.int64)
    short = [i for i, t in enumerate(texts) if len(t) <= chunk]
    pieces = [pieces_of(texts[i]) for i in short]
    counts = np.array(encoder.counts([p for each in pieces for p in each]), dtype=np.int64)
    ends = np.cumsum([0, *map(len, pieces)])
    out[short] = np.diff(np.concatenate([[0], np.cumsum(counts)])[ends])
    for i, text in enumerate(texts):
        if len(text) > chunk:
            out[i] = count_tokens(encoder, text, chunk, overlap)
    return out


def count_tokens(encoder, text, chunk=CHUNK_CHARS, overlap=OVERLAP_CHARS):
    """Tokens of ``text`` as the library counts them in the whole text."""
    if len(text) <= chunk:
        return sum(encoder.counts(pieces_of(text)))
    end, settled, total = chunk, 0, 0
    starts, counts = encoder.chunk(text[:end], 0)
    while end < len(text):
        shared = overlap
        while True:
            begin = max(settled, end - shared)
            next_end = min(len(text), max(end, begin) + chunk)
            next_starts, next_counts = encoder.chunk(text[begin:next_end], begin)
            splice = settled if begin == settled else _common(starts, next_starts, end - MARGIN)
            if splice is not None:
                break
            shared *= 2
        total += sum(counts[bisect_left(starts, settled) : bisect_left(starts, splice)])
        settled, end, starts, counts = splice, next_end, next_starts, next_counts
    return total + sum(counts[bisect_left(starts, settled) :])


def _common(left, right, limit):
    """The first start that both chunks have, not beyond ``limit``."""
    i, j = bisect_left(left, right[0]) if right else len(left), 0
    while i < len(left) and j < len(right) and left[i] <= limit:
        if left[i] == right[j]:
            return left[i]
        if left[i] < right[j]:
            i += 1
        else:
            j += 1
    return None


_ENCODERS = {}


def encoder_for(path):
    """One encoder per worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_counts(docs, vocabulary, chunk=CHUNK_CHARS, overlap=OVERLAP_CHARS, limit=512):
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``vocabulary`` is the path of a byte-level tokenizers file, the same on every
    executor. One pass over the rows, no shuffle; a lost executor costs the tasks
    it ran. A null text counts as empty: no bytes, no tokens. Null ids and
    repeated rows stay as they are, an empty table gives an empty result.
    """

    def count(batch):
        encoder = encoder_for(vocabulary)
        n = count_batch(encoder, batch.column(1).to_pylist(), chunk, overlap)
        return {"doc_id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": n}

    sized = ids_and_texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = map_batches(sized, count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
