"""Words of many texts at once, by hash."""

import numpy as np

from fieldspark.llm.common import mix, text_bytes

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Bytes of words between the six white-space characters, and of letters and digits
# (of ASCII; every byte of another character counts as one).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALPHANUMERIC[low:high] = True

_powers = {}


def _powers_of(base, n):
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(n + (n >> 3) + 1, base, dtype=np.uint64)
        known[0] = 1
        _powers[int(base)] = known = np.cumprod(known)
    return known[:n]


def word_hashes(column, solid=NOT_SPACE):
    """64-bit hashes of the maximal runs of ``solid`` bytes in an Arrow column of texts,
    A-Z taken as a-z, and the number of them in each text."""
    data, starts = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(max(len(starts) - 1, 0), np.int64)
    inside = solid[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    first = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    after = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers_of(BASE, len(data)), out=sums[1:])
    content = (sums[after] - sums[first]) * _powers_of(INVERSE, len(data))[first]
    hashes = mix(content + (after - first).astype(np.uint64) * INVERSE)
    return hashes, np.diff(np.searchsorted(first, starts))
