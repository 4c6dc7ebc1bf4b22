"""Sorted hash arrays in files that workers map into memory.

A table of keys is sorted by 64-bit hash. The leading bits are implied by a short index
of where each run of them starts, the next 32 bits are kept, so a key that is not in the
table is taken for one that is about once in a thousand million lookups. Counts take a
byte; larger ones stand in a list of their own.
"""

import json
import mmap
import os
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs

LARGE = 255
OPEN_FILES = 4096


def write_arrays(folder, name, arrays):
    """Write ``arrays`` to a new file and return its path. A task that is repeated
    writes another file; only the paths in the job's result are ever read."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}.bin"
    header, at, parts = {}, 0, []
    for key, values in arrays.items():
        values = np.ascontiguousarray(values)
        header[key] = (values.dtype.str, len(values), at)
        parts.append(values)
        at += -(-values.nbytes // 8) * 8
    head = json.dumps(header).encode()
    head += b" " * (-len(head) % 8)
    files, place = pyarrow.fs.FileSystem.from_uri(path)
    files.create_dir(os.path.dirname(place), recursive=True)
    with files.open_output_stream(place) as out:
        out.write(np.array([len(head)], "<i8").tobytes() + head)
        for values in parts:
            out.write(values.tobytes() + b"\0" * (-values.nbytes % 8))
    return path


@lru_cache(OPEN_FILES)
def read_arrays(path):
    """The arrays of a file: mapped into memory where the folder is mounted, otherwise
    read whole (a file has a bounded size)."""
    if urlparse(path).scheme in ("", "file"):
        with open(urlparse(path).path, "rb") as source:
            # The file is closed again: only the mapping stays, so no limit of open files is met.
            data = np.frombuffer(mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)
    else:
        files, place = pyarrow.fs.FileSystem.from_uri(path)
        with files.open_input_file(place) as source:
            data = np.frombuffer(source.read(), np.uint8)
    n = int(data[:8].view("<i8")[0])
    header = json.loads(bytes(data[8 : 8 + n]))
    base = 8 + n
    return {
        key: data[base + at : base + at + length * np.dtype(kind).itemsize].view(kind)
        for key, (kind, length, at) in header.items()
    }


def small_counts(name, *columns):
    """Columns of counts as bytes. A row with a large one is marked in the first column
    and stands in full in a list."""
    large = np.flatnonzero(np.max(columns, axis=0) >= LARGE) if len(columns[0]) else np.zeros(0, np.int64)
    out = {f"{name}_large": large.astype(np.uint32)}
    for i, values in enumerate(columns):
        out[f"{name}_all{i}"] = values[large].astype(np.int64)
        low = np.minimum(values, LARGE).astype(np.uint8)
        if not i:
            low[large] = LARGE
        out[f"{name}_{i}"] = low
    return out


def hash_table(name, keys, *columns, extra=None):
    """Arrays of the table of unsigned 64-bit ``keys`` with columns of counts."""
    order = np.argsort(keys)
    keys = keys[order]
    bits = max(0, int(len(keys) // 3).bit_length() - 1)
    starts = np.searchsorted(_lead(keys, bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    out = {f"{name}_starts": starts.astype(np.uint32), f"{name}_keys": _follow(keys, bits)}
    if columns:
        out |= small_counts(name, *[c[order] for c in columns])
    if extra is not None:
        out[f"{name}_extra"] = extra[order]
    return out


def _lead(keys, bits):
    return keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)


def _follow(keys, bits):
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def find(arrays, name, keys):
    """Where each key stands in the table, or -1."""
    starts, known = arrays[f"{name}_starts"], arrays[f"{name}_keys"]
    place = np.full(len(keys), -1, np.int64)
    if not len(known) or not len(keys):
        return place
    bits = (len(starts) - 1).bit_length() - 1
    lead = _lead(keys, bits).astype(np.int64)
    wanted = _follow(keys, bits)
    at, end = starts[lead].astype(np.int64), starts[lead + 1].astype(np.int64)
    rows, left = None, np.flatnonzero(at < end)
    while len(left):
        # A run has a few sorted keys: those left are compared with the next one.
        at, end, wanted = at[left], end[left], wanted[left]
        rows = left if rows is None else rows[left]
        there = known[at]
        same = there == wanted
        place[rows[same]] = at[same]
        at += 1
        left = np.flatnonzero((there < wanted) & (at < end))
    return place


def counts_at(arrays, name, place, column=0):
    """A column's counts at places of the table; 0 where the place is -1."""
    values = arrays[f"{name}_{column}"]
    if not len(values):
        return np.zeros(len(place), np.int64)
    inside = np.maximum(place, 0)
    out = values[inside].astype(np.int64)
    large = np.flatnonzero((arrays[f"{name}_0"][inside] == LARGE) & (place >= 0))
    if len(large):
        out[large] = arrays[f"{name}_all{column}"][np.searchsorted(arrays[f"{name}_large"], place[large])]
    out[place < 0] = 0
    return out
