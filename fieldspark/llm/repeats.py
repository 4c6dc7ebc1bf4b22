"""Removal of passages that an earlier document already has, byte for byte.

Every string of ``LENGTH`` bytes is owned by the smallest hash among the seeds (short
strings) it is made of. Equal strings have equal owners wherever they stand, so a
text falls into segments, runs of strings with one owner, and only segments of one
owner have to be compared.

1. Documents are written in packs, and each pack lists its owners. Owners that stand
   in one document only are dropped: what is counted per pack is bounded by its size,
   however often a passage occurs.
2. Packs send each distinct segment of the remaining owners once, with the smallest
   document that has it.
3. The suffixes of all segments of a bucket of owners are sorted, but for those that
   cannot begin a maximal repeat; a stack scan over the common prefixes of neighbours
   walks the tree of prefix intervals. An interval whose suffixes follow different
   bytes (or begin their segment) is a maximal repeat; all its suffixes are its
   occurrences, and the smallest document among them owns it.
4. Every pack gets, for its segments, the smallest document of each string, and
   removes what a document has from a smaller one.
"""

import io

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from fieldspark.llm.common import give_back, iterate_batches, map_batches, mix, text_bytes
from fieldspark.storage import new_path

LENGTH = 50
SEED = 24
# Segments of one owner are cut after so many strings (periodic texts).
MOST_STRINGS = 256
PACK_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
# Segments of so many bytes, whole owners at a time, are sorted together.
SORTED_BYTES = 1 << 20
NO_ID = np.int64(2**63 - 1)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


# -- segments of a batch of texts ----------------------------------------------


def segments(data, starts, length=LENGTH, seed=SEED):
    """Where each segment begins, its number of strings, its owner and its text.

    ``data`` holds all texts, ``starts`` where each begins (one entry more).
    """
    nothing = np.zeros(0, np.int64)
    if len(data) < length:
        return nothing, nothing, np.zeros(0, np.uint64), nothing
    owner = _owners(data, length, seed)
    # A string must end inside its text.
    step = np.zeros(len(owner) + 1, dtype=np.int32)
    long = np.diff(starts) >= length
    np.add.at(step, starts[:-1][long], 1)
    np.add.at(step, starts[1:][long] - length + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    differs = np.ones(len(owner) + 1, dtype=bool)
    differs[1:-1] = (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    begin = np.flatnonzero(differs[:-1] & valid)
    end = np.flatnonzero(differs[1:] & valid) + 1
    # Two texts meet without a gap only where one of them has no string at all.
    parts = -(-(end - begin) // MOST_STRINGS)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(begin, parts) + within * MOST_STRINGS
    strings = np.minimum(MOST_STRINGS, np.repeat(end, parts) - at)
    return at, strings, owner[at], np.searchsorted(starts, at, side="right") - 1


def _owners(data, length, seed):
    """The smallest seed hash of the string at each position."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data),), "<u8", padded, 0, (1,))
    n = len(data) - seed + 1
    seeds = np.zeros(n, dtype=np.uint64)
    for i, at in enumerate(range(0, seed, 8)):
        at = min(at, seed - 8)
        seeds += words[at : at + n] * ODD[i % 3]
        seeds ^= seeds >> np.uint64(29)
    seeds = mix(seeds)
    # Smallest of a window by doubling.
    window, have = length - seed + 1, 1
    while 2 * have <= window:
        seeds = np.minimum(seeds[:-have], seeds[have:])
        have *= 2
    rest = window - have
    return np.minimum(seeds[: len(seeds) - rest], seeds[rest:]) if rest else seeds


# -- maximal repeats of a set of segments --------------------------------------


def _string_hashes(text, at, length):
    """A hash of the ``length`` bytes (8 or more) at each place."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text),), "<u8", padded, 0, (1,))
    out = np.zeros(len(at), dtype=np.uint64)
    for i, offset in enumerate([*range(0, length - 8, 8), length - 8]):
        out = (out + words[at + offset]) * ODD[i % 3]
        out ^= out >> np.uint64(29)
    return mix(out)


def _common_prefix(a, b):
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def maximal_repeats(contents, length=LENGTH):
    """``(size, occurrences)`` of the maximal repeats of at least ``length`` bytes in
    a list of byte strings; an occurrence is (which string, position).

    A repeat cannot grow to the right (its interval's common prefix) nor to the left:
    its occurrences follow different bytes, or one begins its string.
    """
    suffixes = _suffixes(contents, length)
    for size, _, lower, upper in _scan(suffixes, contents, length):
        yield size, [(w, at) for _, w, at in suffixes[lower:upper]]


def _suffixes(contents, length):
    """The suffixes that can begin a maximal repeat, in order: (suffix, which, at).

    A string of ``length`` bytes that occurs once begins none, nor does one that
    follows the same byte everywhere; only the other suffixes are sorted. Equal
    hashes of different strings would only let more of them through.
    """
    if length < 8:
        every = [(c[i:], w, i) for w, c in enumerate(contents) for i in range(len(c) - length + 1)]
        return sorted(every)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    first = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(contents), np.uint8)
    strings = np.maximum(sizes - length + 1, 0)
    which = np.repeat(np.arange(len(contents)), strings)
    inside = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    at = first[which] + inside
    if not len(at):
        return []
    key = _string_hashes(text, at, length)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    left = np.where(inside == 0, -1, text[at - 1].astype(np.int64))[order]
    low, high = np.minimum.reduceat(left, new), np.maximum.reduceat(left, new)
    count = np.diff(np.concatenate([new, [len(key)]]))
    open_ = np.repeat((count > 1) & ((low < 0) | (low != high)), count)
    chosen = order[open_]
    pairs = zip(which[chosen].tolist(), inside[chosen].tolist(), strict=True)
    return sorted((contents[w][i:], w, i) for w, i in pairs)


def _scan(suffixes, contents, length):
    """Bottom-up walk over the prefix intervals with a stack of open ones: the common
    prefix of each maximal repeat, that of the interval around it, its first suffix,
    and the one behind its last."""
    several = -2

    def left_of(which, at):
        # The start of a string counts as a byte of its own.
        return several if at == 0 else contents[which][at - 1]

    def joined(a, b):
        return a if a == b else several

    # Open intervals: [common prefix, first suffix, byte to the left or ``several``].
    stack = []
    for i in range(1, len(suffixes) + 1):
        common = 0
        if i < len(suffixes):
            common = _common_prefix(suffixes[i - 1][0], suffixes[i][0])
        lower, left = i - 1, left_of(*suffixes[i - 1][1:])
        while stack and stack[-1][0] > common:
            size, lower, other = stack.pop()
            left = joined(left, other)
            if left == several:
                yield size, max(common, stack[-1][0] if stack else 0), lower, i
        if stack and stack[-1][0] == common:
            stack[-1][2] = joined(stack[-1][2], left)
        elif common >= length:
            stack.append([common, lower, left])


def smallest_owner(contents, owners, length=LENGTH):
    """For each string of each segment the smallest document that has it, in one
    array, and where each segment's strings begin there.

    ``owners`` holds the smallest document of each segment as a whole.
    """
    strings = np.fromiter((max(0, len(c) - length + 1) for c in contents), np.int64, len(contents))
    bounds = np.concatenate([[0], np.cumsum(strings)])
    best = np.repeat(np.asarray(owners, dtype=np.int64), strings)
    suffixes = _suffixes(contents, length)
    which = np.fromiter((w for _, w, _ in suffixes), np.int64, len(suffixes))
    place = bounds[which] + np.fromiter((at for _, _, at in suffixes), np.int64, len(suffixes))
    owner = np.asarray(owners, dtype=np.int64)[which]
    for size, around, lower, upper in _scan(suffixes, contents, length):
        # The interval around this one has all its suffixes and more: what it covers
        # is settled there with a document no larger.
        smallest = owner[lower:upper].min()
        here = place[lower:upper, None] + np.arange(max(0, around - length + 1), size - length + 1)
        best[here] = np.minimum(best[here], smallest)
    return best, bounds


# -- packs ---------------------------------------------------------------------


def _pack(batch):
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpack(blob):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    with pa.ipc.open_stream(raw) as reader:
        return reader.read_next_batch()


class Pack:
    """Documents of one pack and their segments."""

    def __init__(self, batch, id_at, text_at, bits):
        self.batch = batch
        ids = batch.column(id_at).cast(pa.int64()).fill_null(int(NO_ID))
        self.ids = ids.to_numpy(zero_copy_only=False)
        self.data, self.starts = text_bytes(batch.column(text_at).cast(pa.string()).fill_null(""))
        self.at, self.strings, owner, self.text = segments(self.data, self.starts)
        # The leading bits name the bucket, the 32 behind them the owner within it.
        self.owner = owner >> np.uint64(32 - bits)
        self.bits = bits

    def owners(self):
        """Distinct owners in order, and whether several documents here have them."""
        order = np.argsort(self.owner, kind="stable")
        sorted_ = self.owner[order]
        if not len(sorted_):
            return sorted_, np.zeros(0, bool)
        first = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1])
        last = np.concatenate([first[1:], [len(sorted_)]]) - 1
        return sorted_[first], self.text[order[first]] != self.text[order[last]]

    def by_bucket(self, owners):
        bucket = owners >> np.uint64(32)
        edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield int(bucket[a]), slice(a, b)

    def shared(self, marks):
        """Segments whose owner is marked, with their distinct contents.

        ``marks`` holds for some buckets one bit per owner of the pack.
        """
        owners, _ = self.owners()
        kept = np.zeros(len(owners), dtype=bool)
        for bucket, part in self.by_bucket(owners):
            if bucket in marks:
                n = part.stop - part.start
                kept[part] = np.unpackbits(np.frombuffer(marks[bucket], np.uint8), count=n).astype(bool)
        rows = np.flatnonzero(kept[np.searchsorted(owners, self.owner)]) if len(owners) else np.zeros(0, np.int64)
        raw = self.data.tobytes()
        sizes = self.strings[rows] + LENGTH - 1
        pieces = [raw[a : a + n] for a, n in zip(self.at[rows].tolist(), sizes.tolist(), strict=True)]
        number = {}
        content = np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int64, len(pieces))
        smallest = np.full(len(number), NO_ID, dtype=np.int64)
        np.minimum.at(smallest, content, self.ids[self.text[rows]])
        owner = np.zeros(len(number), dtype=np.uint64)
        owner[content] = self.owner[rows]
        return rows, content, list(number), smallest, owner


def _write_packs(docs, path, bits, id_at, text_at):
    """Packs of documents, and for each pack and bucket its owners."""

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            if not batch.num_rows:
                continue
            pack = Pack(batch, id_at, text_at, bits)
            owners, several = pack.owners()
            rows = {"kind": [0], "pack": [number], "bucket": [-1], "data": [_pack(batch)], "marks": [None]}
            for bucket, part in pack.by_bucket(owners):
                rows["kind"].append(1)
                rows["pack"].append(number)
                rows["bucket"].append(bucket)
                rows["data"].append(owners[part].astype(np.uint32).tobytes())
                rows["marks"].append(np.packbits(several[part]).tobytes())
            yield rows
            number += 1

    schema = "kind int, pack long, bucket long, data binary, marks binary"
    iterate_batches(docs, run, schema, PACK_BYTES).write.partitionBy("kind").parquet(path)


def _mark_shared(rows):
    """Which owners of a bucket stand in several documents, for each pack."""
    values = [np.frombuffer(d, np.uint32) for d in rows["data"]]
    several = [
        np.unpackbits(np.frombuffer(m, np.uint8), count=len(v)).astype(bool)
        for m, v in zip(rows["marks"], values, strict=True)
    ]
    every = np.concatenate(values)
    distinct, count = np.unique(every, return_counts=True)
    wanted = count > 1
    wanted[np.searchsorted(distinct, every[np.concatenate(several)])] = True
    distinct = distinct[wanted]
    out = {"pack": [], "bucket": [], "marks": []}
    for pack, bucket, v in zip(rows["pack"], rows["bucket"], values, strict=True):
        here = np.searchsorted(distinct, v)
        found = (here < len(distinct)) & (distinct[np.minimum(here, len(distinct) - 1)] == v) if len(distinct) else np.zeros(len(v), bool)
        if found.any():
            out["pack"].append(pack)
            out["bucket"].append(bucket)
            out["marks"].append(np.packbits(found).tobytes())
    return out


def _marks(buckets, marks):
    return dict(zip(buckets, marks, strict=True)) if buckets else {}


def _squeeze(*arrays):
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a if isinstance(a, bytes) else a.tobytes() for a in arrays))


def _send(owner, smallest, contents):
    sizes = np.fromiter(map(len, contents), np.uint32, len(contents))
    head = np.array([len(contents)], dtype=np.int64)
    return _squeeze(head, owner.astype(np.uint64), smallest, sizes, b"".join(contents))


def _receive(blob):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    owner = np.frombuffer(raw, np.uint64, n, 8)
    smallest = np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    sizes = np.frombuffer(raw, np.uint32, n, 8 + 16 * n).astype(np.int64)
    at = 8 + 20 * n + np.concatenate([[0], np.cumsum(sizes)])
    return owner, smallest, [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _owner_groups(rows, owners, contents):
    """Rows in the order of owners, whole owners together, in groups of bounded size."""
    part, size = [], 0
    for i in rows:
        if size >= SORTED_BYTES and owners[i] != owners[part[-1]]:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(contents[i])
    if part:
        yield part


def _answer(rows):
    """The smallest document of every string of the segments of a bucket, by pack: runs
    of strings with one document, as many as a segment has."""
    received = [_receive(d) for d in rows["data"]]
    number = {}
    places = [
        np.fromiter((number.setdefault(c, len(number)) for c in contents), np.int64, len(contents))
        for _, _, contents in received
    ]
    every = list(number)
    smallest = np.full(len(every), NO_ID, dtype=np.int64)
    owners = np.zeros(len(every), dtype=np.uint64)
    for at, (owner, least, _) in zip(places, received, strict=True):
        np.minimum.at(smallest, at, least)
        owners[at] = owner
    # A segment that has its owner to itself is settled; the others are compared.
    _, inverse, count = np.unique(owners, return_inverse=True, return_counts=True)
    alone = np.flatnonzero(count[inverse] == 1)
    mixed = np.flatnonzero(count[inverse] > 1)
    mixed = mixed[np.argsort(owners[mixed], kind="stable")].tolist()
    sizes = np.fromiter(map(len, every), np.int64, len(every)) - LENGTH + 1
    runs = [(alone, sizes[alone], smallest[alone])]
    for part in _owner_groups(mixed, owners, every):
        part = np.array(part)
        best, bounds = smallest_owner([every[i] for i in part], smallest[part])
        new = np.ones(len(best), dtype=bool)
        new[1:] = best[1:] != best[:-1]
        new[bounds[:-1]] = True
        first = np.flatnonzero(new)
        segment = np.searchsorted(bounds, first, side="right") - 1
        last = np.concatenate([first[1:], [len(best)]])
        runs.append((part[segment], last - bounds[segment], best[first]))
    of, ends, docs = (np.concatenate(c) for c in zip(*runs, strict=True))
    order = np.argsort(of, kind="stable")
    ends, docs = ends[order], docs[order]
    counts = np.bincount(of, minlength=len(every))
    begin = np.cumsum(counts) - counts
    out = {"pack": rows["pack"], "bucket": rows["bucket"], "answer": []}
    for at in places:
        n = counts[at]
        index = np.arange(n.sum()) + np.repeat(begin[at] - (np.cumsum(n) - n), n)
        head = np.array([len(n), len(index)], dtype=np.int64)
        out["answer"].append(_squeeze(head, n.astype(np.int64), docs[index], ends[index]))
    return out


def _read_answer(blob):
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
    n, m = int(raw[0]), int(raw[1])
    return raw[2 : 2 + n], raw[2 + n : 2 + n + m], raw[2 + n + m :]


def _remove(pack, marks, answers):
    """Covered bytes of the pack's documents, as one array of flags."""
    step = np.zeros(len(pack.data) + 1, dtype=np.int32)
    rows, content, _, _, owner = pack.shared(marks)
    if not len(rows):
        return np.zeros(len(pack.data), dtype=bool)
    # Contents were sent bucket by bucket, in their order within the pack.
    bucket = (owner >> np.uint64(32)).astype(np.int64)
    runs = [None] * len(owner)
    for b in np.unique(bucket).tolist():
        counts, docs, ends = _read_answer(answers[b])
        edges = np.concatenate([[0], np.cumsum(counts)])
        for k, i in enumerate(np.flatnonzero(bucket == b).tolist()):
            runs[i] = (docs[edges[k] : edges[k + 1]], ends[edges[k] : edges[k + 1]])
    # Most contents have one run: all of those at once, the others one by one.
    single = np.fromiter((len(r[0]) == 1 for r in runs), bool, len(runs))
    first = np.fromiter((r[0][0] for r in runs), np.int64, len(runs))
    doc = pack.ids[pack.text[rows]]
    gone = single[content] & (first[content] < doc)
    np.add.at(step, pack.at[rows[gone]], 1)
    np.add.at(step, pack.at[rows[gone]] + pack.strings[rows[gone]] + LENGTH - 1, -1)
    for r, c, d in zip(
        rows[~single[content]].tolist(),
        content[~single[content]].tolist(),
        doc[~single[content]].tolist(),
        strict=True,
    ):
        docs, ends = runs[c]
        begin = 0
        for owner_doc, end in zip(docs.tolist(), ends.tolist(), strict=True):
            if owner_doc < d:
                step[pack.at[r] + begin] += 1
                step[pack.at[r] + end + LENGTH - 1] -= 1
            begin = end
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs, id_col="doc_id", text_col="text", whole_characters=False):
    """``docs`` with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and
    ``removed`` (begin and end of each removed run, flat), all its columns kept.

    A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a
    document with a smaller id; strings are judged on the input. A null text is an
    empty one. A null id counts as larger than all others; rows that repeat an id do
    not remove from each other. Columns of ``docs`` named like the new ones are
    replaced; an empty table gives an empty result. With ``whole_characters`` a
    character that loses a byte goes as a whole, so ``kept`` is text again; nothing
    else of the text changes.
    """
    spark = docs.sparkSession
    added = ["kept", "n_bytes", "n_removed", "removed"]
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in added])
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    bits = max(1, min(32, int(total // BUCKET_BYTES).bit_length()))
    path = new_path(spark, "packs")
    _write_packs(docs, path, bits, id_at, text_at)
    written = spark.read.schema("kind int, pack long, bucket long, data binary, marks binary").parquet(path)
    packs = written.where("kind = 0").select("pack", "data")
    owners = written.where("kind = 1").select("pack", "bucket", "data", "marks")

    marked = _by_bucket(owners, _mark_shared, "pack long, bucket long, marks binary")
    marks = marked.groupBy("pack").agg(
        F.collect_list("bucket").alias("buckets"), F.collect_list("marks").alias("marks")
    )

    def send(batch):
        out = {"pack": [], "bucket": [], "data": []}
        for row in batch.to_pylist():
            pack = Pack(_unpack(row["data"]), id_at, text_at, bits)
            _, _, contents, smallest, owner = pack.shared(_marks(row["buckets"], row["marks"]))
            bucket = (owner >> np.uint64(32)).astype(np.int64)
            for b in np.unique(bucket).tolist():
                rows = np.flatnonzero(bucket == b)
                out["pack"].append(row["pack"])
                out["bucket"].append(b)
                out["data"].append(_send(owner[rows], smallest[rows], [contents[i] for i in rows]))
        return out

    # Marks are asked for twice; kept in files, they and what stands on them are not
    # computed again for the second use or after a loss.
    marks_path = new_path(spark, "marks")
    marks.write.parquet(marks_path)
    marks = spark.read.parquet(marks_path)
    sent = map_batches(packs.join(marks, "pack"), send, "pack long, bucket long, data binary")
    answered = _by_bucket(sent, _answer, "pack long, bucket long, answer binary")
    answers = answered.groupBy("pack").agg(
        F.collect_list("bucket").alias("answered"), F.collect_list("answer").alias("answers")
    )
    fields = docs.schema
    out_schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "kept binary", "n_bytes long", "n_removed long", "removed array<long>"]
    )

    def clean(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(_unpack(row["data"]), id_at, text_at, bits)
                found = _marks(row["answered"], row["answers"])
                marks = _marks(row["buckets"], row["marks"]) if found else {}
                gone = _remove(pack, marks, found)
                yield _cleaned(pack, _widened(pack, gone) if whole_characters else gone)
        give_back()

    joined = packs.join(marks, "pack", "left").join(answers, "pack", "left")
    return joined.mapInArrow(clean, out_schema)


def _widened(pack, gone):
    """The bytes of all characters of which a byte is gone."""
    if not gone.any():
        return gone
    first = (pack.data & 0xC0) != 0x80
    first[pack.starts[:-1][pack.starts[:-1] < len(first)]] = True
    lost = np.logical_or.reduceat(gone, np.flatnonzero(first))
    return lost[np.cumsum(first) - 1]


def _cleaned(pack, gone):
    begins, ends = pack.starts[:-1], pack.starts[1:]
    sums = np.concatenate([[0], np.cumsum(gone)])
    removed = sums[ends] - sums[begins]
    kept, runs = [], []
    raw = pack.data.tobytes()
    for a, b, n in zip(begins.tolist(), ends.tolist(), removed.tolist(), strict=True):
        if not n:
            kept.append(raw[a:b])
            runs.append([])
            continue
        own = np.concatenate([[False], gone[a:b], [False]])
        cuts = np.flatnonzero(own[1:] != own[:-1])
        runs.append(cuts.tolist())
        kept.append(pack.data[a:b][~gone[a:b]].tobytes())
    columns = [
        *pack.batch.columns,
        pa.array(kept, pa.binary()),
        pa.array(ends - begins, pa.int64()),
        pa.array(removed, pa.int64()),
        pa.array(runs, pa.list_(pa.int64())),
    ]
    names = [*pack.batch.schema.names, "kept", "n_bytes", "n_removed", "removed"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _by_bucket(df, fn, schema):
    """``fn`` on all rows of a bucket at once. What a bucket holds is bounded: each
    pack adds an owner, or a distinct segment, at most once."""
    import pandas as pd

    names = [p.split()[0] for p in schema.split(", ")]

    def run(rows):
        found = pd.DataFrame(fn({c: rows[c].tolist() for c in rows.columns}), columns=names)
        give_back()
        return found

    return df.groupBy("bucket").applyInPandas(run, schema)
