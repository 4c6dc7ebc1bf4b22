"""Components of documents whose word shingles overlap by a given share.

Candidates come from an exact partition scheme: two sets that link differ in at most
D shingles, D a share of their sizes. Cut the space of shingle hashes into m cells;
a set that fills more than D of them shares at least one filled cell, in full, with
every set it links with. The hash of a cell's content is a signature, and m is the
smallest power of two that fills enough cells, so sets of similar size meet at the
same m. Signatures of many shingles are shared by near copies and hardly by others,
however frequent single shingles are.

What the signatures connect is cut up by odd sketches: a bitmap with the parity of the
hashes that fall on each bit. Two sketches differ in at most as many bits as their sets
do in shingles, so a pair that differs in more bits than it may in shingles is out, and
no link is lost. A sketch has about a bit per shingle, so large groups fit one task.

Sets still connected are then compared exactly, in blocks of bounded size, through
signature trees: a node holds the bitmap of all hashes below it and the
range of set sizes, and two nodes are compared further only if the bitmaps have
enough bits in common for any sizes in range. Sets already connected are skipped.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from fieldspark.llm.common import ids_and_texts, iterate_batches, map_batches, mix, text_bytes
from fieldspark.llm.graph import components
from fieldspark.storage import broadcast_if_small, cut_lineage, new_path

WORDS = 4
PERCENT = 85
# Tables of powers are as long as a batch and stay in the worker.
BATCH = 1 << 20
SIGNATURE_BUCKET_BYTES = 48 << 20
# So many sketches are compared in one task.
SKETCHES = 1 << 15
# A block holds at most about so many sets and shingles.
BLOCK_SETS = 2048
BLOCK_SHINGLES = 1 << 20
LEAF, FANOUT = 16, 8
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SECOND = np.uint64(0xA0761D6478BD642F)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


# -- sets ----------------------------------------------------------------------

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n):
    if n > len(_POWERS[0]):
        size = n + (n >> 3)
        for i, base in enumerate((BASE, INVERSE)):
            grown = np.full(size, base, dtype=np.uint64)
            grown[0] = 1
            _POWERS[i] = np.cumprod(grown)
    return _POWERS[0][:n], _POWERS[1]


def word_hashes(column):
    """Hashes of all words of an Arrow column of texts, and the words per text."""
    data, starts = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    first = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]]) | edge[:-1]))
    after = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]]) | edge[1:])) + 1
    powers, inverse = _powers(len(data) + 1)
    terms = (LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[:-1]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    hashes = mix((sums[after] - sums[first]) * inverse[first])
    return hashes, np.diff(np.searchsorted(first, starts))


def shingle_sets(column, words=WORDS):
    """The sorted distinct shingle hashes of each text; all words as one shingle
    where there are fewer than ``words``; empty without words."""
    hashes, counts = word_hashes(column)
    ends = np.cumsum(counts)
    shingles = hashes.copy()
    for i in range(1, words):
        shingles = mix(shingles * SECOND + np.concatenate([hashes[i:], np.zeros(min(i, len(hashes)), np.uint64)]))
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(shingles[end - n : end - words + 1]))
        elif n:
            own = mix(hashes[end - n : end] + np.arange(1, n + 1, dtype=np.uint64) * SECOND)
            out.append(mix(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hashes(sets):
    """Two 64-bit hashes of each set, as signed numbers."""
    one = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    two = np.array([mix(s ^ SECOND).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return mix(one).view(np.int64), mix(two).view(np.int64)


# -- signatures ----------------------------------------------------------------


def most_differences(n, percent=PERCENT):
    """How many shingles a set of n may differ in, at most, from one it links with."""
    return (100 - percent) * (n + n * 100 // percent) // (100 + percent)


def _power_of_two(n):
    return 1 << max(0, int(n - 1).bit_length())


def signatures(shingles, percent=PERCENT):
    """Hashes of the filled cells, at every number of cells at which a set that
    links with this one may have enough filled cells."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.uint64)
    needed = most_differences(n, percent) + 1
    smallest = -(-n * percent // 100)
    cells = _power_of_two(most_differences(smallest, percent) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ BASE))])
    out = []
    while True:
        bits = cells.bit_length() - 1
        cell = shingles >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64)
        first = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
        content = sums[np.concatenate([first[1:], [n]])] - sums[first]
        out.append(mix(content ^ mix(cell[first] * SECOND + np.uint64(cells))))
        if len(first) >= needed:
            return np.concatenate(out)
        cells *= 2


def _planes(numbers):
    """Byte planes of sorted numbers' differences: the high ones are all zero."""
    steps = np.diff(numbers, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw, n):
    planes = np.frombuffer(raw, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _signature_rows(batch, bits, words, percent):
    """Signatures of a batch by bucket, one node for each, and the edges between
    nodes that share a signature already here."""
    sets = [s for s in shingle_sets(batch.column(1), words)]
    nodes, _ = set_hashes(sets)
    nodes, first = np.unique(nodes, return_index=True)
    found = [signatures(sets[i], percent) for i in first.tolist()]
    if not sum(map(len, found)):
        return None
    keys = np.concatenate(found)
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    least = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
    edges = np.unique(np.stack([owner[~new], least[~new]], axis=1), axis=0)
    keys, owner = keys[new], owner[new]
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    out = {"bucket": [], "data": []}
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        here, index = np.unique(owner[a:b], return_inverse=True)
        pairs = edges if i == 0 else edges[:0]
        raw = b"".join(
            [
                np.array([b - a, len(here), len(pairs)], np.int64).tobytes(),
                _planes(keys[a:b]),
                index.astype(np.uint32).tobytes(),
                nodes[here].tobytes(),
                nodes[pairs].astype(np.int64).tobytes(),
            ]
        )
        out["bucket"].append(int(bucket[a]))
        out["data"].append(zstandard.ZstdCompressor(level=1).compress(raw))
    return out


def _read_signatures(blob):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m, e = np.frombuffer(raw, np.int64, 3).tolist()
    keys = _from_planes(raw[24 : 24 + 8 * n], n)
    at = 24 + 8 * n
    index = np.frombuffer(raw, np.uint32, n, at)
    nodes = np.frombuffer(raw, np.int64, m, at + 4 * n)
    edges = np.frombuffer(raw, np.int64, 2 * e, at + 4 * n + 8 * m).reshape(e, 2)
    return keys, nodes[index], edges


def _candidate_edges(rows):
    """Nodes that share a signature, each with the smallest that has it."""
    import pandas as pd

    parts = [_read_signatures(d) for d in rows["data"]]
    keys = np.concatenate([p[0] for p in parts])
    nodes = np.concatenate([p[1] for p in parts])
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    least = nodes[np.flatnonzero(new)][np.cumsum(new) - 1]
    pairs = np.stack([nodes, least], axis=1)[(nodes != least)]
    pairs = np.unique(np.concatenate([pairs, *(p[2] for p in parts)]), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


# -- sketches ------------------------------------------------------------------


def sketch(shingles):
    """Parity of the hashes on each of about as many bits as there are shingles."""
    bits = max(64, _power_of_two(len(shingles)))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def sketch_edges(nodes, sizes, sketches, percent=PERCENT):
    """Pairs of nodes that may link, enough of them to connect all that may.

    Sets that link differ in size by less than two, so a sketch meets those of its own
    width and, folded in half, those of twice the width.
    """
    width = {}
    for i, s in enumerate(sketches):
        width.setdefault(len(s), []).append(i)
    group = np.arange(len(nodes))
    edges = []
    for w, own in sorted(width.items()):
        own = sorted(own, key=lambda i: sizes[i])
        wider = sorted(width.get(2 * w, []), key=lambda i: sizes[i])
        bits = np.frombuffer(b"".join(sketches[i] for i in own), np.uint64).reshape(len(own), -1)
        if wider:
            folded = np.frombuffer(b"".join(sketches[i] for i in wider), np.uint64).reshape(len(wider), 2, -1)
            bits = np.concatenate([bits, folded[:, 0] ^ folded[:, 1]])
        index = np.array(own + wider)
        n = np.array([sizes[i] for i in index])
        last = np.searchsorted(n, n[: len(own)] * 100 // percent, side="right")
        for row, end in enumerate(last.tolist()):
            other = slice(row + 1, end)
            if end <= row + 1:
                continue
            apart = np.bitwise_count(bits[other] ^ bits[row]).sum(axis=1)
            near = apart <= (100 - percent) * (n[other] + n[row]) // (100 + percent)
            near = index[other][near]
            mine = group[index[row]]
            labels, first = np.unique(group[near], return_index=True)
            for label, at in zip(labels.tolist(), first.tolist(), strict=True):
                if label != mine:
                    edges.append((nodes[index[row]], nodes[near[at]]))
                    group[group == label] = mine
    return edges


# -- signature trees -----------------------------------------------------------


class Tree:
    """Levels of nodes over sets: bitmaps combined by OR, and size ranges.

    ``slack`` is how many shingles of a set share a bit with another one of it; an
    overlap is at most the common bits and the smaller slack.
    """

    def __init__(self, sets, width):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        least = np.array([s[0] for s in sets], dtype=np.uint64)
        self.order = np.lexsort((least, sizes))
        bitmaps = np.zeros((len(sets), width // 64), dtype=np.uint64)
        for row, i in enumerate(self.order.tolist()):
            bit = sets[i] & np.uint64(width - 1)
            np.bitwise_or.at(bitmaps[row], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        sizes = sizes[self.order]
        slack = sizes - np.bitwise_count(bitmaps).sum(axis=1)
        self.levels = [(bitmaps, sizes, sizes, slack)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            bitmaps, low, high, slack = self.levels[-1]
            at = np.arange(0, len(bitmaps), step)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bitmaps, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(slack, at),
                )
            )
            step = FANOUT

    def children(self, level, node):
        step = LEAF if level == 1 else FANOUT
        return node * step, min((node + 1) * step, len(self.levels[level - 1][0]))


def _may_link(left, a, right, b, percent):
    """Which of the nodes ``a`` of one level may hold a set that links with one below
    node ``b`` of another: flags, one per node of the slice."""
    bits, low, high, slack = (x[a] for x in left)
    other_bits, other_low, other_high, other_slack = (x[b] for x in right)
    overlap = np.bitwise_count(bits & other_bits).sum(axis=1) + np.minimum(slack, other_slack)
    overlap = np.minimum(overlap, np.minimum(high, other_high))
    return (
        ((100 + percent) * overlap >= percent * (low + other_low))
        & (100 * high >= percent * other_low)
        & (100 * other_high >= percent * low)
    )


class Groups:
    """Union-find over the sets of a block."""

    def __init__(self, labels):
        self.parent = list(range(len(labels)))
        first = {}
        for i, label in enumerate(labels):
            self.join(first.setdefault(label, i), i)

    def find(self, i):
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def tree_links(sets, labels, percent=PERCENT):
    """Pairs of sets that link, enough of them to connect all that are connected.

    Sets with equal ``labels`` count as connected from the start. The tree is joined
    with itself from the root down.
    """
    width = min(1 << 16, max(256, _power_of_two(2 * max(map(len, sets)))))
    tree, links = Tree(sets, width), []
    groups = Groups(labels)
    order = tree.order.tolist()
    top = len(tree.levels) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        if level == 0:
            a, b = order[i], order[j]
            if groups.find(a) != groups.find(b):
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    links.append((a, b))
                    groups.join(a, b)
            continue
        first, last = tree.children(level, i)
        other_first, other_last = tree.children(level, j)
        below = tree.levels[level - 1]
        if level == 1 and len({groups.find(order[k]) for k in (*range(first, last), *range(other_first, other_last))}) == 1:
            continue
        for k in range(first, last):
            # Within one node every pair of children once.
            start = max(other_first, k) if i == j else other_first
            if level == 1 and i == j:
                start = k + 1
            part = slice(start, other_last)
            hits = np.flatnonzero(_may_link(below, part, below, k, percent)) + start
            stack.extend((level - 1, k, h) for h in hits.tolist())
    return links


# -- the join ------------------------------------------------------------------


def _by_unit(batches, columns):
    """Rows of sorted batches, grouped by their first column."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[0] != key:
                if rows:
                    yield rows
                key, rows = row[0], []
            rows.append(row)
    if rows:
        yield rows


def _linked(units, percent):
    """Links inside each unit; a row is (unit, node, label, set)."""

    def run(batches):
        for rows in _by_unit(batches, ["unit", "node", "label", "set"]):
            distinct = {r[1]: (r[2], np.frombuffer(r[3], np.uint64)) for r in rows}
            nodes = sorted(distinct)
            if len(nodes) < 2:
                continue
            links = tree_links(
                [distinct[n][1] for n in nodes], [distinct[n][0] for n in nodes], percent
            )
            if links:
                yield {"a": [nodes[i] for i, _ in links], "b": [nodes[j] for _, j in links]}

    return iterate_batches(units, run, "a long, b long")


def _may_linked(units, percent):
    """Edges between the nodes of each unit whose sketches allow a link."""

    def run(batches):
        for rows in _by_unit(batches, ["unit", "node", "n_shingles", "sketch"]):
            distinct = {r[1]: r for r in rows}
            nodes = sorted(distinct)
            edges = sketch_edges(nodes, [distinct[n][2] for n in nodes], [distinct[n][3] for n in nodes], percent)
            if edges:
                yield {"a": [a for a, _ in edges], "b": [b for _, b in edges]}

    return iterate_batches(units, run, "a long, b long")


def document_sets(docs, words=WORDS):
    """``doc_id, n_shingles, node, check, sketch`` per row: two hashes name the set."""

    def run(batch):
        sets = shingle_sets(batch.column(1), words)
        node, check = set_hashes(sets)
        return {
            "doc_id": batch.column(0),
            "n_shingles": [len(s) for s in sets],
            "node": node,
            "check": check,
            "sketch": [sketch(s) for s in sets],
        }

    schema = "doc_id long, n_shingles long, node long, check long, sketch binary"
    return map_batches(docs, run, schema, BATCH)


def _named(texts, words):
    node, check = set_hashes(shingle_sets(texts, words))
    return {"node": node, "check": check}


def jaccard_components(docs, words=WORDS, percent=PERCENT):
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Two rows link when 100 * common >= ``percent`` * united shingles; a component is
    named by the smallest id in it. A null or wordless text has no shingle and is
    linked with nothing: its component is its own id. A null id is never the
    smallest; a component without any id is null. Rows that repeat an id stand each
    for their own text. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = ids_and_texts(docs)
    sets_path = new_path(spark, "sets")
    document_sets(texts, words).write.parquet(sets_path)
    sets = spark.read.parquet(sets_path)
    linked = links(texts, sets, words, percent)
    least = sets.where("n_shingles > 0").groupBy("node", "check").agg(F.min("doc_id").alias("least"))
    if linked is not None:
        named = least.join(components(linked), "node", "left").withColumn(
            "label", F.coalesce("label", "node")
        )
        smallest = named.groupBy("label").agg(F.min("least").alias("smallest"))
        least = named.join(smallest, "label").select("node", "check", F.col("smallest").alias("least"))
    joined = sets.drop("sketch").join(least, ["node", "check"], "left")
    return joined.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def links(texts, sets, words=WORDS, percent=PERCENT):
    """Links ``a, b`` between sets (by node) that connect every component; None if no
    two different sets share a signature."""
    spark = texts.sparkSession
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(1, min(32, int(8 * total // SIGNATURE_BUCKET_BYTES).bit_length()))
    rows = map_batches(
        texts, lambda b: _signature_rows(b, bits, words, percent), "bucket long, data binary", BATCH
    )
    found = rows.groupBy("bucket").applyInPandas(_candidate_edges, "a long, b long")
    candidates_path = new_path(spark, "candidates")
    found.distinct().write.parquet(candidates_path)
    candidates = spark.read.parquet(candidates_path)
    if not candidates.limit(1).count():
        return None
    # Everything a set may link with is in its candidate component; sketches cut it.
    wide = components(candidates).withColumnRenamed("label", "candidate")
    nodes = (
        sets.where("n_shingles > 0")
        .join(wide, "node")
        .groupBy("node", "candidate", "n_shingles")
        .agg(F.min("sketch").alias("sketch"))
    )
    counts = wide.groupBy("candidate").agg(F.ceil(F.count(F.lit(1)) / SKETCHES).cast("int").alias("blocks"))
    dealt = nodes.join(counts, "candidate").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("candidate", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        "node",
        "n_shingles",
        "sketch",
    )
    near_path = new_path(spark, "near")
    _may_linked(_sorted_units(units), percent).write.parquet(near_path)
    near = spark.read.parquet(near_path)
    if not near.limit(1).count():
        return None
    grouped = components(near).withColumnRenamed("label", "candidate")
    # A row of each set gives its text: by id, or by the set's hashes if no row has one.
    distinct = (
        sets.where("n_shingles > 0")
        .groupBy("node", "check", "n_shingles")
        .agg(F.min("doc_id").alias("doc_id"))
    )
    members = cut_lineage(distinct.join(grouped, "node"))
    sizes = members.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"), F.min("node").alias("anchor")
    )
    sizes = sizes.where("n > 1").withColumn(
        "blocks",
        F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("m") / BLOCK_SHINGLES)).cast("int"),
    )
    members = cut_lineage(
        members.join(sizes.drop("n", "m"), "candidate")
        .withColumn("block", F.pmod(F.xxhash64("check"), F.col("blocks")).cast("int"))
        .select("doc_id", "node", "check", "candidate", "block", "blocks", "anchor")
    )

    def extract(batch):
        found = shingle_sets(batch.column("text"), words)
        node, check = set_hashes(found)
        # A repeated id may come with another text.
        same = (node == batch.column("node").to_numpy()) & (check == batch.column("check").to_numpy())
        batch = batch.filter(pa.array(same))
        return {
            **{c: batch.column(c) for c in ("node", "candidate", "block", "blocks", "anchor")},
            "set": [s.tobytes() for s, ok in zip(found, same, strict=True) if ok],
        }

    chosen = texts.where("doc_id IS NOT NULL").join(broadcast_if_small(members.where("doc_id IS NOT NULL")), "doc_id")
    schema = "node long, candidate long, block int, blocks int, anchor long, set binary"
    sets_path = new_path(spark, "member-sets")
    map_batches(chosen, extract, schema, BATCH).write.parquet(sets_path)
    nameless = members.where("doc_id IS NULL").drop("doc_id")
    if nameless.limit(1).count():
        # A set comes once, from the one row with the smallest text that has it.
        hashed = map_batches(
            texts.where("doc_id IS NULL").select("doc_id", "text"),
            lambda b: {"text": b.column("text"), **_named(b.column("text"), words)},
            "text string, node long, check long",
            BATCH,
        )
        rows = hashed.join(broadcast_if_small(nameless), ["node", "check"]).groupBy(*members.drop("doc_id").columns)
        map_batches(rows.agg(F.min("text").alias("text")), extract, schema, BATCH).write.mode("append").parquet(sets_path)
    stored = spark.read.parquet(sets_path)

    # First every block on its own, together with one common set of its candidate
    # component, which ties the blocks of a large group of near copies.
    is_anchor = F.col("node") == F.col("anchor")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    inside = stored.withColumn(
        "unit", F.explode(F.when(is_anchor, everywhere).otherwise(F.array("block")))
    ).select(F.xxhash64("candidate", "unit").alias("unit"), "node", F.col("node").alias("label"), "set")
    first_path = new_path(spark, "links")
    _linked(_sorted_units(inside), percent).write.parquet(first_path)
    first = spark.read.parquet(first_path)

    # Then pairs of blocks, where a component of several blocks is not yet one.
    several = stored.where("blocks > 1").select("node", "candidate")
    if not several.limit(1).count():
        return first
    labels = components(first)
    now = several.distinct().join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = now.groupBy("candidate").agg(F.count_distinct("label").alias("labels")).where("labels > 1")
    rest = stored.join(open_.select("candidate"), "candidate").join(
        now.select("node", "label").distinct(), "node"
    )
    across = (
        rest.withColumn("other", F.explode(everywhere))
        .where("block <> other")
        .select(
            F.xxhash64("candidate", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
            "node",
            "label",
            "set",
        )
    )
    second_path = new_path(spark, "links")
    _linked(_sorted_units(across), percent).write.parquet(second_path)
    return first.unionByName(spark.read.parquet(second_path))


def _sorted_units(rows):
    return rows.repartition("unit").sortWithinPartitions("unit")


def keep_smallest(docs, words=WORDS, percent=PERCENT, id_col="doc_id"):
    """The rows of ``docs`` that carry the smallest id of their component, all columns.

    Rows without an id stay, and so do all rows of an id that stays; an id goes if
    any of its rows is linked with a smaller one.
    """
    found = jaccard_components(docs, words, percent).select(
        F.col("doc_id").alias("_id"), F.col("component_id").alias("_component")
    )
    gone = found.where("_id <> _component").select("_id").distinct()
    gone = broadcast_if_small(cut_lineage(gone))
    return docs.join(gone, docs[id_col].cast("long") == gone["_id"], "left_anti")
