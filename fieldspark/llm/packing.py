"""Packing of tokenised documents into sequences of a fixed window.

A document longer than the window fills whole windows; what is left over, shorter
than the window, is one piece and is never cut. Only the histogram of those lengths
is solved on the driver, so its size is bounded by the window:

1. lengths are rounded up to a grain; every combination of at most three of the
   longer lengths that fills the window is a column, and non-negative least squares
   finds how often to use each so that the histogram is met;
2. the counts are rounded down and applied;
3. what remains, short lengths included, is packed greedily by exact length: the
   longest that is left, then again and again the longest that still fits; such a
   pattern is repeated for as long as its lengths last.

The plan says, for each length, which ranks go into which pattern, copy and slot.
Pieces get their rank within their length in Spark and look their place up.
"""

import zlib

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.llm.bpe import BATCH, trie_for
from fieldspark.llm.common import ids_and_texts, map_batches
from fieldspark.storage import cut_lineage

WINDOW = 4096
GRAIN = 16
# Shorter lengths lose too much by rounding and are left to the greedy part.
SHORTEST_COMBINED = 256
END_ID = 2


# -- the plan ------------------------------------------------------------------


def combinations(units, shortest):
    """All ascending combinations of one to three lengths, in units, that fill
    ``units`` exactly; none shorter than ``shortest``."""
    found = [(units,)]
    for a in range(shortest, units // 2 + 1):
        found.append((a, units - a))
        for b in range(a, (units - a) // 2 + 1):
            found.append((a, b, units - a - b))
    return found


def non_negative_least_squares(a, b, rounds=None, tolerance=1e-9):
    """x >= 0 that minimises |a x - b|: columns enter one by one where the residual
    still slopes up, and leave where the unbounded solution turns negative."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, dtype=bool)
    scale = max(1.0, float(np.abs(b).max()) if len(b) else 1.0)
    for _ in range(rounds or 3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        enter = int(np.argmax(slope)) if n else 0
        if not n or slope[enter] <= tolerance * scale:
            break
        used[enter] = True
        while True:
            at = np.flatnonzero(used)
            own = a[:, at]
            try:
                s = np.linalg.solve(own.T @ own, own.T @ b)
            except np.linalg.LinAlgError:
                s = np.linalg.lstsq(own, b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            falling = s <= 0
            step = np.min(x[at][falling] / np.maximum(x[at][falling] - s[falling], 1e-300))
            x[at] += step * (s - x[at])
            out = at[x[at] <= 1e-12 * scale]
            x[out], used[out] = 0, False
            if not used.any():
                break
    return x


def plan(histogram, window=WINDOW, grain=GRAIN, shortest=SHORTEST_COMBINED):
    """Patterns of sequences that place every piece.

    ``histogram`` maps a length (1 to ``window``) to its number of pieces. Returns
    a list of ``(lengths, copies)``: the exact lengths in a sequence and how many
    sequences look like that. Each length occurs as often as the histogram says.
    """
    left = {n: c for n, c in histogram.items() if c}
    patterns = []
    units = window // grain
    counts = np.zeros(units + 1, dtype=np.int64)
    for n, c in left.items():
        if n >= shortest:
            counts[-(-n // grain)] += c
    columns = [c for c in combinations(units, -(-shortest // grain)) if all(counts[u] for u in c)]
    if columns:
        matrix = np.zeros((units + 1, len(columns)))
        for j, c in enumerate(columns):
            for u in c:
                matrix[u, j] += 1
        repeats = np.floor(non_negative_least_squares(matrix, counts.astype(float)) + 1e-6)
        # Within a unit the lengths are handed out from the longest down.
        stock = {}
        for n in sorted(left, reverse=True):
            if n >= shortest:
                stock.setdefault(-(-n // grain), []).append([n, left[n]])
        for j in np.argsort([-len(c) for c in columns], kind="stable"):
            column, copies = columns[j], int(repeats[j])
            while copies > 0:
                taken, need = [], {}
                for u in column:
                    need[u] = need.get(u, 0) + 1
                # As many copies as the current exact lengths allow.
                most = copies
                for u, times in need.items():
                    while stock.get(u) and not stock[u][0][1]:
                        stock[u].pop(0)
                    if not stock.get(u):
                        most = 0
                    elif stock[u][0][1] >= times:
                        most = min(most, stock[u][0][1] // times)
                    else:
                        most = min(most, 1) if sum(c for _, c in stock[u]) >= times else 0
                if not most:
                    break
                for u in column:
                    while not stock[u][0][1]:
                        stock[u].pop(0)
                    n = stock[u][0][0]
                    stock[u][0][1] -= most
                    left[n] -= most
                    taken.append(n)
                patterns.append((taken, most))
                copies -= most
    patterns += greedy({n: c for n, c in left.items() if c}, window)
    return patterns


def greedy(left, window):
    """Patterns from exact lengths: the longest, then whatever longest still fits."""
    patterns = []
    lengths = sorted(left, reverse=True)
    while lengths:
        room, pattern = window, []
        for n in lengths:
            times = min(room // n, left[n])
            if times:
                pattern.append((n, times))
                room -= n * times
                if not room:
                    break
        copies = min(left[n] // times for n, times in pattern)
        for n, times in pattern:
            left[n] -= copies * times
        patterns.append(([n for n, times in pattern for _ in range(times)], copies))
        lengths = [n for n in lengths if left[n]]
    return patterns


def places(patterns):
    """For each length four arrays over its runs: the rank each run ends at, the
    sequence it starts with, the offset of its pieces there, the pieces a sequence.

    A run is one length's share of a pattern: ``times`` consecutive ranks per copy.
    """
    runs, sequence = {}, 0
    for lengths, copies in patterns:
        slot = 0
        while slot < len(lengths):
            n, times = lengths[slot], 1
            while slot + times < len(lengths) and lengths[slot + times] == n:
                times += 1
            offset = sum(lengths[:slot])
            runs.setdefault(n, []).append((copies * times, sequence, offset, times))
            slot += times
        sequence += copies
    out = {}
    for n, each in runs.items():
        taken, first, offset, times = (np.array(c, dtype=np.int64) for c in zip(*each, strict=True))
        out[n] = (np.cumsum(taken), first, offset, times)
    return out


# -- the pieces ----------------------------------------------------------------


def pieces(docs, vocabulary, window=WINDOW, end_id=END_ID):
    """``doc_id, start, length, ids_crc32, doc_tokens`` of each piece: whole windows
    from the start of a document, then the rest. Tokenised once, without a shuffle."""

    def cut(batch):
        ids, offsets = trie_for(vocabulary).encode_batch(batch.column(1).to_pylist())
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        end = np.array([end_id], dtype="<u4")
        for key, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
            own = np.concatenate([ids[a:b].astype("<u4"), end])
            for start in range(0, len(own), window):
                part = own[start : start + window]
                out["doc_id"].append(key)
                out["start"].append(start)
                out["length"].append(len(part))
                out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                out["doc_tokens"].append(len(own))
        return out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return map_batches(ids_and_texts(docs), cut, schema, BATCH)


def pack(cut, window=WINDOW, grain=GRAIN, shortest=SHORTEST_COMBINED):
    """``sequence_id, offset`` for every piece (rows with a ``length``).

    The pieces are written once to the checkpoint folder, then counted by length,
    planned, ranked within their length and placed. No task sees all pieces of one
    length: they are numbered inside the partitions they were written by, and only
    the sizes of those are added up.
    """
    spark = cut.sparkSession
    columns = cut.columns
    cut = cut_lineage(cut.withColumn("_row", F.monotonically_increasing_id()))
    cut = cut.withColumn("_chunk", F.shiftright("_row", 33))
    sizes = cut.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    counted = sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    runs = places(plan({r["length"]: r["n"] for r in counted}, window, grain, shortest))
    shared = spark.sparkContext.broadcast(runs)
    before = W.partitionBy("length").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("length", "_chunk").orderBy("_row")) - 1
    ranked = cut.withColumn("_inside", inside).join(starts, ["length", "_chunk"])
    ranked = ranked.select(*columns, (F.col("_start") + F.col("_inside")).cast("long").alias("_rank"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in columns)
    kinds = kinds.replace("bigint", "long")

    def place(batch):
        length = batch.column("length").to_numpy()
        rank = batch.column("_rank").to_numpy()
        sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            ends, first, base, times = shared.value[int(n)]
            run = np.searchsorted(ends, rank[rows], side="right")
            within = rank[rows] - np.concatenate([[0], ends])[run]
            sequence[rows] = first[run] + within // times[run]
            offset[rows] = base[run] + within % times[run] * n
        return {**{c: batch.column(c) for c in columns}, "sequence_id": sequence, "offset": offset}

    return map_batches(ranked, place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs, vocabulary, window=WINDOW):
    """Pieces of all documents with their places.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. A null
    text is an empty one and has the end id alone; null ids and repeated rows are
    documents like others; an empty table gives no pieces.
    """
    return pack(pieces(docs, vocabulary, window), window)
