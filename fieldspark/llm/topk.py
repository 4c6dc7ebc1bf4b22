"""Exact top-k inner products through a bit-sliced index.

Every component becomes the integer ``floor(scale * x)``. A block of rows keeps, for
each dimension, the distance of that integer from the block's smallest one, without
its ``drop`` lowest bits, as bitmaps: one slice per bit, one bit per row.

A query is a weighted sum of dimensions. Positive weights add the slices, negative
ones add the complement, so everything added is non-negative; each set bit of a
weight adds the slices once, shifted. Bitmaps of equal weight are added three at a
time (sum and carry) until one bitmap per binary digit of the score is left. From
the most significant slice down, the k-th largest of these coarse scores is found by
counting. What the dropped bits can add is bounded, so rows more than that bound
below it are out; the boundary rows left are resolved with their exact integers.
"""

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.llm.common import iterate_batches, map_batches
from fieldspark.storage import cut_lineage

BLOCK_ROWS = 32768
QUERY_ROWS = 256
DROP_BITS = 2
SALTS = 16


# -- bitmaps -----------------------------------------------------------------


def bitmap(flags):
    """One bit per row, in 64-bit words."""
    packed = np.packbits(flags, bitorder="little")
    words = np.zeros((len(flags) + 63) // 64 * 8, dtype=np.uint8)
    words[: len(packed)] = packed
    return words.view(np.uint64)


def rows_of(words, n):
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), count=n, bitorder="little"))


def add_all(columns):
    """Add bitmaps; ``columns[p]`` holds those of weight 2^p. One bitmap per digit."""
    digits, p = [], 0
    while p < len(columns):
        column = columns[p]
        while len(column) > 1:
            if p + 1 == len(columns):
                columns.append([])
            a, b = column.pop(), column.pop()
            if column:
                c = column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                columns[p + 1].append((a & b) | (half & c))
            else:
                column.append(a ^ b)
                columns[p + 1].append(a & b)
        digits.append(column[0] if column else None)
        p += 1
    return digits


def kth_largest(digits, valid, k):
    """The largest value that at least k valid rows reach, 0 if there are fewer."""
    sure, open_ = np.zeros_like(valid), valid
    value = 0
    for p in range(len(digits) - 1, -1, -1):
        slice_ = digits[p]
        if slice_ is None:
            continue
        above = open_ & slice_
        reached = sure | above
        if int(np.bitwise_count(reached).sum()) >= k:
            value |= 1 << p
            open_ = above
        else:
            sure = reached
            open_ = open_ & ~slice_
    return value


def at_least(digits, valid, value):
    """Valid rows whose number is ``value`` or more."""
    if value <= 0:
        return valid
    if value >> len(digits):
        return np.zeros_like(valid)
    greater, equal = np.zeros_like(valid), valid
    for p in range(len(digits) - 1, -1, -1):
        slice_ = digits[p] if digits[p] is not None else np.zeros_like(valid)
        if value >> p & 1:
            equal = equal & slice_
        else:
            greater = greater | (equal & slice_)
            equal = equal & ~slice_
    return greater | equal


# -- one block ---------------------------------------------------------------


def _narrowest(matrix):
    top = int(np.abs(matrix).max()) if matrix.size else 0
    return next(k for k in (np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)


class Block:
    """The slices of some rows and their exact integers."""

    def __init__(self, ids, matrix, drop=DROP_BITS):
        self.ids, self.matrix, self.drop = ids, matrix, drop
        self.n = len(ids)
        self.low = matrix.min(axis=0)
        reach = matrix.max(axis=0) - self.low
        self.bits = [max(0, int(r).bit_length() - drop) for r in reach]
        self.slices = []
        for d, bits in enumerate(self.bits):
            coarse = (matrix[:, d] - self.low[d]) >> drop
            self.slices.append([bitmap((coarse >> b & 1).astype(bool)) for b in range(bits)])
        self.everything = bitmap(np.ones(self.n, dtype=bool))

    def pack(self):
        return {
            "ids": self.ids.astype(np.int64).tobytes(),
            "numbers": self.matrix.astype(width := _narrowest(self.matrix)).tobytes(),
            "width": np.dtype(width).itemsize,
            "slices": b"".join(s.tobytes() for each in self.slices for s in each),
            "bits": [int(b) for b in self.bits],
            "low": [int(v) for v in self.low],
        }

    @classmethod
    def unpack(cls, ids, numbers, width, slices, bits, low, drop=DROP_BITS):
        block = cls.__new__(cls)
        block.ids = np.frombuffer(ids, np.int64)
        block.n, block.drop = len(block.ids), drop
        block.matrix = np.frombuffer(numbers, f"i{width}").reshape(block.n, -1)
        words = np.frombuffer(slices, np.uint64).reshape(sum(bits), -1) if sum(bits) else []
        block.bits, block.low, block.slices, at = bits, np.array(low), [], 0
        for b in bits:
            block.slices.append(list(words[at : at + b]))
            at += b
        block.everything = bitmap(np.ones(block.n, dtype=bool))
        return block

    def top(self, own, weights, k):
        """Ids and scores of the k best rows, without the rows named ``own``."""
        valid = self.everything & ~bitmap(self.ids == own)
        columns = [[] for _ in range(1)]
        for weight, slices in zip(weights, self.slices, strict=True):
            size, negative = abs(int(weight)), weight < 0
            if not size or not slices:
                continue
            used = [~s for s in slices] if negative else slices
            shift = 0
            while size >> shift:
                if size >> shift & 1:
                    while len(columns) < shift + len(used):
                        columns.append([])
                    for b, s in enumerate(used):
                        columns[shift + b].append(s)
                shift += 1
        digits = add_all(columns)
        # Dropped bits add at most this many units of a coarse score.
        loose = int(np.abs(weights).sum()) * ((1 << self.drop) - 1) >> self.drop
        boundary = kth_largest(digits, valid, k) - loose - 1
        rows = rows_of(at_least(digits, valid, boundary), self.n)
        scores = self.matrix[rows].astype(np.int64) @ weights
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


# -- the table ---------------------------------------------------------------


def quantised(rows, id_col, vector_col, scale):
    """Rows that take part, their components as integers."""
    x = F.col(vector_col)
    whole = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))
    )
    return rows.where(F.col(id_col).isNotNull() & x.isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("numbers"),
    )


def _stacks(batches, most):
    """Rows of equal dimension together, at most ``most`` at a time."""
    waiting = {}

    def stack(rows):
        return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.int64).reshape(len(rows), -1)

    for batch in batches:
        for key, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = waiting.setdefault(len(numbers), [])
            rows.append((key, numbers))
            if len(rows) == most:
                yield stack(waiting.pop(len(numbers)))
    for rows in waiting.values():
        yield stack(rows)


def build_index(rows, drop=DROP_BITS, block_rows=BLOCK_ROWS):
    """One row per block of up to ``block_rows`` vectors of one dimension: every row
    is in one block. Written to the checkpoint folder, so block numbers stay."""
    n = rows.count()

    def blocks(batches):
        first = TaskContext.get().partitionId() << 20
        for i, (ids, matrix) in enumerate(_stacks(batches, block_rows)):
            packed = Block(ids, matrix, drop).pack()
            yield {
                "block": [first + i],
                "dimension": [matrix.shape[1]],
                **{k: [v] for k, v in packed.items()},
            }

    schema = (
        "block long, dimension int, ids binary, numbers binary, width int, slices binary, "
        "bits array<int>, low array<long>"
    )
    return cut_lineage(iterate_batches(rows.repartition(max(1, -(-n // block_rows))), blocks, schema))


def top_k(index, queries, k, drop=DROP_BITS, query_rows=QUERY_ROWS):
    """``query_id, rank, vec_id, score`` of the k best rows of each query.

    Blocks of queries meet blocks of the index; each pair is one task's work and
    gives at most k rows a query. Ties go to the smaller id, a query's own id is
    left out. Only vectors of equal dimension meet.
    """
    m = queries.count()

    def groups(batches):
        first = TaskContext.get().partitionId() << 20
        for i, (ids, matrix) in enumerate(_stacks(batches, query_rows)):
            yield {
                "group": [first + i],
                "dimension": [matrix.shape[1]],
                "query_ids": [ids.astype(np.int64).tobytes()],
                "weights": [matrix.astype(np.int64).tobytes()],
            }

    grouped = cut_lineage(
        iterate_batches(
            queries.repartition(max(1, -(-m // query_rows))),
            groups,
            "group long, dimension int, query_ids binary, weights binary",
        )
    )
    # Only the numbers of blocks and groups are paired, spread over the salts. Groups
    # travel to each block; the blocks themselves are shuffled once.
    salted = grouped.select("group", "dimension", F.pmod(F.xxhash64("group"), F.lit(SALTS)).alias("salt"))
    pairs = (
        index.select("block", "dimension", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        .join(salted.withColumn("salt", F.col("salt").cast("int")), ["dimension", "salt"])
        .select("block", "group")
    )
    work = (
        pairs.join(grouped.drop("dimension"), "group")
        .join(index.drop("dimension"), "block")
        .select("ids", "numbers", "width", "slices", "bits", "low", "query_ids", "weights")
    )

    def score(batch):
        out = {"query_id": [], "vec_id": [], "score": []}
        for row in batch.to_pylist():
            block = Block.unpack(
                *(row[c] for c in ("ids", "numbers", "width", "slices", "bits", "low")), drop
            )
            own = np.frombuffer(row["query_ids"], np.int64)
            weights = np.frombuffer(row["weights"], np.int64).reshape(len(own), -1)
            for q in range(len(own)):
                ids, scores = block.top(own[q], weights[q], k)
                out["query_id"] += [int(own[q])] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return out

    found = map_batches(work, score, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search(rows, is_query, k, id_col="vec_id", vector_col="embedding", scale=256.0):
    """The k best other rows for every row that satisfies ``is_query``.

    A vector that is null, or holds a null, infinite or undefined component, takes
    no part, nor does a row without an id. Rows that repeat an id are candidates
    each on their own; as queries they count once, with the smallest vector. An
    empty table gives an empty result.
    """
    numbers = quantised(rows, id_col, vector_col, scale)
    queries = numbers.where(is_query(F.col("id"))).groupBy("id").agg(F.min("numbers").alias("numbers"))
    return top_k(build_index(numbers), queries, k)
