"""The solver of the classifier's network: L-BFGS whose gradients are summed over all
partitions.

The rows are packed once into compact blocks that every pass reads again, mapped into
memory where the shared folder is mounted; the network goes over a block in numpy. Only the weights, one loss and one gradient a task travel.
What the solver has learned of the curvature is kept, so training that goes on in epochs
seldom needs more than a pass for an iteration: a solver that starts afresh every time
searches for its step again.
"""

import json
import math
import mmap
import os
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from fieldspark.storage import cut_lineage, new_path

BLOCK_ROWS = 2048
# Rows that go through the network at once: their activations stay in the cache.
CHUNK_ROWS = 512
# A pass has no task for fewer rows: it would take longer to start.
TASK_ROWS = 8192
# Gradients that the driver adds up itself; more are first added up by tasks.
MOST_RESULTS = 64
# Pairs of steps and changes of the gradient that the solver remembers.
MEMORY = 10
SUFFICIENT, FLATTER = 1e-4, 0.9
TRIALS = 20
# A block stands in the file ``path`` from byte ``at`` on, or in ``data``.
BLOCK = "n long, path string, at long, size long, data binary"
ARRAYS = ("used", "counts", "positions", "values", "labels")
OPEN_FILES = 1024


# -- rows ------------------------------------------------------------------------


def _entries(column, width):
    """How many places of each row are stored, the places and the values."""
    if column.null_count:
        raise ValueError("a row to train on has no features")
    if pa.types.is_struct(column.type):
        values, sizes = column.field("values"), column.field("size").to_numpy(zero_copy_only=False)
        sparse = column.field("type").to_numpy(zero_copy_only=False) == 0
        counts = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.where(sparse, sizes, counts)
    else:
        values = column
        counts = sizes = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        sparse = np.zeros(len(counts), bool)
    if (sizes != width).any():
        raise ValueError(f"rows to train on have other than {width} features")
    positions = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if sparse.any():
        positions[np.repeat(sparse, counts)] = column.field("indices").filter(pa.array(sparse)).flatten().to_numpy()
    values = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    if not np.isfinite(values).all():
        raise ValueError("a row to train on has a feature that is not a finite number")
    return counts, positions, values


def pack(rows, width, classes):
    """Blocks of the rows' ``features`` and ``label``, written once."""

    folder = new_path(rows.sparkSession, "packed")
    mounted = urlparse(folder).scheme in ("", "file")

    def blocks(batches):
        path, at = f"{urlparse(folder).path}/{uuid.uuid4().hex}.bin", 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                n, data = block(batch.slice(start, BLOCK_ROWS))
                if not mounted:
                    yield row(n, None, None, len(data), data)
                    continue
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "ab") as out:
                    out.write(data)
                yield row(n, path, at, len(data), None)
                at += len(data)

    def row(*values):
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()
        names = [part.split()[0] for part in BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names=names)

    def block(batch):
        counts, positions, values = _entries(batch.column("features"), width)
        labels = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
        if not np.isin(labels, np.arange(classes)).all():
            raise ValueError(f"labels to train on must be 0 to {classes - 1}")
        used, positions = np.unique(positions, return_inverse=True)
        kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
        return len(counts), _to_bytes(
            used.astype(np.int32), counts.astype(np.int32), positions.astype(kind), values, labels.astype(np.int32)
        )

    return cut_lineage(rows.mapInArrow(blocks, BLOCK))


def _to_bytes(*arrays):
    """The ``ARRAYS`` behind a header with their kinds and lengths, each from a multiple
    of eight bytes on."""
    head = json.dumps([(a.dtype.str, len(a)) for a in arrays]).encode()
    parts = [np.int64(len(head)).tobytes(), head, *[a.tobytes() for a in arrays]]
    return b"".join(x + b"\0" * (-len(x) % 8) for x in parts)


def _from_bytes(data):
    length = int(data[:8].view(np.int64)[0])
    at, out = 8 + length + -length % 8, {}
    for name, (kind, n) in zip(ARRAYS, json.loads(bytes(data[8 : 8 + length]))):
        size = n * np.dtype(kind).itemsize
        out[name] = data[at : at + size].view(kind)
        at += size + -size % 8
    return out


@lru_cache(OPEN_FILES)
def _mapped(path):
    with open(path, "rb") as source:
        return np.frombuffer(mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)


def _read(batch, i):
    """The arrays of block ``i``."""
    path, at, size = (batch.column(c)[i].as_py() for c in ("path", "at", "size"))
    if path is None:
        return _from_bytes(np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8))
    return _from_bytes(_mapped(path)[at : at + size])


def _chunks(block):
    """Rows of a block as matrices over the places that it uses, with the labels."""
    used, counts, positions, values, labels = (block[name] for name in ARRAYS)
    ends = np.concatenate([[0], np.cumsum(counts)])
    for start in range(0, len(labels), CHUNK_ROWS):
        end = min(start + CHUNK_ROWS, len(labels))
        own = slice(ends[start], ends[end])
        x = np.zeros((end - start, len(used)))
        x.reshape(-1)[np.repeat(np.arange(end - start) * len(used), counts[start:end]) + positions[own]] = values[own]
        yield used, x, labels[start:end]


# -- the network -----------------------------------------------------------------


def layer_views(weights, layers):
    """The matrix and the biases of each layer in a vector of Spark ML's layout: input by
    input, then the biases."""
    views, at = [], 0
    for n, m in zip(layers, layers[1:]):
        views.append((weights[at : at + n * m].reshape(n, m), weights[at + n * m : at + n * m + m]))
        at += n * m + m
    return views


def add_gradient(views, slopes, used, x, labels):
    """Add the gradient of the rows' cross-entropy to ``slopes``; its sum is returned.
    Sigmoids between the layers, a softmax behind the last."""
    passed = [x]
    with np.errstate(over="ignore"):
        for i, (w, b) in enumerate(views):
            z = passed[-1] @ (w if i else w[used])
            z += b
            if i < len(views) - 1:
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1.0
                np.reciprocal(z, out=z)
            passed.append(z)
    rows = np.arange(len(labels))
    z = passed.pop()
    z -= z.max(axis=1, keepdims=True)
    own = z[rows, labels]
    np.exp(z, out=z)
    total = z.sum(axis=1, keepdims=True)
    loss = float(np.log(total).sum() - own.sum())
    z /= total
    z[rows, labels] -= 1.0
    for i in range(len(views) - 1, -1, -1):
        w, b = slopes[i]
        if i:
            w += passed[i].T @ z
        else:
            w[used] += passed[i].T @ z
        b += z.sum(axis=0)
        if i:
            z = z @ views[i][0].T
            z *= passed[i]
            np.subtract(1.0, passed[i], out=passed[i])
            z *= passed[i]
    return loss


RESULT = "loss double, gradient binary"


def _result(loss, gradient):
    return pa.RecordBatch.from_arrays(
        [pa.array([loss], pa.float64()), pa.array([gradient.tobytes()], pa.binary())], names=["loss", "gradient"]
    )


def mean_loss(blocks, layers, weights):
    """Mean cross-entropy over all rows of the blocks, and its gradient."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def one_pass(batches):
        views, gradient, loss = layer_views(shared.value, layers), np.zeros(len(shared.value)), 0.0
        slopes = layer_views(gradient, layers)
        for batch in batches:
            for i in range(batch.num_rows):
                for chunk in _chunks(_read(batch, i)):
                    loss += add_gradient(views, slopes, *chunk)
        yield _result(loss, gradient)

    def add_up(batches):
        loss, gradient = 0.0, np.zeros(len(shared.value))
        for batch in batches:
            loss += sum(batch.column("loss").to_pylist())
            for x in batch.column("gradient"):
                gradient += np.frombuffer(x.as_buffer(), float)
        yield _result(loss, gradient)

    sums, tasks = blocks.mapInArrow(one_pass, RESULT), blocks.rdd.getNumPartitions()
    if tasks > MOST_RESULTS:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(add_up, RESULT)
    # One row a task.
    found = sums.collect()
    shared.destroy()
    loss = sum(r["loss"] for r in found)
    return loss, np.sum([np.frombuffer(r["gradient"], float) for r in found], axis=0)


# -- the solver ------------------------------------------------------------------


class Solver:
    """L-BFGS on the mean loss of ``rows`` with columns ``features`` and ``label``. It
    can go on after any number of iterations; ``objectives`` are the losses so far."""

    def __init__(self, rows, layers, weights):
        blocks = pack(rows, layers[0], layers[-1])
        self.layers, self.n = layers, blocks.agg(F.sum("n")).first()[0]
        # Fewer tasks without a shuffle; there are never more than before.
        self.blocks = blocks.coalesce(-(-self.n // TASK_ROWS))
        self.weights, self.pairs, self.passes = weights, [], 0
        self.loss, self.gradient = self.at(weights)
        self.objectives = [self.loss]

    def at(self, weights):
        self.passes += 1
        loss, gradient = mean_loss(self.blocks, self.layers, weights)
        return loss / self.n, gradient / self.n

    def run(self, iterations):
        for _ in range(iterations):
            if not self.iterate():
                break
        return self

    def iterate(self):
        """One iteration; False where no step makes the loss smaller."""
        while True:
            direction = self.direction()
            slope = float(direction @ self.gradient)
            size = float(np.linalg.norm(direction))
            found = self.search(direction, slope, 1.0 if self.pairs else 1.0 / size) if slope < 0 else None
            if found is not None:
                break
            if not self.pairs:
                return False
            self.pairs = []
        step, loss, gradient = found
        change, rise = step * direction, gradient - self.gradient
        if change @ rise > 1e-12 * (rise @ rise):
            self.pairs = [*self.pairs, (change, rise)][-MEMORY:]
        self.weights, self.loss, self.gradient = self.weights + change, loss, gradient
        self.objectives.append(loss)
        return True

    def direction(self):
        d, kept = -self.gradient, []
        for s, y in reversed(self.pairs):
            a = (s @ d) / (s @ y)
            d = d - a * y
            kept.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(self.pairs, reversed(kept)):
            d = d + s * (a - (y @ d) / (s @ y))
        return d

    def search(self, direction, slope, step):
        """A step with the strong Wolfe conditions, its loss and gradient; the best one
        that makes the loss smaller, if none is found within the trials."""
        low, high, best = (0.0, self.loss, slope), None, None
        for _ in range(TRIALS):
            loss, gradient = self.at(self.weights + step * direction)
            here = float(gradient @ direction)
            finite = math.isfinite(loss) and math.isfinite(here)
            if not finite or loss > self.loss + SUFFICIENT * step * slope or loss >= low[1]:
                high = (step, loss, here) if finite else (step, math.inf, math.inf)
            else:
                best = step, loss, gradient
                if abs(here) <= -FLATTER * slope:
                    return best
                if here * ((high[0] if high else math.inf) - low[0]) >= 0:
                    high = low
                low = (step, loss, here)
            step = _between(low, high) if high else 2.0 * step
        return best


def _between(low, high):
    """The minimum of the parabola through both losses and the slope at ``low``, not too
    near to either end."""
    (a, f, d), (b, g, _) = low, high
    width = b - a
    bend = g - f - d * width
    part = -d * width / (2.0 * bend) if math.isfinite(bend) and bend > 0 else 0.5
    return a + width * min(0.9, max(0.1, part))
