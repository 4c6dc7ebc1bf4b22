"""What several operators of this subpackage share."""

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
BATCH_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark, max_bytes=BATCH_BYTES):
    """Arrow batches end at ``max_bytes``, not only after a number of rows, so a
    Python worker holds a few megabytes of text however long the texts are."""
    if int(spark.conf.get(BATCH_BYTES_SETTING, str(2**31 - 1))) > max_bytes:
        spark.conf.set(BATCH_BYTES_SETTING, str(max_bytes))


def let(value, body):
    """``body(value)`` as an expression that computes ``value`` once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ids_and_texts(docs, id_col="doc_id", text_col="text"):
    """Only the two columns an operator needs, under fixed names; a null text is
    an empty one. Other columns of ``docs``, whatever they are called, stay out."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def map_batches(df, fn, schema, max_bytes=BATCH_BYTES):
    """``fn(batch) -> dict of columns`` (or None) on each Arrow batch."""
    bound_batches(df.sparkSession, max_bytes)
    arrow = _arrow_schema(schema)

    def run(batches):
        for batch in batches:
            columns = fn(batch) if batch.num_rows else None
            if columns is not None:
                arrays = [_array(columns[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def give_back():
    """Return memory that the task has freed to the system: workers serve many tasks,
    of other operators too, and share the executor's memory with each other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def iterate_batches(df, fn, schema, max_bytes=BATCH_BYTES):
    """``fn(iterator of batches) -> iterator of dicts of columns`` per partition."""
    bound_batches(df.sparkSession, max_bytes)
    arrow = _arrow_schema(schema)

    def run(batches):
        for columns in fn(batches):
            arrays = [_array(columns[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def _array(values, kind):
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values.cast(kind)
    return pa.array(values, type=kind)


KINDS = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def _arrow_schema(schema):
    fields = [part.split() for part in schema.split(",")]
    return pa.schema([(name, KINDS[kind]) for name, kind in fields])


def text_bytes(column):
    """The bytes of all texts of an Arrow string column in one array, and where
    each text starts (one entry more than there are texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def mix(x):
    """Spread the bits of unsigned 64-bit numbers (multiply and shift)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
