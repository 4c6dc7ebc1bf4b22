"""Exact row numbers without sending a table through one task."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.functions.cells import md5_key
from fieldspark.storage import cut_lineage

# monotonically_increasing_id keeps the partition above bit 33.
PARTITION_SHIFT = 33
ROW_MASK = (1 << PARTITION_SHIFT) - 1


def bucketed_rank(df, keys, bucket, order, name, total=None, few_buckets=False):
    """0-based rank per ``keys`` in the order (``bucket``, ``order``).

    ``bucket`` is a column that never decreases along ``order``. Only bucket
    sizes are summed across a key; rows are numbered inside one bucket, so a hot
    key is spread over as many tasks as it has buckets. Without keys the bucket
    sizes themselves pass through one task: ``hash_rank`` fixes their number.
    ``few_buckets`` promises a fixed number of buckets, whose starts may then be
    broadcast.
    """
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        starts = starts.withColumn(total, F.sum("_n").over(W.partitionBy(*keys)))
    starts = starts.drop("_n")
    if few_buckets:
        starts = F.broadcast(starts)
    inside = F.row_number().over(W.partitionBy(*keys, bucket).orderBy(*order))
    renamed = starts.withColumnsRenamed({c: f"_at_{c}" for c in (*keys, bucket)})
    # A missing key is a key like others.
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]
    joined = df.join(renamed, [*same, F.col(bucket) == F.col(f"_at_{bucket}")])
    ranked = joined.withColumn(name, F.col("_start") + inside - 1)
    return ranked.select(*df.columns, name, *([total] if total else []))


def hash_rank(df, key, seed, name="rank", digits=4, total=None):
    """0-based rank in a seeded random order of the unique column ``key``.

    Rows are bucketed by the first hex digits of an md5: 16^digits even buckets
    (65,536 by default), whatever the keys look like. Raise ``digits`` with the
    data; the table of bucket sizes is all that is broadcast.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hashed = df.withColumn("_md5", md5_key(seed, *keys)).withColumn(
        "_bucket", F.substring("_md5", 1, digits)
    )
    ranked = bucketed_rank(hashed, [], "_bucket", ["_md5", *keys], name, total, few_buckets=True)
    return ranked.drop("_md5", "_bucket")


def hash_cuts(df, key, seed, percents, digits=4):
    """The places in the order of ``hash_rank`` at which parts of the rows end: for each
    percentage the (md5, key...) of the first row behind it, None behind the last row.

    Buckets are counted, at most 16^digits numbers; rows are ranked inside the one
    bucket that holds each place. No other row is shuffled or sorted.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hashed = df.select(*keys, md5_key(seed, *keys).alias("_md5"))
    hashed = hashed.withColumn("_bucket", F.substring("_md5", 1, digits))
    sizes = sorted((r["_bucket"], r["count"]) for r in hashed.groupBy("_bucket").count().collect())
    total = sum(n for _, n in sizes)
    wanted = {}
    for p in percents:
        place, start = total * p // 100, 0
        for bucket, n in sizes:
            if place < start + n:
                wanted[p] = (bucket, place - start)
                break
            start += n
    borders = hashed.where(F.col("_bucket").isin(sorted({b for b, _ in wanted.values()})))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy("_md5", *keys)) - 1
    pairs = F.struct("_bucket", inside.alias("_at"))
    hits = [F.struct(F.lit(b).alias("_bucket"), F.lit(at).cast("int").alias("_at")) for b, at in wanted.values()]
    rows = borders.select("_md5", *keys, pairs.alias("_place"))
    found = {
        (r["_place"]["_bucket"], r["_place"]["_at"]): (r["_md5"], *[r[k] for k in keys])
        for r in (rows.where(F.col("_place").isin(hits)).collect() if hits else [])
    }
    return [found[wanted[p]] if p in wanted else None for p in percents]


def sorted_rank(df, order, name="rank", total=None):
    """0-based rank in the order of any unique sortable columns.

    A range-partitioned sort is written to the checkpoint folder once, so the
    partition sizes and the rows come from the very same split; only one row
    per sort partition passes through the running sum.
    """
    ordered = cut_lineage(
        df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_slot", PARTITION_SHIFT))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(W.partitionBy()).alias(total or "_total"),
    )
    rank = F.col("_start") + F.col("_slot").bitwiseAND(F.lit(ROW_MASK))
    return (
        ordered.join(F.broadcast(starts), "_part")
        .withColumn(name, rank)
        .select(*df.columns, name, *([total] if total else []))
    )
