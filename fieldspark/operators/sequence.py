"""Ordered work on daily series: arrays, kernels, pools, batches, splits."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.functions import cells, vectors
from fieldspark.functions.cells import md5_key
from fieldspark.operators.merge import join_keys, one_per_date
from fieldspark.operators.ranking import bucketed_rank, hash_cuts, sorted_rank
from fieldspark.schema import LOOKBACK_DAYS, WEATHER
from fieldspark.storage import broadcast_if_small, cut_lineage

# Days per chunk when a series is cut so that one key is never one task.
CHUNK_DAYS = 64
# A century of windows of so many days is some tens of megabytes.
BROADCAST_DAYS = 16


def assemble_sequence(df, keys, date="Date", cols=WEATHER, n=LOOKBACK_DAYS, out="sequence"):
    """One ordered array of daily structs per key, and its number of days.

    ``keys`` name one inspection, so a group has the ``n`` rows its look-back
    produced. Groups of another size stay too: ``{out}_days`` tells them, and
    ``{out}_complete`` whether there are ``n``.
    """
    entries = F.array_sort(F.collect_list(F.struct(date, *cols)))
    return (
        df.groupBy(*keys)
        .agg(entries.alias(out))
        .withColumn(f"{out}_days", F.size(out))
        .withColumn(f"{out}_complete", F.size(out) == n)
    )


def attach_sequence(
    inspections, weather, date="Date", cols=WEATHER, n=LOOKBACK_DAYS, out="sequence"
):
    """The same arrays without exploding or shuffling the inspections.

    The ``n``-day arrays are built once per calendar day on the weather side
    (bounded by the number of dates) and looked up by the inspection date.
    """
    daily = one_per_date(weather, date, cols)
    blanks = [F.lit(None).cast(daily.schema[c].dataType).alias(c) for c in cols]

    def window(end, found=None):
        def on(day):
            if found is None:
                return F.struct(day.alias(date), *blanks)
            hit = F.get(F.filter(found, lambda w: w[date] == day), F.lit(0))
            return F.struct(day.alias(date), *[hit[c].alias(c) for c in cols])

        return F.transform(F.sequence(F.date_sub(end, n - 1), end), on)

    ends = F.explode(F.sequence(F.col(date), F.date_add(F.col(date), n - 1)))
    by_end = (
        daily.select(ends.alias("_end"), F.struct(date, *cols).alias("_day"))
        .groupBy("_end")
        .agg(F.collect_list("_day").alias("_days"))
        .select("_end", window(F.col("_end"), F.col("_days")).alias("_window"))
    )
    # At most a row of n days for each date of the calendar: measured only where that
    # could be much.
    small = F.broadcast if n <= BROADCAST_DAYS else lambda days: broadcast_if_small(cut_lineage(days))
    known = inspections.join(small(by_end), F.col(date) == F.col("_end"), "left")
    return known.withColumn(out, F.coalesce("_window", window(F.col(date)))).drop("_end", "_window")


def moving_kernel(df, key, date, col, weights, pad=True, relu=False, out="kernel"):
    """Weighted sum over adjacent calendar days of a key, stride 1.

    The kernel is centred; a missing day counts as 0 with ``pad`` and voids the
    output without it. Expects one row per (key, date). Series are cut into
    chunks of days; a row within reach of other chunks is copied to them, so a long
    or hot series is many small windows.
    """
    left = (len(weights) - 1) // 2
    right = len(weights) - 1 - left
    day = F.unix_date(F.col(date))

    def chunk(shift):
        return F.floor((day + shift) / CHUNK_DAYS)

    # All chunks a row can be within reach of, however long the kernel is.
    copies = F.sequence(chunk(-right), chunk(left))
    spread = (
        df.withColumn("_day", day)
        .withColumn("_home", chunk(0))
        .withColumn("_chunk", F.explode(copies))
    )
    series = W.partitionBy(key, "_chunk").orderBy("_day")
    value = F.lit(0.0)
    present = F.lit(True)
    for i, weight in enumerate(weights):
        at = F.max(F.col(col)).over(series.rangeBetween(i - left, i - left))
        value = value + F.coalesce(at, F.lit(0.0)) * F.lit(float(weight))
        present = present & at.isNotNull()
    if relu:
        value = vectors.rectify(value)
    if not pad:
        value = F.when(present, value)
    result = (
        spread.withColumn(out, value)
        .where(F.col("_chunk") == F.col("_home"))
        .select(*df.columns, out)
    )
    return result if pad else result.where(F.col(out).isNotNull())


def convolve_sequence(df, col, weights, pad=0, relu=False, out="kernel"):
    """The same kernel over an array column."""
    return df.withColumn(out, vectors.convolve(F.col(col), weights, pad, relu))


def pool_windows(df, key, date, col, k, how="max", out="pooled", keep_tail=False):
    """Maximum or mean of every full block of ``k`` rows of a key, in date order.

    The last block is left out when it is short, unless ``keep_tail``. Expects
    one row per (key, date); rows are numbered per chunk of days. Rows without a
    key are one series.
    """
    if how not in ("max", "mean"):
        raise ValueError(f"unknown pooling: {how}")
    chunked = df.select(key, date, col).withColumn(
        "_chunk", F.floor(F.unix_date(F.col(date)) / CHUNK_DAYS)
    )
    ranked = bucketed_rank(chunked, [key], "_chunk", [date], "_rank")
    pooled = (
        ranked.groupBy(key, F.floor(F.col("_rank") / k).alias("block"))
        .agg(
            (F.max if how == "max" else F.avg)(col).alias(out),
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    return (pooled if keep_tail else pooled.where(F.col("_rows") == k)).drop("_rows")


def global_mean_pool(df, key, col, out="mean"):
    """Mean of a whole series; for an array column, of each row's elements."""
    if df.schema[col].dataType.typeName() == "array":
        return df.select(key, vectors.mean(F.col(col)).alias(out))
    return df.groupBy(key).agg(F.avg(cells.no_nan(F.col(col))).alias(out))


def assign_batches(df, order, size, drop_last=True, out="batch"):
    """Number fixed-size batches in the order of unique columns.

    Only those columns are sorted and written once; the other columns meet their
    row's number by key.
    """
    order = order if isinstance(order, (list, tuple)) else [order]
    ranked = sorted_rank(df.select(*order), order, "_rank", total="_total")
    batch = F.floor(F.col("_rank") / size)
    if drop_last:
        ranked = ranked.where(batch < F.floor(F.col("_total") / size))
    numbered = ranked.select(*order, batch.alias(out))
    if set(df.columns) == set(order):
        return numbered.select(*df.columns, out)
    return join_keys(df, numbered, order, "inner")


def exact_split(df, key, seed=42, percents=(70, 85), out="split", digits=4):
    """Seeded shuffle, then the first 70 %, the next up to 85 %, the rest.

    Two values of the shuffled order are the borders; every row is compared with
    them, none is moved.
    """
    keys = [key] if isinstance(key, str) else list(key)
    place = F.struct(md5_key(seed, *keys).alias("_md5"), *keys)

    def before(cut):
        if cut is None:
            return F.lit(True)
        named = zip(["_md5", *keys], cut)
        return place < F.struct(*[F.lit(v).cast(_kind(df, c)).alias(c) for c, v in named])

    first, second = (before(c) for c in hash_cuts(df, keys, seed, percents, digits))
    part = F.when(first, "train").when(second, "validation").otherwise("test")
    return df.withColumn(out, part)


def _kind(df, c):
    return "string" if c == "_md5" else df.schema[c].dataType


def time_series(df, date, col):
    """Rows, mean and maximum of a metric per date, in date order."""
    value = cells.no_nan(F.col(col))
    return (
        df.groupBy(date)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.max(value).alias("max"),
        )
        .orderBy(date)
    )
