"""Ordering, sampling, splitting and binning."""

from pyspark.sql import functions as F

from fieldspark.functions import cells, vectors
from fieldspark.operators.ranking import sorted_rank


def preview(df, order, n=10):
    """The first ``n`` rows in a stated order; each task keeps ``n`` rows."""
    order = order if isinstance(order, (list, tuple)) else [order]
    return df.orderBy(*order).limit(n)


def seeded_shuffle(df, key, seed=42, position=None):
    """Reproducible random order of the unique column ``key``; ``position`` adds
    the 0-based place as a column, for tables that are written or joined."""
    drawn = df.withColumn("_draw", cells.md5_key(seed, key))
    if position:
        return sorted_rank(drawn, ["_draw", key], position).drop("_draw")
    return drawn.orderBy("_draw", key).drop("_draw")


def hash_split(df, key, seed=42, percents=(70, 85), out="split"):
    """Row-wise 70/15/15 that does not move when rows are added; no shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    draw = F.conv(F.substring(cells.md5_key(seed, *keys), 1, 8), 16, 10).cast("long") % 100
    part = (
        F.when(draw < percents[0], "train").when(draw < percents[1], "validation").otherwise("test")
    )
    return df.withColumn(out, part)


def argmax_class(df, scores, out="predicted"):
    return df.withColumn(out, vectors.argmax(F.col(scores)))


def scatter_pairs(df, x, y):
    """The (x, y) pairs themselves, where both are present."""
    pairs = df.select(cells.no_nan(F.col(x)).alias(x), cells.no_nan(F.col(y)).alias(y))
    return pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def scatter_bins(df, x, y, nx=20, ny=20):
    """Row counts on an ``nx`` by ``ny`` grid over the range of the data."""
    pairs = scatter_pairs(df, x, y)
    ranges = pairs.agg(
        F.struct(
            F.min(x).alias("x_lo"), F.max(x).alias("x_hi"), F.min(y).alias("y_lo"), F.max(y).alias("y_hi")
        ).alias("r")
    ).scalar()

    def bin_of(c, name, n):
        lo, hi = ranges[f"{name}_lo"], ranges[f"{name}_hi"]
        step = F.coalesce(F.floor(F.try_divide(F.col(c) - lo, (hi - lo) / n)), F.lit(0))
        return F.least(step, F.lit(n - 1)).alias(f"{name}_bin")

    return pairs.groupBy(bin_of(x, "x", nx), bin_of(y, "y", ny)).agg(F.count(F.lit(1)).alias("n"))
