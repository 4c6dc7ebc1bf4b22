"""Exact quartiles, whiskers and outlier counts at any size."""

from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.functions.cells import no_nan
from fieldspark.operators.merge import join_keys
from fieldspark.storage import broadcast_if_small, cut_lineage

WHISKER_REACH = 1.5
QUARTILES = (0.25, 0.5, 0.75)
BOX = ("q1", "median", "q3")
# One task puts at most so many distinct values in order.
MOST_VALUES = 1 << 16
# Into so many parts a larger bucket is cut; its number grows by as many bits.
PART_BITS = 6


def _value_buckets(values, cuts):
    """Number the values by approximate quantile ranges.

    The cut points need not be exact: any ascending cuts give exact ranks
    below, they only decide how evenly the values spread over tasks.
    """
    points = values.approxQuantile("_x", [i / cuts for i in range(1, cuts)], 0.5 / cuts)
    splits = [float("-inf"), *sorted(set(points) - {float("inf"), float("-inf")}), float("inf")]
    if len(splits) < 3:
        return values.withColumn("_bucket", F.lit(0).cast("long"))
    cut = Bucketizer(splits=splits, inputCol="_x", outputCol="_bucket").transform(values)
    return cut.withColumn("_bucket", F.col("_bucket").cast("long"))


def _wanted_ranks(sizes, key, probabilities):
    """Which buckets hold the rows that the quantiles lie between.

    ``sizes`` has one row per key and bucket; the result adds ``n`` and the
    wanted places inside the bucket, at most two per probability.
    """
    prior = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.select(
        key,
        "_bucket",
        "_size",
        F.coalesce(F.sum("_size").over(prior), F.lit(0)).alias("_start"),
        F.sum("_size").over(W.partitionBy(key)).alias("n"),
    )
    ranks = {}
    for i, p in enumerate(probabilities):
        spot = (F.col("n") - 1) * F.lit(p)
        ranks[f"lo{i}"], ranks[f"hi{i}"] = F.floor(spot), F.ceil(spot)
    ends = F.col("_start") + F.col("_size")
    holds_any = reduce(or_, [(at >= F.col("_start")) & (at < ends) for at in ranks.values()])
    places = F.array(
        *[F.struct(F.lit(n).alias("name"), (at - F.col("_start")).alias("at")) for n, at in ranks.items()]
    )
    inside = F.filter(places, lambda r: (r["at"] >= 0) & (r["at"] < F.col("_size")))
    return placed.where(holds_any).select(key, "_bucket", "n", inside.alias("_ranks"))


def _narrow(counted, wanted, key, most):
    """Cut buckets with over ``most`` distinct values and keep the parts that hold a
    wanted place, until none is larger.

    ``counted`` has the distinct values of the wanted buckets with their counts. The
    cuts are approximate quantiles of a bucket's own distinct values, so each round
    leaves about one in ``2^PART_BITS`` of them whatever their distribution, and counts
    alone tell which part holds a place.
    """
    parts = 1 << PART_BITS
    while True:
        sizes = counted.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_distinct"))
        if (sizes.agg(F.max("_distinct")).first()[0] or 0) <= most:
            return counted, wanted
        large = sizes.where(F.col("_distinct") > most).select(key, "_bucket")
        points = F.percentile_approx("_x", [i / parts for i in range(1, parts)], 100 * parts)
        cuts = join_keys(counted, broadcast_if_small(large), [key, "_bucket"], "left_semi")
        cuts = cut_lineage(cuts.groupBy(key, "_bucket").agg(points.alias("_cuts")))
        cut = join_keys(counted, broadcast_if_small(cuts), [key, "_bucket"], "left")
        part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_x"))), F.lit(0))
        cut = cut.withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_cuts")
        filled = cut.groupBy(key, "_bucket", "_part").agg(F.sum("_n").alias("_size"))
        prior = W.partitionBy(key, "_bucket").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        filled = filled.withColumn("_start", F.coalesce(F.sum("_size").over(prior), F.lit(0)))
        moved = F.transform(
            "_ranks", lambda r: F.struct(r["name"].alias("name"), (r["at"] - F.col("_start")).alias("at"))
        )
        inside = F.filter(moved, lambda r: (r["at"] >= 0) & (r["at"] < F.col("_size")))
        found = join_keys(filled, wanted, [key, "_bucket"], "inner").withColumn("_ranks", inside)
        found = cut_lineage(found.where(F.size("_ranks") > 0).select(key, "_bucket", "_part", "n", "_ranks"))
        numbered = (F.shiftleft("_bucket", PART_BITS) + F.col("_part")).alias("_bucket")
        kept = join_keys(cut, broadcast_if_small(found.select(key, "_bucket", "_part")), [key, "_bucket", "_part"], "left_semi")
        counted = cut_lineage(kept.select(key, numbered, "_x", "_n"))
        wanted = found.select(key, numbered, "n", "_ranks")


def exact_quantiles(df, col, key, probabilities=QUARTILES, cuts=256, most=MOST_VALUES):
    """Linearly interpolated quantiles per key, as columns q0, q1, ... and ``n``.

    Rows without a key are a group of their own, as in every other group-by here.
    A first pass counts the value buckets of every key, which locates the bucket
    of each wanted rank. A second pass looks at those buckets alone: equal
    values are counted together, buckets with over ``most`` of them are cut again
    around the wanted ranks, and what is left of each is put in order by its own
    task. A key holding most of the table is read by all tasks and shuffled by none.
    """
    values = df.select(F.col(key), no_nan(F.col(col)).alias("_x"))
    values = values.where(F.col("_x").isNotNull())
    values = _value_buckets(values, cuts)
    sizes = values.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    wanted = cut_lineage(_wanted_ranks(sizes, key, probabilities))

    near = join_keys(values, broadcast_if_small(wanted.select(key, "_bucket")), [key, "_bucket"], "inner")
    counted = cut_lineage(near.groupBy(key, "_bucket", "_x").agg(F.count(F.lit(1)).alias("_n")))
    counted, wanted = _narrow(counted, wanted, key, most)
    upto = W.partitionBy(key, "_bucket").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    summed = counted.withColumn("_upto", F.sum("_n").over(upto))
    hits = join_keys(summed, wanted, [key, "_bucket"], "inner").withColumn(
        "_ranks",
        F.filter(
            "_ranks",
            lambda r: (r["at"] < F.col("_upto")) & (r["at"] >= F.col("_upto") - F.col("_n")),
        ),
    )
    found = (
        hits.select(key, "n", "_x", F.explode("_ranks.name").alias("_name"))
        .groupBy(key, "n")
        .agg(
            *[
                F.max(F.when(F.col("_name") == f"{side}{i}", F.col("_x"))).alias(f"{side}{i}")
                for i in range(len(probabilities))
                for side in ("lo", "hi")
            ]
        )
    )

    def between(i, p):
        spot = (F.col("n") - 1) * F.lit(p)
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        return (low + (high - low) * (spot - F.floor(spot))).alias(f"q{i}")

    return found.select(key, "n", *[between(i, p) for i, p in enumerate(probabilities)])


def _whiskers(rows, keys, box):
    """Furthest values inside the fences and the count outside, per key."""
    reach = WHISKER_REACH * (box["q3"] - box["q1"])
    inside = (F.col("_x") >= box["q1"] - reach) & (F.col("_x") <= box["q3"] + reach)
    return rows.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def boxplot_stats(df, col, by=None, cuts=256):
    """Quartiles, whisker ends (furthest values within 1.5 IQR) and outliers.

    Two passes: the fences follow from the quartiles. The quartiles, one row
    per key, are written to the checkpoint folder between the passes.
    """
    key = by or "_all"
    data = df if by else df.withColumn(key, F.lit(0))
    data = data.select(key, no_nan(F.col(col)).alias("_x")).where(F.col("_x").isNotNull())
    quartiles = cut_lineage(
        exact_quantiles(data, "_x", key, cuts=cuts).select(
            key, "n", *[F.col(f"q{i}").alias(n) for i, n in enumerate(BOX)]
        )
    )
    if by:
        rows = join_keys(data, broadcast_if_small(quartiles), [key], "inner")
        return _whiskers(rows, [key, "n", *BOX], {c: F.col(c) for c in BOX})
    row = quartiles.first()
    box = {c: F.lit(row[c] if row else None).cast("double") for c in BOX}
    return _whiskers(data, [], box).select(
        F.lit(row["n"] if row else 0).cast("bigint").alias("n"),
        *[box[c].alias(c) for c in BOX],
        "whisker_low",
        "whisker_high",
        "outliers",
    )
