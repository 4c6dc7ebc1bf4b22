"""Keyed joins, enrichment and merges."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.functions.cells import is_blank
from fieldspark.schema import KEYS, WEATHER
from fieldspark.storage import broadcast_if_small, cut_lineage


def one_per_date(weather, date_col="Date", cols=WEATHER):
    """At most one row per calendar date (a filled row wins over a blank one).

    Years 1 to 9999 hold 3.65 million dates, a century 36,525, so the result
    has a size bound that does not depend on the number of inspections.
    """
    best = weather.groupBy(date_col).agg(F.max(F.struct(*cols)).alias("_best"))
    return best.select(date_col, *[F.col(f"_best.{c}") for c in cols])


def enrich_weather(df, weather, date_col="Date"):
    """Attach the day's weather; days without weather get NULL."""
    daily = one_per_date(weather, date_col)
    keep = [c for c in df.columns if c not in WEATHER]
    return df.select(*keep).join(F.broadcast(daily), date_col, "left").select(*keep, *WEATHER)


def backfill_weather(df, weather, date_col="Date"):
    """Where the temperature is blank, replace all three weather fields."""
    daily = one_per_date(weather, date_col).select(
        date_col, *[F.col(c).alias(f"_new_{c}") for c in WEATHER]
    )
    blank = is_blank(F.col(WEATHER[0]))
    filled = {
        c: F.when(blank, F.col(f"_new_{c}").cast(df.schema[c].dataType)).otherwise(F.col(c))
        for c in WEATHER
    }
    return (
        df.join(F.broadcast(daily), date_col, "left").select(
            *[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns]
        )
    )


def keep_first(df, keys, *order):
    """Per key the row that comes first in ``order`` (columns or expressions).

    Row number 1 is a group limit to Spark: each task cuts its own rows to one
    per key before the shuffle, so a hot key costs one row per task, and
    columns nobody reads later are never shuffled.
    """
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_turn", first).where(F.col("_turn") == 1).drop("_turn")


def dedup_last(df, keys, order_col):
    """Per key the row with the largest ``order_col``."""
    return keep_first(df, keys, F.desc(order_col))


def join_keys(left, right, keys, how):
    """Join on the keys with NULL equal to NULL, as grouping has it."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_key_{k}" for k in keys])


def merge_insert_only(
    existing,
    new,
    order_col,
    keys=KEYS,
    policy="prefer_recorded",
    is_recorded="is_recorded",
    existing_unique=False,
):
    """Insert rows whose key is absent; existing rows are never overwritten.

    Among new rows the first in ``order_col`` wins; among duplicates inside the
    existing side the last one wins. Policy "first" goes by that alone, so a
    look-back row may shadow a real inspection that comes later; policy
    "prefer_recorded" lets a row with ``is_recorded`` beat any without.
    One shuffle on the key, reduced before it. ``existing_unique`` says that
    ``existing`` has one row per key, as an earlier merge leaves it: then the keys
    of the new rows are sent to it, and its rows stay where they are unless the
    delivery is too large to broadcast.
    """
    if policy not in ("first", "prefer_recorded"):
        raise ValueError(f"unknown merge policy: {policy}")
    recorded = F.coalesce(F.col(is_recorded), F.lit(False))
    prefer = policy == "prefer_recorded"
    if existing is None:
        return keep_first(new, keys, *([~recorded] if prefer else []), order_col)
    if existing_unique:
        # The winners are computed once. Their keys, measured, go to the existing
        # rows; those are neither shuffled nor sorted as long as the delivery is small.
        first = cut_lineage(merge_insert_only(None, new, order_col, keys, policy, is_recorded))
        there = join_keys(existing, broadcast_if_small(first.select(*keys)), keys, "left_semi")
        added = cut_lineage(new_winners(there, first, keys, policy, is_recorded))
        if prefer:
            beaten = broadcast_if_small(added.where(recorded).select(*keys))
            existing = join_keys(existing, beaten, keys, "left_anti")
        return existing.unionByName(added, allowMissingColumns=True)
    sides = existing.withColumn("_side", F.lit(0)).unionByName(
        new.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    there = F.col("_side") == 0
    last_there = F.when(there, F.col(order_col)).desc()
    order = [F.col("_side"), last_there, F.when(~there, F.col(order_col))]
    return keep_first(sides, keys, *([~recorded] if prefer else []), *order).drop("_side")


def new_winners(existing, first, keys=KEYS, policy="prefer_recorded", is_recorded="is_recorded"):
    """The rows of ``first`` (one per key) that ``existing`` has no better row for."""
    recorded = F.coalesce(F.col(is_recorded), F.lit(False))
    known = existing.groupBy(*keys).agg(F.max(recorded).alias("_known"))
    wins = F.col("_known").isNull()
    if policy == "prefer_recorded":
        wins = wins | (recorded & ~F.col("_known"))
    return join_keys(first, known, keys, "left").where(wins).drop("_known")


def append_missing(existing, new, order_col, keys=KEYS):
    """Only the new rows to append: first per key, key absent from ``existing``."""
    known = existing.select(*keys).distinct()
    return join_keys(keep_first(new, keys, order_col), known, keys, "left_anti")


def apply_dictionary(df, dictionary, col, out=None):
    """Value to code through a dictionary table (column, value, code); unknown
    values get NULL. The dictionary is measured before it is broadcast."""
    codes = dictionary.where(F.col("column") == col).select(
        F.col("value").alias("_value"), F.col("code").alias("_code")
    )
    same = F.col(col).cast("string") == F.col("_value")
    joined = df.join(broadcast_if_small(codes), same, "left")
    out = out or col
    kept = [c for c in df.columns if c != out]
    return joined.select(*kept, F.col("_code").alias(out))
