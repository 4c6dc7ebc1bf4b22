"""Descriptive statistics, each in one pass over its input."""

from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.cells import no_nan
from fieldspark.functions.vectors import doubles, over
from fieldspark.operators.ranking import sorted_rank
from fieldspark.schema import POSITIVE_ABOVE


def _long(row, *structs):
    """One wide row to one row per struct."""
    return row.select(F.inline(F.array(*structs)))


def positive_days(df, key="SiteID", col="DipCount", t=POSITIVE_ABOVE):
    """Rows over the threshold per key; keys without any are absent."""
    return df.where(over(F.col(col), t) == 1).groupBy(key).agg(
        F.count(F.lit(1)).alias("positive_days")
    )


def correlation_matrix(df, cols):
    """Pearson r for every pair, over the rows where both are present.

    All pairs come from one aggregate. Each column is blanked where its partner
    is missing, and a column that is constant there gives NULL: its smallest and
    largest value are compared, since sums leave a residue of rounding.
    """
    data = df.select(*[no_nan(F.col(c)).alias(c) for c in cols])
    aggregates = []
    for x, y in combinations(cols, 2):
        in_x = F.when(F.col(y).isNotNull(), F.col(x))
        in_y = F.when(F.col(x).isNotNull(), F.col(y))
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(in_x) * F.stddev_pop(in_y))
        varies = (F.min(in_x) < F.max(in_x)) & (F.min(in_y) < F.max(in_y))
        aggregates.append(F.when(varies, r).alias(f"{x}~{y}"))
    for x in cols:
        aggregates.append(F.when(F.min(x) < F.max(x), F.lit(1.0)).alias(f"{x}~{x}"))
    cells = [
        F.struct(
            F.lit(x).alias("x"),
            F.lit(y).alias("y"),
            F.col(f"`{x}~{y}`" if cols.index(x) <= cols.index(y) else f"`{y}~{x}`").alias("r"),
        )
        for x in cols
        for y in cols
    ]
    return _long(data.agg(*aggregates), *cells)


def _per_column(df, cols, **aggregates):
    """One row per column: ``aggregates`` over its values, NULL and NaN skipped.

    The columns become (position, value) rows, so the aggregate stays small and
    compiled however wide the table is, and every task sends one row per column.
    """
    values = F.posexplode(F.array(*[no_nan(F.col(c)) for c in cols])).alias("_at", "_x")
    names = F.array(*[F.lit(c) for c in cols])
    return (
        df.select(values)
        .groupBy("_at")
        .agg(*[fn("_x").alias(n) for n, fn in aggregates.items()])
        .select(F.get(names, F.col("_at")).alias("column"), *aggregates)
    )


def column_profile(df, cols):
    """Minimum, maximum and mean per numeric column."""
    return _per_column(df, cols, min=F.min, max=F.max, mean=F.avg)


def _elements(df, c):
    if df.schema[c].dataType.typeName() == "array":
        return doubles(F.col(c))
    return F.array(F.col(c).cast("double"))


def invalid_audit(df, cols):
    """NaN and infinity counts per column; array columns count elements."""

    def tally(c, test):
        return F.sum(F.size(F.filter(_elements(df, c), test)))

    infinity = F.lit(float("inf"))
    row = df.agg(
        *[tally(c, F.isnan).alias(f"{c}~nan") for c in cols],
        *[tally(c, lambda x: F.abs(x) == infinity).alias(f"{c}~inf") for c in cols],
    )
    return _long(
        row,
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.coalesce(F.col(f"`{c}~nan`"), F.lit(0)).alias("nan_count"),
                F.coalesce(F.col(f"`{c}~inf`"), F.lit(0)).alias("inf_count"),
            )
            for c in cols
        ],
    )


def invalid_positions(df, key, col):
    """Key, element position and value of every NaN or infinity."""
    invalid = F.isnan("value") | (F.abs("value") == F.lit(float("inf")))
    return df.select(key, F.posexplode(_elements(df, col)).alias("pos", "value")).where(invalid)


def fit_standardizer(df, cols):
    """Mean and population standard deviation per column (0 becomes 1)."""
    fitted = _per_column(df, cols, mean=F.avg, std=F.stddev_pop)
    return fitted.select(
        "column",
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.coalesce(F.nullif("std", F.lit(0.0)), F.lit(1.0)).alias("std"),
    )


def _distinct_values(df, cols, order, order_col):
    """(column, value, seen): each value with what it is ordered by."""
    if order not in ("sorted", "first_seen"):
        raise ValueError(f"unknown dictionary order: {order}")

    def place(c):
        if order == "first_seen":
            return F.col(order_col)
        is_number = isinstance(df.schema[c].dataType, T.NumericType)
        return F.col(c).cast("double") if is_number else F.lit(0.0)

    entries = [
        F.struct(
            F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), place(c).alias("seen")
        )
        for c in cols
    ]
    return (
        df.select(F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.min("seen").alias("seen"))
    )


def _coded(distinct):
    """(column, value, code) with codes 0, 1, ... per column."""
    ranked = sorted_rank(distinct, ["column", "seen", "value"], "rank")
    starts = ranked.groupBy("column").agg(F.min("rank").alias("start"))
    return ranked.join(F.broadcast(starts), "column").select(
        "column", "value", (F.col("rank") - F.col("start")).cast("int").alias("code")
    )


def fit_dictionaries(df, cols, order="sorted", order_col=None):
    """Distinct values of several columns with codes 0, 1, ... per column.

    ``order`` is "sorted" (by value, numbers as numbers) or "first_seen" (by the
    smallest ``order_col``). One scan for all columns; only distinct values are
    sorted. Returns (column, value, code).
    """
    return _coded(_distinct_values(df, cols, order, order_col))


def extend_dictionaries(dictionary, df, cols, order="first_seen", order_col=None):
    """The dictionary with the values of a later delivery appended.

    Codes that were given stay; a value that is new to a column gets the next free
    code of that column, new values in the order of ``fit_dictionaries``. Only the
    distinct new values are sorted. The delivery may have columns that the dictionary
    does not know yet.
    """
    known = dictionary.select("column", "value")
    fresh = _distinct_values(df, cols, order, order_col).join(known, ["column", "value"], "left_anti")
    # A row a column.
    used = dictionary.groupBy("column").agg((F.max("code") + 1).alias("used"))
    added = _coded(fresh).join(F.broadcast(used), "column", "left")
    code = (F.col("code") + F.coalesce("used", F.lit(0))).cast("int").alias("code")
    return dictionary.select("column", "value", "code").union(added.select("column", "value", code))


def fit_dictionary(df, col, order="sorted", order_col=None):
    return fit_dictionaries(df, [col], order, order_col)
