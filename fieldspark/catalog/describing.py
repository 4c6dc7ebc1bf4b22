"""Aggregates and descriptive statistics."""

from pyspark.sql import functions as F

from fieldspark.catalog.base import (
    broken_vectors,
    combined,
    inspections,
    query,
    rounded,
    sql6,
    table,
    vectors,
    with_views,
)
from fieldspark.functions.vectors import softmax
from fieldspark.operators import evaluate, stats
from fieldspark.operators.boxplot import boxplot_stats
from fieldspark.operators.features import log1p_col
from fieldspark.operators.order import argmax_class, hash_split
from fieldspark.operators.sequence import time_series
from fieldspark.storage import cut_lineage


@query(
    "positive_days_per_site",
    with_views(
        "inspections",
        """SELECT "SiteID", count(*) AS positive_days FROM inspections WHERE "DipCount" > 0.1 GROUP BY 1""",
    ),
)
def positive_days(spark, sf_dir):
    return stats.positive_days(inspections(spark, sf_dir))


CORRELATED = ["Temperature", "Precipitation", "CloudCoverage", "LogDipCount"]


def _corr_sql():
    pairs = " UNION ALL ".join(
        f"""SELECT '{x}' AS x, '{y}' AS y, CASE WHEN isnan(r) THEN NULL ELSE {sql6("r")} END AS r
        FROM (SELECT corr("{x}", "{y}") AS r FROM d)"""
        for x in CORRELATED
        for y in CORRELATED
    )
    return with_views("combined", pairs, d='SELECT *, ln(1 + "DipCount") AS "LogDipCount" FROM combined')


@query("correlation_matrix", _corr_sql())
def correlation_matrix(spark, sf_dir):
    rows = log1p_col(combined(spark, sf_dir), "DipCount")
    return rounded(stats.correlation_matrix(rows, CORRELATED), "r")


def _box_sql(source, col, key=None):
    group = f'GROUP BY "{key}"' if key else ""
    pick = f'"{key}", ' if key else ""
    on = f'ON d."{key}" IS NOT DISTINCT FROM q."{key}"' if key else "ON true"
    by = f'd."{key}", ' if key else ""
    quartiles = f"""
        SELECT {pick}count(*) AS n, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median,
          quantile_cont({col}, 0.75) AS q3 FROM {source} WHERE {col} IS NOT NULL {group}"""
    body = f"""
        SELECT {by}q.n, {sql6("q1")} AS q1, {sql6("median")} AS median, {sql6("q3")} AS q3,
          min({col}) FILTER (WHERE {col} >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
          max({col}) FILTER (WHERE {col} <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
          count(*) FILTER (WHERE {col} < q1 - 1.5 * (q3 - q1) OR {col} > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM {source} d JOIN q {on} WHERE {col} IS NOT NULL GROUP BY {by}q.n, q1, median, q3"""
    return with_views(source, body, q=quartiles)


@query("boxplot_stats", _box_sql("inspections", '"DipCount"'))
def boxplot(spark, sf_dir):
    return rounded(boxplot_stats(inspections(spark, sf_dir), "DipCount"), "q1", "median", "q3")


@query("boxplot_stats_per_site", _box_sql("inspections", '"DipCount"', "SiteID"))
def boxplot_per_site(spark, sf_dir):
    rows = inspections(spark, sf_dir)
    return rounded(boxplot_stats(rows, "DipCount", "SiteID"), "q1", "median", "q3")


MEASURED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "fit_standardizer",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {sql6(f"avg({c})")} AS mean, {sql6(f"stddev_pop({c})")} AS std FROM lineitem"""
        for c in MEASURED
    ),
)
def fit_standardizer(spark, sf_dir):
    return rounded(stats.fit_standardizer(table(spark, sf_dir, "lineitem"), MEASURED), "mean", "std")


CODED = ["MosquitoRank", "TreatedBy", "Action", "SiteID"]


def _dictionary_sql(order):
    union = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", "{c}" AS value, CAST(row_number() OVER (ORDER BY {order.format(c)}) - 1 AS INTEGER) AS code
        FROM (SELECT "{c}", min(seq) AS seen FROM inspections WHERE "{c}" IS NOT NULL GROUP BY 1)"""
        for c in CODED
    )
    return with_views("inspections", union)


@query("fit_dictionary", _dictionary_sql('"{}"'))
def fit_dictionary(spark, sf_dir):
    return stats.fit_dictionaries(inspections(spark, sf_dir), CODED)


@query("fit_dictionary_first_seen", _dictionary_sql("seen"))
def fit_dictionary_first_seen(spark, sf_dir):
    return stats.fit_dictionaries(inspections(spark, sf_dir), CODED, "first_seen", "seq")


def _extended_sql():
    union = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", "{c}" AS value, CAST(row_number() OVER (ORDER BY late, seen) - 1 AS INTEGER) AS code
        FROM (SELECT "{c}", min(seq % 3) AS late,
                min_by(seq, [seq % 3, seq]) AS seen
              FROM inspections WHERE "{c}" IS NOT NULL GROUP BY 1)"""
        for c in CODED
    )
    return with_views("inspections", union)


@query("extend_dictionaries", _extended_sql())
def extend_dictionaries(spark, sf_dir):
    """Three deliveries one after the other; values keep the codes they were given."""
    rows = inspections(spark, sf_dir)
    part = lambda i: rows.where(F.col("seq") % 3 == i)
    dictionary = stats.fit_dictionaries(part(0), CODED, "first_seen", "seq")
    for i in (1, 2):
        dictionary = stats.extend_dictionaries(cut_lineage(dictionary), part(i), CODED, order_col="seq")
    return dictionary


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", min({c}) AS "min", max({c}) AS "max", {sql6(f"avg({c})")} AS mean FROM lineitem"""
        for c in MEASURED
    ),
)
def column_profile(spark, sf_dir):
    return rounded(stats.column_profile(table(spark, sf_dir, "lineitem"), MEASURED), "mean")


@query(
    "invalid_audit",
    with_views(
        "broken_vectors",
        """SELECT 'v' AS "column", count(*) FILTER (WHERE isnan(x)) AS nan_count,
          count(*) FILTER (WHERE isinf(x)) AS inf_count FROM (SELECT unnest(v) AS x FROM broken_vectors)
        UNION ALL
        SELECT 'head', count(*) FILTER (WHERE isnan(v[1])), count(*) FILTER (WHERE isinf(v[1])) FROM broken_vectors""",
    ),
)
def invalid_audit(spark, sf_dir):
    rows = broken_vectors(spark, sf_dir).withColumn("head", F.get("v", F.lit(0)))
    return stats.invalid_audit(rows, ["v", "head"])


@query(
    "invalid_positions",
    with_views(
        "broken_vectors",
        """SELECT vec_id, pos, CASE WHEN isnan(x) THEN 'NaN' WHEN x > 0 THEN 'Infinity' ELSE '-Infinity' END AS found
        FROM (SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS x FROM broken_vectors)
        WHERE isnan(x) OR isinf(x)""",
    ),
)
def invalid_positions(spark, sf_dir):
    found = stats.invalid_positions(broken_vectors(spark, sf_dir), "vec_id", "v")
    return found.select("vec_id", "pos", F.col("value").cast("string").alias("found"))


def _scored(spark, sf_dir):
    """Ten class scores per vector: the mean of the elements at positions that leave
    the class as remainder by ten, as probabilities; every eleventh label is missing."""
    classes = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda c: F.aggregate(
            F.filter("v", lambda x, i: i % 10 == c), F.lit(0.0), lambda a, x: a + x
        )
        / F.size(F.filter("v", lambda x, i: i % 10 == c)),
    )
    rows = vectors(spark, sf_dir).withColumn("scores", classes)
    rows = rows.withColumn("probability", softmax(F.col("scores")))
    label = F.when(F.col("vec_id") % 11 != 0, F.col("label"))
    return argmax_class(rows, "probability").withColumn("label", label)


SCORED = """
        SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN label END AS label,
          list_transform(s, lambda x: exp(x) / list_sum(list_transform(s, lambda y: exp(y)))) AS probability,
          list_position(s, list_max(s)) - 1 AS predicted
        FROM (SELECT vec_id, label, list_transform(range(10),
          lambda c: list_avg(list_filter(v, lambda x, i: (i - 1) % 10 = c))) AS s FROM vectors)"""


def _scored_sql(body):
    return with_views("vectors", body, scored=SCORED)


@query("accuracy", _scored_sql(f"""
        SELECT count(*) AS n, {sql6("avg(CASE WHEN predicted = label THEN 1 ELSE 0 END)")} AS accuracy FROM scored"""))
def accuracy(spark, sf_dir):
    return rounded(evaluate.accuracy(_scored(spark, sf_dir)), "accuracy")


@query("log_loss", _scored_sql(f"""
        SELECT count(*) AS n, count(label) AS n_scored, {sql6("avg(CASE WHEN label IS NOT NULL THEN -ln(greatest(probability[label + 1], 1e-8)) END)")} AS log_loss FROM scored"""))
def log_loss(spark, sf_dir):
    return rounded(evaluate.log_loss(_scored(spark, sf_dir)), "log_loss")


@query("log_loss_plus_epsilon", _scored_sql(f"""
        SELECT count(*) AS n, count(label) AS n_scored, {sql6("avg(-ln(probability[label + 1] + 1e-8))")} AS log_loss FROM scored"""))
def log_loss_plus_epsilon(spark, sf_dir):
    return rounded(evaluate.log_loss(_scored(spark, sf_dir), plus_epsilon=True), "log_loss")


@query(
    "batch_rollup",
    f"""SELECT CAST(o_orderdate AS DATE) AS epoch, o_orderpriority AS batch,
      {sql6("avg(o_totalprice)")} AS mean_o_totalprice FROM orders GROUP BY 1, 2""",
)
def batch_rollup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("epoch"), F.col("o_orderpriority").alias("batch"), "o_totalprice"
    )
    return rounded(evaluate.batch_rollup(orders, ["epoch", "batch"], "o_totalprice"), "mean_o_totalprice")


SPLIT = """CASE WHEN CAST('0x' || substr(md5('42-' || vec_id), 1, 8) AS BIGINT) % 100 < 70 THEN 'train'
  WHEN CAST('0x' || substr(md5('42-' || vec_id), 1, 8) AS BIGINT) % 100 < 85 THEN 'validation' ELSE 'test' END"""


@query("evaluate", _scored_sql(f"""
        SELECT {SPLIT} AS split, count(*) AS n, count(label) AS n_scored, {sql6("avg(CASE WHEN label IS NOT NULL THEN -ln(greatest(probability[label + 1], 1e-8)) END)")} AS loss,
          {sql6("avg(CASE WHEN predicted = label THEN 1 ELSE 0 END)")} AS accuracy FROM scored GROUP BY 1"""))
def evaluation(spark, sf_dir):
    rows = hash_split(_scored(spark, sf_dir), "vec_id")
    return rounded(evaluate.evaluate(rows), "loss", "accuracy")


@query(
    "time_series",
    with_views(
        "inspections",
        f"""SELECT "Date", count("DipCount") AS n, {sql6('avg(ln(1 + "DipCount"))')} AS mean,
          {sql6('max(ln(1 + "DipCount"))')} AS "max" FROM inspections GROUP BY 1""",
    ),
)
def series(spark, sf_dir):
    rows = log1p_col(inspections(spark, sf_dir), "DipCount")
    return rounded(time_series(rows, "Date", "LogDipCount"), "mean", "max").orderBy("Date")
