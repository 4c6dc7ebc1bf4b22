"""Ordered series: arrays, kernels, pools, batches and exact splits."""

from pyspark.sql import functions as F

from fieldspark.catalog.base import (
    combined,
    inspections,
    query,
    r6,
    rounded,
    sql6,
    table,
    vectors,
    weather_weekdays,
    with_views,
)
from fieldspark.operators import sequence
from fieldspark.operators.calendar import lookback_expand
from fieldspark.operators.merge import enrich_weather
from fieldspark.schema import KEYS
from fieldspark.storage import cut_lineage

SEQUENCE_SQL = with_views(
    "expanded weather_weekdays",
    """SELECT seq, "SiteID", CAST(row_number() OVER (PARTITION BY seq ORDER BY "Date") - 1 AS INTEGER) AS pos,
      "Date", w."Temperature", w."Precipitation", w."CloudCoverage"
    FROM expanded LEFT JOIN weather_weekdays w USING ("Date")""",
)


def _days(df):
    return df.select("seq", "SiteID", F.posexplode("sequence").alias("pos", "_day")).select(
        "seq", "SiteID", "pos", "_day.*"
    )


@query("assemble_sequence", SEQUENCE_SQL)
def assemble_sequence(spark, sf_dir):
    rows = lookback_expand(inspections(spark, sf_dir).select("seq", *KEYS))
    known = enrich_weather(rows, weather_weekdays(spark, sf_dir))
    return _days(sequence.assemble_sequence(known, ["seq", "SiteID"]))


@query("attach_sequence", SEQUENCE_SQL)
def attach_sequence(spark, sf_dir):
    rows = inspections(spark, sf_dir).select("seq", *KEYS)
    return _days(sequence.attach_sequence(rows, weather_weekdays(spark, sf_dir)))


def _day(shift):
    return f"""max("Wetness") OVER (PARTITION BY "SiteID" ORDER BY "Date"
      RANGE BETWEEN INTERVAL {shift} DAY {"PRECEDING" if shift < 0 else "FOLLOWING"}
      AND INTERVAL {shift} DAY {"PRECEDING" if shift < 0 else "FOLLOWING"})""".replace("-", "")


BEFORE, AFTER = _day(-1), _day(1)


@query(
    "moving_kernel",
    with_views(
        "combined",
        f"""SELECT "SiteID", "Date", {sql6(f'0.25 * coalesce({BEFORE}, 0) + 0.5 * "Wetness" - 0.75 * coalesce({AFTER}, 0)')} AS kernel
        FROM combined""",
    ),
)
def moving_kernel(spark, sf_dir):
    rows = combined(spark, sf_dir).select(*KEYS, "Wetness")
    out = sequence.moving_kernel(rows, "SiteID", "Date", "Wetness", [0.25, 0.5, -0.75])
    return out.select(*KEYS, r6("kernel").alias("kernel"))


@query(
    "moving_kernel_valid_relu",
    with_views(
        "combined",
        f"""SELECT "SiteID", "Date", {sql6('greatest(before * 0.25 + "Wetness" * 0.5 - after * 0.75, 0.0)')} AS kernel
        FROM (SELECT "SiteID", "Date", "Wetness", {BEFORE} AS before, {AFTER} AS after FROM combined)
        WHERE before IS NOT NULL AND after IS NOT NULL""",
    ),
)
def moving_kernel_valid(spark, sf_dir):
    rows = combined(spark, sf_dir).select(*KEYS, "Wetness")
    out = sequence.moving_kernel(rows, "SiteID", "Date", "Wetness", [0.25, 0.5, -0.75], pad=False, relu=True)
    return out.select(*KEYS, r6("kernel").alias("kernel"))


REACH = 75


@query(
    "moving_kernel_wide",
    with_views(
        "combined",
        f"""SELECT "SiteID", "Date", {sql6(f'coalesce(sum("Wetness") OVER (PARTITION BY "SiteID" ORDER BY "Date" RANGE BETWEEN INTERVAL {REACH} DAY PRECEDING AND INTERVAL {REACH} DAY FOLLOWING), 0)')} AS kernel
        FROM combined""",
    ),
)
def moving_kernel_wide(spark, sf_dir):
    """A kernel that reaches over several chunks of days."""
    rows = combined(spark, sf_dir).select(*KEYS, "Wetness")
    out = sequence.moving_kernel(rows, "SiteID", "Date", "Wetness", [1.0] * (2 * REACH + 1))
    return out.select(*KEYS, r6("kernel").alias("kernel"))


@query(
    "convolve_sequence",
    with_views(
        "vectors",
        f"""SELECT vec_id, pos, {sql6("greatest(coalesce(v[pos], 0) * 0.25 + v[pos + 1] * 0.5 - coalesce(v[pos + 2], 0) * 0.75, 0.0)")} AS kernel
        FROM (SELECT vec_id, v, CAST(unnest(range(len(v))) AS INTEGER) AS pos FROM vectors)""",
    ),
)
def convolve_sequence(spark, sf_dir):
    out = sequence.convolve_sequence(vectors(spark, sf_dir), "v", [0.25, 0.5, -0.75], pad=1, relu=True)
    return rounded(out.select("vec_id", F.posexplode("kernel").alias("pos", "kernel")), "kernel")


def _pool_sql(how, tail=""):
    return with_views(
        "combined",
        f"""SELECT "SiteID", block, {sql6(how + '("Wetness")')} AS pooled FROM (
          SELECT "SiteID", "Wetness", CAST(floor((row_number() OVER (PARTITION BY "SiteID" ORDER BY "Date") - 1) / 3) AS BIGINT) AS block
          FROM combined) GROUP BY 1, 2 {tail}""",
    )


def _landed(spark, sf_dir, *cols):
    """The combined table written once, as a job that reads it twice expects."""
    return cut_lineage(combined(spark, sf_dir).select(*KEYS, *cols))


@query("pool_windows", _pool_sql("max", "HAVING count(*) = 3"))
def pool_max(spark, sf_dir):
    pooled = sequence.pool_windows(_landed(spark, sf_dir, "Wetness"), "SiteID", "Date", "Wetness", 3)
    return rounded(pooled, "pooled")


@query("pool_windows_mean", _pool_sql("avg"))
def pool_mean(spark, sf_dir):
    pooled = sequence.pool_windows(
        _landed(spark, sf_dir, "Wetness"), "SiteID", "Date", "Wetness", 3, "mean", keep_tail=True
    )
    return rounded(pooled, "pooled")


@query(
    "pool_windows_null_key",
    with_views(
        "combined",
        f"""SELECT site AS "SiteID", block, {sql6('max("Wetness")')} AS pooled FROM (
          SELECT site, "Wetness", CAST(floor((row_number() OVER (PARTITION BY site ORDER BY "Date") - 1) / 3) AS BIGINT) AS block
          FROM (SELECT CASE WHEN "SiteID" NOT IN (SELECT min("SiteID") FROM combined) THEN "SiteID" END AS site, "Date", "Wetness" FROM combined))
        GROUP BY 1, 2 HAVING count(*) = 3""",
    ),
)
def pool_null_key(spark, sf_dir):
    """The first site has no name: its blocks are there like all others."""
    rows = _landed(spark, sf_dir, "Wetness")
    first = rows.agg(F.min("SiteID")).first()[0]
    nameless = rows.withColumn("SiteID", F.when(F.col("SiteID") != first, F.col("SiteID")))
    return rounded(sequence.pool_windows(nameless, "SiteID", "Date", "Wetness", 3), "pooled")


@query(
    "global_mean_pool",
    with_views(
        "combined",
        f"""SELECT "SiteID", {sql6('avg("DipCount")')} AS mean FROM combined GROUP BY 1""",
    ),
)
def global_mean(spark, sf_dir):
    pooled = sequence.global_mean_pool(combined(spark, sf_dir), "SiteID", "DipCount")
    return rounded(pooled, "mean")


@query(
    "global_mean_pool_array",
    with_views("vectors", f"""SELECT vec_id, {sql6("list_avg(v)")} AS mean FROM vectors"""),
)
def global_mean_array(spark, sf_dir):
    return rounded(sequence.global_mean_pool(vectors(spark, sf_dir), "vec_id", "v"), "mean")


@query(
    "assign_batches",
    """SELECT o_orderkey, o_totalprice, batch FROM (
      SELECT o_orderkey, o_totalprice, CAST(floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) / 128) AS BIGINT) AS batch,
        count(*) OVER () AS n FROM orders) WHERE batch < floor(n / 128)""",
)
def assign_batches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sequence.assign_batches(orders, ["o_totalprice", "o_orderkey"], 128)


@query(
    "exact_split",
    """SELECT o_orderkey, CASE WHEN r < floor(n * 70 / 100) THEN 'train' WHEN r < floor(n * 85 / 100) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42-' || o_orderkey), o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)""",
)
def exact_split(spark, sf_dir):
    return sequence.exact_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
