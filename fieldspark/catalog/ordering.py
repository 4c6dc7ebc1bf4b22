"""Sorts, limits, shuffles, splits, binning."""

from pyspark.sql import functions as F

from fieldspark.catalog.base import inspections, query, table, vectors, with_views
from fieldspark.operators import order


@query(
    "preview",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10""",
)
def preview(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    return order.preview(
        rows, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 10
    )


@query(
    "seeded_shuffle",
    """SELECT event_id, user_id, row_number() OVER (ORDER BY md5('7-' || event_id), event_id) - 1 AS place FROM events""",
)
def seeded_shuffle(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return order.seeded_shuffle(rows, "event_id", 7, "place")


@query(
    "hash_split",
    """SELECT event_id, CASE WHEN draw < 70 THEN 'train' WHEN draw < 85 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT event_id, CAST('0x' || substr(md5('42-' || event_id), 1, 8) AS BIGINT) % 100 AS draw FROM events)""",
)
def hash_split(spark, sf_dir):
    return order.hash_split(table(spark, sf_dir, "events").select("event_id"), "event_id")


@query(
    "argmax_class",
    with_views(
        "vectors",
        "SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS predicted FROM vectors",
    ),
)
def argmax_class(spark, sf_dir):
    return order.argmax_class(vectors(spark, sf_dir), "v").select("vec_id", "predicted")


@query(
    "scatter_pairs",
    with_views(
        "inspections",
        """SELECT "Wetness", "DipCount" FROM inspections WHERE "DipCount" IS NOT NULL AND "Wetness" IS NOT NULL""",
    ),
)
def scatter_pairs(spark, sf_dir):
    return order.scatter_pairs(inspections(spark, sf_dir), "Wetness", "DipCount")


@query(
    "scatter_bins",
    """SELECT CAST(least(floor((l_quantity - x_lo) / ((x_hi - x_lo) / 20)), 19) AS BIGINT) AS x_bin,
      CAST(least(floor((l_extendedprice - y_lo) / ((y_hi - y_lo) / 20)), 19) AS BIGINT) AS y_bin, count(*) AS n
    FROM lineitem, (SELECT min(l_quantity) AS x_lo, max(l_quantity) AS x_hi,
      min(l_extendedprice) AS y_lo, max(l_extendedprice) AS y_hi FROM lineitem) GROUP BY 1, 2""",
)
def scatter_bins(spark, sf_dir):
    return order.scatter_bins(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
