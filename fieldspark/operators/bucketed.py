"""A merged table kept in buckets of its key, so that a delivery of any size is merged
without moving the rows that are there."""

import uuid

from pyspark.sql import functions as F

from fieldspark.operators.merge import merge_insert_only
from fieldspark.schema import KEYS
from fieldspark.storage import cut_lineage, new_path

# The key as one text that is never null, so that missing keys meet as well.
KEY = "_key"
BUCKETS = 64


def key_text(keys=KEYS):
    return F.to_json(F.struct(*keys))


def bucket_count(spark, table):
    """The number of buckets that a table was written with."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def save_bucketed(rows, table, keys=KEYS, buckets=BUCKETS, path=None):
    """Write rows, one a key, as a table of buckets of the key. A key is a row, so
    buckets are even; choose their number so that one fits a task."""
    spark = rows.sparkSession
    keyed = rows if KEY in rows.columns else rows.withColumn(KEY, key_text(keys))
    _save(keyed.repartition(buckets, KEY), table, buckets, path or new_path(spark, "bucketed"))
    return spark.table(table)


def _save(rows, table, buckets, path):
    rows.write.format("parquet").option("path", path).bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(table)


def merge_sides(existing, new, buckets, order_col, keys=KEYS, policy="prefer_recorded", is_recorded="is_recorded"):
    """The existing rows that stay and the new rows that win, as two tables.

    Only the new rows are shuffled: they are cut to one a key and dealt out as the
    buckets are; each bucket of the existing side meets them where it is read.
    """
    recorded = F.coalesce(F.col(is_recorded), F.lit(False))
    first = merge_insert_only(None, new, order_col, keys, policy, is_recorded).withColumn(KEY, key_text(keys))
    first = cut_lineage(first.repartition(buckets, KEY))
    known = existing.select(KEY, recorded.alias("_known"))
    # A checkpoint does not remember how its rows lie; the new side alone is dealt again.
    met = first.hint("merge").join(known, KEY, "left")
    wins = F.col("_known").isNull()
    if policy == "prefer_recorded":
        wins = wins | (recorded & ~F.col("_known"))
    added = cut_lineage(met.where(wins).drop("_known"))
    if policy == "prefer_recorded":
        beaten = added.where(recorded).select(KEY)
        existing = existing.hint("merge").join(beaten, KEY, "left_anti")
    return existing, added


def merge_into_bucketed(spark, table, new, order_col, keys=KEYS, policy="prefer_recorded", is_recorded="is_recorded", out=None):
    """Merge new rows into a table from ``save_bucketed`` and return the name of the
    table that holds the result, in as many buckets.

    Same rules as ``merge_insert_only`` with one row a key on the existing side. The
    input table is not changed; ``out`` names the result.
    """
    buckets, existing = bucket_count(spark, table), spark.table(table)
    stay, added = merge_sides(existing, new, buckets, order_col, keys, policy, is_recorded)
    out = out or f"merged_{uuid.uuid4().hex}"
    path = new_path(spark, "bucketed")
    names = [c for c in existing.columns if c != KEY]
    names += [c for c in added.columns if c not in existing.columns]
    both = stay.unionByName(added.repartition(buckets, KEY), allowMissingColumns=True)
    _save(both.select(KEY, *names), out, buckets, path)
    return out


def read_bucketed(spark, table):
    return spark.table(table).drop(KEY)
