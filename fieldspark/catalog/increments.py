"""Incremental jobs over landed files."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.catalog.base import (
    combined,
    inspections,
    query,
    weather_daily,
    weather_weekdays,
    with_views,
)
from fieldspark.catalog.merging import BACKFILL
from fieldspark.schema import COMBINED_COLUMNS, KEYS, WEATHER
from fieldspark.storage import new_path
from fieldspark.streaming import incremental


def _open(schema):
    """The schema with every column optional, as files are read."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


@query("incremental_backfill", BACKFILL)
def incremental_backfill(spark, sf_dir):
    """Runs with no weather, weekday weather and all of it; each writes what it fills."""
    root = new_path(spark, "incremental-backfill")
    rows = combined(spark, sf_dir).select("seq", *KEYS, *WEATHER)
    schema = _open(rows.schema)
    rows.write.parquet(f"{root}/landing")
    daily = weather_daily(spark, sf_dir)
    for weather in (daily.where(F.lit(False)), weather_weekdays(spark, sf_dir), daily):
        stream = incremental.file_stream(spark, f"{root}/landing", schema)
        incremental.incremental_backfill(stream, weather, f"{root}/out", f"{root}/checkpoint")
    return incremental.read_backfilled(spark, f"{root}/out", daily.where(F.lit(False)), schema)


COLUMNS = ", ".join(f'"{c}"' for c in COMBINED_COLUMNS)


MERGED = with_views(
    "expanded weather_weekdays",
    f"""SELECT seq, is_recorded, {COLUMNS} FROM (SELECT * FROM expanded
      QUALIFY row_number() OVER (PARTITION BY "SiteID", "Date"
        ORDER BY is_recorded DESC, coalesce("MosquitoRank" = 'High', false) DESC,
          CASE WHEN coalesce("MosquitoRank" = 'High', false) THEN 0 ELSE seq % 2 END, seq) = 1)
    LEFT JOIN weather_weekdays USING ("Date")""",
)


def _deliveries(spark, sf_dir):
    """Inspections in three parts, in the order in which they land."""
    rows = inspections(spark, sf_dir)
    high = F.coalesce(F.col("MosquitoRank") == "High", F.lit(False))
    odd = F.col("seq") % 2 == 1
    return rows.where(high), rows.where(~high & ~odd), rows.where(~high & odd)


@query("incremental_merge", MERGED)
def incremental_merge(spark, sf_dir):
    """Inspections land in three deliveries, one run after each, compacted between."""
    root = new_path(spark, "incremental-merge")
    weather = weather_weekdays(spark, sf_dir)
    for i, delivery in enumerate(_deliveries(spark, sf_dir)):
        schema = _open(delivery.schema)
        expanded = incremental.merged_schema(schema)
        delivery.write.mode("append").parquet(f"{root}/landing")
        stream = incremental.file_stream(spark, f"{root}/landing", schema)
        incremental.incremental_merge(spark, stream, weather, root)
        if i == 1:
            incremental.compact_merged(spark, root, expanded)
            incremental.remove_compacted(spark, root)
    return incremental.read_merged(spark, root, expanded).select("seq", "is_recorded", *COMBINED_COLUMNS)


@query("keyed_merge", MERGED)
def keyed_merge(spark, sf_dir):
    """The same deliveries merged through state by site and date."""
    root = new_path(spark, "keyed-merge")
    weather = weather_weekdays(spark, sf_dir)
    for delivery in _deliveries(spark, sf_dir):
        schema = _open(delivery.schema)
        delivery.write.mode("append").parquet(f"{root}/landing")
        stream = incremental.file_stream(spark, f"{root}/landing", schema)
        incremental.keyed_merge(stream, weather, root)
    rows = incremental.read_keyed(spark, root, incremental.merged_schema(schema))
    return rows.select("seq", "is_recorded", *COMBINED_COLUMNS)
