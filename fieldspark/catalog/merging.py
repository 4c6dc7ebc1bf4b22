"""Enrichment, back-fill and keyed merges, and the whole combined table."""

import uuid

from pyspark.sql import functions as F

from fieldspark.catalog.base import (
    combined,
    expanded,
    inspections,
    query,
    weather_daily,
    weather_weekdays,
    with_views,
)
from fieldspark.operators import bucketed
from fieldspark.operators.merge import (
    append_missing,
    apply_dictionary,
    backfill_weather,
    dedup_last,
    enrich_weather,
    merge_insert_only,
)
from fieldspark.operators.stats import fit_dictionary, positive_days
from fieldspark.plans.combined import build_combined
from fieldspark.schema import COMBINED_COLUMNS, INSPECTION_COLUMNS, KEYS, WEATHER

COLUMNS = ", ".join(f'"{c}"' for c in COMBINED_COLUMNS)
RAW_COLUMNS = ", ".join(f'"{c}"' for c in INSPECTION_COLUMNS)


@query(
    "enrich_weather",
    with_views(
        "inspections weather_weekdays",
        """SELECT i.seq, i."SiteID", i."Date", w."Temperature", w."Precipitation", w."CloudCoverage"
        FROM inspections i LEFT JOIN weather_weekdays w USING ("Date")""",
    ),
)
def enrich(spark, sf_dir):
    rows = inspections(spark, sf_dir).select("seq", *KEYS)
    return enrich_weather(rows, weather_weekdays(spark, sf_dir))


BACKFILL = with_views(
    "combined weather_daily",
    """SELECT c.seq, c."SiteID", c."Date",
      CASE WHEN c."Temperature" IS NULL THEN w."Temperature" ELSE c."Temperature" END AS "Temperature",
      CASE WHEN c."Temperature" IS NULL THEN w."Precipitation" ELSE c."Precipitation" END AS "Precipitation",
      CASE WHEN c."Temperature" IS NULL THEN w."CloudCoverage" ELSE c."CloudCoverage" END AS "CloudCoverage"
    FROM combined c LEFT JOIN weather_daily w USING ("Date")""",
)


@query("backfill_weather", BACKFILL)
def backfill(spark, sf_dir):
    rows = combined(spark, sf_dir).select("seq", *KEYS, *WEATHER)
    return backfill_weather(rows, weather_daily(spark, sf_dir))


SIDES = """
    SELECT *, 0 AS side, -seq AS turn FROM expanded WHERE "MosquitoRank" = 'High'
    UNION ALL
    SELECT *, 1, seq FROM expanded WHERE "MosquitoRank" IS DISTINCT FROM 'High'"""


def _merged(order):
    return with_views(
        "expanded",
        f"""SELECT seq, is_recorded, {RAW_COLUMNS} FROM ({SIDES})
        QUALIFY row_number() OVER (PARTITION BY "SiteID", "Date" ORDER BY {order}) = 1""",
    )


def _merge(spark, sf_dir, policy):
    """Inspections ranked "High" are already in the table, the others arrive."""
    rows = expanded(spark, sf_dir)
    there = F.coalesce(F.col("MosquitoRank") == "High", F.lit(False))
    merged = merge_insert_only(rows.where(there), rows.where(~there), "seq", KEYS, policy)
    return merged.select("seq", "is_recorded", *INSPECTION_COLUMNS)


@query("merge_insert_only", _merged("is_recorded DESC, side, turn"))
def merge_prefer_recorded(spark, sf_dir):
    return _merge(spark, sf_dir, "prefer_recorded")


@query("merge_into_unique", _merged("is_recorded DESC, side, turn"))
def merge_into_unique(spark, sf_dir):
    """The existing side is merged first, so only its keys meet the new rows."""
    rows = expanded(spark, sf_dir)
    there = F.coalesce(F.col("MosquitoRank") == "High", F.lit(False))
    table = merge_insert_only(rows.where(there), rows.where(F.lit(False)), "seq")
    merged = merge_insert_only(table, rows.where(~there), "seq", existing_unique=True)
    return merged.select("seq", "is_recorded", *INSPECTION_COLUMNS)


@query("merge_into_bucketed", _merged("is_recorded DESC, side, turn"))
def merged_buckets(spark, sf_dir):
    """The existing side lies in buckets of its key and is not moved."""
    rows = expanded(spark, sf_dir)
    there = F.coalesce(F.col("MosquitoRank") == "High", F.lit(False))
    first = merge_insert_only(rows.where(there), rows.where(F.lit(False)), "seq")
    name = f"existing_{uuid.uuid4().hex}"
    bucketed.save_bucketed(first, name, buckets=8)
    merged = bucketed.merge_into_bucketed(spark, name, rows.where(~there), "seq")
    return bucketed.read_bucketed(spark, merged).select("seq", "is_recorded", *INSPECTION_COLUMNS)


@query("merge_insert_only_first", _merged("side, turn"))
def merge_first(spark, sf_dir):
    return _merge(spark, sf_dir, "first")


@query(
    "merge_append_missing",
    with_views(
        "inspections",
        f"""SELECT seq, {RAW_COLUMNS} FROM inspections i
        WHERE "MosquitoRank" IS DISTINCT FROM 'High' AND NOT EXISTS (SELECT 1 FROM inspections e
          WHERE e."MosquitoRank" = 'High' AND e."SiteID" = i."SiteID" AND e."Date" = i."Date")
        QUALIFY row_number() OVER (PARTITION BY "SiteID", "Date" ORDER BY seq) = 1""",
    ),
)
def merge_append(spark, sf_dir):
    rows = inspections(spark, sf_dir)
    there = F.coalesce(F.col("MosquitoRank") == "High", F.lit(False))
    return append_missing(rows.where(there), rows.where(~there), "seq").select("seq", *INSPECTION_COLUMNS)


@query(
    "dedup_last",
    with_views(
        "inspections",
        f"""SELECT seq, {RAW_COLUMNS} FROM inspections
        QUALIFY row_number() OVER (PARTITION BY "SiteID", "Date" ORDER BY seq DESC) = 1""",
    ),
)
def dedup(spark, sf_dir):
    return dedup_last(inspections(spark, sf_dir), KEYS, "seq").select("seq", *INSPECTION_COLUMNS)


@query(
    "apply_dictionary",
    with_views(
        "inspections",
        """SELECT seq, "Material", CAST(code AS INTEGER) AS code FROM inspections LEFT JOIN (
          SELECT "Material" AS m, row_number() OVER (ORDER BY "Material") - 1 AS code
          FROM (SELECT DISTINCT "Material" FROM inspections WHERE "Material" IS NOT NULL)) ON m = "Material" """,
    ),
)
def dictionary(spark, sf_dir):
    rows = inspections(spark, sf_dir).select("seq", "Material")
    return apply_dictionary(rows, fit_dictionary(rows, "Material"), "Material", "code")


@query(
    "build_combined",
    with_views("combined", f"SELECT seq, is_recorded, {COLUMNS} FROM combined"),
)
def build(spark, sf_dir):
    """Scan to finished table: expand, mask, merge by key, attach weather."""
    return combined(spark, sf_dir)


@query(
    "build_combined_first",
    with_views(
        "expanded weather_weekdays",
        f"""SELECT seq, is_recorded, {COLUMNS} FROM (SELECT * FROM expanded
          QUALIFY row_number() OVER (PARTITION BY "SiteID", "Date" ORDER BY seq) = 1)
        LEFT JOIN weather_weekdays USING ("Date")""",
    ),
)
def build_first(spark, sf_dir):
    return build_combined(
        inspections(spark, sf_dir), weather_weekdays(spark, sf_dir), "seq", policy="first"
    ).select("seq", "is_recorded", *COMBINED_COLUMNS)


@query(
    "flagship",
    with_views(
        "combined",
        """SELECT "SiteID", count(*) AS positive_days FROM combined WHERE "DipCount" > 0.1 GROUP BY 1""",
    ),
)
def flagship(spark, sf_dir):
    """Positive days per site over the finished combined table."""
    return positive_days(combined(spark, sf_dir))
