"""Projections, cleaning, filters, dates and row generators."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.catalog.base import (
    combined,
    inspections,
    inspections_text,
    query,
    table,
    weather_weekdays,
    with_views,
)
from fieldspark.operators import calendar, clean
from fieldspark.schema import KEYS, NA_TOKENS, SITE_NUMBERS, WEATHER

TRIMMED = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"


def _trimmed(c):
    return TRIMMED.format(f'"{c}"')


@query(
    "blank_to_null",
    with_views(
        "inspections_text",
        f"""
        SELECT seq, nullif({_trimmed("SiteID")}, '') AS "SiteID",
          CASE WHEN {_trimmed("DipCount")} IN ('', 'NA') THEN NULL ELSE {_trimmed("DipCount")} END AS "DipCount",
          nullif({_trimmed("Temperature")}, '') AS "Temperature",
          nullif("Action", 'None') AS "Action"
        FROM inspections_text""",
    ),
)
def blank_to_null(spark, sf_dir):
    cols = ["SiteID", "DipCount", "Temperature", "Action"]
    return clean.blank_to_null(inspections_text(spark, sf_dir), cols, NA_TOKENS).select("seq", *cols)


NUMBER = f"""coalesce(try_cast({_trimmed("DipCount")} AS DOUBLE), 0.0)"""


@query(
    "to_number_or_default",
    with_views(
        "inspections_text",
        f"""SELECT seq, CASE WHEN "DipCount" LIKE '%abc' THEN 0.0 ELSE {NUMBER} END AS "DipCount"
        FROM inspections_text""",
    ),
)
def to_number(spark, sf_dir):
    return clean.to_number(inspections_text(spark, sf_dir), ["DipCount"]).select("seq", "DipCount")


@query(
    "to_number_prefix",
    with_views(
        "inspections_text",
        f"""SELECT seq, CASE WHEN "DipCount" LIKE '%abc'
          THEN CAST(replace("DipCount", 'abc', '') AS DOUBLE) ELSE {NUMBER} END AS "DipCount"
        FROM inspections_text""",
    ),
)
def to_number_prefix(spark, sf_dir):
    text = inspections_text(spark, sf_dir)
    return clean.to_number(text, ["DipCount"], prefix=True).select("seq", "DipCount")


@query(
    "fill_category",
    with_views(
        "inspections",
        """SELECT seq, coalesce("MosquitoRank", 'Missing') AS "MosquitoRank",
          coalesce("CattailMosquito", 'Missing') AS "CattailMosquito",
          coalesce("Material", 'Missing') AS "Material" FROM inspections""",
    ),
)
def fill_category(spark, sf_dir):
    cols = ["MosquitoRank", "CattailMosquito", "Material"]
    return clean.fill_category(inspections(spark, sf_dir), cols).select("seq", *cols)


@query(
    "fill_numeric",
    with_views(
        "combined",
        """SELECT "SiteID", "Date", coalesce("DipCount", 0) AS "DipCount",
          coalesce("Temperature", 0) AS "Temperature" FROM combined""",
    ),
)
def fill_numeric(spark, sf_dir):
    filled = clean.fill_numeric(combined(spark, sf_dir), ["DipCount", "Temperature", "NotThere"])
    return filled.select(*KEYS, "DipCount", "Temperature")


@query(
    "conform",
    with_views(
        "inspections",
        """SELECT "Wetness", seq, "Action" AS "Deed", CAST(NULL AS DOUBLE) AS "Temperature",
          'unknown' AS "Inspector" FROM inspections""",
    ),
)
def conform(spark, sf_dir):
    wanted = (
        T.StructType()
        .add("Wetness", "double")
        .add("seq", "long")
        .add("Deed", "string")
        .add("Temperature", "double")
        .add("Inspector", "string")
    )
    return clean.conform(
        inspections(spark, sf_dir),
        wanted,
        required=["seq", "Wetness"],
        defaults={"Inspector": "unknown"},
        renames={"Action": "Deed"},
    )


@query("check_label_range", "SELECT vec_id, label FROM embeddings WHERE label NOT BETWEEN 0 AND 6")
def check_label_range(spark, sf_dir):
    return clean.check_range(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 7)


@query(
    "drop_excess",
    with_views(
        "inspections_text",
        f"""SELECT seq, "Temperature", "Action" FROM inspections_text
        WHERE NOT ({_trimmed("Temperature")} = '' AND lower(coalesce("Action", '')) = 'none')""",
    ),
)
def drop_excess(spark, sf_dir):
    rows = inspections_text(spark, sf_dir).select("seq", "Temperature", "Action")
    return clean.drop_excess(rows)


@query(
    "filter_report",
    with_views(
        "inspections_text",
        f"""SELECT count(*) AS "before", count(*) FILTER (WHERE keep) AS "after",
          count(*) FILTER (WHERE NOT keep) AS removed
        FROM (SELECT NOT ({_trimmed("Temperature")} = '' AND lower(coalesce("Action", '')) = 'none') AS keep
          FROM inspections_text)""",
    ),
)
def filter_report(spark, sf_dir):
    return clean.filter_report(inspections_text(spark, sf_dir), ~clean.is_excess())


@query(
    "recorded_only",
    with_views(
        "inspections_text",
        """SELECT seq, "Action" FROM inspections_text WHERE "Action" IS DISTINCT FROM 'none'""",
    ),
)
def recorded_only(spark, sf_dir):
    return clean.recorded_only(inspections_text(spark, sf_dir).select("seq", "Action"))


@query(
    "threshold_label",
    with_views(
        "inspections",
        """SELECT seq, CASE WHEN "DipCount" > 0.1 THEN 1 ELSE 0 END AS "Breeding" FROM inspections""",
    ),
)
def threshold_label(spark, sf_dir):
    return clean.threshold_label(inspections(spark, sf_dir)).select("seq", "Breeding")


@query(
    "mask_synthetic",
    with_views(
        "inspections",
        """SELECT seq, "SiteID", CASE WHEN rec THEN "TreatedBy" ELSE 'none' END AS "TreatedBy",
          CASE WHEN rec THEN "Action" ELSE 'none' END AS "Action",
          CASE WHEN rec THEN "Wetness" ELSE -1 END AS "Wetness",
          CASE WHEN rec THEN "DipCount" END AS "DipCount", CASE WHEN rec THEN "Material" END AS "Material"
        FROM (SELECT *, "Wetness" > 50 AS rec FROM inspections)""",
    ),
)
def mask_synthetic(spark, sf_dir):
    rows = inspections(spark, sf_dir).withColumn("is_recorded", F.col("Wetness") > 50)
    return clean.mask_synthetic(rows).select(
        "seq", "SiteID", "TreatedBy", "Action", "Wetness", "DipCount", "Material"
    )


@query(
    "split_features",
    with_views(
        "combined",
        """SELECT "SiteID", "Date", 'weather' AS family, unnest(['Temperature', 'Precipitation', 'CloudCoverage']) AS name,
          unnest(["Temperature", "Precipitation", "CloudCoverage"]) AS value FROM combined
        UNION ALL
        SELECT "SiteID", "Date", 'site', unnest(['WetlandType', 'Wetness', 'DipCount']),
          unnest(["WetlandType", "Wetness", "DipCount"]) FROM combined""",
    ),
)
def split_features(spark, sf_dir):
    """Both families in long form."""
    rows = combined(spark, sf_dir).select(*KEYS, *SITE_NUMBERS, *WEATHER)
    weather, site = clean.split_features(rows, exclude=KEYS)
    cells = [
        F.struct(F.lit(family).alias("family"), F.lit(c).alias("name"), F.col(c).alias("value"))
        for family, cols in (("weather", weather), ("site", site))
        for c in cols
    ]
    return rows.select(*KEYS, F.inline(F.array(*cells)))


PARSED = """CASE WHEN "Date" <> 'unknown' THEN CAST(strptime("Date", '%m/%d/%Y') AS DATE) END"""


@query(
    "parse_us_date",
    with_views("inspections_text", f"""SELECT * FROM (SELECT seq, {PARSED} AS "Date" FROM inspections_text) WHERE "Date" IS NOT NULL"""),
)
def parse_us_date(spark, sf_dir):
    return calendar.parse_us_date(inspections_text(spark, sf_dir).select("seq", "Date"))


@query(
    "format_date",
    with_views(
        "inspections_text",
        f"""SELECT seq, coalesce(strftime({PARSED}, '%Y-%m-%d'), "Date") AS iso,
          coalesce(strftime({PARSED}, '%m/%d/%Y'), "Date") AS us FROM inspections_text""",
    ),
)
def format_date(spark, sf_dir):
    rows = inspections_text(spark, sf_dir).select("seq", F.col("Date").alias("raw"), "Date")
    parsed = calendar.parse_us_date(rows, on_error="keep").withColumns(
        {"iso": F.col("Date"), "us": F.col("Date")}
    )
    iso = calendar.format_date(parsed, "iso", "iso", "raw")
    return calendar.format_date(iso, "us", "us", "raw").select("seq", "iso", "us")


@query(
    "date_ordinal",
    with_views(
        "inspections_text",
        f"""SELECT seq, coalesce(CAST({PARSED} - DATE '1970-01-01' AS INTEGER) + 719163, 0) AS "DateOrdinal"
        FROM inspections_text""",
    ),
)
def date_ordinal(spark, sf_dir):
    rows = calendar.parse_us_date(inspections_text(spark, sf_dir), on_error="keep")
    return calendar.date_ordinal(rows).select("seq", "DateOrdinal")


@query(
    "date_parts",
    with_views(
        "inspections_text",
        f"""SELECT seq, CAST(coalesce(month(d), 0) AS INTEGER) AS "Month", CAST(coalesce(day(d), 0) AS INTEGER) AS "Day",
          CAST(coalesce(year(d), 0) AS INTEGER) AS "Year" FROM (SELECT seq, {PARSED} AS d FROM inspections_text)""",
    ),
)
def date_parts(spark, sf_dir):
    rows = calendar.parse_us_date(inspections_text(spark, sf_dir), on_error="keep")
    return calendar.date_parts(rows).select("seq", "Month", "Day", "Year")


@query(
    "shift_days",
    with_views("inspections", """SELECT seq, CAST("Date" - 4 AS DATE) AS earlier FROM inspections"""),
)
def shift_days(spark, sf_dir):
    return calendar.shift_days(inspections(spark, sf_dir), "Date", 4, "earlier").select("seq", "earlier")


@query(
    "lookback_expand",
    with_views(
        "inspections",
        """SELECT seq, "SiteID", CAST(unnest(generate_series("Date" - 4, "Date", INTERVAL 1 DAY)) AS DATE) AS "Date",
          "Date" AS inspected_on,
          unnest([false, false, false, false, true]) AS is_recorded FROM inspections""",
    ),
)
def lookback_expand(spark, sf_dir):
    rows = inspections(spark, sf_dir).select("seq", "SiteID", "Date")
    return calendar.lookback_expand(rows)


@query(
    "missing_weather_dates",
    with_views(
        "expanded weather_weekdays",
        """SELECT DISTINCT "Date" FROM expanded WHERE "Date" NOT IN (SELECT "Date" FROM weather_weekdays)""",
    ),
)
def missing_weather_dates(spark, sf_dir):
    rows = calendar.lookback_expand(inspections(spark, sf_dir).select("Date"))
    return calendar.missing_weather_dates(rows, weather_weekdays(spark, sf_dir))
