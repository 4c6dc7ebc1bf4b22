"""Registry, and the views that stand in for inspections and weather.

The given tables hold no inspections, so both engines derive them from
``events``: a user is a site, an event an inspection, a view event an
inspection without action, an error event one without a count.
"""

from pyspark.sql import functions as F

from fieldspark.plans.combined import build_combined, expand_inspections
from fieldspark.schema import COMBINED_COLUMNS

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# Added before rounding so that an exact half does not sit on the boundary,
# where the last bit of a sum decides.
NUDGE = 1e-9


def r6(c):
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") + F.lit(NUDGE), 6)


def sql6(expression):
    return f"(round(CAST({expression} AS DOUBLE) + 1e-9, 6) + 0.0)"


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inspections(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    k = F.regexp_extract("props", "([0-9]+)", 1)

    def by_kind(pairs, otherwise=None):
        c = F
        for name, result in pairs.items():
            c = c.when(kind == name, result)
        return c.otherwise(otherwise)

    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("SiteID"),
        F.length(kind).cast("double").alias("WetlandType"),
        F.when(value >= 50, "High").when(value >= 10, "Medium").when(value >= 1, "Low").alias("MosquitoRank"),
        by_kind({"signup": "Yes", "click": "No"}).alias("CattailMosquito"),
        by_kind({"purchase": "Yes"}, "No").alias("CulexFound"),
        F.concat(F.lit("crew "), F.substring(k, 1, 1)).alias("TreatedBy"),
        F.col("ts").cast("date").alias("Date"),
        k.cast("double").alias("Wetness"),
        F.when(kind == "view", "none").otherwise(kind).alias("Action"),
        F.when(kind != "error", value).alias("DipCount"),
        by_kind({"purchase": "Bti", "click": "Methoprene"}).alias("Material"),
    )


def weather_daily(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("Date"), "value", "user_id")
    return e.groupBy("Date").agg(
        F.max("value").alias("Temperature"),
        F.min("value").alias("Precipitation"),
        F.count_distinct("user_id").cast("double").alias("CloudCoverage"),
    )


def weather_weekdays(spark, sf_dir):
    """What a station closed at weekends has reported."""
    return weather_daily(spark, sf_dir).where(F.weekday("Date") < 5)


def expanded(spark, sf_dir):
    return expand_inspections(inspections(spark, sf_dir))


def combined(spark, sf_dir):
    """Weather is missing at weekends and before the first event."""
    return build_combined(
        inspections(spark, sf_dir), weather_weekdays(spark, sf_dir), "seq"
    ).select("seq", "is_recorded", *COMBINED_COLUMNS)


def inspections_text(spark, sf_dir):
    """The same events as raw text with padding, blanks and bad values."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    k = F.regexp_extract("props", "([0-9]+)", 1)
    day = F.col("ts").cast("date")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit("\t")).alias("SiteID"),
        F.when((kind == "error") & (F.col("value") < 5), "unknown")
        .when(kind == "click", F.date_format(day, "M/d/yyyy"))
        .otherwise(F.date_format(day, "MM/dd/yyyy"))
        .alias("Date"),
        F.when(kind == "error", "")
        .when(kind == "view", " \t")
        .when(kind == "signup", "NA")
        .when(kind == "click", F.concat(k, F.lit("abc")))
        .otherwise(F.concat(F.lit(" "), k, F.lit(".5 ")))
        .alias("DipCount"),
        F.when(kind == "click", "  ").when(kind == "view", "").otherwise(k).alias("Temperature"),
        F.when(kind == "view", F.when(k < "5", "none").otherwise("NONE"))
        .when(kind == "click", "None")
        .when(kind == "signup", None)
        .otherwise(kind)
        .alias("Action"),
    )


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), "label"
    )


def broken_vectors(spark, sf_dir):
    """Vectors with NaN and infinities in place of some elements."""
    nan, inf = float("nan"), float("inf")
    return vectors(spark, sf_dir).withColumn(
        "v",
        F.transform(
            "v",
            lambda x: F.when(F.abs(x) < 0.01, F.lit(nan))
            .when(x > 0.25, F.lit(inf))
            .when(x < -0.25, F.lit(-inf))
            .otherwise(x),
        ),
    )


VIEWS = {
    "inspections": """
        SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS "SiteID",
          CAST(length(event_type) AS DOUBLE) AS "WetlandType",
          CASE WHEN value >= 50 THEN 'High' WHEN value >= 10 THEN 'Medium' WHEN value >= 1 THEN 'Low' END AS "MosquitoRank",
          CASE event_type WHEN 'signup' THEN 'Yes' WHEN 'click' THEN 'No' END AS "CattailMosquito",
          CASE event_type WHEN 'purchase' THEN 'Yes' ELSE 'No' END AS "CulexFound",
          'crew ' || substr(regexp_extract(props, '([0-9]+)', 1), 1, 1) AS "TreatedBy",
          CAST(ts AS DATE) AS "Date",
          CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS "Wetness",
          CASE event_type WHEN 'view' THEN 'none' ELSE event_type END AS "Action",
          CASE WHEN event_type <> 'error' THEN value END AS "DipCount",
          CASE event_type WHEN 'purchase' THEN 'Bti' WHEN 'click' THEN 'Methoprene' END AS "Material"
        FROM events""",
    "weather_daily": """
        SELECT CAST(ts AS DATE) AS "Date", max(value) AS "Temperature", min(value) AS "Precipitation",
          CAST(count(DISTINCT user_id) AS DOUBLE) AS "CloudCoverage"
        FROM events GROUP BY 1""",
    "weather_weekdays": """
        SELECT * FROM weather_daily WHERE isodow("Date") <= 5""",
    "expanded": """
        SELECT seq, "SiteID", "WetlandType", "MosquitoRank", "CattailMosquito", "CulexFound",
          CASE WHEN back = 0 THEN "TreatedBy" ELSE 'none' END AS "TreatedBy",
          CAST("Date" - back AS DATE) AS "Date",
          CASE WHEN back = 0 THEN "Wetness" ELSE -1 END AS "Wetness",
          CASE WHEN back = 0 THEN "Action" ELSE 'none' END AS "Action",
          CASE WHEN back = 0 THEN "DipCount" END AS "DipCount",
          CASE WHEN back = 0 THEN "Material" END AS "Material",
          "Date" AS inspected_on, back = 0 AS is_recorded
        FROM inspections, (SELECT unnest([0, 1, 2, 3, 4]) AS back)""",
    "merged": """
        SELECT * FROM expanded
        QUALIFY row_number() OVER (PARTITION BY "SiteID", "Date" ORDER BY is_recorded DESC, seq) = 1""",
    "combined": """
        SELECT m.*, w."Temperature", w."Precipitation", w."CloudCoverage"
        FROM merged m LEFT JOIN weather_weekdays w USING ("Date")""",
    "inspections_text": """
        SELECT event_id AS seq, '  ' || CAST(user_id AS VARCHAR) || chr(9) AS "SiteID",
          CASE WHEN event_type = 'error' AND value < 5 THEN 'unknown'
            WHEN event_type = 'click' THEN strftime(CAST(ts AS DATE), '%-m/%-d/%Y')
            ELSE strftime(CAST(ts AS DATE), '%m/%d/%Y') END AS "Date",
          CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN ' ' || chr(9) WHEN 'signup' THEN 'NA'
            WHEN 'click' THEN regexp_extract(props, '([0-9]+)', 1) || 'abc'
            ELSE ' ' || regexp_extract(props, '([0-9]+)', 1) || '.5 ' END AS "DipCount",
          CASE event_type WHEN 'click' THEN '  ' WHEN 'view' THEN ''
            ELSE regexp_extract(props, '([0-9]+)', 1) END AS "Temperature",
          CASE event_type WHEN 'view' THEN CASE WHEN regexp_extract(props, '([0-9]+)', 1) < '5' THEN 'none' ELSE 'NONE' END
            WHEN 'click' THEN 'None' WHEN 'signup' THEN NULL ELSE event_type END AS "Action"
        FROM events""",
    "vectors": """
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings""",
    "broken_vectors": """
        SELECT vec_id, label, list_transform(v, lambda x: CASE WHEN abs(x) < 0.01 THEN CAST('NaN' AS DOUBLE)
          WHEN x > 0.25 THEN CAST('Infinity' AS DOUBLE) WHEN x < -0.25 THEN CAST('-Infinity' AS DOUBLE) ELSE x END) AS v
        FROM vectors""",
}

NEEDS = {
    "weather_weekdays": ["weather_daily"],
    "expanded": ["inspections"],
    "merged": ["expanded"],
    "combined": ["merged", "weather_weekdays"],
    "broken_vectors": ["vectors"],
}


def with_views(names, body, **more):
    """``body`` with the named views, those they need, and ``more`` in front."""
    ordered = []

    def add(name):
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    texts = {n: VIEWS[n] for n in ordered} | more
    views = ",\n".join(f"{n} AS ({text})" for n, text in texts.items())
    return f"WITH {views}\n{body}"
