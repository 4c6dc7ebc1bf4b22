"""Sources and sinks: derived tables are written, then read back as landed files."""

from pyspark.sql import functions as F

from fieldspark.catalog.base import (
    inspections,
    query,
    rounded,
    sql6,
    table,
    weather_daily,
    with_views,
)
from fieldspark.operators import calendar, clean
from fieldspark.schema import INSPECTION_COLUMNS, INSPECTION_TEXT, SITE_NUMBERS, text_schema
from fieldspark.sources.readers import (
    read_inspections,
    read_positional,
    read_run_log,
    read_weather_json,
)
from fieldspark.sources.writers import write_table
from fieldspark.storage import new_path

TYPED = """
SELECT seq, "SiteID", "WetlandType", "MosquitoRank", "CattailMosquito", "CulexFound", "TreatedBy",
  "Date", "Wetness", "Action", "DipCount", "Material"
FROM inspections"""


def _typed(landed):
    numbers = clean.blank_to_null(landed)
    for c in SITE_NUMBERS:
        numbers = numbers.withColumn(c, F.col(c).try_cast("double"))
    return calendar.parse_us_date(numbers, "Date", "drop").select(
        F.col("seq").try_cast("bigint").alias("seq"), *INSPECTION_COLUMNS
    )


@query("read_inspections", with_views("inspections", TYPED))
def landed_inspections(spark, sf_dir):
    """Write as CSV, columns in another order, and read back by name."""
    path = new_path(spark, "inspections-csv")
    columns = ["DipCount", "seq", *[c for c in INSPECTION_COLUMNS if c != "DipCount"]]
    write_table(inspections(spark, sf_dir).select(*columns), path, "csv")
    schema = text_schema(["seq", *INSPECTION_TEXT.names])
    landed = read_inspections(spark, path, schema)
    return _typed(landed.where(F.col("_bad_record").isNull()))


@query("read_positional", with_views("inspections", TYPED))
def landed_positional(spark, sf_dir):
    """Header names are ignored; the file has one column more than is asked for."""
    path = new_path(spark, "inspections-positional")
    source = inspections(spark, sf_dir).select("seq", *INSPECTION_COLUMNS)
    renamed = source.toDF(*[f"c{i}" for i in range(len(source.columns))])
    write_table(renamed.withColumn("extra", F.lit("x")), path, "csv")
    return _typed(read_positional(spark, path, ["seq", *INSPECTION_COLUMNS]))


@query(
    "csv_dialect",
    """
    SELECT doc_id, text, lang, source FROM documents""",
)
def csv_dialect(spark, sf_dir):
    """Whole texts through a semicolon file with quoted line breaks."""
    path = new_path(spark, "documents-csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    docs.write.options(
        header=True, sep=";", quote="'", escape="'", quoteAll=True, emptyValue="", lineSep="\n",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    back = read_inspections(
        spark,
        path,
        text_schema(docs.columns),
        {"separator": ";", "quote": "'", "quoted_line_breaks": True, "line_separator": "\n"},
    )
    return back.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), "text", "lang", "source")


@query("write_table", with_views("inspections", TYPED))
def written(spark, sf_dir):
    path = new_path(spark, "inspections-orc")
    source = inspections(spark, sf_dir)
    write_table(source, path, "orc", partition_by=["Action"])
    return spark.read.schema(source.schema).orc(path).select("seq", *INSPECTION_COLUMNS)


@query(
    "read_weather_json",
    with_views(
        "weather_daily",
        """
        SELECT "Date", CASE WHEN isodow("Date") < 7 THEN "Temperature" END AS "Temperature",
          CASE WHEN isodow("Date") < 7 THEN "Precipitation" END AS "Precipitation",
          CASE WHEN isodow("Date") < 6 THEN "CloudCoverage" END AS "CloudCoverage"
        FROM weather_daily""",
    ),
)
def landed_weather(spark, sf_dir):
    """Payloads with an empty weather list on Sundays and no hourly part on Saturdays."""
    path = new_path(spark, "weather-json")
    hourly = F.array(F.struct(F.col("CloudCoverage").cast("string").alias("cloudcover")))
    day = F.struct(
        F.col("Temperature").cast("string").alias("avgtempC"),
        F.col("Precipitation").cast("string").alias("precipMM"),
        F.when(F.weekday("Date") < 5, hourly).alias("hourly"),
    )
    days = F.when(F.weekday("Date") < 6, F.array(day)).otherwise(F.array())
    payloads = weather_daily(spark, sf_dir).select(
        F.date_format("Date", "yyyy-MM-dd").alias("date"), F.struct(days.alias("weather")).alias("data")
    )
    write_table(payloads, path, "json")
    return read_weather_json(spark, path)


@query(
    "read_run_log",
    f"""
    SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS "Epoch",
      CASE WHEN month(o_orderdate) > 6 THEN {sql6("avg(o_totalprice)")} END AS "TrainingLoss",
      {sql6("avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)")} AS "ValidationAccuracy"
    FROM orders GROUP BY year(o_orderdate), month(o_orderdate)""",
)
def landed_run_log(spark, sf_dir):
    """One log line per order month, the loss "nan" in the first half year."""
    path = new_path(spark, "run-log")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("day"), "o_totalprice", "o_orderstatus"
    )
    log = orders.groupBy(F.year("day").alias("y"), F.month("day").alias("m")).agg(
        F.avg("o_totalprice").alias("loss"),
        F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("hits"),
    )
    write_table(
        log.select(
            (F.col("y") * 12 + F.col("m")).alias("Epoch"),
            F.when(F.col("m") > 6, F.col("loss").cast("string")).otherwise("nan").alias("TrainingLoss"),
            F.col("hits").alias("ValidationAccuracy"),
        ),
        path,
        "csv",
    )
    return rounded(read_run_log(spark, path), "TrainingLoss", "ValidationAccuracy")
