"""Table layouts shared by every module."""

from pyspark.sql import types as T

# The file formats this toolkit reads and writes.
US_DATE = "MM/dd/yyyy"
US_DATE_LENIENT = "M/d/yyyy"
ISO_DATE = "yyyy-MM-dd"

KEYS = ["SiteID", "Date"]
WEATHER = ["Temperature", "Precipitation", "CloudCoverage"]
CATEGORIES = [
    "MosquitoRank",
    "CattailMosquito",
    "CulexFound",
    "TreatedBy",
    "Action",
    "Material",
]
SITE_NUMBERS = ["WetlandType", "Wetness", "DipCount"]
DATE_NUMBERS = ["DateOrdinal", "Month", "Day", "Year"]
WEATHER_FEATURES = WEATHER + DATE_NUMBERS

COMBINED_COLUMNS = [
    "SiteID",
    "WetlandType",
    "MosquitoRank",
    "CattailMosquito",
    "CulexFound",
    "TreatedBy",
    "Date",
    "Wetness",
    "Action",
    "DipCount",
    "Material",
    "Temperature",
    "Precipitation",
    "CloudCoverage",
]
INSPECTION_COLUMNS = [c for c in COMBINED_COLUMNS if c not in WEATHER]

MISSING = "Missing"
NO_ACTION = "none"
SYNTHETIC_WETNESS = -1
POSITIVE_ABOVE = 0.1
LOOKBACK_DAYS = 5

# The tokens a CSV reader of the usual dataframe libraries takes
# as missing. Case matters; lower-case "none" is a real action and is not here.
NA_TOKENS = [
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def text_schema(columns):
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _typed(name):
    if name == "Date":
        return T.StructField(name, T.DateType())
    if name in SITE_NUMBERS + WEATHER:
        return T.StructField(name, T.DoubleType())
    return T.StructField(name, T.StringType())


INSPECTION_TEXT = text_schema(INSPECTION_COLUMNS)
COMBINED_TEXT = text_schema(COMBINED_COLUMNS)
INSPECTIONS = T.StructType([_typed(c) for c in INSPECTION_COLUMNS])
COMBINED = T.StructType([_typed(c) for c in COMBINED_COLUMNS])

WEATHER_PAYLOAD = T.StructType().add(
    "data",
    T.StructType().add(
        "weather",
        T.ArrayType(
            T.StructType()
            .add("date", T.StringType())
            .add("avgtempC", T.StringType())
            .add("precipMM", T.StringType())
            .add("hourly", T.ArrayType(T.StructType().add("cloudcover", T.StringType())))
        ),
    ),
)

RUN_LOG_TEXT = text_schema(["Epoch", "TrainingLoss", "ValidationAccuracy"])
