"""Date columns: parsing policies, parts, look-back days."""

from pyspark.sql import functions as F

from fieldspark.functions import cells
from fieldspark.schema import LOOKBACK_DAYS


def parse_us_date(df, col="Date", on_error="drop"):
    """Month/day/year text to a date.

    ``on_error``: "drop" removes rows without a readable date, "fail" stops the
    job, "keep" leaves NULL (``date_parts`` and ``date_ordinal`` then give 0).
    """
    parsed = cells.parse_us_date(F.col(col))
    if on_error == "fail":
        message = F.concat(F.lit("unreadable date: "), F.coalesce(F.col(col), F.lit("NULL")))
        parsed = F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(message).cast("date"))
    out = df.withColumn(col, parsed)
    return out.where(F.col(col).isNotNull()) if on_error == "drop" else out


def format_date(df, col="Date", style="us", raw=None):
    """Date to text; where it is NULL the text column ``raw`` stays, if given."""
    return df.withColumn(col, cells.format_date(F.col(col), style, F.col(raw) if raw else None))


def date_ordinal(df, col="Date", out="DateOrdinal"):
    return df.withColumn(out, F.coalesce(cells.date_ordinal(F.col(col)), F.lit(0)))


def date_parts(df, col="Date"):
    parts = {"Month": F.month, "Day": F.dayofmonth, "Year": F.year}
    return df.withColumns({n: F.coalesce(fn(F.col(col)), F.lit(0)) for n, fn in parts.items()})


def shift_days(df, col="Date", n=1, out=None):
    return df.withColumn(out or col, cells.shift_days(F.col(col), n))


def lookback_expand(df, date_col="Date", n=LOOKBACK_DAYS):
    """One row per day of the ``n`` days ending on the recorded date, oldest first.

    ``inspected_on`` keeps the recorded date and ``is_recorded`` marks its own
    row. A narrow transformation: no shuffle.
    """
    days = F.sequence(F.date_sub(F.col(date_col), n - 1), F.col(date_col))
    return (
        df.withColumn("inspected_on", F.col(date_col))
        .withColumn(date_col, F.explode(days))
        .withColumn("is_recorded", F.col(date_col) == F.col("inspected_on"))
    )


def missing_weather_dates(df, weather, date_col="Date", only_blank=None):
    """Distinct dates for which no weather is landed yet.

    With ``only_blank`` just the rows lacking that column are asked about. The
    date list is de-duplicated before the join, so the join sees days, not rows.
    """
    if only_blank:
        df = df.where(cells.is_blank(F.col(only_blank)))
    known = weather.select(date_col).distinct()
    return df.select(date_col).where(F.col(date_col).isNotNull()).distinct().join(
        known, date_col, "left_anti"
    )
