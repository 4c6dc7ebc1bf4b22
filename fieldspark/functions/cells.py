"""Column expressions for single cells: text, numbers, dates."""

from pyspark.sql import functions as F

from fieldspark.schema import ISO_DATE, US_DATE, US_DATE_LENIENT

# Blanks that count as padding, and the day number of 1970-01-01
# when 0001-01-01 is day 1.
PADDING = " \t\r\n"
EPOCH_ORDINAL = 719163

NUMBER_PREFIX = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def blank_to_null(c, tokens=()):
    text = F.btrim(c, F.lit(PADDING))
    missing = text.isin("", *tokens)
    return F.when(~missing, text)


def is_blank(c):
    """True for NULL, empty or padding-only text; numbers are blank when NULL or NaN."""
    return F.coalesce(F.btrim(c.cast("string"), F.lit(PADDING)).isin("", "NaN"), F.lit(True))


def parse_number(c, default=0.0, prefix=False):
    """Text to double; blank, unreadable and NaN become ``default``.

    With ``prefix`` the leading number of a longer text counts ("12abc" is 12).
    """
    text = F.btrim(c, F.lit(PADDING))
    if prefix:
        text = F.regexp_extract(text, NUMBER_PREFIX, 1)
    return F.coalesce(F.nanvl(text.try_cast("double"), F.lit(None).cast("double")), F.lit(default))


def no_nan(c):
    """NaN becomes NULL, so aggregates and comparisons skip it."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def parse_us_date(c):
    return F.try_to_date(F.btrim(c, F.lit(PADDING)), US_DATE_LENIENT)


def format_date(c, style="us", raw=None):
    text = F.date_format(c, {"us": US_DATE, "iso": ISO_DATE}[style])
    return text if raw is None else F.coalesce(text, raw)


def date_ordinal(c):
    return F.unix_date(c) + F.lit(EPOCH_ORDINAL)


def shift_days(c, n):
    """The date ``n`` days earlier."""
    return F.date_sub(c, n)


def md5_key(seed, *keys):
    """Reproducible pseudo-random text per row, the same in any SQL engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
