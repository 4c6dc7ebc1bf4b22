"""Cleaning, conforming and filtering of inspection tables."""

from pyspark.sql import functions as F

from fieldspark.functions import cells, vectors
from fieldspark.schema import (
    MISSING,
    NO_ACTION,
    POSITIVE_ABOVE,
    SYNTHETIC_WETNESS,
    WEATHER_FEATURES,
)


def _map_columns(df, cols, fn):
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def blank_to_null(df, cols=None, tokens=()):
    """Trim text; empty text and the given NA tokens become NULL."""
    if cols is None:
        cols = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return _map_columns(df, cols, lambda c: cells.blank_to_null(c, tokens))


def to_number(df, cols, default=0.0, prefix=False):
    return _map_columns(df, cols, lambda c: cells.parse_number(c, default, prefix))


def fill_category(df, cols, token=MISSING):
    return _map_columns(df, cols, lambda c: F.coalesce(cells.blank_to_null(c), F.lit(token)))


def fill_numeric(df, cols, value=0.0):
    """NULL and NaN become ``value`` in those of ``cols`` that exist."""
    present = [c for c in cols if c in df.columns]
    return _map_columns(df, present, lambda c: F.coalesce(cells.no_nan(c), F.lit(value)))


def conform(df, schema, required=(), defaults=None, renames=None):
    """The columns of ``schema`` in order, matched by name.

    Absent optional columns are filled from ``defaults`` (NULL otherwise), a
    missing required one is an error, and every other column is dropped.
    """
    for old, new in (renames or {}).items():
        df = df.withColumnRenamed(old, new)
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}")
    defaults = defaults or {}
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name)))
            .try_cast(f.dataType)
            .alias(f.name)
            for f in schema
        ]
    )


def check_range(df, col, k, strict=False):
    """Rows whose label is not one of 0..k-1; strict mode returns all rows and
    fails the job on the first offender."""
    c = F.col(col)
    inside = F.coalesce((c >= 0) & (c < k), F.lit(False))
    if not strict:
        return df.where(~inside)
    message = F.concat(F.lit(f"label outside 0..{k - 1}: "), F.coalesce(c.cast("string"), F.lit("NULL")))
    return df.withColumn(col, F.when(inside, c).otherwise(F.raise_error(message)))


def is_excess(temperature="Temperature", action="Action"):
    """No weather and no action: nothing to learn from such a row."""
    quiet = F.lower(F.coalesce(F.col(action), F.lit(""))) == NO_ACTION
    return cells.is_blank(F.col(temperature)) & quiet


def drop_excess(df, temperature="Temperature", action="Action"):
    return df.where(~is_excess(temperature, action))


def filter_report(df, keep):
    """One row: rows before, after and removed by the condition ``keep``."""
    kept = F.count_if(F.coalesce(keep, F.lit(False)))
    return df.agg(
        F.count(F.lit(1)).alias("before"),
        kept.alias("after"),
        (F.count(F.lit(1)) - kept).alias("removed"),
    )


def recorded_only(df, action="Action"):
    """Drop rows whose action is exactly "none"; a missing action stays."""
    return df.where(~F.col(action).eqNullSafe(F.lit(NO_ACTION)))


def threshold_label(df, col="DipCount", t=POSITIVE_ABOVE, out="Breeding"):
    return df.withColumn(out, vectors.over(F.col(col), t))


def mask_synthetic(df, is_recorded="is_recorded"):
    """Blank the fields that only the recorded day can know."""
    recorded = F.col(is_recorded)

    def on_other_days(name, value):
        kind = df.schema[name].dataType
        return F.when(recorded, F.col(name)).otherwise(F.lit(value).cast(kind))

    masks = {
        "TreatedBy": NO_ACTION,
        "Action": NO_ACTION,
        "Wetness": SYNTHETIC_WETNESS,
        "DipCount": None,
        "Material": None,
    }
    return df.withColumns({c: on_other_days(c, v) for c, v in masks.items() if c in df.columns})


def split_features(df, label="Breeding", exclude=()):
    """Column names of the weather family and of the site family."""
    weather = [c for c in WEATHER_FEATURES if c in df.columns]
    site = [c for c in df.columns if c not in {label, *weather, *exclude}]
    return weather, site
