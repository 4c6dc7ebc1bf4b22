"""From inspections and daily weather to the combined table."""

from pyspark.sql import functions as F

from fieldspark.functions.cells import no_nan
from fieldspark.operators.calendar import lookback_expand, parse_us_date
from fieldspark.operators.clean import blank_to_null, mask_synthetic
from fieldspark.operators.merge import enrich_weather, keep_first, merge_insert_only
from fieldspark.schema import (
    KEYS,
    LOOKBACK_DAYS,
    NO_ACTION,
    SITE_NUMBERS,
    SYNTHETIC_WETNESS,
    WEATHER,
)


def expand_inspections(inspections, n=LOOKBACK_DAYS):
    """Look-back rows of every inspection, synthetic fields masked."""
    return mask_synthetic(lookback_expand(inspections, "Date", n))


def build_combined(
    inspections,
    weather,
    order_col,
    existing=None,
    policy="prefer_recorded",
    n=LOOKBACK_DAYS,
    existing_unique=False,
):
    """Expand, merge by (site, date), then attach the weather of the days left.

    Of several inspections of one site on one day only the first in
    ``order_col`` can ever win a merged row, recorded or synthetic, under either
    policy: its look-back days are the same and its order is smaller. So the
    others are reduced away before the expansion, map-side. What is left of a
    site is at most one row per calendar day, so it can be brought together by
    site before it is expanded: the ``n``-fold rows are merged where they arise
    and never shuffled. Weather depends on the date alone and joins last, on
    the fewest rows; existing rows keep theirs.
    """
    first = keep_first(inspections, KEYS, order_col).repartition("SiteID")
    new = merge_insert_only(None, expand_inspections(first, n), order_col, KEYS, policy)
    new = enrich_weather(new, weather)
    if existing is None:
        return new
    return merge_insert_only(
        existing, new, order_col, KEYS, policy, existing_unique=existing_unique
    )


def typed(raw, tokens=(), on_error="drop"):
    """Landed text to numbers and dates; blanks, NA ``tokens`` and unreadable
    numbers are NULL. Rows without a readable date follow ``on_error``."""
    text = blank_to_null(raw, None, tokens)
    numbers = {
        c: no_nan(F.col(c).try_cast("double")) for c in SITE_NUMBERS + WEATHER if c in raw.columns
    }
    return parse_us_date(text.withColumns(numbers), "Date", on_error)


def with_recorded_flag(combined):
    """Tell recorded rows from look-back rows in a table that lost the flag: a
    look-back row carries every mask at once."""
    masked = (
        (F.col("TreatedBy") == NO_ACTION)
        & (F.col("Action") == NO_ACTION)
        & (F.col("Wetness") == SYNTHETIC_WETNESS)
        & F.col("DipCount").isNull()
        & F.col("Material").isNull()
    )
    return combined.withColumn("is_recorded", ~F.coalesce(masked, F.lit(False)))
