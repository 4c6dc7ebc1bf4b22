"""The tables behind each chart of the combined data."""

from fieldspark.operators.boxplot import boxplot_stats
from fieldspark.operators.clean import fill_numeric, recorded_only
from fieldspark.operators.features import log1p_col
from fieldspark.operators.order import scatter_bins
from fieldspark.operators.sequence import time_series
from fieldspark.operators.stats import correlation_matrix, positive_days
from fieldspark.schema import WEATHER

LOGGED = "LogDipCount"


def describe(combined):
    """Recorded rows only, a missing count taken as 0; name to table."""
    rows = log1p_col(fill_numeric(recorded_only(combined), ["DipCount"]), "DipCount", LOGGED)
    return {
        "count_boxplot": boxplot_stats(rows, "DipCount"),
        "count_over_time": time_series(rows, "Date", LOGGED),
        "temperature_against_count": scatter_bins(rows, "Temperature", LOGGED),
        "cloud_against_count": scatter_bins(rows, "CloudCoverage", LOGGED),
        "positive_days_per_site": positive_days(rows),
        "correlation": correlation_matrix(rows, [*WEATHER, LOGGED]),
    }
