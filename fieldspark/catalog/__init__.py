"""Registered queries and their SQL twins."""

from fieldspark.catalog import (  # noqa: F401
    cleaning,
    describing,
    encoding,
    increments,
    landing,
    merging,
    modelling,
    ordering,
    sequences,
)
from fieldspark.catalog.base import QUERIES, SQL  # noqa: F401
