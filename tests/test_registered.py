"""Every registered query against its SQL twin, and shape checks for the rest."""

import os
import re

import pytest
from compare import database, differences, spark_result, sql_result

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    assert differences(spark_result(QUERIES[name](spark, SF_DIR)), sql_result(db, SQL[name])) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    own = {n for n in QUERIES if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own == set(SQL) & own


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["SiteID", "positive_days"]
