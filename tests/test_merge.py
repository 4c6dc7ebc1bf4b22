"""Merges and enrichment against a plain dictionary model of the same rules."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldspark.catalog import base
from fieldspark.operators.merge import (
    append_missing,
    apply_dictionary,
    backfill_weather,
    dedup_last,
    enrich_weather,
    merge_insert_only,
)
from fieldspark.operators.stats import positive_days
from fieldspark.plans.combined import build_combined, expand_inspections, with_recorded_flag
from fieldspark.schema import INSPECTION_COLUMNS, INSPECTIONS, KEYS

START = datetime.date(2024, 5, 1)
SCHEMA = "seq bigint, " + INSPECTIONS.simpleString()[7:-1].replace(":", " ")


def random_inspections(seed, rows=120, hot=True):
    """A third of the rows belong to one site."""
    rnd = random.Random(seed)
    out = []
    for seq in range(rows):
        site = "hot" if hot and rnd.random() < 0.34 else f"s{rnd.randrange(6)}"
        day = START + datetime.timedelta(days=rnd.randrange(15))
        count = rnd.choice([None, 0.0, 0.1, 0.2, 3.0])
        out.append((seq, site, 1.0, "High", None, "No", "Ann", day, 2.0, rnd.choice(["Pump", "none"]), count, "Bti"))
    rnd.shuffle(out)
    return out


def loop_merge(existing, inspections, policy):
    """Row by row, in order: later existing rows overwrite, new ones only insert."""
    merged = {}
    for row in sorted(existing):
        there = merged.get((row[1], row[2]))
        if policy == "first" or there is None or row[3] >= there[3]:
            merged[row[1], row[2]] = row
    new = []
    for r in sorted(inspections):
        for back in (4, 3, 2, 1, 0):
            new.append((r[0], r[1], r[7] - datetime.timedelta(days=back), back == 0))
    for row in new:
        key = row[1], row[2]
        if key not in merged or (policy == "prefer_recorded" and row[3] and not merged[key][3]):
            merged[key] = row
    return sorted(merged.values())


def as_rows(df):
    return sorted(tuple(r) for r in df.select("seq", "SiteID", "Date", "is_recorded").collect())


@pytest.mark.parametrize("policy", ["first", "prefer_recorded"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_build_combined_is_the_row_by_row_merge(spark, policy, seed):
    rows = random_inspections(seed)
    inspections = spark.createDataFrame(rows, SCHEMA)
    weather = spark.createDataFrame(
        [(START + datetime.timedelta(days=n), float(n), 0.0, 1.0) for n in range(0, 15, 2)],
        "Date date, Temperature double, Precipitation double, CloudCoverage double",
    )
    old = random_inspections(seed + 100, 40)
    existing = expand_inspections(spark.createDataFrame(old, SCHEMA))
    for there, start in ((None, []), (existing, [tuple(r) for r in as_rows(existing)])):
        out = build_combined(inspections, weather, "seq", existing=there, policy=policy)
        assert as_rows(out) == loop_merge(start, rows, policy)


@pytest.mark.parametrize("policy", ["first", "prefer_recorded"])
def test_unique_existing_gives_the_same_merge(spark, policy):
    rows = [(r[0], None if r[1] == "s1" else r[1], *r[2:]) for r in random_inspections(8)]
    old = expand_inspections(spark.createDataFrame(rows[:50], SCHEMA))
    new = expand_inspections(spark.createDataFrame(rows[50:], SCHEMA))
    table = merge_insert_only(None, old, "seq", KEYS, policy)
    plain = merge_insert_only(table, new, "seq", KEYS, policy)
    quick = merge_insert_only(table, new, "seq", KEYS, policy, existing_unique=True)
    key = lambda r: str(r)
    assert sorted(as_tuples(quick), key=key) == sorted(as_tuples(plain), key=key)


def as_tuples(df):
    return [tuple(r) for r in df.select("seq", "SiteID", "Date", "is_recorded").collect()]


@pytest.mark.parametrize("policy", ["first", "prefer_recorded"])
def test_merge_is_idempotent(spark, policy):
    new = expand_inspections(spark.createDataFrame(random_inspections(5), SCHEMA))
    once = merge_insert_only(None, new, "seq", KEYS, policy)
    assert as_rows(merge_insert_only(once, new, "seq", KEYS, policy)) == as_rows(once)


def test_masked_fields_and_recorded_flag(spark):
    out = expand_inspections(spark.createDataFrame(random_inspections(6), SCHEMA))
    for r in out.collect():
        if not r["is_recorded"]:
            assert (r["TreatedBy"], r["Action"], r["Wetness"]) == ("none", "none", -1.0)
            assert r["DipCount"] is None and r["Material"] is None
    again = with_recorded_flag(out.drop("is_recorded").select("seq", *INSPECTION_COLUMNS))
    assert again.where("is_recorded").count() == out.where("is_recorded").count()


def test_unknown_policy(spark):
    rows = expand_inspections(spark.createDataFrame(random_inspections(7, 3), SCHEMA))
    with pytest.raises(ValueError, match="policy"):
        merge_insert_only(None, rows, "seq", KEYS, "last")


def test_dedup_and_append(spark):
    d = START
    table = spark.createDataFrame([("a", d, 1), ("a", d, 3), ("a", d, 2), ("b", d, 1)], "SiteID string, Date date, seq int")
    assert sorted(r["seq"] for r in dedup_last(table, KEYS, "seq").collect()) == [1, 3]
    new = spark.createDataFrame([("a", d, 9), ("c", d, 8), ("c", d, 7)], "SiteID string, Date date, seq int")
    assert append_missing(table, new, "seq").collect() == [("c", d, 7)]


def test_weather_join_never_multiplies_or_drops_rows(spark):
    d1, d2 = START, START + datetime.timedelta(days=1)
    rows = spark.createDataFrame([(1, d1), (2, d2), (3, None)], "i int, Date date")
    weather = spark.createDataFrame(
        [(d1, None, None, None), (d1, 5.0, 1.0, 2.0)],
        "Date date, Temperature double, Precipitation double, CloudCoverage double",
    )
    out = {r["i"]: r["Temperature"] for r in enrich_weather(rows, weather).collect()}
    assert out == {1: 5.0, 2: None, 3: None}


def test_backfill_replaces_all_three_and_only_blank_rows(spark):
    d = START
    rows = spark.createDataFrame(
        [(1, d, " ", "old", "old"), (2, d, "7", "", ""), (3, None, None, "old", "old")],
        "i int, Date date, Temperature string, Precipitation string, CloudCoverage string",
    )
    weather = spark.createDataFrame(
        [(d, 5.0, 1.5, None)], "Date date, Temperature double, Precipitation double, CloudCoverage double"
    )
    out = {r["i"]: tuple(r)[2:] for r in backfill_weather(rows, weather).collect()}
    assert out == {1: ("5.0", "1.5", None), 2: ("7", "", ""), 3: (None, None, None)}


def test_apply_dictionary_keeps_unknown_rows(spark):
    rows = spark.createDataFrame([("x",), ("y",), (None,)], "v string")
    codes = spark.createDataFrame([("v", "x", 4), ("other", "y", 1)], "column string, value string, code int")
    assert sorted(apply_dictionary(rows, codes, "v").collect(), key=str) == [(4,), (None,), (None,)]


GOLDEN = [
    ("first", 1, 5066, 1184, 150, 3182),
    ("first", -1, 5066, 1184, 120, 120),
    ("prefer_recorded", 1, 5066, 1184, 150, 3182),
    ("prefer_recorded", -1, 5066, 1184, 150, 3192),
]


@pytest.mark.parametrize("policy,direction,merged,blank,sites,days", GOLDEN)
def test_golden_numbers(spark, policy, direction, merged, blank, sites, days):
    """Worked out beforehand in two engines, in both file orders."""
    sf_dir = "/root/testdata/sf0.01"
    rows = base.inspections(spark, sf_dir).withColumn("seq", F.col("seq") * direction)
    weather = base.weather_daily(spark, sf_dir).where(~F.dayofmonth("Date").isin(7, 14, 21, 28))
    out = build_combined(rows, weather, "seq", policy=policy).cache()
    positive = positive_days(out)
    assert out.count() == merged
    assert out.where("Temperature IS NULL").count() == blank
    assert positive.count() == sites
    assert positive.agg(F.sum("positive_days")).first()[0] == days


def test_flagship_by_an_independent_count():
    sql = "SELECT count(DISTINCT (user_id, CAST(ts AS DATE))) FROM '/root/testdata/sf0.01/events.parquet'"
    assert duckdb.sql(sql).fetchall()[0][0] == 4006
