"""Merging into buckets of the key without moving the rows that are there."""

import uuid

import pytest
from pyspark.sql import functions as F
from test_merge import SCHEMA, as_rows, random_inspections

from fieldspark.operators import bucketed
from fieldspark.operators.merge import merge_insert_only
from fieldspark.plans.combined import expand_inspections

BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


def name():
    return f"t_{uuid.uuid4().hex}"


@pytest.mark.parametrize("policy", ["first", "prefer_recorded"])
def test_buckets_equal_the_merge(spark, policy):
    rows = random_inspections(31, 120) + [(900, None, *random_inspections(1, 1)[0][2:])]
    parts = [spark.createDataFrame(rows[i::3], SCHEMA) for i in range(3)]
    expanded = [expand_inspections(p) for p in parts]
    want = merge_insert_only(None, expanded[0], "seq", policy=policy)
    table = name()
    bucketed.save_bucketed(want, table, buckets=4)
    for part in expanded[1:]:
        want = merge_insert_only(want, part, "seq", policy=policy, existing_unique=True)
        table = bucketed.merge_into_bucketed(spark, table, part, "seq", policy=policy)
        assert bucketed.bucket_count(spark, table) == 4
    got = bucketed.read_bucketed(spark, table)
    assert got.columns == expanded[0].columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_existing_rows_are_not_exchanged(spark):
    rows = spark.range(4000).select(
        F.format_string("s%d", F.col("id") % 40).alias("SiteID"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 40).cast("int")).alias("Date"),
        (F.col("id") % 3 == 0).alias("is_recorded"),
        F.col("id").alias("seq"),
    )
    table = name()
    existing = bucketed.save_bucketed(rows, table, buckets=8)
    new = rows.withColumn("is_recorded", F.lit(True)).withColumn("seq", F.col("seq") + 9000)
    old = spark.conf.get(BROADCAST)
    spark.conf.set(BROADCAST, "-1")
    try:
        stay, added = bucketed.merge_sides(existing, new, 8, "seq")
        plan = stay._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "Bucketed: true" in plan
        scan = plan[: plan.index("Bucketed: true")]
        # What stands between the join and the bucketed scan: no exchange.
        assert "Exchange" not in scan.split("SortMergeJoin")[-1] and "Broadcast" not in plan
        assert added.count() == rows.where("NOT is_recorded").count()
        assert stay.count() == rows.where("is_recorded").count()
    finally:
        spark.conf.set(BROADCAST, old)


def test_columns_of_both_sides_stay(spark):
    table = name()
    old = spark.createDataFrame([("a", 1, True, "x")], "SiteID string, Date int, is_recorded boolean, was string")
    bucketed.save_bucketed(old, table, buckets=2)
    new = spark.createDataFrame([("b", 2, False, 7, "n")], "SiteID string, Date int, is_recorded boolean, seq int, fresh string")
    merged = bucketed.merge_into_bucketed(spark, table, new, "seq")
    got = bucketed.read_bucketed(spark, merged)
    assert got.columns == ["SiteID", "Date", "is_recorded", "was", "seq", "fresh"]
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, True, "x", None, None), ("b", 2, False, None, 7, "n")]
