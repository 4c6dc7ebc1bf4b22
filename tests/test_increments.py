"""Keyed state, months of any size, dates that wait for weather."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_jobs import SCHEMA, as_rows, random_inspections, weather

from fieldspark.plans.combined import build_combined
from fieldspark.streaming import incremental


@pytest.mark.parametrize("policy", ["first", "prefer_recorded"])
def test_keyed_state_equals_the_batch_merge(spark, tmp_path, policy):
    rows = sorted(random_inspections(21, 90))
    parts = [rows[60:], rows[:30], rows[30:60], []]  # not in the order of seq
    schema = spark.createDataFrame(rows, SCHEMA).schema
    known, root, land = weather(spark, range(30)), str(tmp_path / "t"), str(tmp_path / "land")
    merged = None
    for part in parts:
        if part:
            spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(land)
            merged = build_combined(spark.createDataFrame(part, SCHEMA), known, "seq", merged, policy)
        incremental.keyed_merge(incremental.file_stream(spark, land, schema), known, root, policy=policy)
    got = incremental.read_keyed(spark, root, incremental.merged_schema(schema), policy=policy)
    assert as_rows(got) == as_rows(merged)


def test_a_run_writes_only_what_it_made_win(spark, tmp_path):
    rows = sorted(random_inspections(22, 40))
    schema = spark.createDataFrame(rows, SCHEMA).schema
    known, root, land = weather(spark, range(30)), str(tmp_path / "t"), str(tmp_path / "land")
    for part in (rows, rows):  # the same rows again
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(land)
        incremental.keyed_merge(incremental.file_stream(spark, land, schema), known, root)
    assert spark.read.parquet(f"{root}/changes/batch=0").count() > 0
    assert spark.read.parquet(f"{root}/changes/batch=1").count() == 0


def test_nothing_merged_reads_as_nothing(spark, tmp_path):
    schema = incremental.merged_schema(spark.createDataFrame([], SCHEMA).schema)
    assert incremental.read_keyed(spark, str(tmp_path), schema).count() == 0


def test_a_large_month_is_written_by_many_tasks(spark, tmp_path):
    day = datetime.date(2024, 5, 1)
    sites = spark.range(60_000).select(
        F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("SiteID"), F.lit(day).alias("Date"), F.lit("High").alias("MosquitoRank")
    )
    land, root, size = str(tmp_path / "land"), str(tmp_path / "t"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    sites.write.parquet(land)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in sites.schema])
    old = spark.conf.get(size)
    spark.conf.set(size, "500k")
    try:
        incremental.incremental_merge(spark, incremental.file_stream(spark, land, schema), weather(spark, range(9)), root)
        files = list((tmp_path / "t" / "merged" / "run=1" / "month=2024-05").glob("*.parquet"))
        assert len(files) >= 4
        incremental.compact_merged(spark, root, incremental.merged_schema(schema))
        files = list((tmp_path / "t" / "compacted" / "run=1" / "month=2024-05").glob("*.parquet"))
        assert len(files) >= 4
    finally:
        spark.conf.set(size, old)
    assert incremental.read_merged(spark, root, incremental.merged_schema(schema)).count() == 5 * 60_000


def test_beaten_folders_go(spark, tmp_path):
    rows = sorted(random_inspections(23, 60))
    schema = spark.createDataFrame(rows, SCHEMA).schema
    expanded = incremental.merged_schema(schema)
    known, root, land = weather(spark, range(30)), str(tmp_path / "t"), str(tmp_path / "land")
    merged = None
    for i in range(3):
        part = spark.createDataFrame(rows[20 * i : 20 * i + 20], SCHEMA)
        part.write.mode("append").parquet(land)
        incremental.incremental_merge(spark, incremental.file_stream(spark, land, schema), known, root)
        merged = build_combined(part, known, "seq", merged)
        if i < 2:
            incremental.compact_merged(spark, root, expanded)
            incremental.remove_compacted(spark, root)
    assert [p.name for p in (tmp_path / "t" / "merged").glob("run=*")] == ["run=3"]
    assert [p.name for p in (tmp_path / "t" / "compacted").glob("run=*")] == ["run=2"]
    assert as_rows(incremental.read_merged(spark, root, expanded)) == as_rows(merged)


def test_a_run_reads_the_dates_whose_weather_came(spark, tmp_path):
    first = datetime.date(2024, 4, 25)
    schema = "SiteID string, Date date, Temperature double, Precipitation double, CloudCoverage double"
    rows = [(f"s{i}", first + datetime.timedelta(days=i % 6), None, None, None) for i in range(30)] + [("lost", None, None, None, None)]
    land, out, checkpoint = (str(tmp_path / n) for n in ("land", "out", "cp"))
    kinds = spark.createDataFrame([], schema).schema

    def run(part, known):
        spark.createDataFrame(part, schema).write.mode("append").parquet(land)
        incremental.incremental_backfill(incremental.file_stream(spark, land, kinds), weather(spark, known), out, checkpoint)

    run(rows, range(0))
    ready = incremental._open_dates(spark, out, {str(first), "2031-01-01"})
    assert ready == {str(first): 0}
    pruned = incremental._waiting(spark, out, incremental._pending_schema(kinds), ready)
    plan = pruned._jdf.queryExecution().explainString(pruned._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = next(line for line in plan.splitlines() if line.startswith("PartitionFilters: "))
    assert f"= {first}" in scan and "run" in scan and "DataFilters" not in plan
    assert {r[0] for r in pruned.select("Date").distinct().collect()} == {first}
    run([], range(2))
    assert sorted(incremental._open_dates(spark, out)) == [str(first + datetime.timedelta(days=d)) for d in range(2, 6)] + ["none"]
    # Rows of a date that was filled wait again when its weather is not given.
    run([("late", first, None, None, None)], range(3, 4))
    assert incremental._open_dates(spark, out)[str(first)] == 2
    run([], range(6))
    assert list(incremental._open_dates(spark, out)) == ["none"]
    read = incremental.read_backfilled(spark, out, weather(spark, range(0)), kinds)
    assert read.count() == 32 and read.where("Temperature IS NULL").count() == 1
    assert read.columns == kinds.names
