"""Incremental jobs, file jobs and the training plan, end to end on small data."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_merge import SCHEMA, as_rows, random_inspections

from fieldspark import jobs
from fieldspark.operators import boxplot, evaluate, features, model, sequence, stats
from fieldspark.operators.merge import merge_insert_only
from fieldspark.operators.stats import fit_dictionaries
from fieldspark.plans import training
from fieldspark.plans.combined import build_combined, expand_inspections
from fieldspark.schema import COMBINED_COLUMNS
from fieldspark.streaming import incremental

WEATHER_SCHEMA = "Date date, Temperature double, Precipitation double, CloudCoverage double"


def weather(spark, days):
    first = datetime.date(2024, 4, 25)
    rows = [(first + datetime.timedelta(days=d), 10.0 + d, float(d % 3), 50.0) for d in days]
    return spark.createDataFrame(rows, WEATHER_SCHEMA)


@pytest.mark.parametrize("policy", ["first", "prefer_recorded"])
def test_incremental_merge_over_runs(spark, tmp_path, policy):
    rows = sorted(random_inspections(11, 90))
    parts = [rows[:30], rows[30:60], rows[60:]]
    schema = spark.createDataFrame(rows, SCHEMA).schema
    known, root = weather(spark, range(30)), str(tmp_path / "table")
    for part in [*parts, []]:  # a run without news changes nothing
        if part:
            spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(str(tmp_path / "land"))
        stream = incremental.file_stream(spark, str(tmp_path / "land"), schema)
        incremental.incremental_merge(spark, stream, known, root, policy=policy)
    got = incremental.read_merged(spark, root, incremental.merged_schema(schema), policy)
    merged = None
    for part in parts:
        merged = build_combined(spark.createDataFrame(part, SCHEMA), known, "seq", merged, policy)
    assert as_rows(got) == as_rows(merged)
    assert len(list((tmp_path / "table" / "merged").glob("run=*"))) == 3


def test_a_merge_lost_after_staging_is_made_good(spark, tmp_path, monkeypatch):
    rows = sorted(random_inspections(12, 40))
    schema = spark.createDataFrame(rows, SCHEMA).schema
    known, root, land = weather(spark, range(30)), str(tmp_path / "t"), str(tmp_path / "land")

    def run():
        stream = incremental.file_stream(spark, land, schema)
        incremental.incremental_merge(spark, stream, known, root)

    spark.createDataFrame(rows[:20], SCHEMA).write.parquet(land)
    with monkeypatch.context() as m:
        m.setattr(incremental, "merge_insert_only", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run()
    spark.createDataFrame(rows[20:], SCHEMA).write.mode("append").parquet(land)
    run()
    got = incremental.read_merged(spark, root, incremental.merged_schema(schema))
    assert as_rows(got) == as_rows(build_combined(spark.createDataFrame(rows, SCHEMA), known, "seq"))


def test_backfill_retries_only_what_is_missing(spark, tmp_path):
    rows = expand_inspections(spark.createDataFrame(random_inspections(13, 20), SCHEMA))
    table = rows.withColumns({c: F.lit(None).cast("double") for c in COMBINED_COLUMNS[-3:]})
    table.write.parquet(str(tmp_path / "land"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in table.schema])
    out = str(tmp_path / "out")
    few, all_days = weather(spark, range(0, 30, 2)), weather(spark, range(30))
    for _ in range(2):
        stream = incremental.file_stream(spark, str(tmp_path / "land"), schema)
        incremental.incremental_backfill(stream, few, out, str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == table.count()
    first = incremental.read_backfilled(spark, out, few, schema)
    assert 0 < first.where("Temperature IS NULL").count() < table.count()
    assert incremental.read_backfilled(spark, out, all_days, schema).where("Temperature IS NULL").count() == 0


def test_pending_rows_go_as_weather_arrives(spark, tmp_path):
    days = [datetime.date(2024, 4, 25) + datetime.timedelta(days=d) for d in range(4)]
    rows = [("s", d, None, None, None) for d in days]
    schema = "SiteID string, Date date, Temperature double, Precipitation double, CloudCoverage double"
    land, out, checkpoint = (str(tmp_path / n) for n in ("land", "out", "cp"))
    spark.createDataFrame(rows, schema).write.parquet(land)
    kinds = spark.createDataFrame(rows, schema).schema
    pending = []
    for known in (range(0), range(0, 2), range(4), range(4)):
        stream = incremental.file_stream(spark, land, kinds)
        incremental.incremental_backfill(stream, weather(spark, known), out, checkpoint)
        pending.append(incremental.count_pending(spark, out, kinds))
        assert incremental.read_backfilled(spark, out, weather(spark, range(0)), kinds).count() == 4
    assert pending == [4, 2, 0, 0]
    read = incremental.read_backfilled(spark, out, weather(spark, range(0)), kinds)
    assert sorted(r.Temperature for r in read.collect()) == [10.0, 11.0, 12.0, 13.0]


def test_three_deliveries_with_a_compaction_between(spark, tmp_path):
    rows = sorted(random_inspections(14, 90))
    schema = spark.createDataFrame(rows, SCHEMA).schema
    expanded = incremental.merged_schema(schema)
    known, root, land = weather(spark, range(30)), str(tmp_path / "t"), str(tmp_path / "land")
    for i in range(3):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], SCHEMA).write.mode("append").parquet(land)
        incremental.incremental_merge(spark, incremental.file_stream(spark, land, schema), known, root)
        if i < 2:
            incremental.compact_merged(spark, root, expanded)
    merged = None
    for i in range(3):
        part = spark.createDataFrame(rows[30 * i : 30 * i + 30], SCHEMA)
        merged = build_combined(part, known, "seq", merged)
    got = incremental.read_merged(spark, root, expanded)
    assert as_rows(got) == as_rows(merged)
    first = datetime.date(2024, 5, 3)
    some = incremental.read_merged(spark, root, expanded, since=first)
    assert as_rows(some) == as_rows(merged.where(F.col("Date") >= F.lit(first)))


def test_an_unfinished_merge_below_a_finished_one_is_merged(spark, tmp_path, monkeypatch):
    """Two runs die after staging; a later one merges all three in their order."""
    rows = sorted(random_inspections(15, 60))
    schema = spark.createDataFrame(rows, SCHEMA).schema
    known, root, land = weather(spark, range(30)), str(tmp_path / "t"), str(tmp_path / "land")

    def run(part):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(land)
        incremental.incremental_merge(spark, incremental.file_stream(spark, land, schema), known, root)

    with monkeypatch.context() as m:
        m.setattr(incremental, "_merge_run", lambda *a: None)
        run(rows[:20])
        run(rows[20:40])
    run(rows[40:])
    got = incremental.read_merged(spark, root, incremental.merged_schema(schema))
    merged = None
    for i in range(3):
        merged = build_combined(spark.createDataFrame(rows[20 * i : 20 * i + 20], SCHEMA), known, "seq", merged)
    assert as_rows(got) == as_rows(merged)


def test_dense_score_is_the_matrix_product(spark):
    rnd = np.random.default_rng(0)
    shapes = [(6, 4), (3, 6), (2, 3)]
    layers = [(rnd.normal(size=s), rnd.normal(size=s[0])) for s in shapes]
    table = [
        (n, i, float(b[i]), [float(x) for x in w[i]]) for n, (w, b) in enumerate(layers) for i in range(len(b))
    ]
    weights = spark.createDataFrame(table, "layer int, neuron int, bias double, weights array<double>")
    xs = rnd.normal(size=(50, 4))
    xs[3, 1], xs[4, 2] = np.nan, np.inf
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], "i int, x array<double>")
    got = model.dense_score(rows, "x", model.read_layers(weights.repartition(3))).orderBy("i").collect()
    h = np.nan_to_num(xs, nan=0.0, posinf=0.0)
    for n, (w, b) in enumerate(layers):
        h = h @ w.T + b
        h = np.maximum(h, 0) if n < 2 else h
    assert np.allclose([r["scores"] for r in got], h)


def test_history_of_a_run_marks_best_and_last(spark):
    rnd = np.random.default_rng(6)
    xs = rnd.normal(size=(120, 2))
    rows = spark.createDataFrame([([float(v) for v in x], int(x[0] > 0)) for x in xs], "features array<double>, label int")
    _, history = model.train_with_history(rows, rows, hidden=(3,), epochs=4, iterations=2)
    marked = sorted(model.run_history(spark, history).collect())
    best = max(marked, key=lambda r: (r["validation_accuracy"], -r["epoch"]))
    assert [r["epoch"] for r in marked if r["is_best"]] == [best["epoch"]]
    assert [r["epoch"] for r in marked if r["is_last"]] == [4]
    assert marked[-1]["objective"] <= marked[0]["objective"]
    with pytest.raises(ValueError, match="no rows"):
        model.train_classifier(rows.where("label > 5"))


def test_missing_vectors_have_no_scores(spark):
    weights = spark.createDataFrame([(0, 0, 1.0, [2.0, 0.0])], "layer int, neuron int, bias double, weights array<double>")
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, None)], "i int, x array<double>")
    got = {r["i"]: r["scores"] for r in model.dense_score(rows, "x", model.read_layers(weights)).collect()}
    assert got == {1: [7.0], 2: None}


def test_training_learns_a_separable_rule(spark):
    rnd = np.random.default_rng(5)
    xs = rnd.normal(size=(400, 3))
    rows = spark.createDataFrame([([float(v) for v in x], int(x[0] + x[1] > 0)) for x in xs], "features array<double>, label int")
    fitted = model.train_classifier(rows, hidden=(8,), max_iter=60)
    scored = model.score_classifier(fitted, rows)
    assert scored.where("predicted = label").count() > 380
    baseline = model.score_classifier(model.train_baseline(rows), rows)
    assert baseline.where("predicted = label").count() > 380


def test_matrices_have_no_label_leak_and_fit_on_train(spark):
    combined = build_combined(spark.createDataFrame(random_inspections(14, 200), SCHEMA), weather(spark, range(0, 30, 2)), "seq")
    m = training.matrices(combined)
    assert m.weather_columns == ["Temperature", "Precipitation", "CloudCoverage", "DateOrdinal", "Month", "Day", "Year"]
    assert m.site_columns[0] == "SiteCode" and "DipCount" not in m.site_columns
    rows = m.rows.where("split = 'train'").collect()
    x = np.array([r["features"] for r in rows])
    assert x.shape[1] == len(m.weather_columns) + len(m.site_columns)
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9)
    std = x.std(axis=0)
    assert np.all(np.isclose(std, 1) | np.isclose(std, 0))
    five, columns, _ = training.encode(combined, days=5)
    assert len(columns) == 4 * 3 + 7
    by_date = {r["Date"]: r["Temperature"] for r in combined.collect()}
    for r in five.collect():
        for back in (1, 4):
            day = r["Date"] - datetime.timedelta(days=back)
            assert r[f"Temperature_{back}"] == (by_date.get(day) or 0.0)
    kept = training.matrices(combined, keep_label_source=True, fit_on="all")
    assert "DipCount" in kept.site_columns
    assert np.allclose(np.array([r["features"] for r in kept.rows.collect()]).mean(axis=0), 0, atol=1e-9)


def test_file_jobs(spark, tmp_path):
    lines = ["SiteID,WetlandType,MosquitoRank,CattailMosquito,CulexFound,TreatedBy,Date,Wetness,Action,DipCount,Material"]
    day = datetime.date(2024, 5, 10)
    for i in range(120):
        d = day + datetime.timedelta(days=i % 20)
        lines.append(f"s{i % 9},1,High,Yes,,Ann,{d:%m/%d/%Y},{i % 4},{'Pump' if i % 3 else 'none'},{(i * 7 % 5) / 10},Bti")
    lines.append("s1,1,High,Yes,,Ann,not a date,1,Pump,1,Bti")
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    days = [
        {"date": f"{day + datetime.timedelta(days=n):%Y-%m-%d}", "data": {"weather": [{"avgtempC": str(n), "precipMM": "1", "hourly": [{"cloudcover": str(n * 3 % 100)}]}]}}
        for n in range(-2, 20)
    ]
    (tmp_path / "few.json").write_text("\n".join(map(json.dumps, days[::2])))
    (tmp_path / "all.json").write_text("\n".join(map(json.dumps, days)))
    p = {n: str(tmp_path / n) for n in ("v1", "v2", "v3", "v4", "tables", "run")}
    src, few, everything = (str(tmp_path / n) for n in ("in.csv", "few.json", "all.json"))

    jobs.combine(spark, src, few, p["v1"])
    jobs.combine(spark, src, few, p["v2"], existing=p["v1"])

    def content(path):
        return sorted(jobs.read_combined(spark, path).select(*COMBINED_COLUMNS).collect(), key=str)

    assert content(p["v1"]) == content(p["v2"])
    jobs.combine(spark, src, few, p["v3"], existing=p["v2"], existing_unique=True)
    assert content(p["v3"]) == content(p["v2"])
    jobs.backfill(spark, p["v2"], everything, p["v3"])
    blank = [sum(r["Temperature"] is None for r in content(v)) for v in (p["v2"], p["v3"])]
    assert blank[0] > blank[1] > 0
    counts = jobs.filter_excess(spark, p["v3"], p["v4"])
    assert counts["removed"] > 0 and counts["after"] == len(content(p["v4"]))
    jobs.describe_tables(spark, p["v4"], p["tables"])
    assert spark.read.parquet(f"{p['tables']}/correlation").count() == 16
    jobs.train(spark, p["v4"], p["run"], epochs=2, iterations=2)
    scores = spark.read.parquet(f"{p['run']}/scores").collect()
    assert sum(r["n"] for r in scores) == counts["after"]
    assert spark.read.parquet(f"{p['run']}/history").where("is_last").first()["epoch"] == 2


def test_jobs_keep_other_columns_and_formats(spark, tmp_path):
    """A column the schema does not name goes through every job, in CSV and Parquet."""
    header = "SiteID,WetlandType,MosquitoRank,CattailMosquito,CulexFound,TreatedBy,Date,Wetness,Action,DipCount,Material,Notes"
    first = [f"s{i % 3},1,High,Yes,,Ann,05/{10 + i:02d}/2024,{i % 4},Pump,0.{i},Bti,note {i % 4}" for i in range(12)]
    later = ["s9,1,High,Yes,,Ann,05/20/2024,2,Pump,0.5,Bti,late"]
    for name, lines in (("in.csv", first), ("more.csv", later)):
        (tmp_path / name).write_text("\n".join([header, *lines]) + "\n")
    day = datetime.date(2024, 5, 1)
    weather_lines = [
        {"date": f"{day + datetime.timedelta(days=n):%Y-%m-%d}", "data": {"weather": [{"avgtempC": str(n), "precipMM": "1", "hourly": [{"cloudcover": "5"}]}]}}
        for n in range(0, 30, 2)
    ]
    (tmp_path / "w.json").write_text("\n".join(map(json.dumps, weather_lines)))
    land, more, days = (str(tmp_path / n) for n in ("in.csv", "more.csv", "w.json"))
    for fmt in ("csv", "parquet"):
        v1, v2, v3, v4, run = (str(tmp_path / f"{fmt}-{n}") for n in ("v1", "v2", "v3", "v4", "run"))
        jobs.combine(spark, land, days, v1, fmt=fmt)
        jobs.combine(spark, more, days, v2, existing=v1, fmt=fmt)
        rows = jobs.read_combined(spark, v2, fmt)
        assert rows.columns == [*COMBINED_COLUMNS, "Notes"]
        assert rows.count() == jobs.read_combined(spark, v1, fmt).count() + 5
        assert {r["Notes"] for r in rows.where("SiteID = 's9'").collect()} == {"late"}
        jobs.backfill(spark, v2, days, v3, fmt)
        counts = jobs.filter_excess(spark, v3, v4, fmt)
        kept = jobs.read_combined(spark, v4, fmt)
        assert "Notes" in kept.columns and kept.count() == counts["after"]
        encoded, _, site = training.encode(kept)
        assert any(c.startswith("Notes_note") for c in site)


def test_more_categories_than_a_table_had_columns(spark):
    rows = spark.range(2600).select(F.format_string("v%05d", "id").alias("c"))
    codes = fit_dictionaries(rows, ["c"])
    first = features.one_hot_columns(rows.where("c = 'v00007'"), ["c"], codes).first()
    assert len(first) == 2600 and sum(first) == 1 and first["c_v00007"] == 1


def test_every_group_is_assembled(spark):
    rows = [("a", datetime.date(2024, 5, d), 1.0, 1.0, 1.0) for d in range(1, 6)] * 2
    table = spark.createDataFrame(rows, "k string, Date date, Temperature double, Precipitation double, CloudCoverage double")
    got = sequence.assemble_sequence(table, ["k"]).first()
    assert got["sequence_days"] == 10 and not got["sequence_complete"]


def test_constant_columns_correlate_with_nothing(spark):
    rows = spark.range(1000).select(F.lit(0.1).alias("x"), F.col("id").cast("double").alias("y"))
    got = {(r["x"], r["y"]): r["r"] for r in stats.correlation_matrix(rows, ["x", "y"]).collect()}
    assert got == {("x", "x"): None, ("x", "y"): None, ("y", "x"): None, ("y", "y"): 1.0}


def test_missing_labels_are_no_hits_and_have_no_loss(spark):
    rows = [([0.9, 0.1], 0, 0), ([0.2, 0.8], 1, None), ([0.5, 0.5], None, None), ([0.3, 0.7], 1, 7)]
    table = spark.createDataFrame(rows, "probability array<double>, predicted int, label int")
    accuracy = evaluate.accuracy(table).first()
    whole = evaluate.evaluate(table.withColumn("split", F.lit("s"))).first()
    loss = evaluate.log_loss(table, plus_epsilon=True).first()
    assert (accuracy["n"], accuracy["accuracy"]) == (4, 0.25) == (whole["n"], whole["accuracy"])
    assert whole["n_scored"] == loss["n_scored"] == 1


def test_a_site_without_a_name_has_a_box(spark):
    rows = [(None, float(i)) for i in range(9)] + [("a", 1.0)]
    got = {r["s"]: r["median"] for r in boxplot.boxplot_stats(spark.createDataFrame(rows, "s string, x double"), "x", "s").collect()}
    assert got == {None: 4.0, "a": 1.0}


def test_existing_rows_are_not_shuffled_for_a_small_delivery(spark):
    existing = spark.range(5000).select(
        F.format_string("s%d", F.col("id") % 50).alias("SiteID"),
        F.date_add(F.lit(datetime.date(2020, 1, 1)), (F.col("id") / 50).cast("int")).alias("Date"),
        F.lit(True).alias("is_recorded"),
        F.col("id").alias("seq"),
        F.col("id").alias("payload"),
    )
    new = existing.limit(20).withColumn("SiteID", F.lit("new"))
    merged = merge_insert_only(existing, new, "seq", existing_unique=True)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert merged.count() == existing.count() + merged.where("SiteID = 'new'").count()


def test_exact_split_moves_no_row(spark):
    rows = spark.range(1000).withColumn("payload", F.lit("x"))
    plan = sequence.exact_split(rows, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
