"""Jobs for spark-submit: combine, backfill, filter, describe, train.

    spark-submit -m fieldspark.jobs combine --inspections in.csv --weather days.json --out v2
"""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.cells import parse_us_date
from fieldspark.operators.clean import (
    blank_to_null,
    drop_excess,
    filter_report,
    is_excess,
)
from fieldspark.operators.merge import backfill_weather
from fieldspark.operators.model import run_history
from fieldspark.plans import training
from fieldspark.plans.combined import build_combined, typed, with_recorded_flag
from fieldspark.plans.describe import describe
from fieldspark.schema import (
    COMBINED,
    COMBINED_COLUMNS,
    COMBINED_TEXT,
    LOOKBACK_DAYS,
    NA_TOKENS,
)
from fieldspark.sources.readers import read_inspections, read_weather_json
from fieldspark.sources.writers import FORMATS, write_table
from fieldspark.storage import cut_lineage


def read_combined(spark, path, fmt="csv", tokens=(), on_error="drop", place=None):
    """A combined table as typed rows, from CSV or from a typed format."""
    if fmt == "csv":
        rows = read_inspections(spark, path, COMBINED_TEXT, place=place, others=True)
        return typed(rows.drop("_bad_record"), tokens, on_error)
    rows = _conformed(spark, path, fmt)
    if not place:
        return rows
    # Files of a typed format have no line order; any fixed order tells repeats apart.
    row = F.monotonically_increasing_id()
    return rows.withColumn(
        place, F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), row.alias("row"))
    )


def _conformed(spark, path, fmt):
    """The known columns with their types, then all others as they are."""
    rows = spark.read.format(fmt).load(path)
    others = [F.col(f"`{c}`") for c in rows.columns if c not in COMBINED_COLUMNS]
    known = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in COMBINED
    ]
    return rows.select(*known, *others)


def _in_order(rows):
    """Known columns first, then the others; not the helpers of a merge."""
    return rows.select(
        *COMBINED_COLUMNS,
        *[F.col(f"`{c}`") for c in rows.columns if c not in {*COMBINED_COLUMNS, *training.HELPERS}],
    )


def combine(
    spark,
    inspections,
    weather,
    out,
    existing=None,
    policy="prefer_recorded",
    existing_unique=False,
    fmt="csv",
):
    """Expand inspections, attach landed weather, merge into an existing table."""
    raw = read_inspections(spark, inspections, place="seq", others=True).drop("_bad_record")
    there = None
    if existing:
        there = with_recorded_flag(read_combined(spark, existing, fmt, on_error="fail", place="seq"))
    merged = build_combined(
        typed(raw),
        read_weather_json(spark, weather),
        "seq",
        existing=there,
        policy=policy,
        existing_unique=existing_unique,
    )
    return write_table(_in_order(merged), out, fmt)


def _as_landed(spark, path, fmt):
    """The table as it is: CSV stays text, so nothing unreadable is lost."""
    if fmt == "csv":
        return _in_order(read_inspections(spark, path, COMBINED_TEXT, others=True))
    return _conformed(spark, path, fmt)


def backfill(spark, combined, weather, out, fmt="csv"):
    """Weather for the rows whose temperature is blank, other rows unchanged."""
    rows = _as_landed(spark, combined, fmt)
    day = parse_us_date(F.col("Date")) if fmt == "csv" else F.col("Date")
    daily = read_weather_json(spark, weather).withColumnRenamed("Date", "_day")
    filled = backfill_weather(rows.withColumn("_day", day), daily, "_day")
    return write_table(filled.drop("_day"), out, fmt)


def filter_excess(spark, combined, out, fmt="csv"):
    """Drop rows with neither weather nor action; returns the counts."""
    rows = blank_to_null(_as_landed(spark, combined, fmt), tokens=NA_TOKENS)
    write_table(drop_excess(rows), out, fmt)
    return filter_report(rows, ~is_excess()).first().asDict()


def describe_tables(spark, combined, out, fmt="csv"):
    rows = cut_lineage(read_combined(spark, combined, fmt, NA_TOKENS, "fail").select(*COMBINED_COLUMNS))
    for name, table in describe(rows).items():
        write_table(table, f"{out}/{name}", "parquet")
    return out


def train(spark, combined, out, fmt="csv", epochs=25, iterations=5, days=LOOKBACK_DAYS):
    """Matrices, model, run history and loss and accuracy per split. The inputs are the
    look-back days, their kernels, the numbers and all categories, sparse."""
    rows = read_combined(spark, combined, fmt, NA_TOKENS, "fail")
    # Typed files are read again as they are; text is converted once.
    rows = cut_lineage(rows) if fmt == "csv" else rows
    matrices = training.sparse_matrices(rows, days=days, kernels=True)
    write_table(matrices.names, f"{out}/names", "parquet")
    write_table(matrices.rows, f"{out}/matrices", "parquet")
    landed = spark.read.parquet(f"{out}/matrices")
    model, history, scores = training.train_and_evaluate(landed, epochs=epochs, iterations=iterations)
    model.write().overwrite().save(f"{out}/model")
    write_table(run_history(spark, history), f"{out}/history", "parquet")
    write_table(scores, f"{out}/scores", "parquet")
    return out


def main(argv=None):
    parser = argparse.ArgumentParser(prog="fieldspark.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name, fn, *required, **optional):
        sub = jobs.add_parser(name, help=fn.__doc__)
        for r in required:
            sub.add_argument(f"--{r}", required=True)
        for o, default in optional.items():
            if default is False:
                sub.add_argument(f"--{o}", action="store_true")
            else:
                sub.add_argument(f"--{o}", default=default, type=type(default) if default else str)
        sub.add_argument("--fmt", default="csv", choices=FORMATS)
        sub.set_defaults(fn=fn)

    job(
        "combine",
        combine,
        "inspections",
        "weather",
        "out",
        existing=None,
        policy="prefer_recorded",
        existing_unique=False,
    )
    job("backfill", backfill, "combined", "weather", "out")
    job("filter", filter_excess, "combined", "out")
    job("describe", describe_tables, "combined", "out")
    job("train", train, "combined", "out", epochs=25, iterations=5, days=LOOKBACK_DAYS)
    args = vars(parser.parse_args(argv))
    fn, name = args.pop("fn"), args.pop("job")
    spark = SparkSession.builder.appName(f"fieldspark {name}").getOrCreate()
    print(fn(spark, **args))


if __name__ == "__main__":
    main()
