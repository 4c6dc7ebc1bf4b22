"""Cleaning, dates and predicates on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.operators import calendar, clean
from fieldspark.schema import NA_TOKENS

NAN = float("nan")


def column(spark, values, kind="string", name="c"):
    schema = f"i int, {name} {kind}"
    return spark.createDataFrame(list(enumerate(values)), schema)


def values(df, name="c"):
    return [r[name] for r in df.orderBy("i").collect()]


def test_blank_to_null_trims_all_padding_and_keeps_none_action(spark):
    raw = column(spark, ["", " \t\r\n", " a b\t", None, "NA", "None", "none", "nan"])
    assert values(clean.blank_to_null(raw)) == [None, None, "a b", None, "NA", "None", "none", "nan"]
    assert values(clean.blank_to_null(raw, tokens=NA_TOKENS)) == [
        None, None, "a b", None, None, None, "none", None,
    ]


def test_to_number(spark):
    raw = ["1.5", " 2 ", "", None, "12abc", "abc", "nan", "-3e2", ".5x"]
    assert values(clean.to_number(column(spark, raw), ["c"])) == [1.5, 2, 0, 0, 0, 0, 0, -300, 0]
    prefix = clean.to_number(column(spark, raw), ["c"], default=-1.0, prefix=True)
    assert values(prefix) == [1.5, 2, -1, -1, 12, -1, -1, -300, 0.5]


def test_fills(spark):
    assert values(clean.fill_category(column(spark, [None, " ", "x"]), ["c"])) == ["Missing", "Missing", "x"]
    numbers = column(spark, [None, NAN, 2.0], "double")
    assert values(clean.fill_numeric(numbers, ["c", "absent"])) == [0.0, 0.0, 2.0]


def test_threshold_is_strict_and_nan_is_not_positive(spark):
    rows = column(spark, [0.2, None, 0.1, NAN, 0.10001], "double", "DipCount")
    assert values(clean.threshold_label(rows), "Breeding") == [1, 0, 0, 0, 1]


def test_conform_orders_fills_and_refuses(spark):
    rows = spark.createDataFrame([("7", "x", 1)], "b string, junk string, a int")
    wanted = T.StructType().add("a", "long").add("b", "integer").add("t", "double").add("who", "string")
    out = clean.conform(rows, wanted, required=["a"], defaults={"who": "?"})
    assert out.schema.simpleString() == "struct<a:bigint,b:int,t:double,who:string>"
    assert out.collect() == [(1, 7, None, "?")]
    with pytest.raises(ValueError, match="t"):
        clean.conform(rows, wanted, required=["t"])


def test_label_range(spark):
    rows = column(spark, [0, 1, 2, -1, None], "int")
    assert sorted(r["i"] for r in clean.check_range(rows, "c", 2).collect()) == [2, 3, 4]
    with pytest.raises(Exception, match="label outside"):
        clean.check_range(rows, "c", 2, strict=True).collect()
    assert clean.check_range(rows.where("i < 2"), "c", 2, strict=True).count() == 2


def test_excess_rows(spark):
    rows = spark.createDataFrame(
        [(0, "", "none"), (1, "  ", "NONE"), (2, None, "None"), (3, "", None), (4, "5", "none"), (5, "", "Pump")],
        "i int, Temperature string, Action string",
    )
    assert sorted(r["i"] for r in clean.drop_excess(rows).collect()) == [3, 4, 5]
    assert clean.filter_report(rows, ~clean.is_excess()).collect() == [(6, 3, 3)]


def test_recorded_only_keeps_missing_and_other_case(spark):
    rows = column(spark, ["none", "None", None, "Dredge"], name="Action")
    assert values(clean.recorded_only(rows), "Action") == ["None", None, "Dredge"]


def test_mask_synthetic_in_text_and_typed_tables(spark):
    text = spark.createDataFrame(
        [("a", "3", "x", "1", "m", True), ("a", "3", "x", "1", "m", False)],
        "TreatedBy string, Wetness string, Action string, DipCount string, Material string, is_recorded boolean",
    )
    assert clean.mask_synthetic(text).drop("is_recorded").collect() == [
        ("a", "3", "x", "1", "m"),
        ("none", "-1", "none", None, None),
    ]
    typed = text.withColumn("Wetness", F.col("Wetness").cast("double"))
    assert [r["Wetness"] for r in clean.mask_synthetic(typed).collect()] == [3.0, -1.0]


DATES = ["09/08/2024", "9/8/2024", "2024-09-08", "13/01/2024", "9/8/24", "", None, "02/29/2024", "02/29/2023"]


def test_date_policies(spark):
    day = datetime.date(2024, 9, 8)
    raw = column(spark, DATES, name="Date")
    kept = calendar.parse_us_date(raw, on_error="keep")
    assert values(kept, "Date") == [
        day, day, None, None, None, None, None, datetime.date(2024, 2, 29), None,
    ]
    assert calendar.parse_us_date(raw).count() == 3
    with pytest.raises(Exception, match="unreadable date"):
        calendar.parse_us_date(raw, on_error="fail").collect()
    zeros = calendar.date_parts(calendar.date_ordinal(kept)).where("i = 2")
    assert zeros.select("DateOrdinal", "Month", "Day", "Year").collect() == [(0, 0, 0, 0)]


def test_ordinal_counts_from_year_one(spark):
    days = [datetime.date(1, 1, 1), datetime.date(1969, 12, 31), datetime.date(2024, 9, 8)]
    rows = calendar.date_ordinal(column(spark, days, "date", "Date"))
    assert values(rows, "DateOrdinal") == [d.toordinal() for d in days]


def test_format_date(spark):
    rows = spark.createDataFrame(
        [(0, datetime.date(2024, 1, 5), "raw"), (1, None, "raw")], "i int, c date, t string"
    )
    assert values(calendar.format_date(rows, "c")) == ["01/05/2024", None]
    assert values(calendar.format_date(rows, "c", "iso", "t")) == ["2024-01-05", "raw"]


def test_lookback_is_oldest_first_and_skips_missing_dates(spark):
    rows = column(spark, [datetime.date(2024, 3, 2), None], "date", "Date")
    out = calendar.lookback_expand(rows).collect()
    assert [r["Date"].isoformat() for r in out] == [
        "2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01", "2024-03-02",
    ]
    assert [r["is_recorded"] for r in out] == [False] * 4 + [True]


def test_missing_weather_dates_asks_once_per_blank_day(spark):
    d1, d2, d3 = (datetime.date(2024, 1, n) for n in (1, 2, 3))
    rows = spark.createDataFrame([(d1, ""), (d1, None), (d2, " "), (d3, "4")], "Date date, Temperature string")
    weather = spark.createDataFrame([(d2,)], "Date date")
    assert calendar.missing_weather_dates(rows, weather, only_blank="Temperature").collect() == [(d1,)]


def test_split_features_names(spark):
    rows = spark.createDataFrame([(1, 2.0, 3, 4)], "SiteID int, Temperature double, Month int, Breeding int")
    assert clean.split_features(rows) == (["Temperature", "Month"], ["SiteID"])
