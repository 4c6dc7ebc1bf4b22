"""Readers and writers on small landed files."""

import datetime
import json

import pytest

from fieldspark.operators.clean import conform, threshold_label
from fieldspark.plans.combined import typed
from fieldspark.schema import COMBINED, COMBINED_COLUMNS, COMBINED_TEXT, NA_TOKENS, text_schema
from fieldspark.sources.readers import (
    read_inspections,
    read_positional,
    read_run_log,
    read_weather_json,
)
from fieldspark.sources.writers import write_table

ABC = text_schema(["a", "b", "c"])


def land(tmp_path, text, name="in.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_columns_by_name_absent_and_malformed(spark, tmp_path):
    path = land(tmp_path, "c,a\n1,x\n\n2,\"y, z\"\n3,w,too,many\n")
    rows = read_inspections(spark, path, ABC, seq="seq").orderBy("seq").collect()
    assert [(r["a"], r["b"], r["c"]) for r in rows[:2]] == [("x", None, "1"), ("y, z", None, "2")]
    assert [r["_bad_record"] is None for r in rows] == [True, True, False]


def test_repeated_header_means_the_last_one(spark, tmp_path):
    path = land(tmp_path, "a,b,a\n1,2,3\n")
    assert read_inspections(spark, path, ABC).drop("_bad_record").collect() == [("3", "2", None)]


def test_a_name_that_ends_in_its_position_is_no_repeat(spark, tmp_path):
    path = land(tmp_path, "SiteID,Date,x,y,z,w,Date6\ns,d,1,2,3,4,other\n")
    row = read_inspections(spark, path, text_schema(["SiteID", "Date"]), others=True).first()
    assert row["Date"] == "d" and row["Date6"] == "other"


def test_files_with_other_headers(spark, tmp_path):
    land(tmp_path, "SiteID,Action\ns1,Pump\n", "a.csv")
    land(tmp_path, "Action,SiteID,Notes\nDredge,s2,n\n", "b.csv")
    schema = text_schema(["SiteID", "Action"])
    with pytest.raises(Exception, match="(?i)header"):
        read_inspections(spark, str(tmp_path), schema).collect()
    rows = read_inspections(spark, str(tmp_path), schema, mixed_headers=True, others=True, seq="seq")
    got = [(r["SiteID"], r["Action"], r["Notes"]) for r in rows.orderBy("seq").collect()]
    assert got == [("s1", "Pump", None), ("s2", "Dredge", "n")]


def test_unreadable_weather_lines_stay_visible(spark, tmp_path):
    path = land(tmp_path, '{"date": "2024-05-01", "data": {"weather": []}}\n{broken\n', "w.json")
    assert read_weather_json(spark, path).count() == 1
    rows = read_weather_json(spark, path, bad_records=True).collect()
    assert sorted(r["_bad_record"] or "" for r in rows) == ["", "{broken"]


def test_file_order_over_files_and_partitions(spark, tmp_path):
    for n in range(4):
        land(tmp_path, "a\n" + "".join(f"{n * 100 + i}\n" for i in range(100)), f"part-{n}.csv")
    rows = read_inspections(spark, str(tmp_path), text_schema(["a"]), seq="seq").collect()
    assert sorted((r["seq"], int(r["a"])) for r in rows) == [(i, i) for i in range(400)]


@pytest.mark.parametrize(
    "text,dialect,encoding",
    [
        ("a;b;c\n1;'x;y';3\n", {"separator": ";", "quote": "'"}, "utf-8"),
        ("a,b,c\n 1 , x;y ,3\n", {"trim": True}, "utf-8"),
        ("# note\na,b,c\n# note\n1,x;y,3\n", {"comment": "#"}, "utf-8"),
        ("﻿a,b,c\n1,x;y,3\n", {}, "utf-8"),
        ("﻿a,b,c\n1,x;y,3\n", {"encoding": "UTF-16"}, "utf-16-le"),
        ("﻿a,b,c\n1,x;y,3\n", {"encoding": "UTF-16"}, "utf-16-be"),
        ("a,b,c\r\n1,x;y,3\r\n", {}, "utf-8"),
        ("a,b,c\n\n\n1,x;y,3\n\n", {}, "utf-8"),
    ],
)
def test_dialects(spark, tmp_path, text, dialect, encoding):
    path = land(tmp_path, text, encoding=encoding)
    assert read_inspections(spark, path, ABC, dialect).drop("_bad_record").collect() == [("1", "x;y", "3")]


def test_quotes_and_line_breaks(spark, tmp_path):
    path = land(tmp_path, 'a,b,c\n1,"two ""quoted""\nlines",3\n')
    rows = read_inspections(spark, path, ABC, {"quoted_line_breaks": True}).drop("_bad_record").collect()
    assert rows == [("1", 'two "quoted"\nlines', "3")]
    with pytest.raises(ValueError, match="dialect"):
        read_inspections(spark, path, ABC, {"colour": "red"})


def test_positional_pads_cuts_and_trims(spark, tmp_path):
    path = land(tmp_path, "any,header,here\nA , 1\n\nB,2,3,4,5\n ,\t,9\n")
    rows = read_positional(spark, path, ["x", "y", "z"]).collect()
    assert rows == [("A", "1", None), ("B", "2", "3"), (None, None, "9")]


INSPECTED = (
    "SiteID,Temperature,Date,DipCount,Wetness,Action,Material\n"
    "A,25,09/08/2024,0.2,0.5,Dredge,None\n"
    "B,30,9/9/2024,,0.8,Pump,Water\n"
    "C,28,09/10/2024,0.1,0.3,none,Concrete\n"
    "D,NA,unknown,1,x,Pump,Water\n"
)


def test_text_to_typed_table(spark, tmp_path):
    raw = read_inspections(spark, land(tmp_path, INSPECTED), COMBINED_TEXT)
    rows = threshold_label(typed(raw, NA_TOKENS)).orderBy("SiteID").collect()
    assert [r["Breeding"] for r in rows] == [1, 0, 0]
    assert rows[0]["Material"] is None and rows[2]["Action"] == "none"
    assert rows[1]["Date"] == datetime.date(2024, 9, 9) and rows[1]["DipCount"] is None
    kept = typed(raw, NA_TOKENS, on_error="keep").where("SiteID = 'D'").first()
    assert (kept["Date"], kept["Temperature"], kept["Wetness"]) == (None, None, None)


@pytest.mark.parametrize("fmt", ["csv", "parquet", "orc", "json"])
def test_write_then_read(spark, tmp_path, fmt):
    raw = read_inspections(spark, land(tmp_path, INSPECTED), COMBINED_TEXT)
    rows = typed(raw, NA_TOKENS).select(*COMBINED_COLUMNS)
    path = write_table(rows, str(tmp_path / "out"), fmt)
    if fmt == "csv":
        back = typed(read_inspections(spark, path, COMBINED_TEXT))
    else:
        back = conform(spark.read.schema(COMBINED).format(fmt).load(path), COMBINED)
    back = back.select(*COMBINED_COLUMNS)
    assert back.schema == COMBINED
    assert sorted(back.collect(), key=str) == sorted(rows.collect(), key=str)
    with pytest.raises(ValueError, match="format"):
        write_table(rows, path, "xls")


def test_weather_payloads(spark, tmp_path):
    def hour(c):
        return [{"cloudcover": c}, {"cloudcover": "99"}]

    def day(**entry):
        return {"weather": [entry, {"avgtempC": "-99"}]}

    payloads = [
        {"date": "2024-05-01", "data": day(avgtempC="12", precipMM="0.5", hourly=hour("40"))},
        {"date": "2024-05-02", "data": {"weather": []}},
        {"date": "2024-05-03"},
        {"date": "2024-05-04", "data": day(avgtempC="", precipMM="1.0", hourly=[])},
        {"data": day(date="2024-05-05", avgtempC="7", precipMM="x", hourly=hour("nan"))},
        {"data": {"weather": []}},
    ]
    path = land(tmp_path, "\n".join(map(json.dumps, payloads)) + "\nnot json\n", "days.json")
    rows = {r["Date"].day: tuple(r)[1:] for r in read_weather_json(spark, path).collect()}
    assert rows == {
        1: (12.0, 0.5, 40.0),
        2: (None, None, None),
        3: (None, None, None),
        4: (None, 1.0, None),
        5: (7.0, None, None),
    }


def test_run_log(spark, tmp_path):
    path = land(tmp_path, "Epoch,TrainingLoss,ValidationAccuracy\n1,nan,0.634921\n2,0.5,\nx,bad,0.1\n")
    rows = read_run_log(spark, path).collect()
    assert rows == [(1, None, 0.634921), (2, 0.5, None), (None, None, 0.1)]
