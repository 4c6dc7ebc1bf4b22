"""Files of UTF-16 and UTF-32, read by byte ranges."""

import pytest
from pyspark.sql import functions as F

from fieldspark.schema import text_schema
from fieldspark.sources import readers
from fieldspark.sources.readers import read_inspections

ABC = text_schema(["a", "b", "c"])
# Names of the reader, by names of Python.
ENCODINGS = {"utf-16-le": "utf-16le", "utf-16-be": "utf-16be", "utf-16": "utf-16", "utf-32-be": "utf-32", "utf-32": "utf-32"}
SPLIT = "spark.sql.files.maxPartitionBytes"


def land(tmp_path, text, encoding, name="in.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", sorted(ENCODINGS))
def test_a_wide_file_is_many_tasks(spark, tmp_path, encoding):
    lines = [f'{i},"é {i}, x",日本{i}' for i in range(3000)]
    path = land(tmp_path, "c,a,b\r\n" + "\r\n".join(lines) + "\r\n", encoding)
    spark.conf.set(SPLIT, "8k")
    try:
        rows = read_inspections(spark, path, ABC, {"encoding": ENCODINGS[encoding]}, place="at")
        assert rows.rdd.getNumPartitions() > 4
        got = rows.orderBy("at").drop("at").collect()
    finally:
        spark.conf.unset(SPLIT)
    assert got == [(f"é {i}, x", f"日本{i}", str(i), None) for i in range(3000)]


@pytest.mark.parametrize("encoding", ["utf-16", "utf-32"])
def test_wide_and_narrow_files_read_the_same(spark, tmp_path, encoding):
    text = "a;b\n1;' x'\n\n# note\n2;y;z\n;\n3;''''\n"
    dialect = {"separator": ";", "quote": "'", "comment": "#"}
    narrow = read_inspections(spark, land(tmp_path, text, "utf-8", "n.csv"), ABC, dialect).collect()
    wide = read_inspections(spark, land(tmp_path, text, encoding, "w.csv"), ABC, {**dialect, "encoding": encoding}).collect()
    assert sorted(map(str, wide)) == sorted(map(str, narrow)) and len(wide) == 4


def spy(monkeypatch):
    seen = []
    real = readers._wide_lines
    monkeypatch.setattr(readers, "_wide_lines", lambda *a: (seen.append(real(*a)), seen[-1])[1])
    return seen


def test_line_ends_across_characters_are_seen(spark, tmp_path, monkeypatch):
    """U+0A15 and U+0100 side by side hold the bytes of a line end of UTF-16LE."""
    seen = spy(monkeypatch)
    assert b"\n\0" in "ਕĀ".encode("utf-16-le")
    path = land(tmp_path, "a,b\nxਕĀy,1\nz,2\n", "utf-16-le")
    rows = read_inspections(spark, path, ABC, {"encoding": "utf-16le"}).drop("_bad_record").collect()
    assert rows == [("xਕĀy", "1", None), ("z", "2", None)] and seen == [None]


def test_a_repeated_header_line_stays_a_row(spark, tmp_path, monkeypatch):
    seen = spy(monkeypatch)
    path = land(tmp_path, "a,b\n1,2\na,b\n", "utf-16")
    rows = read_inspections(spark, path, ABC, {"encoding": "utf-16"}).drop("_bad_record").collect()
    assert rows == [("1", "2", None), ("a", "b", None)] and seen == [None]


def test_several_wide_files(spark, tmp_path, monkeypatch):
    seen = spy(monkeypatch)
    land(tmp_path, "a,b\n1,2\n", "utf-16-le", "x.csv")
    (tmp_path / "y.csv").write_bytes(b"\xfe\xff" + "a,b\n3,4\n".encode("utf-16-be"))
    rows = read_inspections(spark, str(tmp_path), ABC, {"encoding": "utf-16"})
    # The first file has no mark: its bytes are taken in the other order and do not match.
    assert seen == [None]
    (tmp_path / "x.csv").write_bytes(b"\xff\xfe" + "a,b\n1,2\n".encode("utf-16-le"))
    rows = read_inspections(spark, str(tmp_path), ABC, {"encoding": "utf-16"}, seq="n")
    assert seen[1] is not None
    assert [(r["n"], r["a"], r["b"]) for r in rows.orderBy("n").collect()] == [(0, "1", "2"), (1, "3", "4")]
    land(tmp_path, "b,a\n5,6\n", "utf-16", "z.csv")
    mixed = read_inspections(spark, str(tmp_path), ABC, {"encoding": "utf-16"}, mixed_headers=True)
    assert sorted((r["a"], r["b"]) for r in mixed.select(F.col("a"), F.col("b")).collect()) == [("1", "2"), ("3", "4"), ("6", "5")]
