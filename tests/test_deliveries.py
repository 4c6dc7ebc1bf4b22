"""Row places without a sort, batches without copies, dictionaries that grow."""

from pyspark.sql import functions as F

from fieldspark.operators import sequence, stats
from fieldspark.schema import text_schema
from fieldspark.sources.readers import read_inspections


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_order_rows_as_the_files_do(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"part-{n}.csv").write_text("a\n" + "".join(f"{n * 50 + i}\n" for i in range(50)))
    rows = read_inspections(spark, str(tmp_path), text_schema(["a"]), place="at")
    assert [int(r["a"]) for r in rows.orderBy("at").collect()] == list(range(150))
    text = plan_of(rows)
    assert "Sort" not in text and "Exchange" not in text and "RDD" not in text.replace("FileScan", "")


def test_both_a_place_and_a_number(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a\n5\n6\n7\n")
    rows = read_inspections(spark, str(tmp_path / "x.csv"), text_schema(["a"]), place="at", seq="seq")
    assert [(r["seq"], r["a"]) for r in rows.orderBy("at").collect()] == [(0, "5"), (1, "6"), (2, "7")]


def test_batches_write_only_their_keys(spark, monkeypatch):
    written = []
    monkeypatch.setattr(
        "fieldspark.operators.ranking.cut_lineage", lambda df: (written.append(df.columns), df.checkpoint())[1]
    )
    df = spark.range(105).select((F.col("id") * 11 % 105).alias("k"), F.lit("wide").alias("payload"))
    got = sequence.assign_batches(df.unionByName(df.limit(0)), "k", 10)
    assert written == [["k", "_slot"]]
    assert got.columns == ["k", "payload", "batch"]
    assert sorted((r["k"], r["batch"]) for r in got.collect()) == [(k, k // 10) for k in range(100)]


def test_batches_of_a_missing_key(spark):
    df = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b")], "k int, v string")
    got = {r["v"]: r["batch"] for r in sequence.assign_batches(df, "k", 2, drop_last=False).collect()}
    assert got == {"n": 0, "a": 0, "b": 1}


def test_codes_stay_when_values_come(spark):
    schema = "seq long, c string, d int"
    first = spark.createDataFrame([(1, "z", 5), (2, "a", None), (3, "z", 4)], schema)
    later = spark.createDataFrame([(9, "b", 5), (7, "a", 8), (8, "c", 6), (10, None, 6)], schema)
    old = stats.fit_dictionaries(first, ["c", "d"], "first_seen", "seq")
    grown = stats.extend_dictionaries(old, later, ["c", "d"], order_col="seq")
    codes = {(r["column"], r["value"]): r["code"] for r in grown.collect()}
    assert codes == {
        ("c", "z"): 0, ("c", "a"): 1, ("c", "c"): 2, ("c", "b"): 3,
        ("d", "5"): 0, ("d", "4"): 1, ("d", "8"): 2, ("d", "6"): 3,
    }
    again = stats.extend_dictionaries(grown, later, ["c", "d"], order_col="seq")
    assert {(r["column"], r["value"]): r["code"] for r in again.collect()} == codes
    fresh = stats.extend_dictionaries(old.where("column = 'c'"), later, ["d"], order="sorted")
    assert {r["value"]: r["code"] for r in fresh.where("column = 'd'").collect()} == {"5": 0, "6": 1, "8": 2}
