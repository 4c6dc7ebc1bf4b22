"""Run a registered query and its SQL twin and compare them by value."""

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def database(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def _cell(x):
    if isinstance(x, float):
        return ("num", "nan" if math.isnan(x) else repr(x))
    if isinstance(x, bool):
        return ("bool", x)
    if isinstance(x, int):
        return ("num", repr(float(x)))
    if isinstance(x, datetime.datetime):
        return ("ts", x.isoformat())
    if isinstance(x, (list, tuple)):
        return ("list", tuple(_cell(e) for e in x))
    return (type(x).__name__, str(x))


KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def spark_result(df):
    names = sorted(df.columns)
    kinds = [KINDS.get(df.schema[n].dataType.simpleString(), df.schema[n].dataType.simpleString()) for n in names]
    rows = sorted(tuple(_cell(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    return names, kinds, rows


def sql_result(db, sql):
    relation = db.sql(sql)
    order = sorted(range(len(relation.columns)), key=lambda i: relation.columns[i])
    names = [relation.columns[i] for i in order]
    kinds = [str(relation.types[i]) for i in order]
    rows = sorted(tuple(_cell(r[i]) for i in order) for r in relation.fetchall())
    return names, kinds, rows


def differences(spark_side, sql_side):
    """Empty when equal, otherwise a short account of what differs."""
    (n1, k1, r1), (n2, k2, r2) = spark_side, sql_side
    if n1 != n2:
        return f"columns {n1} against {n2}"
    if k1 != k2:
        return f"types {list(zip(n1, k1, k2))}"
    if len(r1) != len(r2):
        return f"{len(r1)} rows against {len(r2)}"
    wrong = [(a, b) for a, b in zip(r1, r2) if a != b]
    return f"{len(wrong)} of {len(r1)} rows, first {wrong[0]}" if wrong else ""
