"""Awkward rows that every operator must take."""

import random

from pyspark.sql import functions as F

CLASHES = (
    "n_chars lang source unit node label kept removed score _id _component key mark words "
    "n_tokens pack bucket sketch rank ids"
).split()


def prose(seed, n):
    rng = random.Random(seed)
    words = ["river", "stone", "the", "of", "light", "énorme", "and", "über", "casa", "is", "wind", "no"]
    text = []
    for i in range(n):
        word = rng.choice(words) + rng.choice(["", "s", "ing", "ly", "est"]) * (rng.random() < 0.6)
        text.append(word + (".\n" if rng.random() < 0.08 else " "))
    return "".join(text)


def awkward():
    long = prose(1, 4000)
    return [
        (1, prose(2, 120)),
        (2, prose(2, 120) + " tail"),
        (3, ""),
        (4, None),
        (5, long),
        (6, long),
        (7, long[:-300] + prose(9, 60)),
        (8, "x"),
        (8, "x"),
        (9, "   \n\t "),
        (10, "a" * 3000),
        (11, "日本語のテキスト " * 40),
        (12, "<|endoftext|> don't 12.5% É\x00\x1c|| !!"),
        (13, prose(3, 200)),
        (13, prose(3, 200)),
        (13, prose(4, 200)),
        (None, prose(2, 120)),
        (None, None),
    ]


def documents(spark, rows=None, clashes=True):
    """A table of (doc_id, text) with further columns whose names operators use inside."""
    docs = spark.createDataFrame(awkward() if rows is None else rows, "doc_id long, text string")
    for name in CLASHES if clashes else ():
        docs = docs.withColumn(name, F.lit(None).cast("string") if name != "n_chars" else F.lit(7))
    return docs


def empty(spark):
    return documents(spark, [])


def collected(df, *columns):
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))
