"""A training corpus from raw documents: good ones, one of each group of near copies,
without passages that an earlier document has, packed into sequences.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet to
the shared folder and read again for the next one, so a stage that fails is repeated
from files and nothing before it is computed twice. All stages but the last return
the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import functions as F

from fieldspark.llm import jaccard_join, line_quality, packing, repeats
from fieldspark.llm.common import table
from fieldspark.storage import new_path

VOCABULARY = "word_bpe_49k.json"


def quality(spark, docs, sf_dir):
    """Documents that the line classifier scores 0.5 or more.

    It learns from the labelled documents among ``docs``. A null text scores as an
    empty one; without labels nothing is rejected.
    """
    model = line_quality.train(docs, table(spark, sf_dir, "labels"))
    return line_quality.keep_good(docs, model)


def near_copies(spark, docs, sf_dir):
    """Of documents connected by a Jaccard similarity of 0.8 or more of their
    five-word shingles, the one with the smallest id."""
    return jaccard_join.keep_smallest(docs, words=5, percent=80)


def repeated_passages(spark, docs, sf_dir):
    """Texts without the 50-byte strings that a document with a smaller id has.

    A character that loses a byte goes as a whole; no other character does. ``n_chars``,
    where there is such a column, is that of the new text; a null text stays null. Other
    columns stay as they are, whatever they are called.
    """
    # Under names of their own, no column meets one that the operator adds.
    own = {c: f"_column_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.toDF(*own.values())
    cleaned = repeats.remove_repeats(renamed, own["doc_id"], own["text"], whole_characters=True)
    text = F.when(F.col(own["text"]).isNotNull(), F.col("kept").cast("string"))
    columns = {c: F.col(n) for c, n in own.items()}
    columns["text"] = text
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.coalesce(F.length(text), F.col(own["n_chars"])).cast(kind)
    return cleaned.select([c.alias(name) for name, c in columns.items()])


def packed(spark, docs, sf_dir):
    """The documents' tokens in sequences of 4096."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

# Fitting, byte-level removal and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``; the pieces of the packed corpus."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
