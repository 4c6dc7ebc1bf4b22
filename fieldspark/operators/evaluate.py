"""Scores of predictions against labels; all rows count.

One rule for all: a row without a label, or without a prediction, is no hit. It has no
loss either, nor has one whose label is outside the array; ``n_scored`` counts the rows
that have one.
"""

from pyspark.sql import functions as F

from fieldspark.functions import vectors


def _hit(predicted, label):
    return F.coalesce(predicted == label, F.lit(False)).cast("int")


def accuracy(df, predicted="predicted", label="label"):
    hit = F.avg(_hit(F.col(predicted), F.col(label)))
    return df.agg(F.count(F.lit(1)).alias("n"), hit.alias("accuracy"))


def log_loss(df, probabilities="probability", label="label", plus_epsilon=False):
    loss = vectors.true_class_loss(F.col(probabilities), F.col(label), plus_epsilon)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count(loss).alias("n_scored"), F.avg(loss).alias("log_loss")
    )


def batch_rollup(df, keys, metric):
    """Mean of a metric per epoch, batch or both."""
    return df.groupBy(*keys).agg(F.avg(metric).alias(f"mean_{metric}"))


def evaluate(df, split="split", probabilities="probability", label="label"):
    """Loss and accuracy per split in one pass."""
    scored = df.select(
        split,
        vectors.true_class_loss(F.col(probabilities), F.col(label)).alias("_loss"),
        _hit(vectors.argmax(F.col(probabilities)), F.col(label)).alias("_hit"),
    )
    return scored.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_loss").alias("n_scored"),
        F.avg("_loss").alias("loss"),
        F.avg("_hit").alias("accuracy"),
    )
