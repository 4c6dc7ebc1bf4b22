"""Distributed scoring and training of the classifier."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from fieldspark.functions import vectors
from fieldspark.operators.evaluate import evaluate
from fieldspark.operators.perceptron import Solver

# Widths of the hidden layers.
HIDDEN_LAYERS = (128, 64, 32, 16)


def read_layers(weights):
    """Weight table (layer, neuron, bias, weights) to a list of matrices.

    Its size is that of the network, never that of the data.
    """
    rows = weights.orderBy("layer", "neuron").collect()
    layers = {}
    for r in rows:
        layers.setdefault(r["layer"], []).append(r)
    return [
        (np.array([r["weights"] for r in group], float), np.array([r["bias"] for r in group], float))
        for _, group in sorted(layers.items())
    ]


def dense_score(df, col, layers, out="scores"):
    """Affine layers with ReLU between them, batch by batch in numpy.

    NaN and infinity count as 0 on entry and after each layer; a missing vector has
    no scores. Matrix products on Arrow batches; the weights travel once per
    executor.
    """
    shared = df.sparkSession.sparkContext.broadcast(layers)

    @F.pandas_udf("array<double>")
    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        stack = shared.value
        for batch in batches:
            out = [None] * len(batch)
            there = np.flatnonzero(batch.notna().to_numpy())
            if not len(there):
                yield pd.Series(out, dtype=object)
                continue
            stacked = np.stack(batch.iloc[there].to_numpy()).astype(float)
            x = np.nan_to_num(stacked, nan=0.0, posinf=0.0, neginf=0.0)
            for i, (w, b) in enumerate(stack):
                x = np.nan_to_num(x @ w.T + b, nan=0.0, posinf=0.0, neginf=0.0)
                if i < len(stack) - 1:
                    x = np.maximum(x, 0.0)
            for i, scores in zip(there, x):
                out[i] = scores
            yield pd.Series(out, dtype=object)

    return df.withColumn(out, forward(vectors.doubles(F.col(col))))


def _with_vector(df, features):
    if isinstance(df.schema[features].dataType, VectorUDT):
        return df.withColumn("_features", F.col(features))
    return df.withColumn("_features", array_to_vector(vectors.doubles(F.col(features))))


def train_classifier(
    df,
    features="features",
    label="label",
    classes=2,
    hidden=HIDDEN_LAYERS,
    seed=42,
    max_iter=25,
    initial_weights=None,
    earlier=None,
):
    """Fit the hidden stack on an array or vector column; gradients are summed over all
    partitions, only the weights return to the driver.

    Given an ``earlier`` result on the same rows, its solver goes on for ``max_iter``
    iterations. The result is Spark ML's model; its ``summary()`` is that of the run.
    """
    if earlier is not None:
        run = earlier.summary()
        return _fitted(run.trainer, df.sparkSession, run.solver.run(max_iter))
    first = df.select(features).first()
    if first is None:
        raise ValueError("there are no rows to train on")
    width = len(first[0])
    layers = [width, *hidden, classes]
    trainer = MultilayerPerceptronClassifier(
        featuresCol="_features",
        labelCol=label,
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        predictionCol="_prediction",
        layers=layers,
        seed=seed,
        maxIter=0,
    )
    if initial_weights is None:
        initial_weights = _network(trainer, df.sparkSession).weights
    rows = _with_vector(df.select(features, label), features)
    rows = rows.select(F.col("_features").alias("features"), F.col(label).cast("double").alias("label"))
    solver = Solver(rows, layers, initial_weights.toArray().astype(float)).run(max_iter)
    return _fitted(trainer, df.sparkSession, solver)


class Run:
    """What a fitted network's ``summary()`` tells: the objective before the first and
    after every iteration. It holds the solver too."""

    def __init__(self, trainer, solver):
        self.trainer, self.solver = trainer, solver
        self.objectiveHistory = list(solver.objectives)
        self.totalIterations = len(solver.objectives) - 1


def _network(trainer, spark):
    """Spark ML's network with the trainer's initial weights, which no iteration changes:
    one row of zeros tells it the width."""
    row = [(Vectors.sparse(trainer.getLayers()[0], [], []), 0.0)]
    label = trainer.getLabelCol()
    return trainer.fit(spark.createDataFrame(row, ["_features", label]))


def _fitted(trainer, spark, solver):
    trainer = trainer.copy({trainer.initialWeights: Vectors.dense(solver.weights)})
    fitted, run = _network(trainer, spark), Run(trainer, solver)
    fitted.summary = lambda: run
    return fitted


def train_baseline(df, features="features", label="label", max_iter=25):
    """Logistic regression on the same columns, as a yardstick."""
    trainer = LogisticRegression(
        featuresCol="_features",
        labelCol=label,
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        predictionCol="_prediction",
        maxIter=max_iter,
    )
    return trainer.fit(_with_vector(df.select(features, label), features))


def score_classifier(model, df, features="features"):
    """Add ``probability`` (array) and ``predicted``."""
    scored = model.transform(_with_vector(df, features))
    return scored.withColumns(
        {
            "probability": vector_to_array("_probability"),
            "predicted": F.col("_prediction").cast("int"),
        }
    ).drop("_features", "_probability", "_raw", "_prediction")


def train_with_history(
    train,
    validation,
    features="features",
    label="label",
    classes=2,
    hidden=HIDDEN_LAYERS,
    seed=42,
    epochs=5,
    iterations=5,
):
    """Train in epochs of solver iterations, each going on from the last weights with
    what the solver knows by then.

    Returns the model and one entry per epoch: objective on the training part,
    loss and accuracy on the validation part.
    """
    model, history = None, []
    for epoch in range(1, epochs + 1):
        model = train_classifier(
            train,
            features,
            label,
            classes,
            hidden,
            seed,
            iterations,
            earlier=model,
        )
        objective = model.summary().objectiveHistory[-1]
        scored = score_classifier(model, validation, features).withColumn("split", F.lit("validation"))
        row = evaluate(scored, "split", "probability", label).first()
        loss, accuracy = (row["loss"], row["accuracy"]) if row else (None, None)
        history.append((epoch, float(objective), loss, accuracy))
    return model, history


def run_history(spark, history):
    """History as a table, with the best and the last epoch marked."""
    log = spark.createDataFrame(
        history, "epoch int, objective double, validation_loss double, validation_accuracy double"
    )
    return mark_epochs(log)


def mark_epochs(log):
    """A run log with its best epoch (the earliest of the most accurate) and its last
    one marked; an epoch without an accuracy is never the best."""
    known = F.col("validation_accuracy").isNotNull()
    order = F.struct("validation_accuracy", -F.col("epoch"))
    best = log.agg(F.max_by("epoch", F.when(known, order))).scalar()
    last = log.agg(F.max("epoch")).scalar()
    return log.withColumns(
        {
            "is_best": F.coalesce(F.col("epoch") == best, F.lit(False)),
            "is_last": F.col("epoch") == last,
        }
    )
