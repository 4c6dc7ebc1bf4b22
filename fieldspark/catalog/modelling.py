"""Dense scoring, training, scoring and run history."""

import math

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.catalog.base import combined, query, rounded, sql6, table, vectors, with_views
from fieldspark.operators import model
from fieldspark.operators.order import hash_split
from fieldspark.plans import training
from fieldspark.storage import cut_lineage

# As many epochs as a full training run has, and iterations as the job's.
EPOCHS = 25
ITERATIONS = 5


def centroid_layers(spark, sf_dir):
    """A two-layer weight table out of the data: one neuron per label with the
    label's mean vector as weights, then two neurons weighing those by label."""
    rows = vectors(spark, sf_dir)
    means = (
        rows.select("label", F.posexplode("v").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg("x").alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("w"))
    )
    first = means.select(
        F.lit(1).alias("layer"),
        F.col("label").alias("neuron"),
        F.lit(0.01).alias("bias"),
        F.col("w.x").alias("weights"),
    )
    by_label = means.select("label", F.get("w.x", F.lit(0)).alias("a"), F.get("w.x", F.lit(1)).alias("b"))
    ordered = by_label.agg(F.array_sort(F.collect_list(F.struct("label", "a", "b"))).alias("w"))
    second = ordered.select(
        F.lit(2).alias("layer"),
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("neuron"), F.lit(0.02).alias("bias"), F.col("w.a").alias("weights")),
                F.struct(F.lit(1).alias("neuron"), F.lit(-0.02).alias("bias"), F.col("w.b").alias("weights")),
            )
        ),
    )
    return first.unionByName(second)


@query(
    "dense_score",
    with_views(
        "vectors",
        f"""SELECT h.vec_id, {sql6("sum(greatest(h.z, 0.0) * m.a) + 0.02")} AS score_0,
          {sql6("sum(greatest(h.z, 0.0) * m.b) - 0.02")} AS score_1
        FROM (SELECT f.vec_id, m.label, list_inner_product(f.v, m.w) + 0.01 AS z FROM vectors f, means m) h
        JOIN (SELECT label, w[1] AS a, w[2] AS b FROM means) m USING (label) GROUP BY 1""",
        means="""SELECT label, list(x ORDER BY pos) AS w FROM (
          SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM vectors)
          GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def dense_score(spark, sf_dir):
    layers = model.read_layers(centroid_layers(spark, sf_dir))
    scored = model.dense_score(vectors(spark, sf_dir), "v", layers)
    return rounded(
        scored.select(
            "vec_id",
            F.get("scores", F.lit(0)).alias("score_0"),
            F.get("scores", F.lit(1)).alias("score_1"),
        ),
        "score_0",
        "score_1",
    )


def _classes(spark, sf_dir):
    """Embedding vectors with the parity of their label as class."""
    rows = vectors(spark, sf_dir).withColumn("label", F.col("label") % 2)
    return hash_split(rows.withColumnRenamed("v", "features"), "vec_id")


DRAW = "CAST('0x' || substr(md5('42-' || vec_id), 1, 8) AS BIGINT) % 100"
SPLIT = f"CASE WHEN {DRAW} < 70 THEN 'train' WHEN {DRAW} < 85 THEN 'validation' ELSE 'test' END"


@query(
    "train_classifier",
    with_views(
        "vectors",
        f"""SELECT CAST((64 + 1) * 128 + (128 + 1) * 64 + (64 + 1) * 32 + (32 + 1) * 16 + (16 + 1) * 2 AS BIGINT) AS n_weights,
          count(*) AS n_rows, true AS weights_are_finite, count(*) AS n_distributions, true AS beats_majority
        FROM vectors WHERE {DRAW} < 70""",
    ),
)
def train_classifier(spark, sf_dir):
    """What must hold of a fitted network, whatever its weights: how many they are, that
    every training row gets a distribution, and that the objective is not above the
    loss of always giving the classes their shares."""
    rows = cut_lineage(_classes(spark, sf_dir).where(F.col("split") == "train"))
    fitted = model.train_classifier(rows)
    weights = fitted.weights.toArray()
    scored = model.score_classifier(fitted, rows)
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(counts.values())
    majority = -sum(c / n * math.log(c / n) for c in counts.values())
    objective = fitted.summary().objectiveHistory[-1]
    return scored.agg(
        F.lit(len(weights)).cast("long").alias("n_weights"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(bool(np.isfinite(weights).all())).alias("weights_are_finite"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("n_distributions"),
        F.lit(bool(objective <= majority)).alias("beats_majority"),
    )


def _given_weights(rows):
    """A network of two hidden neurons out of the data: the mean vector of each class,
    then two outputs that weigh one against the other. Its size is that of the
    network; weights are listed input by input, then the biases."""
    means = (
        rows.select("label", F.posexplode("features").alias("pos", "x"))
        .groupBy("pos")
        .pivot("label", [0, 1])
        .agg(F.avg("x"))
        .orderBy("pos")
        .collect()
    )
    hidden = [x for r in means for x in (r["0"], r["1"])]
    return Vectors.dense([*hidden, 0.01, 0.01, 1.0, -1.0, -1.0, 1.0, 0.02, -0.02])


@query(
    "score_classifier",
    with_views(
        "vectors",
        f"""SELECT vec_id, {SPLIT} AS split, CAST(label % 2 AS INTEGER) AS label,
          {sql6("exp(a - b + 0.02) / (exp(a - b + 0.02) + exp(b - a - 0.02))")} AS probability_0,
          {sql6("exp(b - a - 0.02) / (exp(a - b + 0.02) + exp(b - a - 0.02))")} AS probability_1,
          CAST(CASE WHEN a - b + 0.02 >= b - a - 0.02 THEN 0 ELSE 1 END AS INTEGER) AS predicted
        FROM (SELECT vec_id, label, 1 / (1 + exp(-(list_inner_product(v, m0.w) + 0.01))) AS a,
          1 / (1 + exp(-(list_inner_product(v, m1.w) + 0.01))) AS b
          FROM vectors, (SELECT w FROM means WHERE p = 0) m0, (SELECT w FROM means WHERE p = 1) m1)""",
        means="""SELECT p, list(x ORDER BY pos) AS w FROM (
          SELECT p, pos, avg(x) AS x FROM (
            SELECT label % 2 AS p, unnest(range(len(v))) AS pos, unnest(v) AS x FROM vectors) GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def score_classifier(spark, sf_dir):
    """Probabilities and predictions of a network whose weights are known."""
    rows = _classes(spark, sf_dir)
    fitted = model.train_classifier(
        rows, hidden=(2,), max_iter=0, initial_weights=_given_weights(rows)
    )
    scored = model.score_classifier(fitted, rows)
    return rounded(
        scored.select(
            "vec_id",
            "split",
            F.col("label").cast("int").alias("label"),
            F.get("probability", F.lit(0)).alias("probability_0"),
            F.get("probability", F.lit(1)).alias("probability_1"),
            "predicted",
        ),
        "probability_0",
        "probability_1",
    )


@query(
    "run_history",
    f"""WITH log AS (
      SELECT CAST(row_number() OVER (ORDER BY month) AS INTEGER) AS epoch, objective, validation_loss, validation_accuracy
      FROM (SELECT date_trunc('month', o_orderdate) AS month, {sql6("avg(o_totalprice)")} AS objective,
        {sql6("max(o_totalprice)")} AS validation_loss,
        CASE WHEN count(*) % 7 <> 0 THEN avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) END AS validation_accuracy
        FROM orders GROUP BY 1))
    SELECT *, epoch = (SELECT epoch FROM log WHERE validation_accuracy IS NOT NULL
        ORDER BY validation_accuracy DESC, epoch LIMIT 1) AS is_best,
      epoch = (SELECT max(epoch) FROM log) AS is_last FROM log""",
)
def run_history(spark, sf_dir):
    """A log with an epoch for each month of orders, its best and last marked."""
    orders = table(spark, sf_dir, "orders")
    finished = F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    months = orders.groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(
        F.avg("o_totalprice").alias("objective"),
        F.max("o_totalprice").alias("validation_loss"),
        F.when(F.count(F.lit(1)) % 7 != 0, finished).alias("validation_accuracy"),
    )
    # As many rows as there are months.
    log = cut_lineage(
        rounded(months, "objective", "validation_loss").select(
            F.row_number().over(W.orderBy("month")).alias("epoch"),
            "objective",
            "validation_loss",
            "validation_accuracy",
        )
    )
    return model.mark_epochs(log)


@query(
    "train_and_evaluate",
    with_views(
        "combined",
        """SELECT split, count(*) AS n, count(*) AS n_scored, true AS loss_is_finite, true AS accuracy_is_a_share,
          CASE WHEN split = 'train' THEN true END AS beats_the_majority, CASE WHEN split = 'train' THEN true END AS beats_the_shares,
          max(label) AS positives_there, CAST(25 AS BIGINT) AS epochs
        FROM (SELECT CASE WHEN draw < 70 THEN 'train' WHEN draw < 85 THEN 'validation' ELSE 'test' END AS split, label
          FROM (SELECT CAST('0x' || substr(md5('42-' || "SiteID" || '-' || CAST("Date" AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS draw,
            CAST(coalesce("DipCount" > 0.1, false) AS INTEGER) AS label FROM combined))
        GROUP BY 1""",
    ),
)
def train_and_evaluate(spark, sf_dir):
    """Combined table to matrices of five days with kernels, model, and loss and accuracy
    per split: what must hold of them after a full run. On the training part the model
    must be right more often than the larger class is there, and lose less than an answer
    that gives both classes their shares."""
    matrices = training.sparse_matrices(cut_lineage(combined(spark, sf_dir)), days=5, kernels=True)
    rows = cut_lineage(matrices.rows)
    _, history, scores = training.train_and_evaluate(rows, epochs=EPOCHS, iterations=ITERATIONS)
    shares = rows.groupBy("split").agg(F.avg("label").alias("share"), F.max("label").alias("positives_there"))
    scores = scores.join(shares, "split")
    share = F.col("share")
    by_share = -(share * F.ln(share) + (1 - share) * F.ln(1 - share))
    trained = F.col("split") == "train"
    return scores.select(
        "split",
        "n",
        "n_scored",
        (~F.isnan("loss") & (F.col("loss") < float("inf"))).alias("loss_is_finite"),
        F.col("accuracy").between(0, 1).alias("accuracy_is_a_share"),
        F.when(trained, F.col("accuracy") > F.greatest(share, 1 - share)).alias("beats_the_majority"),
        F.when(trained, F.col("loss") < 0.9 * by_share).alias("beats_the_shares"),
        "positives_there",
        F.lit(len(history)).cast("long").alias("epochs"),
    )
