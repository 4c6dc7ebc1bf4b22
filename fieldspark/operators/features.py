"""Encoders, scalers and row-wise vector columns."""

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import functions as F

from fieldspark.functions import vectors
from fieldspark.operators.merge import apply_dictionary
from fieldspark.operators.stats import fit_dictionaries, fit_dictionary


def label_encode(df, col, order="sorted", order_col=None, out=None):
    """Value to code, fitted on the same table."""
    return apply_dictionary(df, fit_dictionary(df, col, order, order_col), col, out)


def categories(dictionary, cols, max_card=None):
    """Values per column in code order; with ``max_card`` they are counted first."""
    if max_card is not None:
        sizes = {r["column"]: r["count"] for r in dictionary.groupBy("column").count().collect()}
        for c in cols:
            if sizes.get(c, 0) > max_card:
                raise ValueError(
                    f"{c} has {sizes[c]} values, too many for one column each; use one_hot_vectors"
                )
    rows = dictionary.where(F.col("column").isin(list(cols))).orderBy("column", "code").collect()
    return {c: [r["value"] for r in rows if r["column"] == c] for c in cols}


def one_hot_columns(df, cols, dictionary, max_card=None):
    """Replace each column by one 0/1 column per dictionary value, ``col_value``.

    The output schema depends on the data, so the dictionary is read while
    planning; the rows then need one projection and no join. For more values
    than a table can have columns use ``one_hot_vectors``.
    """
    values = categories(dictionary, cols, max_card)
    kept = [F.col(c) for c in df.columns if c not in cols]
    flags = [
        F.col(c).eqNullSafe(F.lit(v)).cast("int").alias(f"{c}_{v}") for c in cols for v in values[c]
    ]
    return df.select(*kept, *flags)


def one_hot_vectors(df, cols, dictionary, suffix="_vector"):
    """One sparse vector per column; its width may be in the millions."""
    widest = dictionary.agg(
        *[F.max(F.when(F.col("column") == c, F.col("code"))).cast("double").alias(f"_{c}") for c in cols]
    )
    for c in cols:
        df = apply_dictionary(df, dictionary, c, f"_{c}")
    encoder = OneHotEncoder(
        inputCols=[f"_{c}" for c in cols],
        outputCols=[f"{c}{suffix}" for c in cols],
        dropLast=False,
        handleInvalid="keep",
    )
    fitted = encoder.fit(widest)
    unknown = dict(zip(cols, fitted.categorySizes))
    coded = df.withColumns(
        {f"_{c}": F.coalesce(F.col(f"_{c}"), F.lit(unknown[c])).cast("double") for c in cols}
    )
    return fitted.transform(coded).drop(*[f"_{c}" for c in cols])


def one_hot_leftovers(df, exclude=(), max_card=None):
    """One-hot every text column that is still in the table."""
    cols = [
        f.name
        for f in df.schema
        if f.dataType.simpleString() == "string" and f.name not in exclude
    ]
    return one_hot_columns(df, cols, fit_dictionaries(df, cols), max_card) if cols else df


def standardize(df, stats, cols=None):
    """(x - mean) / std with the table from ``fit_standardizer``.

    The statistics are one row per column; like any fitted model they are read
    while planning, and the rows need one projection.
    """
    fitted = {r["column"]: (r["mean"], r["std"]) for r in stats.collect()}

    def scaled(c):
        mean, std = fitted[c]
        return (F.col(c) - F.lit(mean)) / F.lit(std)

    return df.withColumns({c: scaled(c) for c in (cols or fitted)})


def one_hot_label(df, col, k, out="label_vector"):
    return df.withColumn(out, vectors.one_hot(F.col(col), k))


def assemble_vector(df, cols, out="features"):
    """Number columns and array columns, in order, as one array."""
    parts = []
    for c in cols:
        kind = df.schema[c].dataType.simpleString()
        if kind.startswith("array<array"):
            parts.append(vectors.doubles(F.flatten(F.col(c))))
        elif kind.startswith("array"):
            parts.append(vectors.doubles(F.col(c)))
        else:
            parts.append(F.array(F.col(c).cast("double")))
    return df.withColumn(out, F.concat(*parts))


def split_vector(df, col, at, left="left", right="right"):
    """The first ``at`` elements and the rest."""
    a = F.col(col)
    return df.withColumns(
        {left: F.slice(a, 1, at), right: F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0)))}
    )


def log1p_col(df, col, out=None):
    return df.withColumn(out or f"Log{col}", F.log1p(F.col(col)))


def _per_value(df, cols, fn):
    """Apply ``fn`` to number columns and to the elements of array columns."""

    def apply(c):
        if df.schema[c].dataType.typeName() == "array":
            return vectors.each(F.col(c), fn)
        return fn(F.col(c).cast("double"))

    return df.withColumns({c: apply(c) for c in cols})


def clamp(df, col, lo=-1.0, hi=1.0):
    return _per_value(df, [col], lambda x: vectors.clamp(x, lo, hi))


def repair_invalid(df, cols):
    return _per_value(df, cols, vectors.repair)


def rectify(df, col, slope=0.0):
    return _per_value(df, [col], lambda x: vectors.rectify(x, slope))


def softmax(df, col, out=None):
    return df.withColumn(out or col, vectors.softmax(F.col(col)))


def layer_norm(df, col, out=None, epsilon=vectors.LAYER_NORM_EPSILON):
    return df.withColumn(out or col, vectors.layer_norm(F.col(col), epsilon))


def clip_l2(df, col, max_norm=1.0, out=None):
    return df.withColumn(out or col, vectors.clip_l2(F.col(col), max_norm))
