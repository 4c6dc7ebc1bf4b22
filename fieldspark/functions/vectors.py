"""Column expressions over ``array<double>`` cells; nothing here shuffles."""

from pyspark.sql import functions as F

from fieldspark.functions.cells import no_nan

LAYER_NORM_EPSILON = 1e-6
PROBABILITY_FLOOR = 1e-8


def let(value, body):
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a ``transform`` lambda is otherwise evaluated for
    every element, which makes a row-wise sum quadratic.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_invalid(x):
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def doubles(a):
    return a.cast("array<double>")


SPARSE_JSON = "v struct<indices: array<int>, values: array<double>>"


def sparse_entries(vector):
    """The places and values that a sparse vector column stores, as ``indices`` and
    ``values``.

    ``vector_to_array`` writes out the zeros too, so its work grows with the width. A
    vector's fields cannot be named in an expression, but they are there in its JSON.
    """
    return F.from_json(F.to_json(F.struct(F.col(vector).alias("v"))), F.lit(SPARSE_JSON))["v"]


def each(a, fn):
    return F.transform(doubles(a), fn)


def total(a):
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def mean(a):
    """Mean of the elements; NULL for an empty array."""
    return F.try_divide(total(doubles(a)), F.size(a))


def repair(x):
    """NaN and both infinities become 0."""
    return F.when(_is_invalid(x), F.lit(0.0)).otherwise(x)


def clamp(x, lo, hi):
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.nanvl(x, F.lit(0.0))))


def rectify(x, slope=0.0):
    return F.when(x > 0, x).otherwise(F.lit(float(slope)) * x)


def softmax(a):
    raised = let(F.array_max(doubles(a)), lambda peak: each(a, lambda x: F.exp(x - peak)))
    return let(raised, lambda r: let(total(r), lambda s: F.transform(r, lambda e: e / s)))


def layer_norm(a, epsilon=LAYER_NORM_EPSILON):
    centred = let(mean(a), lambda m: each(a, lambda x: x - m))

    def scaled(d):
        variance = mean(F.transform(d, lambda x: x * x))
        spread = F.sqrt(F.greatest(variance, F.lit(epsilon)) + F.lit(epsilon))
        return let(spread, lambda s: F.transform(d, lambda x: repair(x / s)))

    return let(centred, scaled)


def clip_l2(a, max_norm):
    def scaled(norm):
        return F.when(
            norm > max_norm, each(a, lambda x: x * (F.lit(float(max_norm)) / norm))
        ).otherwise(doubles(a))

    return let(F.sqrt(total(each(a, lambda x: x * x))), scaled)


def argmax(scores):
    """Position of the largest score, the first one on ties; NaN never wins."""
    a = each(scores, lambda x: F.nanvl(x, F.lit(float("-inf"))))
    return let(a, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def one_hot(c, k):
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == c).cast("int"))


def convolve(a, weights, pad=0, relu=False):
    """Sliding weighted sum over the array, stride 1, ``pad`` zeros at both ends."""
    width = len(weights)
    zeros = F.array_repeat(F.lit(0.0), pad)

    def slide(padded):
        def at(i):
            value = F.lit(0.0)
            for j, w in enumerate(weights):
                value = value + F.get(padded, i + j) * F.lit(float(w))
            return rectify(value) if relu else value

        starts = F.sequence(F.lit(0), F.size(padded) - width)
        return F.when(F.size(padded) >= width, F.transform(starts, at)).otherwise(
            F.array().cast("array<double>")
        )

    return let(F.concat(zeros, doubles(a), zeros), slide)


def true_class_loss(probabilities, label, plus_epsilon=False):
    """Minus the log of the probability given to the true class; none without a label
    or with one outside the array."""
    p = F.get(doubles(probabilities), label)
    floor = F.lit(PROBABILITY_FLOOR)
    loss = -F.ln(p + floor if plus_epsilon else F.greatest(p, floor))
    return F.when(p.isNotNull(), loss)


def over(c, bound):
    """1 when over the bound, 0 otherwise; NULL and NaN count as 0."""
    return F.coalesce(no_nan(c) > F.lit(bound), F.lit(False)).cast("int")
