"""From the combined table to feature matrices, a model and its scores."""

import math
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions import vectors
from fieldspark.functions.cells import md5_key, no_nan
from fieldspark.functions.vectors import let
from fieldspark.operators import calendar, clean, features, model, order
from fieldspark.operators.evaluate import evaluate
from fieldspark.operators.merge import apply_dictionary
from fieldspark.operators.sequence import attach_sequence
from fieldspark.operators.stats import fit_dictionaries, fit_standardizer
from fieldspark.schema import CATEGORIES, KEYS, SITE_NUMBERS, WEATHER
from fieldspark.storage import cut_lineage

LABEL = "Breeding"
SITE_CODE = "SiteCode"
UNKNOWN_SITE = -1
# Fixed kernels over a weather series: three days' mean, a rise from the day before the
# last to the day after the next, and a peak between two days.
KERNELS = {"mean3": (1 / 3, 1 / 3, 1 / 3), "rise": (-1.0, 0.0, 1.0), "peak": (-1.0, 2.0, -1.0)}
# A text column with more values than this is encoded by hash, into as many columns.
MOST_VALUES = 4096
HASHED = "hashed"
# Tasks a core that the rows are dealt to at least, and rows of a task at most.
TURNS = 3
ROWS_A_TASK = 250_000
# Columns of a merge that say nothing about a site.
HELPERS = ("seq", "is_recorded", "inspected_on", "_bad_record")


@dataclass
class Matrices:
    """Rows with ``weather``, ``site`` and ``features`` arrays, label and split."""

    rows: DataFrame
    weather_columns: list
    site_columns: list


def day_series(rows, days, kernels=False):
    """The weather of the ``days`` days up to each row's date, one column per
    field and day (``Temperature_1`` is the day before), missing days as 0.

    With ``kernels`` also what the convolution branch makes of a series: every kernel at
    every place that it fits, rectified (``Temperature_rise_0`` ends on the row's own
    day), and each kernel's largest and mean value. All of it depends on the date alone:
    it is computed once per date that the rows have, at most the calendar's, and looked up.
    """
    known = rows.select("Date", *WEATHER).where(F.col(WEATHER[0]).isNotNull())
    series = attach_sequence(rows.select("Date").distinct(), known, n=days, out="_series")
    columns = {}
    for back in range(days - 1, 0, -1):
        for c in WEATHER:
            value = F.get("_series", F.lit(days - 1 - back))[c]
            columns[f"{c}_{back}"] = F.coalesce(no_nan(value), F.lit(0.0))
    arrays = {}
    for c in WEATHER if kernels else ():
        field = F.transform(F.col("_series")[c], lambda x: F.coalesce(no_nan(x), F.lit(0.0)))
        for name, weights in KERNELS.items():
            if days < len(weights):
                continue
            held = f"_{c}_{name}"
            arrays[held] = vectors.convolve(field, weights, 0, True)
            places = days - len(weights) + 1
            for at in range(places):
                columns[f"{c}_{name}_{places - 1 - at}"] = F.get(held, F.lit(at))
            columns[f"{c}_{name}_max"] = F.array_max(held)
            columns[f"{c}_{name}_avg"] = vectors.mean(F.col(held))
    series = series.withColumns(arrays).withColumns(columns) if arrays else series.withColumns(columns)
    by_date = cut_lineage(series.select(F.col("Date").alias("_day"), *columns))
    found = rows.join(F.broadcast(by_date), F.col("Date").eqNullSafe(F.col("_day")), "left")
    return found.drop("_day"), list(columns)


def spread(rows):
    """The rows dealt evenly over all cores and written once, as many tasks a core.

    A merge leaves as many partitions as the narrow combined table asks for, down to one;
    what is made of a row here is many times as wide, and a solver goes over it again and
    again.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    turns = max(TURNS, math.ceil(rows.count() / (cores * ROWS_A_TASK)))
    return cut_lineage(rows.repartition(cores * turns))


@dataclass
class Coded:
    """Filled rows with date numbers and site code, before categories are encoded."""

    rows: DataFrame
    seen: DataFrame
    dictionary: DataFrame
    categories: list
    series: list


def coded_rows(combined, seed=42, fit_on="train", days=1, kernels=False):
    """Label, split, date numbers and site code; dictionaries of the categories. The
    table is read a few times: pass a written or checkpointed one."""
    known = {*KEYS, *CATEGORIES, *SITE_NUMBERS, *WEATHER, *HELPERS}
    others = {f.name: f.dataType for f in combined.schema if f.name not in known}
    texts = [c for c, kind in others.items() if kind.simpleString() == "string"]
    numbers = [c for c, kind in others.items() if isinstance(kind, T.NumericType)]
    categories = [*CATEGORIES, *texts]
    labelled = clean.threshold_label(
        spread(combined.select(*KEYS, *categories, *SITE_NUMBERS, *numbers, *WEATHER))
    )
    labelled, series = day_series(labelled, days, kernels) if days > 1 else (labelled, [])
    split = order.hash_split(labelled, KEYS, seed)
    dated = calendar.date_parts(calendar.date_ordinal(split))
    filled = clean.fill_category(
        clean.fill_numeric(dated, [*SITE_NUMBERS, *numbers, *WEATHER]), ["SiteID", *categories]
    )
    seen = filled.where(F.col("split") == "train") if fit_on == "train" else filled
    dictionary = cut_lineage(fit_dictionaries(seen, ["SiteID", *categories]))
    coded = apply_dictionary(filled, dictionary, "SiteID", SITE_CODE).fillna(UNKNOWN_SITE, [SITE_CODE])
    seen = coded.where(F.col("split") == "train") if fit_on == "train" else coded
    return Coded(coded, seen, dictionary, categories, series)


def _families(rows, series, keep_label_source, categories=()):
    dropped = [*KEYS, "split", *categories] if keep_label_source else [*KEYS, "split", "DipCount", *categories]
    weather, site = clean.split_features(rows, LABEL, [*dropped, *series])
    return series + weather, sorted(site, key=lambda c: c != SITE_CODE)


def encode(combined, seed=42, keep_label_source=False, fit_on="train", days=1):
    """Label, date numbers, site code and one 0/1 column per category value.

    The count that defines the label is left out of the inputs unless
    ``keep_label_source``. Dictionaries are fitted on the training part unless
    ``fit_on`` is "all"; a site they do not know gets the code -1. With ``days``
    above 1 the weather family also holds that many days as a series. Columns that
    the combined table does not name are site features too: text as categories,
    numbers as numbers. Returns the table, the weather columns and the site columns.
    """
    c = coded_rows(combined, seed, fit_on, days)
    encoded = features.one_hot_columns(c.rows, c.categories, c.dictionary)
    return encoded, *_families(encoded, c.series, keep_label_source)


def _scaled_categories(coded):
    """Per category one array: the standardised 0/1 value of every dictionary value.

    Shares come from one count per value; nothing is as wide as the dictionary but
    the array itself, which holds two numbers a value as constants. Returns the
    expressions and the names of the elements.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in coded.categories]))
    counts = coded.seen.select(cells.alias("_cell")).groupBy("_cell.column", "_cell.value").agg(F.count(F.lit(1)).alias("n"))
    shares = {(r["column"], r["value"]): r["n"] for r in counts.collect()}
    total = coded.seen.count()
    values = features.categories(coded.dictionary, coded.categories)
    arrays, names = [], []
    for c in coded.categories:
        absent, present = [], []
        for v in values[c]:
            share = shares.get((c, v), 0) / total if total else 0.0
            spread = math.sqrt(share * (1 - share)) or 1.0
            absent.append(-share / spread)
            present.append((1 - share) / spread)
            names.append(f"{c}_{v}")
        if values[c]:
            arrays.append(_scaled_flags(F.col(c), values[c], absent, present))
    return arrays, names


def _scaled_flags(value, values, absent, present):
    """``absent`` with the entry of the row's value taken from ``present``."""
    zeros, ones = F.array(*map(F.lit, absent)), F.array(*map(F.lit, present))

    def at(place):
        return F.transform(zeros, lambda x, i: F.when(i == place, F.get(ones, i)).otherwise(x))

    return let(F.array_position(F.array(*map(F.lit, values)), value) - 1, at)


def matrices(combined, seed=42, keep_label_source=False, fit_on="train", days=1, kernels=False):
    """Standardised weather and site arrays per row, and both joined. Categories go
    straight into the site array: no table has a column per value. The arrays are dense
    and as wide as the dictionary; for text of any number of values use
    ``sparse_matrices``."""
    coded = coded_rows(combined, seed, fit_on, days, kernels)
    weather, numbers = _families(coded.rows, coded.series, keep_label_source, coded.categories)
    scaled = features.standardize(coded.rows, fit_standardizer(coded.seen, weather + numbers))
    arrays, names = _scaled_categories(coded)
    rows = features.assemble_vector(scaled, weather, "weather")
    rows = features.assemble_vector(rows, numbers, "_numbers")
    rows = rows.withColumn("site", F.concat("_numbers", *arrays))
    rows = features.assemble_vector(rows, ["weather", "site"], "features")
    return Matrices(
        rows.select(*KEYS, "split", F.col(LABEL).alias("label"), "weather", "site", "features"),
        weather,
        [*numbers, *names],
    )


@dataclass
class SparseMatrices:
    """Rows with a dense ``weather`` array and a sparse ``features`` vector: first the
    standardised numbers ``dense_columns``, then the categories, whose places are in the
    table ``names`` (position, name)."""

    rows: DataFrame
    dense_columns: list
    names: DataFrame
    width: int


def sparse_matrices(
    combined, seed=42, keep_label_source=False, fit_on="train", days=1, kernels=False, most_values=MOST_VALUES
):
    """The same inputs with categories as sparse vectors.

    A category's code comes from a join with the dictionary, which stays a table; a
    column with more than ``most_values`` values takes the hash of the value modulo that
    number instead, so the width depends on the number of columns and not on the rows,
    and no text is left out. 0/1 columns are divided by their standard deviation
    (of the fitted part, n - 1) and not centred, which keeps zeros zero: the constant
    that centring would take off is the bias of the first layer. A value unknown to the
    fitted part has no column.
    """
    coded = coded_rows(combined, seed, fit_on, days, kernels)
    weather, numbers = _families(coded.rows, coded.series, keep_label_source, coded.categories)
    rows = features.standardize(coded.rows, fit_standardizer(coded.seen, weather + numbers))
    rows = features.assemble_vector(rows, weather, "weather")
    rows = features.assemble_vector(rows, weather + numbers, "_numbers")
    # One row a column.
    sizes = {r["column"]: r["count"] for r in coded.dictionary.groupBy("column").count().collect()}
    widths, start, places = {}, len(weather) + len(numbers), []
    for c in coded.categories:
        n = sizes.get(c, 0)
        if n > most_values:
            code = F.conv(F.substring(md5_key(HASHED, c), 1, 8), 16, 10).cast("long") % most_values
            rows = rows.withColumn(f"_code_{c}", code)
            buckets = combined.sparkSession.range(most_values).select(
                (F.col("id") + start).cast("int").alias("position"), F.concat(F.lit(f"{c}#"), "id").alias("name")
            )
            places.append(buckets)
        elif n:
            rows = apply_dictionary(rows, coded.dictionary, c, f"_code_{c}")
            own = coded.dictionary.where(F.col("column") == c)
            places.append(
                own.select((F.col("code") + start).alias("position"), F.concat(F.lit(f"{c}_"), "value").alias("name"))
            )
        else:
            continue
        widths[c] = min(n, most_values)
        start += widths[c] + 1  # one place for values that have no code, which stays 0
    rows = _one_hot(rows, widths)
    seen = rows.where(F.col("split") == "train") if fit_on == "train" else rows
    if widths:
        scaler = StandardScaler(inputCol="_flags", outputCol="_scaled", withMean=False, withStd=True)
        rows = scaler.fit(seen).transform(rows)
    rows = rows.withColumn("_dense", array_to_vector("_numbers"))
    parts = ["_dense", "_scaled"] if widths else ["_dense"]
    rows = VectorAssembler(inputCols=parts, outputCol="features").transform(rows)
    named = combined.sparkSession.createDataFrame(list(enumerate(weather + numbers)), "position int, name string")
    for part in places:
        named = named.union(part)
    return SparseMatrices(
        rows.select(*KEYS, "split", F.col(LABEL).alias("label"), "weather", "features"),
        weather + numbers,
        named,
        start,
    )


def _one_hot(rows, widths):
    """Codes in ``_code_{column}`` as one sparse vector ``_flags``."""
    if not widths:
        return rows
    spark = rows.sparkSession
    cols = list(widths)
    largest = spark.createDataFrame(
        [tuple(float(widths[c] - 1) for c in cols)], ", ".join(f"`_code_{c}` double" for c in cols)
    )
    encoder = OneHotEncoder(
        inputCols=[f"_code_{c}" for c in cols],
        outputCols=[f"_flag_{c}" for c in cols],
        dropLast=False,
        handleInvalid="keep",
    ).fit(largest)
    filled = rows.withColumns(
        {f"_code_{c}": F.coalesce(F.col(f"_code_{c}"), F.lit(widths[c])).cast("double") for c in cols}
    )
    flags = encoder.transform(filled)
    return VectorAssembler(inputCols=[f"_flag_{c}" for c in cols], outputCol="_flags").transform(flags)


def train_and_evaluate(rows, hidden=model.HIDDEN_LAYERS, epochs=5, iterations=5, seed=42):
    """Train on the training part, score everything, one row per split.

    ``rows`` are read many times by the solver: pass a written or checkpointed
    table. Returns the model, the run history and the evaluation.
    """
    parts = {p: rows.where(F.col("split") == p) for p in ("train", "validation")}
    fitted, history = model.train_with_history(
        parts["train"],
        parts["validation"],
        hidden=hidden,
        epochs=epochs,
        iterations=iterations,
        seed=seed,
    )
    return fitted, history, evaluate(model.score_classifier(fitted, rows))
