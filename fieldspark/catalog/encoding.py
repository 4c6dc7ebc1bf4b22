"""Encoders, scaling and row-wise vector functions."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fieldspark.catalog.base import (
    broken_vectors,
    combined,
    inspections,
    query,
    rounded,
    sql6,
    table,
    vectors,
    with_views,
)
from fieldspark.functions.vectors import doubles, sparse_entries
from fieldspark.operators import features
from fieldspark.operators.stats import fit_dictionaries, fit_standardizer
from fieldspark.plans import training
from fieldspark.schema import KEYS
from fieldspark.storage import cut_lineage


def _elements(df, col="v"):
    """One row per element, so that values compare one by one."""
    return rounded(df.select("vec_id", F.posexplode(doubles(F.col(col))).alias("pos", "x")), "x")


def _elements_sql(expression, view="vectors"):
    return with_views(
        view,
        f"""SELECT vec_id, pos, {sql6("x")} AS x FROM (
          SELECT vec_id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS x
          FROM (SELECT vec_id, {expression} AS a FROM {view}))""",
    )


def _label_sql(order):
    return with_views(
        "inspections",
        f"""SELECT seq, CAST(code AS INTEGER) AS "SiteID" FROM inspections JOIN (
          SELECT s, row_number() OVER (ORDER BY {order}) - 1 AS code
          FROM (SELECT "SiteID" AS s, min(seq) AS seen FROM inspections GROUP BY 1)) ON s = "SiteID" """,
    )


@query("label_encode", _label_sql("s"))
def label_encode(spark, sf_dir):
    return features.label_encode(inspections(spark, sf_dir).select("seq", "SiteID"), "SiteID")


@query("label_encode_first_seen", _label_sql("seen"))
def label_encode_first_seen(spark, sf_dir):
    rows = inspections(spark, sf_dir).select("seq", "SiteID")
    return features.label_encode(rows, "SiteID", "first_seen", "seq")


ACTIONS = ["click", "error", "none", "purchase", "signup"]


@query(
    "one_hot_columns",
    with_views(
        "inspections",
        "SELECT seq, "
        + ", ".join(f"""CAST("Action" = '{a}' AS INTEGER) AS "Action_{a}" """ for a in ACTIONS)
        + ", "
        + ", ".join(
            f"""CAST(coalesce("Material" = '{m}', false) AS INTEGER) AS "Material_{m}" """
            for m in ("Bti", "Methoprene")
        )
        + " FROM inspections",
    ),
)
def one_hot_columns(spark, sf_dir):
    rows = inspections(spark, sf_dir).select("seq", "Action", "Material")
    return features.one_hot_columns(rows, ["Action", "Material"], fit_dictionaries(rows, ["Action", "Material"]))


@query(
    "one_hot_vectors",
    with_views(
        "inspections",
        """SELECT seq, CAST(code AS INTEGER) AS hot, 1.0::DOUBLE AS flag FROM inspections JOIN (
          SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT "SiteID" AS s FROM inspections)) ON s = "SiteID" """,
    ),
)
def one_hot_vectors(spark, sf_dir):
    """Position and value of the element that is set in each sparse vector."""
    rows = inspections(spark, sf_dir).select("seq", "SiteID")
    coded = features.one_hot_vectors(rows, ["SiteID"], fit_dictionaries(rows, ["SiteID"]))
    entries = coded.select("seq", sparse_entries("SiteID_vector").alias("_set"))
    return entries.select("seq", F.get("_set.indices", F.lit(0)).alias("hot"), F.array_max("_set.values").alias("flag"))


@query(
    "one_hot_leftovers",
    with_views(
        "inspections",
        """SELECT seq, "Wetness", """
        + ", ".join(
            f"""CAST(coalesce("MosquitoRank" = '{m}', false) AS INTEGER) AS "MosquitoRank_{m}" """
            for m in ("High", "Low", "Medium")
        )
        + ", "
        + ", ".join(f"""CAST("CulexFound" = '{m}' AS INTEGER) AS "CulexFound_{m}" """ for m in ("No", "Yes"))
        + " FROM inspections",
    ),
)
def one_hot_leftovers(spark, sf_dir):
    rows = inspections(spark, sf_dir).select("seq", "Wetness", "MosquitoRank", "CulexFound")
    return features.one_hot_leftovers(rows)


SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "standardize",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        sql6(f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)") + f" AS {c}"
        for c in SCALED
    )
    + " FROM lineitem",
)
def standardize(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *SCALED)
    return rounded(features.standardize(rows, fit_standardizer(rows, SCALED)), *SCALED)


@query("one_hot_label", _elements_sql("list_transform(range(10), lambda i: CAST(i = label AS INTEGER))"))
def one_hot_label(spark, sf_dir):
    return _elements(features.one_hot_label(vectors(spark, sf_dir), "label", 10), "label_vector")


@query("assemble_vector", _elements_sql("list_concat([CAST(label AS DOUBLE)], v, v[1:2], v[3:4])"))
def assemble_vector(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("grid", F.array(F.slice("v", 1, 2), F.slice("v", 3, 2)))
    return _elements(features.assemble_vector(rows, ["label", "v", "grid"], "a"), "a")


@query(
    "split_vector",
    with_views("vectors", "SELECT vec_id, list_sum(v[1:20]) IS NOT NULL AS ok, len(v[1:20]) AS left_size, "
      + sql6("list_sum(v[1:20])") + " AS left_sum, len(v[21:]) AS right_size, " + sql6("list_sum(v[21:])")
      + " AS right_sum FROM vectors"),
)
def split_vector(spark, sf_dir):
    from fieldspark.functions.vectors import total

    halves = features.split_vector(vectors(spark, sf_dir), "v", 20)
    return rounded(
        halves.select(
            "vec_id",
            F.lit(True).alias("ok"),
            F.size("left").cast("bigint").alias("left_size"),
            total(F.col("left")).alias("left_sum"),
            F.size("right").cast("bigint").alias("right_size"),
            total(F.col("right")).alias("right_sum"),
        ),
        "left_sum",
        "right_sum",
    )


@query("log1p", f"SELECT l_orderkey, l_linenumber, {sql6('ln(1 + l_extendedprice)')} AS logged FROM lineitem")
def log1p(spark, sf_dir):
    rows = features.log1p_col(table(spark, sf_dir, "lineitem"), "l_extendedprice", "logged")
    return rounded(rows.select("l_orderkey", "l_linenumber", "logged"), "logged")


BROKEN_ZERO = "CASE WHEN isnan(x) THEN 0.0 ELSE x END"


@query(
    "clamp",
    _elements_sql(
        f"list_transform(v, lambda x: greatest(-0.1, least(0.1, {BROKEN_ZERO})))", "broken_vectors"
    ),
)
def clamp(spark, sf_dir):
    return _elements(features.clamp(broken_vectors(spark, sf_dir), "v", -0.1, 0.1))


@query(
    "repair_invalid",
    _elements_sql("list_transform(v, lambda x: CASE WHEN isfinite(x) THEN x ELSE 0.0 END)", "broken_vectors"),
)
def repair_invalid(spark, sf_dir):
    return _elements(features.repair_invalid(broken_vectors(spark, sf_dir), ["v"]))


@query("rectify", _elements_sql("list_transform(v, lambda x: greatest(x, 0.0))"))
def rectify(spark, sf_dir):
    return _elements(features.rectify(vectors(spark, sf_dir), "v"))


@query("rectify_leaky", _elements_sql("list_transform(v, lambda x: CASE WHEN x > 0 THEN x ELSE 0.01 * x END)"))
def rectify_leaky(spark, sf_dir):
    return _elements(features.rectify(vectors(spark, sf_dir), "v", 0.01))


@query(
    "softmax",
    with_views(
        "vectors",
        f"""SELECT vec_id, pos, {sql6("e / s")} AS x FROM (SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos,
          exp(unnest(v) - list_max(v)) AS e, list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS s FROM vectors)""",
    ),
)
def softmax(spark, sf_dir):
    return _elements(features.softmax(vectors(spark, sf_dir), "v"))


@query(
    "layer_norm",
    with_views(
        "vectors",
        f"""SELECT vec_id, pos, {sql6("(x - m) / sqrt(greatest(s, 1e-6) + 1e-6)")} AS x FROM (
          SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS x, list_avg(v) AS m,
            list_var_pop(v) AS s FROM vectors)""",
    ),
)
def layer_norm(spark, sf_dir):
    return _elements(features.layer_norm(vectors(spark, sf_dir), "v"))


@query(
    "clip_l2",
    with_views(
        "vectors",
        f"""SELECT vec_id, pos, {sql6("CASE WHEN norm > 0.9 THEN x * (0.9 / norm) ELSE x END")} AS x FROM (
          SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS x,
            sqrt(list_sum(list_transform(v, lambda y: y * y))) AS norm FROM vectors)""",
    ),
)
def clip_l2(spark, sf_dir):
    return _elements(features.clip_l2(vectors(spark, sf_dir), "v", 0.9))


def _z(c):
    train = "FILTER (WHERE split = 'train') OVER ()"
    return sql6(f"({c} - avg({c}) {train}) / stddev_pop({c}) {train}")


@query(
    "training_features",
    with_views(
        "combined",
        f"""SELECT "SiteID", "Date", split, label, {_z("t")} AS temperature, {_z("o")} AS ordinal, {_z("w")} AS wetness,
          CAST(7 AS INTEGER) AS weather_width, (SELECT 3 + count(*) FROM (
            SELECT DISTINCT unnest([coalesce("MosquitoRank", 'Missing') || '1', coalesce("CattailMosquito", 'Missing') || '2', "CulexFound" || '3',
              "TreatedBy" || '4', "Action" || '5', coalesce("Material", 'Missing') || '6']) FROM numbered WHERE split = 'train')) AS site_width
        FROM numbered""",
        numbered="""SELECT *, CASE WHEN draw < 70 THEN 'train' WHEN draw < 85 THEN 'validation' ELSE 'test' END AS split,
          CAST(coalesce("DipCount" > 0.1, false) AS INTEGER) AS label, coalesce("Temperature", 0) AS t,
          CAST("Date" - DATE '1970-01-01' AS INTEGER) + 719163 AS o, coalesce("Wetness", 0) AS w
          FROM (SELECT *, CAST('0x' || substr(md5('42-' || "SiteID" || '-' || CAST("Date" AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS draw FROM combined)""",
    ),
)
def training_features(spark, sf_dir):
    """Three of the standardised inputs and the widths of both matrices."""
    m = training.matrices(cut_lineage(combined(spark, sf_dir)))
    weather, site = F.col("weather"), F.col("site")
    return rounded(
        m.rows.select(
            *KEYS,
            "split",
            "label",
            F.get(weather, F.lit(m.weather_columns.index("Temperature"))).alias("temperature"),
            F.get(weather, F.lit(m.weather_columns.index("DateOrdinal"))).alias("ordinal"),
            F.get(site, F.lit(m.site_columns.index("Wetness"))).alias("wetness"),
            F.size(weather).alias("weather_width"),
            F.size(site).cast("bigint").alias("site_width"),
        ),
        "temperature",
        "ordinal",
        "wetness",
    )


TRAINING_VIEWS = {
    "numbered": """SELECT *, CASE WHEN draw < 70 THEN 'train' WHEN draw < 85 THEN 'validation' ELSE 'test' END AS split
      FROM (SELECT *, CAST('0x' || substr(md5('42-' || "SiteID" || '-' || CAST("Date" AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS draw FROM combined)""",
    "codes": """SELECT "SiteID", row_number() OVER (ORDER BY "SiteID") - 1 AS code
      FROM (SELECT DISTINCT "SiteID" FROM numbered WHERE split = 'train')""",
    "numbers": """SELECT n."SiteID", n."Date", split, unnest(['Temperature', 'Precipitation', 'CloudCoverage', 'DateOrdinal', 'Month', 'Day', 'Year',
        'SiteCode', 'WetlandType', 'Wetness']) AS name,
      unnest([coalesce("Temperature", 0), coalesce("Precipitation", 0), coalesce("CloudCoverage", 0), n."Date" - DATE '1970-01-01' + 719163,
        month(n."Date"), day(n."Date"), year(n."Date"), coalesce(code, -1), coalesce("WetlandType", 0), coalesce("Wetness", 0)]) AS x
      FROM numbered n LEFT JOIN codes USING ("SiteID")""",
    "texts": """SELECT "SiteID", "Date", split, unnest(['MosquitoRank', 'CattailMosquito', 'CulexFound', 'TreatedBy', 'Action', 'Material']) AS col,
      unnest([coalesce("MosquitoRank", 'Missing'), coalesce("CattailMosquito", 'Missing'), coalesce("CulexFound", 'Missing'),
        coalesce("TreatedBy", 'Missing'), coalesce("Action", 'Missing'), coalesce("Material", 'Missing')]) AS v FROM numbered""",
    "flags": """SELECT t."SiteID", t."Date", t.split, t.col || '_' || d.v AS name, CASE WHEN t.v = d.v THEN 1 ELSE 0 END AS x
      FROM texts t JOIN (SELECT DISTINCT col, v FROM texts WHERE split = 'train') d ON t.col = d.col""",
    "inputs": "SELECT * FROM numbers UNION ALL SELECT * FROM flags",
    "fitted": """SELECT name, avg(x) AS mean, CASE WHEN min(x) < max(x) THEN stddev_pop(x) ELSE 1 END AS spread
      FROM inputs WHERE split = 'train' GROUP BY 1""",
}


@query(
    "training_matrix",
    with_views(
        "combined",
        f"""SELECT "SiteID", "Date", name, {sql6("(x - mean) / spread")} AS value FROM inputs JOIN fitted USING (name)""",
        **TRAINING_VIEWS,
    ),
)
def training_matrix(spark, sf_dir):
    """Every element of the standardised matrices, by the name of its column."""
    return _named_cells(training.matrices(cut_lineage(combined(spark, sf_dir))))


def _named_cells(m):
    names = F.array(*map(F.lit, m.weather_columns + m.site_columns))
    cells = m.rows.select(*KEYS, F.posexplode("features").alias("_at", "value"))
    return rounded(cells.select(*KEYS, F.get(names, F.col("_at")).alias("name"), "value"), "value")


FIELDS = ("Temperature", "Precipitation", "CloudCoverage")
KERNEL_SQL = {
    "mean3": "(a + b + c) / 3",
    "rise": "c - a",
    "peak": "2 * b - a - c",
}
SERIES_VIEWS = {
    "daily": """SELECT "Date", max({'t': "Temperature", 'p': "Precipitation", 'c': "CloudCoverage"}) AS d
      FROM combined WHERE "Temperature" IS NOT NULL GROUP BY 1""",
    "series": """SELECT n."SiteID", n."Date", split, back, coalesce(d.t, 0) AS t, coalesce(d.p, 0) AS p, coalesce(d.c, 0) AS c
      FROM (SELECT *, unnest(range(5)) AS back FROM numbered) n LEFT JOIN daily ON daily."Date" = n."Date" - CAST(back AS INTEGER)""",
    "days": """SELECT "SiteID", "Date", split, unnest(['Temperature_', 'Precipitation_', 'CloudCoverage_']) || back AS name, unnest([t, p, c]) AS x
      FROM series WHERE back > 0""",
    "triples": " UNION ALL ".join(
        f"""SELECT "SiteID", "Date", split, '{name}' AS field, back,
          lead({col}, 2) OVER w AS a, lead({col}) OVER w AS b, {col} AS c FROM series
          WINDOW w AS (PARTITION BY "SiteID", "Date" ORDER BY back)"""
        for name, col in zip(FIELDS, "tpc")
    ),
    "convolved": " UNION ALL ".join(
        f"""SELECT "SiteID", "Date", split, field || '_{name}_' AS stem, back, greatest({expression}, 0) AS x
          FROM triples WHERE back < 3"""
        for name, expression in KERNEL_SQL.items()
    ),
    "kernels": """SELECT "SiteID", "Date", split, stem || back AS name, x FROM convolved
      UNION ALL SELECT "SiteID", "Date", split, stem || 'max', max(x) FROM convolved GROUP BY "SiteID", "Date", split, stem
      UNION ALL SELECT "SiteID", "Date", split, stem || 'avg', avg(x) FROM convolved GROUP BY "SiteID", "Date", split, stem""",
}
ALL_INPUTS = {
    **{k: v for k, v in TRAINING_VIEWS.items() if k not in ("inputs", "fitted")},
    **SERIES_VIEWS,
    "inputs": "SELECT * FROM numbers UNION ALL SELECT * FROM flags UNION ALL SELECT * FROM days UNION ALL SELECT * FROM kernels",
    "fitted": TRAINING_VIEWS["fitted"],
}


@query(
    "training_matrix_days",
    with_views(
        "combined",
        f"""SELECT "SiteID", "Date", name, {sql6("(x - mean) / spread")} AS value FROM inputs JOIN fitted USING (name)""",
        **ALL_INPUTS,
    ),
)
def training_matrix_days(spark, sf_dir):
    """Every element with the five look-back days, their kernels and pools."""
    return _named_cells(training.matrices(cut_lineage(combined(spark, sf_dir)), days=5, kernels=True))


MOST_VALUES = 32


@query(
    "sparse_training_matrix",
    with_views(
        "combined",
        f"""SELECT "SiteID", "Date", name, {sql6("value")} AS value FROM (
          SELECT i."SiteID", i."Date", name, (x - mean) / spread AS value
          FROM (SELECT * FROM numbers UNION ALL SELECT * FROM days UNION ALL SELECT * FROM kernels) i JOIN fitted USING (name)
          UNION ALL
          SELECT "SiteID", "Date", name, 1 / spread FROM named JOIN spreads USING (name) WHERE spread > 0)
        WHERE value <> 0""",
        **{k: v for k, v in ALL_INPUTS.items() if k not in ("flags", "inputs", "fitted")},
        fitted="""SELECT name, avg(x) AS mean, CASE WHEN min(x) < max(x) THEN stddev_pop(x) ELSE 1 END AS spread
          FROM (SELECT * FROM numbers UNION ALL SELECT * FROM days UNION ALL SELECT * FROM kernels) WHERE split = 'train' GROUP BY 1""",
        named=f"""SELECT "SiteID", "Date", split, col || '_' || v AS name FROM texts
          UNION ALL SELECT "SiteID", "Date", split, 'Notes#' || CAST('0x' || substr(md5('hashed-' || notes), 1, 8) AS BIGINT) % {MOST_VALUES}
          FROM (SELECT *, 'seen at ' || "SiteID" || ' on ' || CAST("Date" AS VARCHAR) AS notes FROM numbered)""",
        spreads="""SELECT name, sqrt((m - m * m / n) / (n - 1)) AS spread FROM (
            SELECT name, count(*)::DOUBLE AS m FROM named WHERE split = 'train' GROUP BY 1),
          (SELECT count(*)::DOUBLE AS n FROM numbered WHERE split = 'train')""",
    ),
)
def sparse_training_matrix(spark, sf_dir):
    """Every element that is not 0 of the sparse inputs, with a text column that has a
    value of its own in every row."""
    rows = combined(spark, sf_dir)
    note = F.concat(F.lit("seen at "), "SiteID", F.lit(" on "), F.col("Date").cast("string"))
    m = training.sparse_matrices(
        cut_lineage(rows.withColumn("Notes", note)), days=5, kernels=True, most_values=MOST_VALUES
    )
    cells = m.rows.select(*KEYS, F.posexplode(vector_to_array("features")).alias("position", "value"))
    named = cells.where("value <> 0").join(F.broadcast(m.names), "position")
    return rounded(named.select(*KEYS, "name", "value"), "value")
