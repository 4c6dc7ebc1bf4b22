"""Jobs that run again and again and pick up only what is new.

Both use a file source with ``availableNow``: a run handles the files landed
since the previous one and stops; the stream checkpoint remembers them.
"""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.cells import is_blank
from fieldspark.operators.calendar import lookback_expand
from fieldspark.operators.clean import mask_synthetic
from fieldspark.operators.merge import (
    backfill_weather,
    enrich_weather,
    keep_first,
    merge_insert_only,
    new_winners,
)
from fieldspark.schema import KEYS, LOOKBACK_DAYS, WEATHER
from fieldspark.storage import finished_folders, matching_paths, path_exists, remove_folder

NEEDS_WEATHER = "needs_weather"


def _plus(schema, **columns):
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in columns.items()]])


def _run(stream, out, checkpoint, partition_by):
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*partition_by)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def file_stream(spark, path, schema, fmt="parquet", **options):
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def _run_ids(spark, path):
    """Ids of the runs whose folder below ``path`` was written to the end."""
    if not path_exists(spark, path):
        return []
    return sorted(
        int(name.removeprefix("run="))
        for name in finished_folders(spark, path)
        if name.startswith("run=")
    )


def _landed_ids(spark, path, below=""):
    """Ids of the runs that the stream has begun to land; only folder names are read."""
    names = matching_paths(spark, f"{path}{below}/run=*")
    return sorted({int(n.rsplit("run=", 1)[1]) for n in names})


def _read_runs(spark, path, ids, schema):
    """The rows of finished runs; folders that were not finished are never read."""
    reader = spark.read.schema(schema).option("basePath", path)
    return reader.parquet(*[f"{path}/run={i}" for i in ids])


def _retried(out):
    return f"{out.rstrip('/')}-retried"


def incremental_backfill(stream, weather, out, checkpoint):
    """Land the new rows of ``stream`` and fill what was still blank before.

    New rows go to ``out`` once. Rows that lack weather are filed under their date, so
    a run reads those of the dates whose weather has come since and no others: it fills
    them and writes them to a folder of its own beside ``out``, again by date. The
    names of these folders tell which dates of which runs are done. Runs are numbered
    by what is in the tables. A run that died is made good by the next one.
    """
    spark, schema = stream.sparkSession, _pending_schema(stream.schema)
    run = 1 + max([0, *_run_ids(spark, _retried(out)), *_landed_ids(spark, out, "/*/*")])
    filled = backfill_weather(stream, weather).withColumn("run", F.lit(run))
    waits = is_blank(F.col(WEATHER[0]))
    filled = filled.withColumn(NEEDS_WEATHER, waits).withColumn(
        PENDING_DATE, F.when(waits, F.coalesce(F.col("Date").cast("string"), F.lit(NO_DATE)))
    )
    _run(filled, out, checkpoint, [NEEDS_WEATHER, PENDING_DATE, "run"])
    # At most a row a date.
    known = weather.where(~is_blank(F.col(WEATHER[0]))).select(F.col("Date").cast("string").alias("day"))
    ready = _open_dates(spark, out, {r["day"] for r in known.distinct().collect()})
    if ready:
        again = backfill_weather(_waiting(spark, out, schema, ready), weather)
        again.drop(NEEDS_WEATHER, "run").hint("rebalance", PENDING_DATE).write.mode("overwrite").partitionBy(
            PENDING_DATE
        ).parquet(f"{_retried(out)}/run={run}")


PENDING_DATE = "pending_date"
NO_DATE = "none"


def _pending_schema(schema):
    return _plus(
        schema, **{NEEDS_WEATHER: T.BooleanType(), PENDING_DATE: T.StringType(), "run": T.LongType()}
    )


def _open_dates(spark, out, days=None):
    """The last finished run of every date that has rows still waiting (0 if none), for
    dates among ``days``. Only folder names are read."""
    done = set(_run_ids(spark, _retried(out))) if path_exists(spark, _retried(out)) else set()
    filled, landed = {}, {}
    for path in matching_paths(spark, f"{_retried(out)}/run=*/{PENDING_DATE}=*"):
        run, day = re.search(rf"run=(\d+)/{PENDING_DATE}=([^/]+)$", path).groups()
        if int(run) in done:
            filled[day] = max(int(run), filled.get(day, 0))
    for path in matching_paths(spark, f"{out}/{NEEDS_WEATHER}=true/{PENDING_DATE}=*/run=*"):
        day, run = re.search(rf"{PENDING_DATE}=([^/]+)/run=(\d+)$", path).groups()
        landed[day] = max(int(run), landed.get(day, 0))
    return {
        day: filled.get(day, 0)
        for day, run in sorted(landed.items())
        if run > filled.get(day, 0) and (days is None or day in days)
    }


def _waiting(spark, out, schema, ready):
    """Rows of the given dates that landed after the run that last filled their date;
    the filter is on folder names alone, so other folders are not read."""
    landed = spark.read.schema(schema).parquet(out).where(F.col(NEEDS_WEATHER))
    later = F.lit(False)
    for run in sorted(set(ready.values())):
        days = [day for day, last in ready.items() if last == run]
        later = later | (F.col(PENDING_DATE).isin(days) & (F.col("run") > run))
    return landed.where(later)


def _pending(spark, out, schema):
    """Rows without weather; None if nothing was landed."""
    if not path_exists(spark, out):
        return None
    return _waiting(spark, out, schema, _open_dates(spark, out)).drop(NEEDS_WEATHER, PENDING_DATE, "run")


def read_backfilled(spark, out, weather, schema):
    """Everything landed so far, with today's weather where it was missing."""
    full = _pending_schema(schema)
    rows = spark.read.schema(full).parquet(out).where(~F.col(NEEDS_WEATHER)).select(*schema.names)
    done = _run_ids(spark, _retried(out))
    if done:
        rows = rows.unionByName(_read_runs(spark, _retried(out), done, full).select(*schema.names))
    return rows.unionByName(backfill_weather(_pending(spark, out, full), weather))


def count_pending(spark, out, schema):
    """Rows that still wait for weather."""
    return _pending(spark, out, _pending_schema(schema)).count()


def merged_schema(inspections):
    """Columns of the expanded rows, given the schema of the inspections."""
    extra = {"inspected_on": T.DateType(), "is_recorded": T.BooleanType()}
    return _plus(inspections, **extra, **{c: T.DoubleType() for c in WEATHER})


def incremental_merge(
    spark, stream, weather, root, order_col="seq", policy="prefer_recorded", n=LOOKBACK_DAYS
):
    """Expand newly landed inspections and add them by key once.

    A run writes its expanded rows to ``root/staged/run=...`` and then, in a
    folder of its own under ``root/merged``, only the rows that win a key:
    nothing already merged is rewritten. Runs are numbered by what is in the
    tables, never by a clock. Every staged run without a finished merge is merged,
    in their order, so a run that died after staging is made good by the next one;
    repeating a merge writes the same rows. Keys are compared within the touched
    months. Read with ``read_merged``.
    """
    staged, merged = f"{root}/staged", f"{root}/merged"
    schema = _plus(merged_schema(stream.schema), run=T.LongType())
    known = [*_run_ids(spark, merged), *_run_ids(spark, _compacted(root))]
    run = 1 + max([0, *known, *_landed_ids(spark, staged)])
    expanded = mask_synthetic(lookback_expand(stream, "Date", n))
    rows = enrich_weather(expanded, weather).withColumn("run", F.lit(run))
    _run(rows, staged, f"{root}/stream_checkpoint", ["run"])
    done = {*_run_ids(spark, merged), *_merged_before(spark, root)}
    for each in sorted(set(_landed_ids(spark, staged)) - done):
        _merge_run(spark, root, each, schema, order_col, policy)


def _merge_run(spark, root, run, schema, order_col, policy):
    todo = spark.read.schema(schema).parquet(f"{root}/staged").where(F.col("run") == run)
    todo = todo.drop("run").withColumn("month", F.date_format("Date", "yyyy-MM"))
    new = merge_insert_only(None, todo, order_col, KEYS, policy)
    table = _merged_rows(spark, root, schema)
    if table is not None:
        months = todo.select("month").distinct()  # bounded by the calendar
        new = new_winners(table.join(F.broadcast(months), "month", "left_semi"), new, KEYS, policy)
    _write_by_month(new, f"{root}/merged/run={run}")


def _write_by_month(rows, path):
    """A folder a month. The hint lets Spark split a month of many rows over as many
    tasks and files as its size asks for, and put small months together."""
    rows.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)


def _compacted(root):
    return f"{root}/compacted"


def _merged_before(spark, root):
    """Runs that the last compaction holds: all up to its own number."""
    base = _run_ids(spark, _compacted(root))
    return range(1, base[-1] + 1) if base else []


def _merged_rows(spark, root, schema):
    """The last compaction and the runs merged since; None if there is neither."""
    placed = _plus(schema, month=T.StringType())
    base = _run_ids(spark, _compacted(root))[-1:]
    later = [r for r in _run_ids(spark, f"{root}/merged") if r not in _merged_before(spark, root)]
    parts = []
    if base:
        parts.append(_read_runs(spark, _compacted(root), base, placed))
    if later:
        parts.append(_read_runs(spark, f"{root}/merged", later, placed))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact_merged(spark, root, schema, policy="prefer_recorded"):
    """Write the current rows once, clustered by month, without those beaten since.

    Takes all staged runs as merged up to now, so merge first. Earlier folders are
    no longer read; ``remove_compacted`` deletes them.
    """
    ids = [*_run_ids(spark, f"{root}/merged"), *_run_ids(spark, _compacted(root))]
    if ids:
        rows = read_merged(spark, root, schema, policy)
        rows = rows.withColumn("month", F.date_format("Date", "yyyy-MM"))
        _write_by_month(rows, f"{_compacted(root)}/run={max(ids)}")


def remove_compacted(spark, root):
    """Delete merged runs and compactions that the last compaction has replaced. Staged
    rows stay: they say which runs are merged. Readers of an older state must be done."""
    last = _run_ids(spark, _compacted(root))[-1:]
    for place, beaten in ((f"{root}/merged", lambda i: i <= last[0]), (_compacted(root), lambda i: i < last[0])):
        for i in _run_ids(spark, place) if last else []:
            if beaten(i):
                remove_folder(spark, f"{place}/run={i}")


def read_merged(spark, root, schema, policy="prefer_recorded", since=None, until=None):
    """The current row of every key; ``schema`` comes from ``merged_schema``.

    ``since`` and ``until`` (dates) limit the rows and the months that are read.
    """
    table = _merged_rows(spark, root, _plus(schema, run=T.LongType()))
    if table is None:
        return spark.createDataFrame([], schema)
    for bound, keep in ((since, "__ge__"), (until, "__le__")):
        if bound is not None:
            table = table.where(
                getattr(F.col("month"), keep)(f"{bound:%Y-%m}") & getattr(F.col("Date"), keep)(F.lit(bound))
            )
    if policy == "first":
        return table.drop("run", "month")
    return keep_first(table, KEYS, ~F.col("is_recorded"), F.col("run")).drop("run", "month")


# -- merging with keyed state ---------------------------------------------------

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _precedence(order_col, policy):
    """Of two rows of a key the one with the smaller struct stays. A row of an earlier
    run goes before one of a later run, except that with "prefer_recorded" a recorded
    row goes before one that is not."""
    later = [F.col("run").alias("run"), F.col(order_col).alias("at")]
    if policy == "first":
        return F.struct(*later)
    return F.struct((~F.col("is_recorded")).alias("shadow"), *later)


def keyed_merge(stream, weather, root, order_col="seq", policy="prefer_recorded", n=LOOKBACK_DAYS):
    """Expand newly landed inspections and merge them through state kept by key.

    The state holds the row of every ``SiteID, Date`` that stays, spread over the
    shuffle partitions by key, so neither a month nor a site is one task's work and
    what was merged before is not read again. A run writes only the rows that it made
    win, in a folder a micro-batch below ``root/changes``; writing a batch again
    replaces its folder. The number of a run comes from those folders. Read with
    ``read_keyed``. The state is in RocksDB, on disk, unless the session names another
    store.
    """
    spark = stream.sparkSession
    changes = f"{root}/changes"
    run = 1 + len(finished_folders(spark, changes)) if path_exists(spark, changes) else 1
    expanded = mask_synthetic(lookback_expand(stream, "Date", n))
    rows = enrich_weather(expanded, weather).withColumn("run", F.lit(run).cast("long"))
    others = [c for c in rows.columns if c not in KEYS]
    best = rows.groupBy(*KEYS).agg(F.min_by(F.struct(*others), _precedence(order_col, policy)).alias("_best"))
    # A key that an older row keeps is touched, but nothing changes.
    won = best.select(*KEYS, "_best.*").where(F.col("run") == run)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    store = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, store or ROCKSDB)
    try:
        query = (
            won.writeStream.outputMode("update")
            .option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset(STATE_STORE) if store is None else spark.conf.set(STATE_STORE, store)


def read_keyed(spark, root, schema, order_col="seq", policy="prefer_recorded"):
    """The current row of every key that ``keyed_merge`` has merged; ``schema`` comes
    from ``merged_schema``. A key has a row for each time that a better one came."""
    changes = f"{root}/changes"
    names = finished_folders(spark, changes) if path_exists(spark, changes) else []
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(_plus(schema, run=T.LongType())).parquet(*[f"{changes}/{n}" for n in names])
    return keep_first(rows, KEYS, _precedence(order_col, policy)).drop("run")
