"""Shared folders for checkpoints and written tables."""

import tempfile
import uuid

from pyspark.sql import functions as F


def shared_dir(spark):
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode with the setting absent.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldspark-"))
    return context.getCheckpointDir()


def new_path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/fieldspark/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable checkpoint: later steps reread files instead of recomputing,
    so a lost executor costs nothing upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df, max_bytes=64 << 20):
    """Broadcast hint only after measuring; above the bound the optimiser
    chooses (shuffled join, skew split at run time). Pass a table that is
    cheap to scan: landed, checkpointed, or aggregated."""
    per_row = F.lit(16 * len(df.columns))
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            per_row = per_row + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            # Written out as text a nested value is about as large as in memory.
            per_row = per_row + F.coalesce(2 * F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    size = df.agg(F.sum(per_row)).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def _file_system(spark, path):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def path_exists(spark, path):
    files, location = _file_system(spark, path)
    return files.exists(location)


def matching_paths(spark, pattern):
    """Paths that a pattern with wildcards matches; only names are read."""
    files, location = _file_system(spark, pattern)
    return [str(s.getPath()) for s in files.globStatus(location) or ()]


def finished_folders(spark, path):
    """Names of the folders below ``path`` whose write was committed."""
    return [p.split("/")[-2] for p in matching_paths(spark, f"{path}/*/_SUCCESS")]


def remove_folder(spark, path):
    """Delete a folder that no table refers to any more."""
    files, location = _file_system(spark, path)
    return files.delete(location, True)


def first_bytes(spark, path, n):
    """The first bytes of a file, as the driver reads them."""
    files, location = _file_system(spark, path)
    stream = files.open(location)
    try:
        read = [stream.read() for _ in range(n)]
    finally:
        stream.close()
    return bytes(b for b in read if b >= 0)
