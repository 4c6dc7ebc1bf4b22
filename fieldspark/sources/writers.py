"""Sinks."""

from fieldspark.schema import US_DATE

FORMATS = ("parquet", "orc", "json", "csv")


def write_table(df, path, fmt="parquet", partition_by=()):
    """Write with header, replacing what is at ``path``.

    A table cannot replace the files it is being read from: give every rewrite
    a new version folder, which also keeps the previous one if a job dies.
    CSV dates are written month/day/year as they are read.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.options(header=True, dateFormat=US_DATE, escape='"')
    writer.save(path)
    return path
