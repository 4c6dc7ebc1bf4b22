"""Landing-zone readers. Schemas are always given, never inferred."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions import cells
from fieldspark.operators.ranking import sorted_rank
from fieldspark.schema import (
    COMBINED_COLUMNS,
    INSPECTION_TEXT,
    NA_TOKENS,
    RUN_LOG_TEXT,
    WEATHER,
    WEATHER_PAYLOAD,
    text_schema,
)
from fieldspark.storage import first_bytes

BAD_RECORD = "_bad_record"

# Reader option per dialect key.
DIALECT_OPTIONS = {
    "separator": "sep",
    "quote": "quote",
    "escape": "escape",
    "quoted_line_breaks": "multiLine",
    "comment": "comment",
    "encoding": "encoding",
    "line_separator": "lineSep",
}


def _options(dialect):
    dialect = dict(dialect or {})
    # A doubled quote inside quotes stands for one quote.
    options = {"escape": dialect.get("quote", '"'), "mode": "PERMISSIVE", "nullValue": ""}
    if dialect.pop("trim", False):
        options.update(ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    for key, value in dialect.items():
        if key not in DIALECT_OPTIONS:
            raise ValueError(f"unknown dialect option: {key}")
        options[DIALECT_OPTIONS[key]] = value
    return options


# Line ends of wide characters as the bytes of a text that UTF-8 writes the same, and the
# bytes of a character. Byte order marks by encoding, longest first.
WIDE_LINE_ENDS = {
    "UTF-16LE": ("\n\0", 2),
    "UTF-16BE": ("\0\n", 2),
    "UTF-32LE": ("\n\0\0\0", 4),
    "UTF-32BE": ("\0\0\0\n", 4),
}
BYTE_ORDER_MARKS = {
    "UTF-32LE": b"\xff\xfe\0\0",
    "UTF-32BE": b"\0\0\xfe\xff",
    "UTF-16LE": b"\xff\xfe",
    "UTF-16BE": b"\xfe\xff",
}


def _is_wide(options):
    return options.get("encoding", "").upper().startswith(("UTF-16", "UTF-32"))


def _whole_files(options):
    """Wide characters read by the CSV reader itself: one task a file."""
    return {**options, "multiLine": True} if _is_wide(options) else options


def _byte_order(spark, file, encoding):
    """The encoding of a file with its byte order, which its first bytes may tell."""
    encoding = encoding.upper()
    if encoding in WIDE_LINE_ENDS:
        return encoding
    start = first_bytes(spark, file, 4)
    for name, mark in BYTE_ORDER_MARKS.items():
        if name.startswith(encoding) and start.startswith(mark):
            return name
    return f"{encoding}BE"


def _decoded(data, encoding):
    mark = BYTE_ORDER_MARKS[encoding]
    bare = F.when(F.substring(data, 1, len(mark)) == F.lit(mark), F.substring(data, len(mark) + 1, 2**31 - 1))
    bare = F.coalesce(bare, data)
    if encoding.startswith("UTF-32"):
        # The order of the bytes is told by a mark.
        text = F.decode(F.concat(F.lit(mark), bare), "UTF-32")
        return F.regexp_replace(text, "^\ufeff", "")
    return F.decode(bare, encoding)


def _wide_lines(spark, files, options, header):
    """Lines of files of wide characters, read by byte ranges as those of narrow ones:
    ``line, _at``, without header lines. None if they cannot be read so: if a line end's
    bytes also stand across two characters, a file has another header or the header
    twice, or quoted fields may hold line breaks.
    """
    if options.get("multiLine") or "lineSep" in options:
        return None
    parts = []
    for encoding in sorted({_byte_order(spark, f, options["encoding"]) for f in files}):
        own = [f for f in files if _byte_order(spark, f, options["encoding"]) == encoding]
        end, width = WIDE_LINE_ENDS[encoding]
        data = F.col("value").cast("binary")
        rows = spark.read.option("lineSep", end).text(own).select(data.alias("data"), _place().alias("_at"))
        # Lines are cut at characters' borders if no line has a part of a character.
        broken = F.octet_length("data") % width != 0
        if rows.where(broken).limit(1).count():
            return None
        line = F.regexp_replace(_decoded(F.col("data"), encoding), "\r$", "")
        parts.append(rows.select(line.alias("line"), "_at"))
    lines = reduce(lambda a, b: a.union(b), parts)
    headers = lines.where(F.col("line") == header).groupBy("_at.file").count()
    single = headers.agg(F.count(F.lit(1)).alias("files"), F.max("count").alias("most")).first()
    if (single["files"], single["most"]) != (len(files), 1):
        return None
    kept = (F.col("line") != header) & (F.trim("line") != "")
    if "comment" in options:
        kept = kept & ~F.startswith(F.col("line"), F.lit(options["comment"]))
    return lines.where(kept)


def _place():
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _rows(spark, path, files, names, options, checked):
    """Rows of CSV files with the reader's column names, the record as it was where it is
    malformed, and ``_at``, the row's place."""
    schema = text_schema(names).add(BAD_RECORD, "string")
    if _is_wide(options):
        as_is = {"header": False, "sep": "\0", "quote": "", "escape": ""}
        as_is |= {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        header = spark.read.options(**{**_whole_files(options), **as_is}).csv(files[0]).first()
        lines = _wide_lines(spark, files, options, header[0].lstrip("\ufeff")) if header else None
        if lines is not None:
            kept = {k: str(v) for k, v in options.items() if k not in ("header", "encoding")}
            kind = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)
            record = F.from_csv("line", kind, {**kept, "columnNameOfCorruptRecord": BAD_RECORD})
            return lines.select(record.alias("record"), "_at").select("record.*", "_at")
    reader = spark.read.schema(schema).options(columnNameOfCorruptRecord=BAD_RECORD, **_whole_files(options))
    return reader.option("enforceSchema", not checked).csv(path).select("*", _place().alias("_at"))


def _files(spark, path):
    """The files below a path, without reading them."""
    rows = spark.read.format("binaryFile").load(path).select("path").collect()
    return sorted(r["path"] for r in rows)


def _header(spark, file, options):
    """The reader's column names and the names as the file has them. The reader numbers
    repeated names by position."""
    options = _whole_files(options)
    raw = spark.read.options(**{**options, "header": False}).csv(file).first()
    names = spark.read.options(**{**options, "header": True}).csv(file).columns
    return tuple(names), tuple(raw or names)


def _by_name(names, raw, name):
    """Column for ``name``; a name repeated in the header means its last occurrence."""
    same = [n for n, r in zip(names, raw) if r == name or (n == name and r is None)]
    return F.col(f"`{same[-1]}`") if same else F.lit(None).cast("string")


def read_inspections(
    spark, path, schema=INSPECTION_TEXT, dialect=None, seq=None, mixed_headers=False, others=False, place=None
):
    """CSV with a header, every field as text, bound by column name.

    Columns absent from the file are NULL and a malformed line stays visible in
    ``_bad_record``; empty lines are skipped. All files must have the same header,
    else the read fails (files of UTF-16 and UTF-32 are not compared); with ``mixed_headers`` every file's header is looked at
    and each file is bound by its own. ``others`` keeps the columns that ``schema``
    does not name. ``place`` names an extra column that orders the rows as the files
    have them, for the merges that depend on it: a struct of file, block and row in the
    block, which costs no sort. ``seq`` names one with the row's number, for which all
    rows are sorted and written once.
    """
    options = {"header": True, **_options(dialect)}
    files = _files(spark, path)
    if not files:
        raise ValueError(f"no files at {path}")
    headers = {}
    for file in files if mixed_headers else files[:1]:
        headers.setdefault(_header(spark, file, options), []).append(file)
    known = [f.name for f in schema]
    parts = []
    for (names, raw), group in headers.items():
        # The reader compares headers itself, except repeated names, which it renames.
        checked = len(files) > 1 and not mixed_headers and names == raw
        rows = _rows(spark, group if mixed_headers else path, group if mixed_headers else files, names, options, checked)
        columns = [_by_name(names, raw, c).alias(c) for c in known]
        if others:
            columns += [_by_name(names, raw, c).alias(c) for c in dict.fromkeys(raw) if c and c not in known]
        columns.append(F.col(BAD_RECORD))
        if seq or place:
            columns.append(F.col("_at").alias(place or "_place"))
        parts.append(rows.select(*columns))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    if not seq:
        return rows
    numbered = sorted_rank(rows, [place or "_place"], seq)
    return numbered if place else numbered.drop("_place")


def read_positional(spark, path, columns=COMBINED_COLUMNS, dialect=None):
    """Ignore the header's names and bind columns by position: short rows are
    padded with NULL, extra fields dropped, empty lines skipped, text trimmed."""
    options = {"header": True, "enforceSchema": True, **_options({"trim": True, **(dialect or {})})}
    rows = spark.read.schema(text_schema(columns)).options(**_whole_files(options)).csv(path)
    return rows.select(*[cells.blank_to_null(F.col(c)).alias(c) for c in columns])


def read_weather_json(spark, path, bad_records=False):
    """Landed payloads, one JSON object per line: the requested ``date`` (or the
    date of the first weather entry) and its weather. Whatever a payload lacks
    is NULL; a payload without any date is dropped. With ``bad_records`` lines that
    are no JSON stay visible in ``_bad_record``."""
    landed = T.StructType([T.StructField("date", T.StringType()), *WEATHER_PAYLOAD.fields])
    rows = (
        spark.read.schema(landed.add(BAD_RECORD, "string"))
        .options(mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_RECORD)
        .json(path)
    )
    first = F.get("data.weather", F.lit(0))
    texts = [
        first["avgtempC"],
        first["precipMM"],
        F.get(first["hourly"], F.lit(0))["cloudcover"],
    ]
    read = rows.select(
        F.try_to_date(F.coalesce("date", first["date"]), "yyyy-M-d").alias("Date"),
        *[
            cells.no_nan(cells.blank_to_null(t, NA_TOKENS).try_cast("double")).alias(n)
            for t, n in zip(texts, WEATHER)
        ],
        BAD_RECORD,
    )
    if bad_records:
        return read.where(F.col("Date").isNotNull() | F.col(BAD_RECORD).isNotNull())
    return read.where(F.col("Date").isNotNull()).drop(BAD_RECORD)


def read_run_log(spark, path):
    """Epoch, training loss, validation accuracy; "nan" and bad text are NULL."""
    log = spark.read.schema(RUN_LOG_TEXT).option("header", True).option("nullValue", "").csv(path)

    def number(c):
        return cells.no_nan(cells.blank_to_null(F.col(c)).try_cast("double")).alias(c)

    return log.select(
        cells.blank_to_null(F.col("Epoch")).try_cast("int").alias("Epoch"),
        number("TrainingLoss"),
        number("ValidationAccuracy"),
    )
