"""Legacy ARC archives: writing, parsing, and conversion to WARC.

An ARC file opens with a version block that names the header fields of its records:
five in version 1, ten in version 2. A record is a header line and as many bytes as
the line declares; nothing else tells where it ends. Conversion keeps those bytes
as the block of a WARC record and makes up what ARC lacks: a record id from the
archive's name and the record's number, an ISO date from the 14, 12 or 8 digits, the
type from what the block is, and digests of block and payload.
"""

import hashlib
import re
import uuid
import zlib

from pyspark.sql import functions as F

from fieldspark.llm.common import iterate_batches
from fieldspark.storage import cut_lineage, new_path

FIELDS = {
    1: ["url", "ip", "date", "content_type", "length"],
    2: ["url", "ip", "date", "content_type", "result", "checksum", "location", "offset", "filename", "length"],
}
# The two header layouts as version blocks spell them: fixed values of the format.
FIELD_LINES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
    "Filename Archive-length",
}
SMALLEST_REVISIT = 100
OUT_BYTES = 4 << 20
CRLF = b"\r\n"


# -- writing ARC -------------------------------------------------------------


def _version_block(version):
    body = f"{version} 0 fieldspark\n{FIELD_LINES[version]}\n"
    name = F.concat(F.lit("filedesc://legacy-"), F.spark_partition_id().cast("string"), F.lit(".arc"))
    rest = {1: "", 2: "200 - - 0 - "}[version]
    return F.concat(
        name, F.lit(f" 0.0.0.0 20000101000000 text/plain {rest}{len(body)}\n{body}\n")
    )


def write_arc(pages, path, id_col="page_id", url_col="url", payload_col="html"):
    """Rows as HTTP responses in gzipped ARC files, one file per partition, versions
    1 and 2 in turn. A null payload is empty; a null url becomes a name of its own."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    key = F.col(id_col).cast("long")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.coalesce(F.concat(F.lit("X-Page-Id: "), key.cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("\r\n"),
    )
    url = F.regexp_replace(
        F.coalesce(F.col(url_col).cast("string"), F.lit("http://unknown.invalid/")),
        "[\\s\\p{Cntrl}]+",
        "%20",
    )
    date = F.date_format(
        F.timestamp_seconds(F.lit(946684800) + F.pmod(F.coalesce(key, F.lit(0)), F.lit(10**9))),
        "yyyyMMddHHmmss",
    )
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    odd = F.spark_partition_id() % 2 == 1
    rows = pages.select(
        url.alias("_url"), date.alias("_date"), F.concat(head, payload).alias("_doc")
    )
    length = F.octet_length("_doc").cast("string")
    common = [F.col("_url"), F.lit(" 0.0.0.0 "), F.col("_date"), F.lit(" text/html ")]
    record = F.when(
        odd, F.concat(*common, F.lit("200 "), F.md5("_doc"), F.lit(" - 0 - "), length)
    ).otherwise(F.concat(*common, length))
    opening = F.when(~first, "").when(odd, _version_block(2)).otherwise(_version_block(1))
    text = F.concat(opening, record, F.lit("\n"), F.col("_doc"))
    rows.select(text.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


# -- parsing -----------------------------------------------------------------


class Reader:
    """Bytes of a possibly gzipped archive, without unpacking it in one piece."""

    def __init__(self, content):
        self.content, self.next = content, 0
        self.packed = content[:2] == b"\x1f\x8b"
        self.unpacker = zlib.decompressobj(31)
        self.buffer, self.at = b"", 0

    def _more(self):
        """Append the next part; what was read before goes."""
        if self.next >= len(self.content):
            return False
        part = self.content[self.next : self.next + (1 << 18)]
        self.next += len(part)
        if self.packed:
            out = []
            while part:
                out.append(self.unpacker.decompress(part))
                part = self.unpacker.unused_data
                if self.unpacker.eof:
                    self.unpacker = zlib.decompressobj(31)
            part = b"".join(out)
        self.buffer, self.at = self.buffer[self.at :] + part, 0
        return True

    def line(self):
        """Up to the next line feed, None at the end."""
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more():
                rest, self.at = self.buffer[self.at :], len(self.buffer)
                return rest or None
        found, self.at = self.buffer[self.at : end], end + 1
        return found.rstrip(b"\r")

    def take(self, n):
        parts, missing = [], n
        while missing:
            part = self.buffer[self.at : self.at + missing]
            self.at += len(part)
            missing -= len(part)
            parts.append(part)
            if missing and not self._more():
                raise ValueError(f"archive ends {missing} bytes before a declared length")
        return b"".join(parts)


def parse_arc(content):
    """Header fields and block of each record of an ARC file, its version block first."""
    reader, fields = Reader(content), None
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        if fields is None and not line.startswith(b"filedesc://"):
            raise ValueError("an ARC file begins with a version block")
        if len(parts) < 2 or not parts[-1].isdigit():
            raise ValueError(f"no declared length in {line[:80]!r}")
        block = reader.take(int(parts[-1]))
        if fields is None:
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = FIELDS[version]
            yield {**dict(zip(FIELDS[1][:4], parts, strict=False)), "version": version}, block
        else:
            # Only the url can hold spaces in files of careless writers.
            n = len(fields) - 1
            named = dict(zip(fields[1:], parts[-n:], strict=True))
            yield {"url": " ".join(parts[:-n]), **named}, block


def parse_warc(content):
    """Named fields and block of each record of a WARC file."""
    reader = Reader(content)
    while (line := reader.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC version line: {line[:80]!r}")
        fields = {}
        while line := reader.line():
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        yield fields, reader.take(int(fields["content-length"]))


def split_http(block):
    """Head and payload of an HTTP message; the whole block if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(i, len(gap)) for gap in (b"\r\n\r\n", b"\n\n") if (i := block.find(gap)) >= 0]
    if not ends:
        return block, b""
    at, gap = min(ends)
    return block[: at + gap], block[at + gap :]


def iso_date(digits):
    """ISO date of 14, 12 or 8 digits; others name the epoch."""
    d = re.sub(r"\D", "", digits or "")
    if len(d) not in (14, 12, 8):
        d = "19700101"
    d = d.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive, number):
    """The same id whenever the same record of the same archive is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def warc_type(url, head):
    if head:
        return "response"
    return "metadata" if url.startswith("dns:") else "resource"


def _rows(rows, names):
    """Rows in groups of a few megabytes."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if size >= OUT_BYTES:
            yield dict(zip(names, zip(*out, strict=True), strict=True))
            out, size = [], 0
    if out:
        yield dict(zip(names, zip(*out, strict=True), strict=True))


def _page_id(head):
    hit = re.search(rb"(?im)^x-page-id:\s*(-?\d+)\s*$", head)
    return int(hit[1]) if hit else None


CONVERTED = (
    "record_id string, type string, uri string, date string, ip string, page_id long, "
    "payload_bytes long, payload_digest string, block_digest string, block binary"
)


def convert_arc(spark, path, blocks=True):
    """One row per record of the ARC files below ``path``, as WARC would name it.

    ``blocks=False`` leaves the blocks themselves out. A file is read by one task
    and unpacked step by step. A declared length that the file does not hold, or a
    missing version block, fails the job: nothing is skipped.
    """
    names = [p.split()[0] for p in CONVERTED.split(", ")]

    def convert(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _rows(_converted(archive.rsplit("/", 1)[-1], content, blocks), names)

    return iterate_batches(_files(spark, path), convert, CONVERTED)


def _converted(archive, content, blocks):
    for number, (fields, block) in enumerate(parse_arc(content)):
        if not number:
            continue
        head, payload = split_http(block)
        yield (
            record_id(archive, number),
            warc_type(fields["url"], head),
            fields["url"],
            iso_date(fields["date"]),
            fields["ip"],
            _page_id(head),
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            hashlib.sha256(block).hexdigest(),
            block if blocks else None,
        )


def _files(spark, path):
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    )


# -- writing and reading WARC ------------------------------------------------


def revisits(records, smallest=SMALLEST_REVISIT):
    """``record_id, refers_to`` of the records that repeat an earlier payload.

    Of responses with equal payloads of at least ``smallest`` bytes the one with the
    smallest page id (then record id) stays; a record without a page id comes last.
    Each group is reduced to its first record before it meets the others.
    """
    light = records.where((F.col("type") == "response") & (F.col("payload_bytes") >= smallest)).select(
        "payload_digest", "record_id", "page_id"
    )
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    first = light.groupBy("payload_digest").agg(F.min(order)["record_id"].alias("refers_to"))
    return (
        light.join(first, "payload_digest")
        .where(F.col("record_id") != F.col("refers_to"))
        .select("record_id", "refers_to")
    )


def write_warc(records, repeats, path):
    """Gzipped WARC files: a warcinfo record, then one record per row. A revisit keeps
    the HTTP head, names what it refers to and drops the payload."""
    joined = records.join(repeats, "record_id", "left")
    is_revisit = F.col("refers_to").isNotNull()
    head_bytes = F.octet_length("block") - F.col("payload_bytes")
    block = F.when(is_revisit, F.expr("substring(block, 1, octet_length(block) - cast(payload_bytes as int))")).otherwise(
        F.col("block")
    )

    def field(name, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    lines = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(is_revisit, "revisit").otherwise(F.col("type"))),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.col("uri")),
        field("WARC-IP-Address", F.col("ip")),
        field("WARC-Refers-To", F.col("refers_to")),
        field(
            "WARC-Profile",
            F.when(is_revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        field("WARC-Block-Digest", F.when(~is_revisit, F.concat(F.lit("sha256:"), F.col("block_digest")))),
        field(
            "Content-Type",
            F.when(head_bytes > 0, "application/http; msgtype=response").otherwise(
                "application/octet-stream"
            ),
        ),
        field("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n"),
    )
    info = "software: fieldspark\r\nformat: WARC File Format 1.1\r\n"
    opening = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:"),
        F.expr("regexp_replace(md5(concat('warcinfo-', spark_partition_id())), '^(.{8})(.{4})(.{4})(.{4})', '$1-$2-$3-$4-')"),
        F.lit(
            "\r\n".join(
                [
                    ">",
                    "WARC-Date: 2000-01-01T00:00:00Z",
                    "Content-Type: application/warc-fields",
                    f"Content-Length: {len(info)}",
                    "",
                    info,
                    "",
                    "",
                ]
            )
        ),
    )
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    text = F.concat(F.when(first, opening).otherwise(""), lines, F.col("_block").cast("string"))
    joined.withColumn("_block", block).select(text.alias("value")).write.option(
        "lineSep", "\r\n\r\n"
    ).option("compression", "gzip").text(path)


READ = (
    "record_id string, record_type string, uri string, date string, refers_to_record string, "
    "page_id long, payload_bytes long, payload_digest string, payload binary"
)


def read_warc(spark, path, payloads=True):
    """One row per record of the WARC files below ``path`` other than warcinfo.

    The digest of a payload that is there is computed anew and must be the declared
    one; a revisit has only the declared digest and no payload.
    """
    names = [p.split()[0] for p in READ.split(", ")]

    def read(batches):
        for batch in batches:
            for content in batch.column(1).to_pylist():
                yield from _rows(_read(content, payloads), names)

    return iterate_batches(_files(spark, path), read, READ)


def _read(content, payloads):
    for fields, block in parse_warc(content):
        kind = fields["warc-type"]
        if kind == "warcinfo":
            continue
        head, payload = split_http(block)
        declared = fields["warc-payload-digest"].removeprefix("sha256:")
        revisit = kind == "revisit"
        if not revisit and hashlib.sha256(payload).hexdigest() != declared:
            raise ValueError(f"{fields['warc-record-id']}: payload and digest differ")
        yield (
            fields["warc-record-id"],
            kind,
            fields.get("warc-target-uri"),
            fields["warc-date"],
            fields.get("warc-refers-to"),
            _page_id(head),
            None if revisit else len(payload),
            declared,
            payload if payloads and not revisit else None,
        )


def convert_pages(pages):
    """Rows of ``pages`` as legacy archives, converted to WARC and read back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` per row. A
    null payload is an empty one; a null id stays null; rows that repeat an id keep a
    record each, the later ones revisit the first. An empty table gives no rows.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    write_warc(convert_arc(spark, arc), revisits(convert_arc(spark, arc, blocks=False)), warc)
    back = cut_lineage(read_warc(spark, warc, payloads=False))
    full = back.where(F.col("record_type") != "revisit").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    # A revisit takes its length and the page it repeats from the record it names.
    again = back.where(F.col("record_type") == "revisit").select(
        "page_id", "payload_digest", "record_type", F.col("refers_to_record").alias("record_id")
    )
    named = back.where(F.col("record_type") != "revisit").select(
        "record_id", "payload_bytes", F.col("page_id").alias("refers_to")
    )
    return full.unionByName(again.join(named, "record_id", "left").drop("record_id"))
