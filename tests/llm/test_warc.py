"""Archives: parsing of both ARC versions, conversion, and the round trip."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from fieldspark.llm import warc

ONE = (
    b"filedesc://a.arc 1.2.3.4 19970101000000 text/plain 76\n"
    b"1 0 Someone\nURL IP-address Archive-date Content-type Archive-length\n      \n"
)
TWO_BODY = b"2 0 Someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
TWO = b"filedesc://b.arc 0.0.0.0 20010203 text/plain 200 - - 0 b.arc %d\n%s" % (len(TWO_BODY), TWO_BODY)


def records(content):
    return [(f, b) for f, b in warc.parse_arc(content)]


def test_version_one():
    body = ONE.split(b"\n", 1)[1]
    opening = b"filedesc://a.arc 1.2.3.4 19970101000000 text/plain %d\n%s" % (len(body), body)
    block = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npay\nload"
    content = opening + b"\nhttp://x/a b 9.9.9.9 199701020304 text/html %d\n%s\n" % (len(block), block)
    content += b"\ndns:x 9.9.9.9 19970102030405 text/dns 0\n\n"
    for packed in (content, gzip.compress(content), gzip.compress(content[:60]) + gzip.compress(content[60:])):
        found = records(packed)
        assert [f["url"] for f, _ in found] == ["filedesc://a.arc", "http://x/a b", "dns:x"]
        assert found[1][1] == block and found[2][1] == b""
        assert found[1][0]["ip"] == "9.9.9.9"
        assert warc.iso_date(found[1][0]["date"]) == "1997-01-02T03:04:00Z"


def test_version_two():
    content = TWO + b"\nhttp://y/ 8.8.8.8 20010203040506 text/plain 404 abc - 77 b.arc 5\nhello\n"
    found = records(content)
    assert found[0][0]["version"] == 2
    assert found[1][0]["result"] == "404" and found[1][0]["checksum"] == "abc"
    assert found[1][1] == b"hello"
    assert warc.split_http(found[1][1]) == (b"", b"hello")


@pytest.mark.parametrize(
    "content",
    [
        b"http://x 1.1.1.1 19970101000000 text/html 3\nabc\n",
        TWO + b"\nhttp://y/ 8.8.8.8 20010203040506 text/plain 404 abc - 77 b.arc 50\nhello\n",
        TWO.replace(b"2 0 Someone", b"7 0 Someone"),
        TWO + b"\nhttp://y/ no length\n",
    ],
)
def test_broken_archives_fail(content):
    with pytest.raises(ValueError):
        records(content)


def test_dates_and_ids():
    assert warc.iso_date("20010203") == "2001-02-03T00:00:00Z"
    assert warc.iso_date(None) == "1970-01-01T00:00:00Z"
    assert warc.record_id("a", 1) == warc.record_id("a", 1) != warc.record_id("a", 2)


def pages(spark, rows):
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return table.withColumns({c: F.lit("x") for c in ("record_id", "refers_to", "block", "payload")})


def expected(rows):
    out = []
    first = {}
    for key, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and key is not None:
            first[body] = min(key, first.get(body, key))
    used = set()
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        again = len(body) >= 100 and (body in used)
        used.add(body)
        out.append(
            (
                str(key),
                len(body),
                hashlib.sha256(body).hexdigest(),
                "revisit" if again else "response",
                str(first.get(body) if again else None),
            )
        )
    return sorted(out)


def test_round_trip(spark):
    long = "<p>\r\n\r\nWARC/1.1\r\n" + "é" * 400
    rows = [
        (5, "http://a/ b\nc", long),
        (3, None, long),
        (9, "http://c", long),
        (9, "http://c", long),
        (4, "http://d", "x" * 99),
        (6, "http://d", "x" * 99),
        (7, "", None),
        (8, "http://e", ""),
        (None, "http://f", "y" * 100),
        (12, "http://f", "y" * 100),
        (13, "http://g", "z" * 300_000),
    ]
    found = warc.convert_pages(pages(spark, rows).repartition(3)).collect()
    got = sorted(
        (str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in found
    )
    assert got == expected(rows)


def test_no_pages(spark):
    assert warc.convert_pages(pages(spark, [])).count() == 0


def test_payloads_come_back(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<b>{i}</b>" * 30) for i in range(20)]
    warc.write_arc(pages(spark, rows).repartition(4), f"{tmp_path}/arc")
    converted = warc.convert_arc(spark, f"{tmp_path}/arc")
    warc.write_warc(converted, warc.revisits(converted), f"{tmp_path}/warc")
    back = {r.page_id: r for r in warc.read_warc(spark, f"{tmp_path}/warc").collect()}
    assert {k: bytes(r.payload).decode() for k, r in back.items()} == {k: h for k, _, h in rows}
    assert {r.uri for r in back.values()} == {u for _, u, _ in rows}
