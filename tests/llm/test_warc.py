import gzip
import hashlib

import pytest

from graphquarry.llm import warc as W

ARC1 = (
    b"filedesc://x.arc 0.0.0.0 19970101000000 text/plain 73\n"
    b"1 0 Old\nURL IP-address Archive-date Content-type Archive-length\n\n\n\n\n\n\n\n"
)


def arc1(url, date, kind, block):
    return f"{url} 10.0.0.1 {date} {kind} {len(block)}\n".encode() + block + b"\n"


def test_both_versions_lengths_types_and_dates():
    head = ARC1[: ARC1.index(b"\n") + 1 + 73]
    http = b"HTTP/1.0 200 OK\nServer: x\n\nbody with\n\nhttp://u 1 2 3 9\n"
    data = head + b"\n" + arc1("http://a/", "19961231235959", "text/html", http) + arc1("dns:a", "1996", "text/dns", b"a. IN A 1.2.3.4")
    for shape in (data, gzip.compress(data), gzip.compress(head + b"\n") + gzip.compress(data[len(head) + 1 :])):
        one, two = W.arc_records(shape)
        assert one["payload"] == b"body with\n\nhttp://u 1 2 3 9\n" and one["version"] == 1
        assert (one["warc_date"], two["warc_date"]) == ("1996-12-31T23:59:59Z", "1970-01-01T00:00:00Z")
        assert W.warc_type(two["media_type"], two["url"], two["http"]) == "response"
        assert one["record_id"].startswith("<urn:uuid:") and one["record_id"] != two["record_id"]
    line = "http://b/ 1.1.1.1 20000102030405 image/png 200 sum - 77 f.arc 3\n"
    (v2,) = W.arc_records(line.encode() + b"\x89PN\n")
    assert v2["version"] == 2 and v2["payload"] == b"\x89PN" and v2["http"] == b""
    back = list(W.warc_records(W.warc_record(v2) + b"\r\n\r\n"))
    assert back[0]["payload"] == b"\x89PN" and back[0]["record_type"] == "resource"
    assert W.hex_digest(back[0]["payload_digest"]) == hashlib.sha1(b"\x89PN").hexdigest()


@pytest.mark.parametrize("bad", [b"http://a/ 1.1.1.1 2000 text/html x\n", b"http://a/ 1.1.1.1 2000 text/html 9\nabc\n", b"a b 3\nabc\n"])
def test_bad_archives_raise(bad):
    with pytest.raises(ValueError, match="f.arc"):
        list(W.arc_records(bad, "f.arc"))


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip_with_revisits(spark, tmp_path, version):
    long, text = "é\r\n\r\nWARC/1.0\n" * 100, "short"
    rows = [
        (1, "http://a/ b", long), (2, "http://b/", long), (7, None, long), (3, "http://c/", text), (4, "http://d/", text),
        (5, "http://e/", None), (6, "http://f/", ""), (None, "http://g/", "x" * 1000), (8, "http://h/", "x" * 1000),
        (9, "http://i/", "HTTP/1.1 200 OK\n\nnot a header"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    W.write_arc(pages, arc, "page_id", "url", "html", version)
    W.convert(spark, arc, warc)
    back = {r["key"]: r for r in W.read_warc(spark, warc).collect()}
    ids = {r["record_id"]: k for k, r in back.items()}
    for key, url, html in rows:
        data, got = (html or "").encode(), back[None if key is None else str(key)]
        assert W.hex_digest(got["payload_digest"]) == hashlib.sha1(data).hexdigest() and got["payload_bytes"] == len(data)
        first = {1: "7", 2: "7", None: "8"}.get(key)
        assert got["record_type"] == ("revisit" if first else "response")
        assert ids.get(got["refers_to"]) == first
        assert (got["payload"] == data) != bool(first)


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    W.write_arc(pages, str(tmp_path / "arc"), "page_id", "url", "html")
    W.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    assert W.read_warc(spark, str(tmp_path / "warc")).collect() == []
