"""Legacy web archives (ARC version 1 and 2) converted to WARC.

ARC files open with a version block that names the field list of all record lines in the file; each
record is one line of fields, the last of which declares the length of what follows. The converter reads files
of either version, plain or gzip, and makes for every record what WARC wants: an identifier derived from the record's
content, an ISO timestamp from the 14 digits, a type from the media type, and SHA-1 digests of payload
and block. Records with equal payloads of at least ``MIN_REVISIT`` bytes become one response and revisits that
refer to it.

Archives are real files. They are written by Spark's text writer with the record separator as line
separator, so any store Spark writes to will do and lost tasks leave no half-written files, and they are read
back as bytes. Readers walk a file record by record; payloads never meet in one task.

Defined cases: repeated rows are one record written twice, both responses; a null payload is an empty one; a null URL or date is written as ``-`` or zeros; records
of no declared length, bad lines and cut-off files raise an error that names the file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from graphquarry.llm.common import kept, table
from graphquarry.session import scratch_path

MIN_REVISIT = 1000
NO_DATE = "00000000000000"
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # URLs, RFC 4122
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Names the row a record stands for; carried as an HTTP header through both formats.
KEY_HEADER = "X-Archive-Key"

RECORD = pa.struct([
    ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("media_type", pa.string()),
    ("http", pa.binary()), ("payload", pa.binary()), ("version", pa.int32()),
    ("record_id", pa.string()), ("warc_date", pa.string()), ("digest", pa.string()), ("key", pa.string()),
    ("payload_bytes", pa.int64()),
])
READ = pa.struct([
    ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("warc_date", pa.string()),
    ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
    ("key", pa.string()), ("payload", pa.binary()),
])


def inflated(data: bytes) -> bytes:
    """A file's content; gzip files may hold one member or one per record."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        if not member.eof:
            raise ValueError("gzip member is cut off")
        data = member.unused_data
    return b"".join(parts)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header, with its blank line, and body; a block without one is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at + len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    return (block[: min(ends)], block[min(ends) :]) if ends else (block, b"")


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name).encode() + rb":[ \t]*([^\r\n]*)", head)
    return found.group(1).decode("utf-8", "replace").strip() if found else None


def iso_date(digits: str) -> str:
    """``YYYYMMDDhhmmss`` as a WARC date; shorter or impossible dates become the epoch."""
    m = re.fullmatch(r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)", digits)
    if not m or not (1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31 and int(m[4]) < 24 and int(m[5]) < 60 and int(m[6]) < 60):
        return "1970-01-01T00:00:00Z"
    return f"{m[1]}-{m[2]}-{m[3]}T{m[4]}:{m[5]}:{m[6]}Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(labelled: str) -> str:
    """``sha1:`` and base-32 as bare lower-case hexadecimal."""
    return base64.b32decode(labelled.removeprefix("sha1:")).hex()


def arc_records(data: bytes, name: str = "") -> Iterator[dict]:
    """Records of one ARC file, without its version block."""
    data, at, fields = inflated(data), 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"{name}: no declared length in record line {line[:200]!r}")
        start = end + 1 if end >= 0 else len(data)
        stop = start + int(parts[-1])
        if stop > len(data):
            raise ValueError(f"{name}: record at byte {at} is cut off")
        block = data[start:stop]
        at = stop
        if line.startswith("filedesc:"):
            # first line of the block: version, a reserved number, the origin; second: the field list
            version, _, rest = block.partition(b" ")
            fields = rest.split(b"\n", 1)[1].split(b"\n", 1)[0].decode().strip().split(" ") if b"\n" in rest else None
            continue
        names = fields if fields and len(fields) == len(parts) else {5: ARC_FIELDS[1].split(), 10: ARC_FIELDS[2].split()}.get(len(parts))
        if names is None:
            raise ValueError(f"{name}: {len(parts)} fields in record line {line[:200]!r}")
        own = dict(zip(names, parts, strict=True))
        http, payload = split_http(block)
        digest = base32_sha1(payload)
        key = header_value(http, KEY_HEADER)
        date = own.get("Archive-date", NO_DATE)
        yield {
            "url": own["URL"], "ip": own.get("IP-address"), "date": date, "media_type": own.get("Content-type"),
            "http": http, "payload": payload, "version": 2 if "Offset" in own else 1,
            "record_id": f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((own['URL'], date, key or '', digest)))}>",
            "warc_date": iso_date(date), "digest": "sha1:" + digest, "key": key,
            "payload_bytes": len(payload),
        }


def warc_type(media_type: str | None, url: str, http: bytes) -> str:
    """The WARC type of an ARC record."""
    if http:
        return "response"
    if url.startswith("dns:") or media_type == "text/dns":
        return "response"
    return "resource"


def warc_record(r: dict, refers_to: str | None = None, refers_url: str | None = None) -> bytes:
    """A WARC/1.0 record without the separator that follows it."""
    kind = "revisit" if refers_to else warc_type(r["media_type"], r["url"], r["http"])
    block = r["http"] if refers_to else r["http"] + r["payload"]
    lines = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Target-URI: {r['url']}", f"WARC-Date: {r['warc_date']}",
        f"WARC-Record-ID: {r['record_id']}", f"WARC-Payload-Digest: {r['digest']}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if r["ip"] and r["ip"] != "0.0.0.0":
        lines.append(f"WARC-IP-Address: {r['ip']}")
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Refers-To-Target-URI: {refers_url}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [
        "Content-Type: " + ("application/http;msgtype=response" if r["http"] else r["media_type"] or "application/octet-stream"),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def warc_records(data: bytes, name: str = "") -> Iterator[dict]:
    """Records of one WARC file, walked by their declared lengths."""
    data, at = inflated(data), 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end]
        length = header_value(head, "Content-Length")
        if end < 0 or not head.startswith(b"WARC/") or not (length or "").isdigit():
            raise ValueError(f"{name}: no WARC record at byte {at}")
        start, at = end + 4, end + 4 + int(length)
        if at > len(data):
            raise ValueError(f"{name}: record is cut off at byte {start}")
        http, payload = split_http(data[start:at])
        kind = header_value(head, "WARC-Type")
        declared = header_value(http, "Content-Length")
        yield {
            "record_id": header_value(head, "WARC-Record-ID"), "record_type": kind,
            "url": header_value(head, "WARC-Target-URI"), "warc_date": header_value(head, "WARC-Date"),
            "payload_digest": header_value(head, "WARC-Payload-Digest") if kind == "revisit" else "sha1:" + base32_sha1(payload),
            "refers_to": header_value(head, "WARC-Refers-To"),
            "payload_bytes": int(declared) if kind == "revisit" and declared else len(payload),
            "key": header_value(http, KEY_HEADER), "payload": None if kind == "revisit" else payload,
        }


def _slim(records: Iterable[dict], wanted: set[str], kind: pa.StructType) -> Iterator[pa.RecordBatch]:
    """Batches of at most a few megabytes with the wanted columns."""
    schema = pa.schema([kind.field(i) for i in range(kind.num_fields) if kind.field(i).name in wanted])
    held, size = [], 0
    for r in records:
        held.append({n: r[n] for n in schema.names})
        size += 200 + sum(len(v) for v in held[-1].values() if isinstance(v, bytes))
        if size >= 1 << 21:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _read(spark: SparkSession, path: str, walk, kind: pa.StructType, columns: list[str] | None) -> DataFrame:
    wanted = set(columns or [kind.field(i).name for i in range(kind.num_fields)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _slim(walk(batch.column(1)[i].as_py(), batch.column(0)[i].as_py()), wanted, kind)

    fields = pa.struct([kind.field(i) for i in range(kind.num_fields) if kind.field(i).name in wanted])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(each, from_arrow_type(fields))


def read_arc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of all ARC files under ``path``, with what WARC needs synthesised."""
    return _read(spark, path, arc_records, RECORD, columns)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of all WARC files under ``path``; a revisit keeps its original's digest and length."""
    return _read(spark, path, warc_records, READ, columns)


def _written(rows: DataFrame, path: str, ending: str) -> None:
    """Binary rows as files of records, each followed by ``ending``."""
    rows.select(F.col("record").cast("string")).write.option("lineSep", ending).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, key: str, url: str, payload: str, version: int = 2) -> None:
    """Rows as legacy ARC files: HTTP responses whose bodies are the payloads, behind a version block."""
    origin = b"%d 0 graphquarry\n%s\n" % (version, ARC_FIELDS[version].encode())
    first = b"filedesc://graphquarry.arc 0.0.0.0 %s text/plain %s%d\n%s" % (
        NO_DATE.encode(), b"200 - - 0 graphquarry.arc " if version == 2 else b"", len(origin), origin
    )
    rest = "200 - - 0 graphquarry.arc " if version == 2 else ""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        for batch in batches:
            held = [] if opened else [first]
            opened = True
            for k, u, body in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = body.as_py() or b""
                named = "" if k.as_py() is None else f"{KEY_HEADER}: {k.as_py()}\r\n"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(data)}\r\n\r\n"
                place = quote(u.as_py() or "-", safe="!#$%&'()*+,/:;=?@[]~|^`{}<>\\\"")
                block = http.encode() + data
                held.append(f"{place} 0.0.0.0 {NO_DATE} text/html {rest}{len(block)}\n".encode() + block)
                if sum(map(len, held[-64:])) > 1 << 21 or len(held) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    rows = pages.select(F.col(key).cast("string"), F.col(url), F.col(payload).cast("binary"))
    _written(rows.mapInArrow(each, "record binary"), path, "\n")


@arrow_udf(from_arrow_type(pa.binary()))
def _as_warc(records: pa.Array, refers_to: pa.Array, refers_url: pa.Array) -> pa.Array:
    rows = zip(records, refers_to, refers_url, strict=True)
    return pa.array([warc_record(r.as_py(), i.as_py(), u.as_py()) for r, i, u in rows], pa.binary())


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT, rank: Column | None = None) -> None:
    """ARC files to WARC files, with revisits for repeated payloads of at least ``min_revisit`` bytes.

    Of equal payloads the record with the largest ``rank`` (the key as a number, else the record id, by
    default) is the response. Only digests, ranks and ids are shuffled to find repeats; payloads are
    read again and joined with the table of repeated digests, which is small enough to send or else
    splits by digest.
    """
    rank = F.col("key").try_cast("long") if rank is None else rank
    digests = read_arc(spark, arc_path, ["digest", "key", "record_id", "url", "payload_bytes"]).where(
        F.col("payload_bytes") >= min_revisit
    )
    order = F.struct(rank.alias("rank"), "record_id")
    repeated = kept(
        digests.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.max_by(F.struct("record_id", "url"), order).alias("original")
        ).where("n > 1").select("digest", "original"),
        "warc-repeats",
    )
    records = read_arc(spark, arc_path)
    plain = records.columns
    own = records.withColumn("digest_", F.when(F.col("payload_bytes") >= min_revisit, F.col("digest")))
    if repeated.isEmpty():
        joined = own.withColumn("original", F.lit(None).cast("struct<record_id:string,url:string>"))
    else:
        joined = own.join(repeated.withColumnRenamed("digest", "digest_"), "digest_", "left")
    other = F.when(F.col("original.record_id") != F.col("record_id"), F.col("original"))
    record = F.struct(*plain)
    _written(joined.select(_as_warc(record, other["record_id"], other["url"]).alias("record")), warc_path, "\r\n\r\n")


def query(spark, sf_dir: str) -> DataFrame:
    arc, warc = scratch_path(spark, "pages-arc"), scratch_path(spark, "pages-warc")
    write_arc(table(spark, sf_dir, "pages"), arc, key="page_id", url="url", payload="html")
    convert(spark, arc, warc)
    back = kept(
        read_warc(spark, warc, ["record_id", "record_type", "payload_digest", "refers_to", "payload_bytes", "key"]), "warc-back"
    )
    number = F.col("key").cast("long")
    revisits = back.where("refers_to IS NOT NULL")
    originals = back.where("refers_to IS NULL").select(F.col("record_id").alias("refers_to"), number.alias("original")).dropDuplicates(["refers_to"])
    rows = back.where("refers_to IS NULL").withColumn("original", F.lit(None).cast("long")).unionByName(
        revisits.join(originals, "refers_to").select(*back.columns, "original")
    )
    return rows.select(
        number.alias("page_id"), "payload_bytes", _hex(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.col("original").alias("refers_to"),
    )


@arrow_udf(from_arrow_type(pa.string()))
def _hex(labelled: pa.Array) -> pa.Array:
    return pa.array([None if x.as_py() is None else hex_digest(x.as_py()) for x in labelled], pa.string())
