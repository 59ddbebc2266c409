"""Web archives: pages written as legacy ARC files, ARC files converted to WARC, WARC files read back.

ARC (versions 1 and 2). A file begins with a version block, `filedesc://`, whose second line says the version and so which fields
the header lines after it have; files put behind one another change version at every such block. A record is a header line, as
many bytes as its last field declares, and a line end. Fields are taken from the right, because old crawlers left blanks in URLs.

    1   URL IP-address Archive-date Content-type Archive-length
    2   URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

Conversion. Every ARC record becomes one WARC/1.0 record: its identifier is made of file and offset (the same at every reading of
that file), its date of the 14 digits (missing ones are the start of the year, month, day, ...), its type of the content
(`response` for an HTTP message, else `resource`), payload and block digests are SHA-1 in base 32. Of records with equal payloads
of at least `least` bytes the one with the largest page id (then the largest identifier) stays as it is; the others become `revisit`
records, with the HTTP head alone as their block and the record they refer to by identifier, URI, date and page id.

Everything but reading the bytes of an archive is columns. Files are written by the text sink of Spark, whose line separator is the
end of a record, so they get its commit rules: a lost task leaves nothing behind.

Bounds: a file has so many records that it is about `FILE_BYTES` large, and never more than `MOST_BYTES` (but one record); it is
read whole by one task. Payloads are compared by SHA-256 in an aggregate and joined back, so no group meets in one task; what is
joined is one small row per repeated payload, written first, so that Spark knows its size. With `compression` gzip a file is one
gzip member, not one per record.

Defined cases: a NULL html is an empty payload; a NULL page_id is less than all others and has no `X-Page-Id`; a NULL url is
`about:blank`; blanks and line ends in a url are percent-encoded; rows that agree in everything are records of their own, one of
them is the response; payloads may hold header lines and separators of both formats, since lengths are declared; an empty table
gives no records; other columns are not read. A record whose length, line end or checksum is wrong is kept and not `intact`.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.base import written
from pulsegrid.session import new_folder

FILE_BYTES, MOST_BYTES = 8 << 20, 256 << 20
LEAST_REPEAT = 1000     # bytes of a payload from which a repeat is a revisit
CAPTURED = "20000101000000"
BATCH_BYTES = 8 << 20
PART = 1 << 16         # compressed bytes taken at a time
GZIP = b"\x1f\x8b"

# fixed texts of the two formats
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def records_per_file(sizes: DataFrame, size: str) -> int:
    mean, most = sizes.agg(F.avg(size), F.max(size)).first()
    if mean is None:
        return 1
    return max(1, min(int(FILE_BYTES // max(1, mean + 500)), int(MOST_BYTES // (most + 500))))


def _rolled(rows: DataFrame, n: int) -> DataFrame:
    """With _file, the number of the file that a row of this partition is written to, and _first, whether it begins it."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_at", at).withColumn("_file", F.floor(F.col("_at") / n)).withColumn("_first", F.col("_at") % n == 0)


def _store(rows: DataFrame, folder: str, n: int, separator: str, compression: str) -> None:
    rows.write.option("maxRecordsPerFile", n).option("lineSep", separator).option("compression", compression).text(folder)


def write_arc(pages: DataFrame, folder: str, compression: str = "gzip", versions: tuple[int, ...] = (1, 2), captured: str = CAPTURED,
              page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """ARC files of `pages`, each as an HTTP response; files take the versions in turn."""
    payload = F.coalesce(F.col(html), F.lit(""))
    n = records_per_file(pages.select(F.octet_length(payload).alias("size")), "size")
    plain = F.coalesce(F.col(url), F.lit("about:blank"))
    for sign, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        plain = F.replace(plain, F.lit(sign), F.lit(code))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length("_payload").cast("string"),
                    F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col("_page").cast("string")), F.lit("")), F.lit("\r\n\r\n"))
    d = _rolled(pages.select(F.col(page_id).alias("_page"), plain.alias("_url"), payload.alias("_payload")), n)
    d = d.withColumn("_body", F.concat(head, "_payload")).withColumn("_name", F.format_string("pages-%05d-%05d.arc", F.spark_partition_id(), "_file"))
    version = F.element_at(F.array(*[F.lit(v) for v in versions]), ((F.spark_partition_id() + F.col("_file")) % len(versions) + 1).cast("int"))

    def line(address: Column, v: int, mime: str, body: Column) -> Column:
        more = [] if v == 1 else [F.lit(" 200 "), F.md5(body.cast("binary")), F.lit(" - 0 "), F.col("_name")]
        return F.concat(address, F.lit(f" 0.0.0.0 {captured} {mime}"), *more, F.lit(" "), F.octet_length(body).cast("string"), F.lit("\n"))

    def record(v: int) -> Column:
        block = F.lit(f"{v} 0 pages\n{ARC_FIELDS[v]}\n")
        version_block = F.concat(line(F.concat(F.lit("filedesc://"), F.col("_name")), v, "text/plain", block), block, F.lit("\n"))
        return F.concat(F.when(F.col("_first"), version_block).otherwise(""), line(F.col("_url"), v, "text/html", F.col("_body")), F.col("_body"))

    value = F.lit(None).cast("string")
    for v in versions:
        value = F.when(F.col("_version") == v, record(v)).otherwise(value)
    _store(d.withColumn("_version", version).select(value.alias("value")), folder, n, "\n", compression)


def _plain(content: bytes) -> bytes:
    """The file without gzip, of one or many members."""
    if content[:2] != GZIP:
        return content
    out, at = [], 0
    while content[at:at + 2] == GZIP:
        member = zlib.decompressobj(31)
        while at < len(content) and not member.eof:
            part = content[at:at + PART]
            out.append(member.decompress(part))
            at += len(part)
        at -= len(member.unused_data)
    return b"".join(out)


def arc_records(content: bytes) -> Iterator[tuple]:
    """(offset, version, url, ip, date, mime, status, body, intact) of every record of an ARC file but its version blocks."""
    at, version = 0, 1
    while at < len(content):
        end = content.find(b"\n", at)
        line = content[at:end if end >= 0 else len(content)]
        if not line.strip():        # empty lines between records
            at += len(line) + 1
            continue
        about = line.startswith(b"filedesc://")
        if about:
            # the line behind it begins with the version, which its own fields have already
            version = int(content[end + 1:content.find(b" ", end + 1)])
        fields = line.rstrip(b"\r").rsplit(b" ", len(ARC_FIELDS[version].split()) - 1)
        size, start = int(fields[-1]), end + 1
        body = content[start:start + size]
        behind = content[start + size:start + size + 1]
        if not about:
            status, check = (int(fields[4]), fields[5]) if version == 2 else (None, b"-")
            intact = len(body) == size and behind in (b"\n", b"") and (check == b"-" or hashlib.md5(body).hexdigest().encode() == check)
            yield at, version, *(f.decode("utf-8", "replace") for f in fields[:4]), status, body, intact
        at = start + size


def _header(head: bytes, name: bytes) -> str | None:
    """The value of a header line, or None."""
    for line in head.split(b"\r\n")[1:]:
        key, found, value = line.partition(b":")
        if found and key.strip().lower() == name:
            return value.strip().decode("utf-8", "replace")
    return None


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _split(body: bytes) -> tuple[bytes, bytes]:
    """Head (with the empty line) and payload of an HTTP message; no head otherwise."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    head, found, payload = body.partition(b"\r\n\r\n")
    return head + found, payload


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weight(r)
        if size >= BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the ARC files of a folder (plain or gzip): file, at (offset), version, url, ip, date, mime, status,
    intact, page_id (of the HTTP head), head, payload."""
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()),
                        ("mime", pa.string()), ("status", pa.int32()), ("intact", pa.bool_()), ("page_id", pa.int64()), ("head", pa.binary()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(batch.column("path"), batch.column("content")):
                    name = path.as_py().rpartition("/")[2]
                    for at, version, url, ip, date, mime, status, body, intact in arc_records(_plain(content.as_py())):
                        head, payload = _split(body)
                        yield name, at, version, url, ip, date, mime, status, intact, _number(_header(head, b"x-page-id")), head, payload

        yield from _in_batches(rows(), schema, lambda r: len(r[-1]))

    return _files(spark, folder).mapInArrow(read, "file string, at long, version int, url string, ip string, date string, mime string, status int, intact boolean, "
                                                  "page_id long, head binary, payload binary")


def _base32(hex_: Column) -> Column:
    """Base 32 of 160 bits in hex: five hex digits are four letters."""
    parts = [F.lpad(F.conv(F.substr(hex_, F.lit(i + 1), F.lit(5)), 16, 32), 4, "0") for i in range(0, 40, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _identifier(seed: Column) -> Column:
    h = F.md5(seed.cast("binary"))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def warc_date(date: Column) -> Column:
    """Up to 14 digits as a UTC time; missing ones are the start of what they count."""
    full = F.concat(date, F.substr(F.lit("00000101000000"), F.length(date) + 1))
    part = lambda a, n: F.substr(full, F.lit(a), F.lit(n))
    return F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit("T"), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2), F.lit("Z"))


def convert(spark: SparkSession, arc: str, folder: str, compression: str = "gzip", least: int = LEAST_REPEAT) -> None:
    """WARC files of the ARC files in folder `arc`, one record per record."""
    r = read_arc(spark, arc).withColumn("id", _identifier(F.concat_ws(":", "file", F.col("at").cast("string")))).withColumn("time", warc_date(F.col("date")))
    r = r.withColumn("key", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    kept = F.max(F.struct("page_id", "id", "url", "time")).alias("kept")
    repeated = written(r.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), kept).filter("n > 1").select("key", "kept"), "repeated")
    n = records_per_file(r.select((F.octet_length("payload") + F.octet_length("head")).alias("size")), "size")
    j = r.join(repeated, "key", "left").withColumn("again", F.coalesce(F.col("kept.id") != F.col("id"), F.lit(False)))
    http = F.octet_length("head") > 0
    j = j.withColumn("type", F.when(F.col("again"), "revisit").when(http, "response").otherwise("resource"))
    j = j.withColumn("block", F.when(F.col("again"), F.col("head")).otherwise(F.concat("head", "payload")))
    d = _rolled(j, n)

    def lines(*pairs: tuple[str, Column]) -> Column:
        return F.concat(*[F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in pairs])

    digest = lambda c: F.concat(F.lit("sha1:"), _base32(F.sha1(c)))
    common = lines(("WARC-Type", F.col("type")), ("WARC-Record-ID", F.col("id")), ("WARC-Date", F.col("time")), ("WARC-Target-URI", F.col("url")),
                   ("WARC-IP-Address", F.col("ip")), ("WARC-Payload-Digest", digest("payload")), ("WARC-Block-Digest", digest("block")))
    refers = lines(("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", F.col("kept.id")), ("WARC-Refers-To-Target-URI", F.col("kept.url")),
                   ("WARC-Refers-To-Date", F.col("kept.time")))
    page = F.coalesce(lines(("X-Refers-To-Page-Id", F.col("kept.page_id").cast("string"))), F.lit(""))
    size = lines(("Content-Type", F.when(http, "application/http; msgtype=response").otherwise(F.col("mime"))), ("Content-Length", F.octet_length("block").cast("string")))
    info = "software: pulsegrid\r\nformat: WARC File Format 1.0\r\n"
    info_record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: warcinfo\r\n"), lines(("WARC-Record-ID", _identifier(F.concat(F.lit("info:"), "id"))), ("WARC-Date", F.col("time"))),
                           F.lit(f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}\r\n\r\n"))
    text = F.concat(F.when(F.col("_first"), info_record).otherwise(""), F.lit("WARC/1.0\r\n"), common, F.when(F.col("again"), F.concat(refers, page)).otherwise(""),
                    size, F.lit("\r\n"), F.col("block").cast("string"))
    _store(d.select(text.alias("value")), folder, n, "\r\n\r\n", compression)


def warc_records(content: bytes) -> Iterator[tuple[bytes, bytes, bool]]:
    """(header, block, intact) of every record of a WARC file."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = content[at:end]
        size, start = int(_header(head, b"content-length") or 0), end + 4
        block = content[start:start + size]
        at = start + size + 4
        yield head, block, len(block) == size and content[at - 4:at] == b"\r\n\r\n" and head.startswith(b"WARC/")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record of the WARC files of a folder: page_id, record_type, record_id, url, time, payload_bytes and
    payload_digest (bare SHA-1 in hex; of the full payload also for revisits), refers_to (page id), refers_to_record, intact (lengths
    and digests are right)."""
    kinds = "page_id long, record_type string, record_id string, url string, time string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, intact boolean"
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("time", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()), ("intact", pa.bool_())])

    def one(head: bytes, block: bytes, intact: bool) -> tuple:
        field = lambda name: _header(head, name)
        kind, told = field(b"warc-type"), (field(b"warc-payload-digest") or "").removeprefix("sha1:")
        http, payload = _split(block)
        digest = base64.b32decode(told).hex() if len(told) == 32 else None
        if kind == "revisit":       # the payload stands elsewhere; the head tells its length
            size = _number(_header(http, b"content-length"))
        else:
            size, made = len(payload), hashlib.sha1(payload).hexdigest()
            digest, intact = made, intact and digest in (made, None)
        return (_number(_header(http, b"x-page-id")), kind, field(b"warc-record-id"), field(b"warc-target-uri"), field(b"warc-date"), size, digest,
                _number(field(b"x-refers-to-page-id")), field(b"warc-refers-to"), intact)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column("content"):
                    for head, block, intact in warc_records(_plain(content.as_py())):
                        if _header(head, b"warc-type") != "warcinfo":
                            yield one(head, block, intact)

        yield from _in_batches(rows(), schema, lambda r: 500)

    return _files(spark, folder).mapInArrow(read, kinds)


def archived(pages: DataFrame, least: int = LEAST_REPEAT, compression: str = "gzip", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """What the WARC files of `pages` say, read back: pages are written as ARC, converted, and read (see `read_warc`)."""
    spark = pages.sparkSession
    arc, folder = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, arc, compression, page_id=page_id, url=url, html=html)
    convert(spark, arc, folder, compression, least)
    return read_warc(spark, folder)
