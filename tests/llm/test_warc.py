"""Archives: round trips, both versions of the old format, repeated payloads."""

import base64
import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF
from pulsegrid.llm import warc
from pulsegrid.llm.queries import QUERIES, SQL
from pulsegrid.session import new_folder

PAGES = "page_id long, url string, html string"


def test_registered_query_and_its_sql(spark):
    got = QUERIES["op13_warc"](spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    rel = con.sql(SQL["op13_warc"])
    assert sorted(tuple(r) for r in got.select(*rel.columns).collect()) == sorted(rel.fetchall())


def expected(rows, least):
    out = []
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    for html, ids in groups.items():
        body = html.encode()
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        for nth, i in enumerate(ids):
            again = nth > 0 and len(body) >= least
            out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("per_file", [None, 1, 3])
def test_odd_pages(spark, monkeypatch, compression, per_file):
    if per_file:
        monkeypatch.setattr(warc, "records_per_file", lambda sizes, size: per_file)
    nasty = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nfiledesc://x 0.0.0.0 2000 text/plain 3\nHTTP/1.1 200 OK\r\n\r\n"
    long = "é" * 600
    rows = [(1, "http://a/ b\tc\nd", nasty), (2, None, None), (3, "", ""), (None, "http://n/", long), (4, "http://l/", long), (4, "http://l/", long), (5, "http://m/", long),
            (6, "http://x/", "x" * 999), (7, "http://x/", "x" * 999), (8, "http://x/", "y" * 1000), (-9, "http://x/", "y" * 1000), (10, "u", "\r\n\r\n\n\n"), (11, "u", nasty * 40),
            (12, "u", nasty * 40), (None, "u", "z" * 1001), (None, "u", "z" * 1001)]
    pages = spark.createDataFrame(rows, PAGES).select("*", *[F.lit(1).alias(c) for c in ("key", "head", "payload", "id", "type", "value", "date")])
    r = warc.archived(pages, compression=compression)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = r.collect()
    assert sorted([tuple(x[c] for c in cols) for x in got], key=str) == expected(rows, 1000) and all(x["intact"] for x in got)
    ids = {x["record_id"]: x for x in got}
    assert len(ids) == len(rows)
    for x in got:
        if x["record_type"] == "revisit":
            to = ids[x["refers_to_record"]]
            assert to["record_type"] == "response" and to["page_id"] == x["refers_to"] and to["payload_digest"] == x["payload_digest"]


def test_empty_table(spark):
    r = warc.archived(spark.createDataFrame([], PAGES))
    assert r.count() == 0


def old_file(version, records):
    fields = warc.ARC_FIELDS[version]
    info = f"{version} 0 someone\n{fields}\n".encode()
    more = b"" if version == 1 else b" 200 - - 0 old.arc"
    out = b"filedesc://old.arc 0.0.0.0 1996 text/plain" + more + b" %d\n" % len(info) + info + b"\n"
    for url, date, mime, body in records:
        check = hashlib.md5(body).hexdigest().encode()
        out += url + b" 10.0.0.1 " + date + b" " + mime + (b"" if version == 1 else b" 404 " + check + b" - 0 old.arc") + b" %d\n" % len(body) + body + b"\n"
    return out


def test_versions_in_one_file():
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nline\nline\n"
    one, two = old_file(1, [(b"http://a b/", b"19961108142103", b"text/html", http)]), old_file(2, [(b"dns:a", b"19970101", b"text/dns", b"a. 1 IN A 1.1.1.1"), (b"http://c/", b"1997", b"text/html", b"")])
    got = list(warc.arc_records(one + two + b"\n\n" + one))
    assert [(r[1], r[2], r[4], r[5], r[6], r[7], r[8]) for r in got] == [
        (1, "http://a b/", "19961108142103", "text/html", None, http, True), (2, "dns:a", "19970101", "text/dns", 404, b"a. 1 IN A 1.1.1.1", True),
        (2, "http://c/", "1997", "text/html", 404, b"", True), (1, "http://a b/", "19961108142103", "text/html", None, http, True)]
    assert [r[0] for r in got][0] == one.index(b"http://a b/")
    assert warc._plain(gzip.compress(one) + gzip.compress(two) + gzip.compress(b"") + gzip.compress(one)) == one + two + one
    # a cut file and a wrong checksum
    assert [r[8] for r in warc.arc_records(one[:-10])] == [False]
    assert [r[8] for r in warc.arc_records(two.replace(b"IN A", b"IN B"))] == [False, True]


def test_conversion_of_old_files(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + b"payload " * 200
    (tmp_path / "a.arc.gz").write_bytes(gzip.compress(old_file(1, [(b"http://a/", b"19961108142103", b"text/html", http), (b"dns:a", b"199702", b"text/dns", b"x")])))
    (tmp_path / "b.arc").write_bytes(old_file(2, [(b"http://b/", b"19980203", b"text/html", http), (b"http://raw/", b"1999", b"image/png", b"\x89PNG\r\n\xff\x00" * 300)]))
    folder = new_folder(spark, "warc")
    warc.convert(spark, str(tmp_path), folder)
    got = {r["url"]: r for r in warc.read_warc(spark, folder).collect()}
    assert {u: (r["time"], r["record_type"] in ("response", "revisit"), r["payload_bytes"] is None or r["payload_bytes"]) for u, r in got.items() if u != "http://a/" and u != "http://b/"} == {
        "dns:a": ("1997-02-01T00:00:00Z", False, 1), "http://raw/": ("1999-01-01T00:00:00Z", False, 2400)}
    assert {got["http://a/"]["time"], got["http://b/"]["time"]} == {"1996-11-08T14:21:03Z", "1998-02-03T00:00:00Z"}
    assert sorted(got[u]["record_type"] for u in ("http://a/", "http://b/")) == ["response", "revisit"] and all(r["intact"] for r in got.values())
    assert got["http://a/"]["payload_digest"] == got["http://b/"]["payload_digest"] == hashlib.sha1(b"payload " * 200).hexdigest()


def test_text_of_a_record(spark):
    folder = new_folder(spark, "warc")
    arc = new_folder(spark, "arc")
    warc.write_arc(spark.createDataFrame([(5, "http://a/", "hello")], PAGES), arc, "none")
    warc.convert(spark, arc, folder, "none")
    text = spark.read.format("binaryFile").load(folder).first()["content"]
    info, page = [(h.decode(), b) for h, b, ok in warc.warc_records(text) if ok]
    assert info[0].startswith("WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:") and text.endswith(b"\r\n\r\n")
    assert "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode() in page[0]
    assert "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(page[1]).digest()).decode() in page[0]
    assert page[1] == b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: 5\r\nX-Page-Id: 5\r\n\r\nhello"
