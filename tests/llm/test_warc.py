"""ARC to WARC and back, against a plain reading of the rules."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from keepwell.llm import warc
from keepwell.llm.queries import op9_warc


def plain(rows):
    """[(page_id, bytes, digest, type, refers_to)], ids distinct."""
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        r = first[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if r == i else "revisit", None if r == i else r))
    return out


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = op9_warc(spark, sf_dir)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows)))


@pytest.mark.parametrize("version", [1, 2])
def test_cases(spark, tmp_path, version):
    same = "<p>same é</p>"
    rows = [(7, "http://a.example/x y\nz", same), (3, None, same), (9, "", same), (1, "http://a.example/", None), (2, "http://b.example", ""),
            (20, "http://c.example", "x" * 300_000), (21, "http://c.example", "a\r\n\r\nb WARC/1.0\r\n"), (22, "http://d.example", "\r\n\r\n"),
            (-5, "http://e.example", "http 200 5\nbody")]
    df = spark.createDataFrame([(i, u, h, 1, "f") for i, u, h in rows], "page_id long, url string, html string, id int, file string") \
        .withColumn("nth", F.lit(1)).repartition(4, "page_id")
    folder, files = warc.archive(df, str(tmp_path), version)
    got = warc.read_warc(spark, folder, files).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows)))
    names = sorted((tmp_path / "warc").iterdir())
    ids, refers, uris = set(), set(), set()
    for n in names:
        with gzip.open(n) as f:
            for h, block in warc.warc_records(f, n.name):
                ids.add(h["warc-record-id"])
                uris.add(h.get("warc-target-uri"))
                assert h["warc-date"] == "2026-01-01T00:00:00Z" and int(h["content-length"]) == len(block)
                if h["warc-type"] == "revisit":
                    refers.add(h["warc-refers-to"])
                    assert warc.split_http(block)[1] == b""
    assert refers and refers <= ids and {"http://a.example/x%20y%0Az", "urn:page:3", "urn:page:9"} <= uris
    assert not list(tmp_path.rglob("*attempt*"))


def test_repeated_and_missing_ids(spark, tmp_path):
    rows = [(5, "u", "p"), (5, "u", "p"), (None, "u", "p"), (None, "u", "q"), (None, "u", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.read_warc(spark, *warc.archive(df, str(tmp_path))).collect())
    assert got == [("5", "response", "None"), ("5", "revisit", "5"), ("None", "response", "None"), ("None", "revisit", "5"), ("None", "revisit", "None")]
    none = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(0)
    assert warc.read_warc(spark, *warc.archive(none, str(tmp_path / "none"))).count() == 0
    least = warc.read_warc(spark, *warc.archive(df, str(tmp_path / "least"), least_bytes=2)).collect()
    assert {r.record_type for r in least} == {"response"}


def test_legacy_headers():
    """Versions, short dates, urls with spaces, records without HTTP, broken archives."""
    head = b"filedesc://old.arc 0.0.0.0 19990102 text/plain 76\n1 0 Alexa\nURL IP-address Archive-date Content-type Archive-length\n\n"
    body = head[head.index(b"\n") + 1:]
    head = head.replace(b" 76\n", b" %d\n" % len(body)) + b"\n"
    one = b"http://x.example/a b 1.2.3.4 199901020304 text/html 5\nhello\n\n"
    two = b"dns:x.example 1.2.3.4 19990102030405 text/dns 3\nabc\n"
    records = list(warc.arc_records(io.BytesIO(head + one + two)))
    assert [r.version for r in records] == [1, 1, 1]
    assert records[1].fields == {"URL": "http://x.example/a b", "IP-address": "1.2.3.4", "Archive-date": "199901020304",
                                 "Content-type": "text/html", "Archive-length": "5"} and records[1].block == b"hello"
    assert [warc.iso_date(r.fields["Archive-date"]) for r in records] == ["1999-01-02T00:00:00Z", "1999-01-02T03:04:00Z", "1999-01-02T03:04:05Z"]
    assert warc.iso_date("soon") == "1970-01-01T00:00:00Z"
    assert b"WARC-Type: resource" in warc.warc_record(0, 2, records[2], None)
    for broken in (one.replace(b" 5\n", b" 500\n"), one.replace(b" 5\n", b" five\n")):
        with pytest.raises(ValueError):
            list(warc.arc_records(io.BytesIO(head + broken)))
