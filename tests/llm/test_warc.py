"""WARC derivatives: round trips through the record format, and links and digests."""

import base64
import gzip
import hashlib
import io
import time

import pytest

from pagelake.llm import warc

PAGE = b"""HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-Long: a\r\n b\r\nSet-Cookie: 1\r\nSet-Cookie: 2\r\n\r\n<!DOCTYPE html><html lang=de><head><title>T&auml;st
 page</title><style>p{}</style><script>var t="</p><a href=x>";</script></head><body><!-- <p>no</p> --><h1>One</h1><p>a <b>b</b>c<br>d &lt;e&gt;<a href="/x" title="a>b">link</a></p>\xe4</body></html>"""


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives_of_responses(spark):
    rows = [("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", PAGE), (None, None, None, None), ("r3", "http://b/", "d", b"HTTP/1.1 200 OK\nContent-Type: image/png\n\n\x89PNG"), ("r4", "u", "d", b"HTTP/1.0 404 Not Found\r\nContent-Type: text/plain\r\n\r\nas  is\n"), ("r5", "u", "d", b"<p>x" + b" y" * 300_000), ("r4", "u", "d", b"HTTP/1.0 404 Not Found\r\nContent-Type: text/plain\r\n\r\nas  is\n")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], warc.RESPONSES + ", type string").repartition(3)
    out = warc.derivatives(df)
    got = {}
    for r in out.collect():
        got.setdefault((r.refers_to, r.type), []).append(r)
    meta, text = got["<urn:uuid:1>", "metadata"][0], got["<urn:uuid:1>", "conversion"][0]
    payload = PAGE.split(b"\r\n\r\n", 1)[1]
    assert text.block.decode() == "Täst page\nOne\na bc\nd <e>link\nä"
    assert text.block_digest == text.payload_digest == sha(text.block) and text.source_digest == meta.source_digest == sha(payload)
    assert meta.block.decode().split("\r\n")[:-1] == [f"refers-to-payload-digest: {sha(payload)}", f"payload-length: {len(payload)}", "source-status: HTTP/1.1 200 OK", "source-header: Content-Type: text/html; charset=iso-8859-1", "source-header: X-Long: a b", "source-header: Set-Cookie: 1", "source-header: Set-Cookie: 2", "title: Täst page", "language: de", "links: 1"]
    assert text.record_id != meta.record_id and (text.target_uri, text.date) == ("http://a/", "2024-01-01T00:00:00Z")
    assert ("r3", "conversion") not in got and ("r3", "metadata") in got
    assert got["r4", "conversion"][0].block == b"as  is\n" and len(got["r4", "conversion"]) == 2
    assert len(got["r5", "conversion"][0].block) == 600_001
    assert [r.block for k, v in got.items() for r in v if r.target_uri is None and r.type == "conversion"] == [b""]
    assert warc.derivatives(df.limit(0)).count() == 0


def test_records_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i}", "http://a/\r\nX: y", "d", PAGE * (i + 1)) for i in range(5)], warc.RESPONSES)
    records = sorted((r.asDict() for r in warc.derivatives(df).collect()), key=lambda r: r["record_id"])
    packed = sorted(warc.members(warc.derivatives(df)).collect(), key=lambda r: r.record_id)
    whole = b"".join(r.member for r in packed)
    (tmp_path / "a.warc.gz").write_bytes(whole)
    (tmp_path / "b.warc").write_bytes(gzip.decompress(whole))
    read = warc.read(spark, f"file://{tmp_path}").collect()
    assert len(read) == 2 * len(records)
    for file in ("a.warc.gz", "b.warc"):
        own = sorted((r for r in read if r.file.endswith(file)), key=lambda r: r.headers["WARC-Record-ID"])
        for r, want in zip(own, records):
            assert r.block == want["block"] and r.headers["WARC-Refers-To"] == want["refers_to"] and r.headers["WARC-Block-Digest"] == sha(r.block)
            assert r.headers["WARC-Type"] == want["type"] and "X" not in r.headers
    assert len(list(warc.parse(io.BytesIO(gzip.decompress(whole))))) == len(records)


def test_pages_become_responses(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, None, None)], "page_id long, url string, html string")
    rows = warc.responses_of(df, "2024-01-01T00:00:00Z").orderBy("page_id").collect()
    status, headers, payload = warc.split_http(bytes(rows[0].block))
    assert status == "HTTP/1.1 200 OK" and dict(headers)["Content-Length"] == str(len(payload)) and payload.decode() == "<p>é</p>"
    assert len({r.record_id for r in rows}) == 2 and len(rows[0].record_id) == 47


@pytest.mark.parametrize("unit", ["<a ", "<script ", "<!--", "<title>", '<a "', "<p title='", "</", "<!", "<a href=x", "&lt", "<style>"])
@pytest.mark.parametrize("end", ["", ">", '">'])
def test_time_grows_with_the_length(unit, end):
    began = time.time()
    warc.derive("r", "u", "d", (unit * (400_000 // len(unit)) + end).encode())
    assert time.time() - began < 2


def test_text_of_malformed_pages():
    assert warc.plain_text("<p title=it's>a</p><p>b") == "a\nb" and warc.plain_text("1 < 2 <b>x</b> <a") == "1 < 2 x <a"
    assert warc.plain_text('<p title="a>b">c<!-- d') == "c" and warc.plain_text("x<script>y</script >z") == "x z" and warc.plain_text("<scr") == "<scr"
