import base64
import gzip
import hashlib

import pytest
from llm_cases import prose

from trafficlens.llm import warc
from trafficlens.session import scratch_path, written

DDL = "page_id bigint, url string, html string, path string, bytes bigint, id int"


def pages(spark, htmls):
    rows = [(i, None if i == 2 else f"http://x/{i}", h, "clash", 3, 4) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, DDL)


def archived(spark, frame):
    return written(warc.write_warc(warc.with_revisits(frame), scratch_path(spark, "warc")), "archives")


HTMLS = [None, "", "<p>é" + "x" * 120, prose(1, 50), prose(1, 50), "short", "short", "x" * 99, "x" * 99, "y" * 100, "y" * 100, prose(2, 30_000)]


@pytest.mark.parametrize("split", [50, 300, 1 << 20])
def test_round_trip_at_any_split(spark, split):
    frame = pages(spark, HTMLS).repartition(3)
    got = {r.id: r for r in warc.read_warc(archived(spark, frame), split_bytes=split).collect()}
    assert got.keys() == set(range(len(HTMLS)))
    first = {}
    for i, html in enumerate(HTMLS):
        data = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        answer = first.setdefault(data, i) if len(data) >= 100 else i
        assert (r.record_type, r.refers_to) == (("response", None) if answer == i else ("revisit", answer))
        assert r.payload == (data if answer == i else None)
        assert r.url == (None if i == 2 else f"http://x/{i}")


def test_magic_inside_a_payload_is_no_record(spark, tmp_path):
    """A stored member inside another one is found by its magic, and refused or read by its header."""
    inner = b"\x1f\x8b\x08 and \x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03 not a record " * 20 + gzip.compress(b"something else")
    data = b"".join(warc.record_bytes(i, "u", inner + bytes([i]), hashlib.sha256(inner + bytes([i])).hexdigest(), None) for i in range(5))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    frame = warc.find_archives(spark, str(tmp_path))
    assert sorted(r.id for r in warc.read_warc(frame, split_bytes=37).collect()) == list(range(5))


def test_a_cut_record_is_an_error(spark, tmp_path):
    data = warc.record_bytes(1, "u", b"abc" * 1000, hashlib.sha256(b"abc" * 1000).hexdigest(), None)
    (tmp_path / "a.warc.gz").write_bytes(data[:-10])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(warc.find_archives(spark, str(tmp_path))).collect()


def test_repeated_rows_null_ids_and_nothing(spark):
    long = "z" * 200
    frame = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, "v", long), (None, None, long), (None, None, None)],
                                  "page_id bigint, url string, html string")
    got = sorted((r.id is None, r.id or 0, r.record_type, r.refers_to or 0) for r in warc.read_warc(archived(spark, frame)).collect())
    assert got == [(False, 1, "response", 0)] * 2 + [(False, 2, "revisit", 1)] + [(True, 0, "response", 0)] * 2
    assert warc.read_warc(archived(spark, frame.limit(0))).count() == 0


def test_archives_of_other_writers(spark, tmp_path):
    body = b"<p>hello</p>"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"

    def member(kind, n, block, *more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID:<urn:uuid:{n}>", f"content-length: {len(block)}", *more]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    message = "Content-Type: application/http; msgtype=response"
    members = [
        member("warcinfo", 0, b"software: x\r\n\r\nmore", "Content-Type: application/warc-fields"),
        member("request", 1, b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        member("response", 2, http + body, message, f"WARC-Payload-Digest: {sha1}", "WARC-Target-URI: http://x/"),
        member("metadata", 3, b"a: b"),
        member("revisit", 4, http, message, f"WARC-Payload-Digest: {sha1}", "WARC-Refers-To: <urn:uuid:2>"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    got = sorted(warc.read_warc(warc.find_archives(spark, str(tmp_path)), split_bytes=100).collect(), key=lambda r: r.record_id)
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "metadata", "revisit"]
    assert [r.payload for r in got] == [b"software: x\r\n\r\nmore", b"", body, b"a: b", None]
    assert all(r.id is None and r.refers_to is None and r.record_id == f"<urn:uuid:{i}>" for i, r in enumerate(got))
    assert (got[2].url, got[4].payload_digest, got[4].refers_to_id) == ("http://x/", sha1, "<urn:uuid:2>")
    with pytest.raises(ValueError, match="does not match"):
        warc.parse_record(gzip.decompress(member("response", 5, http + b"other", message, f"WARC-Payload-Digest: {sha1}")))


def plain_record(n, block, *more, kind="resource"):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{n}>", f"Content-Length: {len(block)}", *more]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_members_of_several_records(spark, tmp_path, monkeypatch, chunk):
    """An archive gzipped as a whole, members of a few records, an empty block, line breaks in and between blocks."""
    monkeypatch.setattr(warc, "CHUNK", chunk)
    blocks = [b"", b"\r\n\r\n", b"WARC/1.0\r\n\r\n", b"x" * 200_000, b"tail\r\n", *(prose(k, 40).encode() for k in range(30))]
    records = [plain_record(k, b) for k, b in enumerate(blocks)]
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"\r\n".join(records)))
    (tmp_path / "some.warc.gz").write_bytes(b"".join(gzip.compress(b"".join(records[k : k + 3])) for k in range(0, len(records), 3)))
    got = warc.read_warc(warc.find_archives(spark, str(tmp_path)), split_bytes=500).collect()
    assert sorted((r.record_id, r.payload) for r in got) == sorted((f"<urn:uuid:{k}>", b) for k, b in enumerate(blocks) for _ in range(2))


@pytest.mark.parametrize("data,message", [
    (b"WARC/1.0\r\nWARC-Type: resource\r\n\r\nabc", "without Content-Length"),
    (b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "without WARC-Type"),
    (plain_record(1, b"abc") + b"garbage\r\n\r\n", "no record begins with"),
    (plain_record(1, b"abc")[:-6], "is cut off"),
    (plain_record(1, b"abc") + b"WARC/1.0\r\nWARC-Ty", "is cut off"),
])
def test_bad_records_name_their_archive(spark, tmp_path, data, message):
    (tmp_path / "bad.warc.gz").write_bytes(b"\0" * 7 + gzip.compress(data))
    with pytest.raises(Exception, match=rf"bad.warc.gz.*byte 7.*{message}|bad.warc.gz.*{message}"):
        warc.read_warc(warc.find_archives(spark, str(tmp_path))).collect()


def test_no_folder_and_empty_archives(spark, tmp_path):
    assert warc.find_archives(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    frame = warc.find_archives(spark, str(tmp_path)).unionByName(spark.createDataFrame([(None, 5), ("x", None)], "path string, bytes bigint"))
    assert warc.read_warc(frame).count() == 0
