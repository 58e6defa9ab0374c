"""Operator 12: archives written, read and assembled, against plain Python."""

import gzip
import hashlib
import os
import tempfile

import pytest

from tabulon.llm import warc as W

BIG = "x" * 100
BODIES = ["", None, "short", "short", BIG, BIG, "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + BIG, BIG + "\r\n", BIG + "\r\n\r\n", BIG + "\r",
          "\r\n\r\n" + BIG, "\r\n" * 60, "\r\n\r\r\n\r\n" * 30, "é日🙂" * 40, "é日🙂" * 40, BIG]
URLS = ["http://a.org/x?y#z", None, "", "no scheme", "https://b.org", "http://c.org/\r\nX: y"]


def pages(spark, ids=None):
    rows = [(None if i == 9 else (ids or list(range(40, 0, -1)))[i], URLS[i % len(URLS)], b, "extra") for i, b in enumerate(BODIES)]
    rows += [rows[4], rows[2], (rows[5][0], "http://other.org/", BIG, "extra")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, record_id string").repartition(3)


def want(rows):
    out = []
    for i, _, body, _ in rows:
        raw = (body or "").encode()
        same = [j for j, _, b, _ in rows if (b or "").encode() == raw and j is not None]
        again = len(raw) >= 100 and same and i != min(same)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return out


def archive(spark, df, **kw):
    path = tempfile.mkdtemp(prefix="warc-test-") + "/a"
    W.write_warc(W.page_records(df, **kw), path)
    return path


def order(r):
    return [(x is None, x if x is not None else 0) for x in r]


def test_pages_come_back(spark):
    rows, df = pages(spark)
    got = W.pages_from_warc(W.read_warc(spark, archive(spark, df)))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want(rows), key=order)


def test_payloads_come_back_byte_for_byte(spark):
    raw = [bytes(range(256)) * 3, b"\xff\xfe\r\n\r\n\x00" * 50, b"\r\n\r\n", b"", b"WARC/1.1\r\n\r\n"]
    df = spark.createDataFrame([(i, "http://a.org/", bytearray(b)) for i, b in enumerate(raw)], "page_id long, url string, html binary")
    path = archive(spark, df)
    held = {bytes(r.payload) for r in W.read_warc(spark, path).where("type = 'response'").collect()}
    assert held == set(raw)
    # a part file is plain WARC: the standard layout, each block of its stated length
    text = b"".join(gzip.open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".gz"))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: request\r\n") and text.endswith(b"\r\n\r\n")


def test_captures_are_nested(spark):
    rows, df = pages(spark)
    got = W.captures(W.read_warc(spark, archive(spark, df))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert len(r.requests) == 1 and len(r.metadata) == 1
        assert bytes(r.requests[0].payload).startswith(b"GET /") and b"\r\nX: y" not in bytes(r.requests[0].payload)
        assert (r.refers_to is not None) == (r.type == "revisit")
        assert r.stated_digest == "sha256:" + r.payload_digest or r.type == "revisit"


def test_chains_back_links_and_loose_records(spark):
    rows = [("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("m2", "metadata", ["m1"]), ("m3", "metadata", ["nowhere"]),
            ("r2", "resource", []), ("m4", "metadata", ["r2", "r1"]), ("m4", "metadata", ["r2", "r1"]), ("q9", "request", ["m3"]), ("r3", "revisit", [])]
    df = spark.createDataFrame([(i, t, c, "d", "text", bytearray(b"p")) for i, t, c in rows],
                               "record_id string, type string, concurrent_to array<string>, date string, content_type string, payload binary")
    got = {r.record_id: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in W.captures(df).collect()}
    assert got == {"r1": (["q1"], ["m1", "m2", "m4"]), "r2": ([], ["m4"]), "r3": ([], [])}
    assert sorted(r.record_id for r in W.loose_records(df).collect()) == ["m3", "q9"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.pages_from_warc(W.read_warc(spark, archive(spark, df))).count() == 0


@pytest.mark.parametrize("raw", [b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc\r\n\r\n", b"no record\r\n\r\n", b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n",
                                 b"WARC/1.1\r\nWARC-Type: request\r\n\r\n\r\n\r\n", b"WARC/1.1\r\nContent-Length: 3"])
def test_broken_archives_are_told(raw):
    s = W.RecordStream("a.gz")
    with pytest.raises(ValueError):
        list(s.feed(raw))
        s.close()
    with pytest.raises(ValueError):
        W.RecordStream("a.warc")


def test_records_of_other_writers(spark):
    """One gzip member per record, WARC/1.0, other field order and case."""
    path = tempfile.mkdtemp(prefix="warc-test-")
    def record(kind, rid, block, *extra):
        head = [b"WARC/1.0", b"content-length: %d" % len(block), b"WARC-Record-ID: " + rid, b"WARC-Type: " + kind, *extra]
        return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")
    with open(path + "/x.warc.gz", "wb") as f:
        f.write(record(b"warcinfo", b"<i>", b"software: x\r\n"))
        f.write(record(b"response", b"<r>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", b"Content-Type: application/http; msgtype=response"))
        f.write(record(b"request", b"<q>", b"GET / HTTP/1.1\r\n\r\n", b"WARC-Concurrent-To: <r>"))
    got = W.captures(W.read_warc(spark, path)).collect()
    assert [(r.record_id, bytes(r.payload), [x.record_id for x in r.requests], r.metadata) for r in got] == [("<r>", b"body", ["<q>"], [])]
