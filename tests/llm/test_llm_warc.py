import base64
import gzip
import hashlib

import pytest

from chunkmill.llm import warc as W


def fact(html):
    raw = (html or "").encode()
    return len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, n int")


def test_round_trip(spark, tmp_dir):
    long = "".join(f"<p>Zeile {i} äöü</p>\r\n\r\nWARC/1.1\r\n" for i in range(30_000))
    rows = [(5, "http://h/a", "<p>x</p>"), (3, "http://h/b", "<p>x</p>"), (4, "http://h/c", None), (8, "http://h/d", ""), (9, None, long),
            (2, "http://h/\r\nX: y", long + "!"), (11, "http://h/e", long), (12, "http://h/f", "0\r\n\r\n"), (12, "http://h/f", "0\r\n\r\n")]
    path = tmp_dir + "/w"
    W.write_archive(frame(spark, rows), path, records_per_file=7)
    out = {r.page_id: r for r in W.read_archive(spark, path).collect()}
    assert set(out) == {2, 3, 4, 5, 8, 9, 11, 12}
    for page, _, html in rows:
        assert (out[page].payload_bytes, out[page].payload_digest) == fact(html)
    first = {3: 5, 4: 8, 9: 11}
    for a, b in first.items():
        assert (out[a].record_type, out[a].refers_to) == ("response", None) and (out[b].record_type, out[b].refers_to) == ("revisit", a)
    assert out[9].n_segments > 10 and out[9].target_uri is None and out[2].target_uri == "http://h/%0D%0AX: y"


def test_min_bytes_and_empty(spark, tmp_dir):
    W.write_archive(frame(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), tmp_dir + "/m", min_bytes=3)
    out = {r.page_id: r.record_type for r in W.read_archive(spark, tmp_dir + "/m").collect()}
    assert out == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    W.write_archive(frame(spark, [(1, "u", "a")]).limit(0), tmp_dir + "/e")
    assert W.read_archive(spark, tmp_dir + "/e").count() == 0


def record(head, block):
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_foreign_archive_with_members_out_of_order(spark, tmp_dir):
    import os

    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=y\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: 1\r\n\r\n"
    parts = [record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:i>"}, b"software: x"),
             record({"WARC-Type": "continuation", "WARC-Record-ID": "<urn:page:7::2>", "WARC-Segment-Origin-ID": "<urn:page:7:>",
                     "WARC-Segment-Number": 2, "WARC-Segment-Total-Length": len(body)}, body[40:]),
             record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:7:>", "WARC-Segment-Number": 1}, body[:40])]
    os.makedirs(tmp_dir + "/f")
    for i, p in enumerate((parts[0] + parts[1], parts[2])):
        with open(f"{tmp_dir}/f/{i}.warc.gz", "wb") as f:
            f.write(b"".join(gzip.compress(x) for x in (p[:9], p[9:])))
    out = W.read_archive(spark, tmp_dir + "/f").collect()
    assert [(r.page_id, r.payload_bytes, r.payload_digest) for r in out] == [(7, *fact("abcde"))]
    os.remove(f"{tmp_dir}/f/1.warc.gz")
    with pytest.raises(Exception, match="incomplete segments"):
        W.read_archive(spark, tmp_dir + "/f").collect()


def test_every_row_comes_back(spark, tmp_dir):
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "same"), (None, "u", "same"), (None, "w", "same"), (None, "x", "other"),
            (2, "u", "other"), (2, "u", None), (None, None, None)]
    W.write_archive(frame(spark, rows), tmp_dir + "/r", records_per_file=2)
    out = W.read_archive(spark, tmp_dir + "/r").collect()
    got = sorted(((r.page_id, r.target_uri, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in out), key=str)
    assert sorted(((r[0], r[1], r[4], r[5]) for r in got), key=str) == sorted(((i, u, *fact(h)) for i, u, h in rows), key=str)
    assert sum(r[2] == "response" for r in got) == 3
    assert {(r[0], r[3]) for r in got if r[2] == "revisit"} == {(1, 1), (None, 1), (None, 2)}


def test_reading_in_pieces(monkeypatch):
    monkeypatch.setattr(W, "READ_BYTES", 5)
    blocks = [b"", b"a" * 100, b"\r\n\r\nWARC/1.1"]
    raw = b"".join(record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:{i}>"}, b) for i, b in enumerate(blocks))
    for packed in (raw, gzip.compress(raw), b"".join(gzip.compress(raw[i:i + 60]) for i in range(0, len(raw), 60))):
        assert [b for _, b in W.parse_records(packed)] == blocks
    for broken in (raw[:-8], raw[:30], gzip.compress(raw)[:-12], raw + b"x", b"no record\r\n\r\n"):
        with pytest.raises(ValueError):
            list(W.parse_records(broken))
    assert list(W.parse_records(b"")) == []


def test_resource_records(spark, tmp_dir):
    import os

    os.makedirs(tmp_dir + "/q")
    with open(f"{tmp_dir}/q/0.warc", "wb") as f:
        f.write(record({"WARC-Type": "resource", "WARC-Record-ID": "<urn:page:4::0>", "WARC-Target-URI": "http://h"}, b"plain \x00 bytes"))
    (r,) = W.read_archive(spark, tmp_dir + "/q").collect()
    assert (r.page_id, r.record_type, r.payload_bytes, r.target_uri) == (4, "resource", 13, "http://h")
