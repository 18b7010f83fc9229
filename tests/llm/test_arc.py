import base64
import gzip
import hashlib
import random

import pytest
from llm_tables import clashing

from kgloom.llm import arc

HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>body</p>"
RECORDS = [("http://a.example/x y?z=1", "1.2.3.4", "20010203040506", "text/html", HTTP), ("dns:a.example", "0.0.0.0", "2001", "text/dns", b"20010203\na.example. IN A 1.2.3.4"), ("ftp://f.example/a", "1.1.1.1", "junk", "no-type", b""), ("http://b.example/", "-", "20011301000000", "text/plain", b"no header\n\nhttp://not.a/header 1.1.1.1 20010101000000 text/html 5\nabc")]


def b32(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", ["plain", "one", "members"])
def test_convert(version, packed):
    data = arc.write_arc("f.arc", RECORDS, version)
    if packed == "one":
        data = gzip.compress(data)
    elif packed == "members":  # one member for each record, as archives have it
        parts = [arc.write_arc("f.arc", RECORDS[:k], version) for k in range(len(RECORDS) + 1)]
        data = b"".join(gzip.compress(b[len(a) :], mtime=0) for a, b in zip([b"", *parts], parts))
    info, page, dns, ftp, odd = arc.convert("f", data)
    assert (info["warc_type"], info["target_uri"], info["warc_date"]) == ("warcinfo", None, "2000-01-01T00:00:00Z")
    assert (page["warc_type"], page["target_uri"], page["warc_date"], page["ip"], page["content_type"]) == ("response", "http://a.example/x y?z=1", "2001-02-03T04:05:06Z", "1.2.3.4", "application/http; msgtype=response")
    assert page["block"] == HTTP and page["block_digest"] == b32(HTTP) and page["payload_digest"] == b32(b"<p>body</p>") and page["truncated"] is None
    assert (dns["warc_type"], dns["content_type"], dns["ip"], dns["warc_date"]) == ("resource", "text/dns", None, "2001-01-01T00:00:00Z")
    assert (ftp["warc_type"], ftp["content_type"], ftp["warc_date"], ftp["content_length"]) == ("resource", "application/octet-stream", "2000-01-01T00:00:00Z", 0)
    assert odd["warc_type"] == "resource" and odd["block"] == RECORDS[3][4] and odd["ip"] is None  # a header inside a block is none
    assert len({r["record_id"] for r in (info, page, dns, ftp, odd)}) == 5
    again = list(arc.convert("other name", data))
    assert [r["record_id"] for r in again][1:] == [r["record_id"] for r in (page, dns, ftp, odd)]


def test_serialised_record_can_be_read_back():
    rec = list(arc.convert("f", arc.write_arc("f", RECORDS)))[1]
    head, _, rest = arc.serialise(rec).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.0\r\n") and rest == HTTP + b"\r\n\r\n" and int(fields["Content-Length"]) == len(HTTP) and fields["WARC-Target-URI"] == RECORDS[0][0]


def test_damage():
    data = arc.write_arc("f.arc", RECORDS[:2])
    cut = list(arc.convert("f", data[:-10]))
    assert cut[-1]["truncated"] == "length" and cut[-1]["content_length"] < len(RECORDS[1][4])
    junk = list(arc.convert("f", b"\x00junk\n\n" + data[:80] + data))
    assert {r["warc_type"] for r in junk} >= {"warcinfo"}
    r = random.Random(1)
    for _ in range(200):
        broken = bytearray(data)
        for _ in range(5):
            broken[r.randrange(len(broken))] = r.randrange(256)
        list(arc.convert("f", bytes(broken)))
        list(arc.convert("f", gzip.compress(data)[: r.randrange(200)]))
    assert list(arc.convert("f", b"")) == []


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("where", ["crc", "middle", "header", "cut"])
def test_damaged_middle_member(version, where):
    noise = random.Random(2).randbytes(20_000).hex().encode()
    records = [(f"http://{c}.example/", "1.1.1.1", "20010101000000", "text/plain", c.encode() + noise) for c in "abcd"]
    parts = [arc.write_arc("f.arc", records[:k], version) for k in range(len(records) + 1)]
    members = [bytearray(gzip.compress(b[len(a) :], mtime=0)) for a, b in zip([b"", *parts], parts)]
    if where == "crc":
        members[2][-6] ^= 255
    elif where == "middle":
        members[2][len(members[2]) // 2 : len(members[2]) // 2 + 40] = b"\xff" * 40
    elif where == "header":
        members[2][2] = 0
    else:
        del members[2][len(members[2]) // 2 :]
    got = list(arc.convert("f", b"".join(members)))[1:]
    by = {r["target_uri"]: r for r in got}
    for k in (0, 2, 3):  # intact ones are whole and unmarked
        r = by[records[k][0]]
        assert r["block"] == records[k][4] and r["truncated"] is None
    if where == "header":
        assert len(got) == 3
    else:
        cut = by["http://b.example/"]
        assert len(got) == 4 and cut["truncated"] == "length" and cut["block"][:5000] == records[1][4][:5000]
    if where == "crc":
        assert by["http://b.example/"]["block"] == records[1][4]


def test_one_damaged_pair_of_bytes_loses_little():
    noise = random.Random(3)
    records = [(f"http://h{k}.example/", "1.1.1.1", "20010101000000", "text/plain", noise.randbytes(3000).hex().encode()) for k in range(40)]
    whole = arc.write_arc("f.arc", records)
    one = bytearray(gzip.compress(whole, mtime=0))
    one[len(one) // 2 : len(one) // 2 + 2] = b"\xff\xff"
    got = list(arc.convert("f", bytes(one)))
    assert 15 <= len(got) < 41 and got[-1]["truncated"] == "length" and all(r["truncated"] is None for r in got[:-1])
    assert [r["block"] for r in got[1:-1]] == [r[4] for r in records[: len(got) - 2]]
    parts = [arc.write_arc("f.arc", records[:k]) for k in (0, 10, 20, 40)]
    members = [bytearray(gzip.compress(b[len(a) :], mtime=0)) for a, b in zip([b"", *parts], parts)]
    members[2][len(members[2]) // 2 : len(members[2]) // 2 + 2] = b"\xff\xff"
    got = {r["target_uri"]: r for r in arc.convert("f", b"".join(members))}
    assert all(got[r[0]]["block"] == r[4] and got[r[0]]["truncated"] is None for r in records[:10] + records[20:]) and len(got) > 34 and sum(r["truncated"] == "length" for r in got.values()) == 1


def test_large_archives_are_read_piece_by_piece():
    import tracemalloc

    data = gzip.compress(arc.write_arc("f.arc", [(f"http://h{k}.example/", "1.1.1.1", "20010101000000", "text/plain", b"x" * 1_000_000) for k in range(60)]), 1)
    tracemalloc.start()
    n = sum(len(r.block) == 1_000_000 for r in arc.parse(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60 and peak < 12_000_000


@pytest.mark.parametrize("text, iso", [("20240229235959", "2024-02-29T23:59:59Z"), ("20230229000000", None), ("2024", "2024-01-01T00:00:00Z"), ("202402", "2024-02-01T00:00:00Z"), ("", None), ("20241", None), ("20240101250000", None), ("x", None)])
def test_dates(text, iso):
    assert arc.warc_date(text) == iso


def test_table(spark):
    data = arc.write_arc("f.arc", RECORDS)
    big = arc.write_arc("big.arc", [("http://big.example/", "1.1.1.1", "20010101000000", "text/html", b"x" * 30_000_000)])
    rows = [("a", data), ("a", data), ("n", None), ("e", b""), (None, data), ("big", big)]
    df = clashing(spark.createDataFrame(rows, "path string, content binary"))
    got = arc.arc_to_warc(df)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert n == {"a": 10, None: 5, "big": 2}
    assert arc.arc_to_warc(spark.createDataFrame([], "path string, content binary")).collect() == []


def test_pages_round_trip(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    files = arc.pages_as_arc(pages)
    got = {r["target_uri"]: bytes(r["block"]).partition(b"\r\n\r\n")[2].decode() for r in arc.arc_to_warc(files).where("warc_type = 'response'").collect()}
    assert got == {r["url"]: r["html"] for r in pages.collect()}
    odd = spark.createDataFrame([(1, None, "x"), (None, "http://a.b/", "x"), (2, "http://a.b/", None)], "page_id long, url string, html string")
    assert arc.arc_to_warc(arc.pages_as_arc(odd)).collect() == []
