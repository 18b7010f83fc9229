"""Converter from the legacy ARC archive format, versions 1 and 2, to WARC records.

An ARC file starts with a version record (`filedesc://`) that states how the fields of every later header line
are to be read; each header line ends in the declared length of its block. Files may be plain or a series of gzip
members. For each record an equivalent WARC record is synthesised: a stable identifier, the time, the type,
and digests of block and payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of a header line after the URL, by version of the file.
FIELDS = {
    1: ("ip", "date", "mime", "length"),
    2: ("ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
SCHEMA = "source string, offset long, warc_type string, record_id string, target_uri string, warc_date string, ip string, content_type string, content_length long, block_digest string, payload_digest string, truncated string, block binary"
_HEADER = re.compile(rb"[a-zA-Z][a-zA-Z0-9+.-]*:\S.* \d+\r?\Z")


_MAGIC, _STEP, _PIECE = b"\x1f\x8b", 1 << 16, 1 << 18


def _salvage(inflater, data: bytes, given: int) -> Iterator[bytes]:
    """What the inflater yields of damaged data, byte by byte, beyond the first `given` bytes."""
    try:
        for k in range(len(data)):
            got = inflater.decompress(data[k : k + 1])
            skip = min(given, len(got))
            given -= skip
            yield got[skip:]
    except zlib.error:
        return


def expand(data: bytes) -> Iterator[tuple[bytes, int]]:
    """(piece, 0) of data in turn, with gzip members, if it starts with one, expanded; (b"", n) where n bytes of a damaged member end.

    What a damaged member yields is kept; reading goes on at the next gzip header. No member is held whole.
    """
    if not data.startswith(_MAGIC):
        yield from ((data[k : k + _PIECE], 0) for k in range(0, len(data), _PIECE))
        return
    at = 0
    while at >= 0:
        d, start, made = zlib.decompressobj(31), at, 0
        try:
            while at < len(data) and not d.eof:
                before, step, given = d.copy(), data[at : at + _STEP], 0
                at += len(step)
                rest = step
                while rest and not d.eof:
                    got = d.decompress(rest, _PIECE)
                    rest, given, made = d.unconsumed_tail, given + len(got), made + len(got)
                    yield got, 0
        except zlib.error:
            for got in _salvage(before, step, given):
                made += len(got)
                yield got, 0
        if not d.eof and made:
            yield b"", made
        at = data.find(_MAGIC, at - len(d.unused_data)) if d.eof else data.find(_MAGIC + b"\x08", start + 2)


class _Reader:
    """Bytes of one archive in turn, with what is still needed of them; a segment ends where damage follows, or with the archive."""

    def __init__(self, data: bytes):
        self.pieces, self.buffer, self.pos, self.base = expand(data), bytearray(), 0, 0
        self.ended = self.over = False
        self.damaged: int | None = None  # where the damaged member starts that ends the segment

    def fill(self, n: int) -> int:
        """Reads on until n bytes stand ready or the segment ends; how many do."""
        while not self.ended and len(self.buffer) - self.pos < n:
            piece, cut = next(self.pieces, (b"", None))
            self.buffer += piece
            if cut is None:
                self.ended = self.over = True
            elif cut:
                self.ended, self.damaged = True, self.base + len(self.buffer) - cut
        return min(n, len(self.buffer) - self.pos)

    def take(self, n: int) -> bytes:
        n = self.fill(n)
        out = bytes(memoryview(self.buffer)[self.pos : self.pos + n])
        self.pos += n
        if self.pos > _PIECE:
            self.base += self.pos
            del self.buffer[: self.pos]
            self.pos = 0
        return out

    def line(self) -> bytes:
        """The next line, with its end."""
        at = self.pos
        while (end := self.buffer.find(b"\n", at)) < 0 and not self.ended:
            at = len(self.buffer)
            self.fill(len(self.buffer) - self.pos + 1)
        return self.take((end + 1 if end >= 0 else len(self.buffer)) - self.pos)

    def next_segment(self) -> bool:
        self.ended, self.damaged = self.over, None
        return not self.over


@dataclass
class ArcRecord:
    offset: int
    url: str
    fields: dict[str, str]
    block: bytes
    truncated: bool


def parse(data: bytes) -> Iterator[ArcRecord]:
    """Records of one ARC file in turn, the version record first; two of them are held at most.

    A line that is no header is skipped, so parsing goes on after damage; a block that ends before its
    declared length is marked truncated. No record reaches beyond damage, and the last one before it is marked truncated
    whatever its length, since where in it the damage lies can't be known.
    """
    r, version, last, end = _Reader(data), 1, None, 0
    while True:
        start = r.base + r.pos
        line = r.line()
        if not line:
            if last is not None:
                last.truncated |= r.damaged is not None and end > r.damaged
                yield last
                last = None
            if not r.next_segment():
                return
            continue
        line = line.rstrip(b"\n").rstrip(b"\r")
        if not _HEADER.match(line):
            continue
        text = line.decode("utf-8", "replace")
        first = text.startswith("filedesc:")
        names = FIELDS[1 if first else version]
        parts = text.rsplit(" ", len(names))  # a URL may hold spaces; the other fields don't
        if len(parts) <= len(names):
            continue
        fields = dict(zip(names, parts[1:]))
        length = int(fields["length"])
        if last is not None:
            yield last
        block = r.take(length)
        if first:
            m = re.match(rb"(\d+) ", block)
            version = 2 if m and int(m[1]) >= 2 else 1
        last, end = ArcRecord(start, parts[0], fields, block, len(block) < length), r.base + r.pos


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(text: str) -> str | None:
    """ISO time of an ARC date of 4 to 14 digits (missing parts are the earliest possible); None if it is no date."""
    if not re.fullmatch(r"\d{4}(\d\d){0,5}", text):
        return None
    full = text + "00000101000000"[len(text) :]
    y, mo, d, h, mi, s = full[:4], full[4:6], full[6:8], full[8:10], full[10:12], full[12:14]
    days = [31, 29 if int(y) % 4 == 0 and (int(y) % 100 or int(y) % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    if not (1 <= int(mo) <= 12 and 1 <= int(d) <= days[int(mo) - 1] and int(h) < 24 and int(mi) < 60 and int(s) < 61):
        return None
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z"


def _uuid(*parts: str) -> str:
    h = hashlib.md5("\n".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def convert(source: str, data: bytes) -> Iterator[dict]:
    """WARC records equivalent to one ARC file's, as dicts by SCHEMA."""
    made = None
    for r in parse(data):
        date, mime, ip, payload = warc_date(r.fields["date"]), r.fields["mime"], r.fields["ip"], None
        if r.url.startswith("filedesc:"):
            kind, mime, made = "warcinfo", "application/warc-fields", date
            r.block = b"".join(b"%s: %s\r\n" % (k, v.encode()) for k, v in ((b"description", "converted from ARC"), (b"filename", r.url[len("filedesc://") :])))
        elif r.block.startswith(b"HTTP/") and re.match(r"https?:", r.url, re.I):
            kind, mime = "response", "application/http; msgtype=response"
            m = re.search(rb"\r?\n\r?\n", r.block)
            payload = r.block[m.end() :] if m else b""
        elif r.url.startswith("dns:"):
            kind, mime = "resource", "text/dns"
        else:
            kind = "resource"
        date = date or made or "1970-01-01T00:00:00Z"
        block = digest(r.block)
        yield {
            "source": source, "offset": r.offset, "warc_type": kind, "record_id": _uuid(kind, r.url, date, block), "target_uri": None if kind == "warcinfo" else r.url, "warc_date": date,
            "ip": None if ip in ("0.0.0.0", "-", "") else ip, "content_type": mime if re.fullmatch(r"[\w.+-]+/[\w.+-]+(;.*)?", mime) else "application/octet-stream", "content_length": len(r.block),
            "block_digest": block, "payload_digest": digest(payload if payload is not None else r.block) if kind != "warcinfo" else None, "truncated": "length" if r.truncated else None, "block": r.block,
        }


def serialise(rec: dict) -> bytes:
    """The record as it stands in a WARC/1.0 file."""
    named = [("WARC-Type", rec["warc_type"]), ("WARC-Record-ID", rec["record_id"]), ("WARC-Date", rec["warc_date"]), ("WARC-Target-URI", rec["target_uri"]), ("WARC-IP-Address", rec["ip"]), ("WARC-Block-Digest", rec["block_digest"]), ("WARC-Payload-Digest", rec["payload_digest"]), ("WARC-Truncated", rec["truncated"]), ("Content-Type", rec["content_type"]), ("Content-Length", str(rec["content_length"]))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v is not None) + "\r\n"
    return head.encode() + rec["block"] + b"\r\n\r\n"


_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
FLUSH = 4_000_000  # bytes of records handed on at once


def _convert(batches):
    for batch in batches:
        rows, size = [], 0
        for source, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            for rec in convert(source, data.as_py() or b""):
                rows.append(rec)
                size += rec["content_length"]
                if size > FLUSH:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def arc_to_warc(files: DataFrame, name_col: str = "path", data_col: str = "content") -> DataFrame:
    """WARC records (see SCHEMA) of ARC files given as rows of name and bytes, as binaryFile reads them.

    Null or empty files have no records; bytes that are no header line are skipped; a record cut off by the end of its
    file or in a damaged gzip member has truncated = 'length', and reading goes on at the next member; dates that are no dates become that of the file's version record; a null name stays null. Repeated rows
    are converted each for itself, with equal identifiers. Other columns don't matter; an empty table gives none.
    """
    src = files.select(F.col(name_col).cast("string").alias("n"), F.col(data_col).cast("binary").alias("d"))
    return src.mapInArrow(_convert, SCHEMA)


def write_arc(name: str, records: list[tuple[str, str, str, str, bytes]], version: int = 1, packed: bool = False) -> bytes:
    """An ARC file of (url, ip, 14-digit date, mime, block) records; packed: each as a gzip member."""
    extra = " Result-code Checksum Location Offset Filename" if version == 2 else ""
    about = f"{version} 0 kgloom\nURL IP-address Archive-date Content-type{extra} Archive-length\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 20000101000000 text/plain {len(about)}\n".encode() + about + b"\n"]
    for url, ip, date, mime, block in records:
        more = " 200 - - 0 " + name if version == 2 else ""
        out.append(f"{url} {ip} {date} {mime}{more} {len(block)}\n".encode() + block + b"\n")
    return b"".join(gzip.compress(x, 1, mtime=0) if packed else x for x in out)


def _pages_to_arc(batches):
    """Each page as an ARC file of its host's address and the page, of version 1 (even page ids) or 2 (odd ones), every third one as gzip members."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            names, files = [], []
            for i, url, html in zip(*(c.slice(lo, 500).to_pylist() for c in batch.columns)):
                body, ip, name = html.encode(), f"10.0.{i % 7}.{i % 200}", f"page-{i}.arc"
                date = f"2001{i % 12 + 1:02d}{i % 28 + 1:02d}{i % 24:02d}{i % 60:02d}00"
                host = re.search("://([^/?#: ]+)", url)
                host = host[1] if host else "none"
                records = [(f"dns:{host}", ip, date, "text/dns", f"{host}. 300 IN A {ip}".encode()), (url, ip, date, "text/html", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n%s" % (len(body), body))]
                names.append(name)
                files.append(write_arc(name, records, i % 2 + 1, packed=i % 3 == 0))
            yield pa.record_batch([pa.array(names), pa.array(files, pa.binary())], names=["path", "content"])


def pages_as_arc(pages: DataFrame) -> DataFrame:
    """An ARC file for every page (page_id, url, html) whose columns are not null: its host's address and an HTTP response.

    Repeated rows give a file each; empty pages are kept; other columns don't matter; an empty table gives no files.
    """
    src = pages.select(F.col("page_id").cast("long").alias("i"), F.col("url").cast("string").alias("u"), F.col("html").cast("string").alias("h")).where("i is not null and u is not null and h is not null")
    return src.mapInArrow(_pages_to_arc, "path string, content binary")


_B32 = "'abcdefghijklmnopqrstuvwxyz234567'"


def _sql_b32(hexed: str) -> str:
    """DuckDB SQL: base 32 of 40 hex digits."""
    group = f"CAST('0x' || substr({hexed}, g * 5 + 1, 5) AS BIGINT)"
    return f"'sha1:' || upper(array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr({_B32}, CAST(({group} >> s) & 31 AS INTEGER) + 1, 1)), '')), ''))"


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, url, html, coalesce(nullif(regexp_extract(url, '://([^/?#: ]+)', 1), ''), 'none') AS host, '10.0.' || page_id % 7 || '.' || page_id % 200 AS ip,
  format('2001-{{:02d}}-{{:02d}}T{{:02d}}:{{:02d}}:00Z', page_id % 12 + 1, page_id % 28 + 1, page_id % 24, page_id % 60) AS warc_date FROM pages),
b AS (SELECT 'response' AS warc_type, url, url AS target_uri, warc_date, ip, 'application/http; msgtype=response' AS content_type, html AS payload,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html AS block FROM p
  UNION ALL SELECT 'resource', 'dns:' || host, 'dns:' || host, warc_date, ip, 'text/dns', host || '. 300 IN A ' || ip, host || '. 300 IN A ' || ip FROM p
  UNION ALL SELECT 'warcinfo', 'filedesc://page-' || page_id || '.arc', NULL, '2000-01-01T00:00:00Z', NULL, 'application/warc-fields', NULL, 'description: converted from ARC' || chr(13) || chr(10) || 'filename: page-' || page_id || '.arc' || chr(13) || chr(10) FROM p),
h AS (SELECT *, sha1(block) AS block_hex, sha1(payload) AS payload_hex FROM b),
d AS (SELECT *, {_sql_b32("block_hex")} AS block_digest, CASE WHEN payload IS NOT NULL THEN {_sql_b32("payload_hex")} END AS payload_digest FROM h),
i AS (SELECT *, md5(warc_type || chr(10) || url || chr(10) || warc_date || chr(10) || block_digest) AS m FROM d)
SELECT warc_type, '<urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) || '>' AS record_id,
  target_uri, warc_date, ip, content_type, octet_length(encode(block)) AS content_length, block_digest, payload_digest, CAST(NULL AS VARCHAR) AS truncated, block FROM i
"""
