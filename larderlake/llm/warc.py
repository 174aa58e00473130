"""WARC: record writer and a salvage reader.

The reader checks each gzip member (or, uncompressed, each record) in turn.
After a failed check it searches for the next place where a whole record can
be read, goes on there, and logs the bytes between as a quarantined gap. The
same holds inside a member of several records, and for what a damaged member
gave before its error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, keep, table

VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: The writer has no clock, so that reruns agree.
DATE = "1970-01-01T00:00:00Z"
#: Payload bytes of one archive, at which the writer starts the next.
ARCHIVE = 16_000_000


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: dict[str, str], body: bytes, compress: bool = True) -> bytes:
    """One record, by default as a gzip member of its own. Line breaks in a value become spaces."""
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() for k, v in (headers | {"Content-Length": str(len(body))}).items())]
    data = b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"
    if not compress:
        return data
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _one(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the plain record at `at`. Raises ValueError when a check fails."""
    if not _LINE.match(data, at):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("headers don't end")
    headers: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError("a header without a colon")
        headers[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", length):
        raise ValueError("bad content-length")
    end = stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the block doesn't end where content-length says")
    body = data[stop + 4 : end]
    said = headers.get("warc-block-digest")
    if said and said.startswith("sha1:") and said[5:] != digest(body):
        raise ValueError("block digest differs")
    return headers, body, end + 4


class _Inflate:
    """decompressobj fed in pieces, so that a small member of a large archive doesn't copy the rest. `error` says why a member isn't whole."""

    def __init__(self):
        self.d, self.end, self.error = zlib.decompressobj(31), 0, ""

    def read(self, data: bytes, at: int) -> bytes:
        out, step = [], 1 << 16
        while not self.d.eof and at < len(data):
            before = self.d.copy()
            try:
                out.append(self.d.decompress(data[at : at + step]))
            except zlib.error as e:
                if step == 1:
                    self.error = f"gzip: {e}"
                    return b"".join(out)
                self.d, step = before, 1  # again, to keep what comes before the error
                continue
            at += step
        self.end = min(at, len(data)) - len(self.d.unused_data)
        if not self.d.eof:
            self.error = "gzip: the member doesn't end"
        return b"".join(out)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
    """("record", start, end, headers, block, "") for each record, ("gap", start, end, {}, b"", reason) for each gap.

    Starts and ends are offsets into `data`. Records and gaps come in order
    and cover all bytes. An empty archive gives nothing. Records and gaps
    inside a gzip member have the member's start and end; such a gap's reason
    tells its place among the inflated bytes. A damaged member reaches to the
    next place where a record can be read. Where its bytes were wrong, and not
    just cut off, only blocks with a digest of their own are kept.
    """
    at = 0
    while at < len(data):
        try:
            found, end = _read(data, at)
        except ValueError as e:
            reason, begin = str(e), at
            at = _next(data, at + 1)
            yield "gap", begin, at, {}, b"", reason
            continue
        end = end or _next(data, at + 1)
        for headers, body, why in found:
            yield ("gap", at, end, {}, b"", why) if why else ("record", at, end, headers, body, "")
        at = end


def _read(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes, str]], int]:
    """(headers, block, "") of each record and ({}, b"", reason) of each gap of the member or plain record at `at`, and its end, 0 if damage hides it. Raises ValueError where no record can be read."""
    if data[at : at + 3] != MEMBER:
        headers, body, end = _one(data, at)
        return [(headers, body, "")], end
    x = _Inflate()
    plain = x.read(data, at)
    found, first, i = [], "", 0
    while i < len(plain):
        try:
            headers, body, end = _one(plain, i)
            if x.error and x.end == 0 and not headers.get("warc-block-digest", "").startswith("sha1:"):
                raise ValueError("no block digest in a damaged member")
            found.append((headers, body, ""))
            i = end
        except ValueError as e:
            begin, reason = i, str(e)
            i = _following(plain, i + 1, bool(x.error and x.end == 0))
            first = first or reason
            found.append(({}, b"", f"{reason} (inflated bytes {begin} to {i})"))
    if not any(not why for _, _, why in found):
        raise ValueError(x.error or first or "no record")
    if x.error:
        found.append(({}, b"", x.error))
    return found, 0 if x.error else x.end


def _following(plain: bytes, at: int, digest: bool) -> int:
    """The next place among inflated bytes where a whole record can be read, or the end. digest: only one with a digest of its block."""
    for m in _LINE.finditer(plain, at):
        try:
            headers = _one(plain, m.start())[0]
        except ValueError:
            continue
        if not digest or headers.get("warc-block-digest", "").startswith("sha1:"):
            return m.start()
    return len(plain)


def _next(data: bytes, at: int) -> int:
    """The next place where a record can be read, or the end."""
    while True:
        m = _LINE.search(data, at)
        places = [x for x in (data.find(MEMBER, at), m.start() if m else -1) if x >= 0]
        if not places:
            return len(data)
        at = min(places)
        try:
            _read(data, at)
            return at
        except ValueError:
            at += 1


def page_digests(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest) of every html in UTF-8; null: empty."""

    def run(it):
        for b in it:
            raw = [(x or "").encode() for x in b["html"].to_pylist()]
            yield {"page_id": b["page_id"], "payload_bytes": [len(x) for x in raw], "payload_digest": [digest(x) for x in raw]}

    return batches(pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")), run, "page_id long, payload_bytes long, payload_digest string")


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """(archive binary): WARC archives with a record for each page (page_id, url, html).

    Of records with equal payloads of at least `least` bytes the one with the
    smallest page_id is a response, the others are revisits without a block.
    The smallest ids are found from digests alone, combined before they are
    shuffled, so a hot payload costs one row a task. Null url and html: empty.
    Rows that repeat a page_id: one record each.
    """
    first = page_digests(pages).where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    cols = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def named(it):
        for b in it:
            yield {"page_id": b["page_id"], "url": b["url"], "html": b["html"], "payload_digest": [digest((x or "").encode()) for x in b["html"].to_pylist()]}

    rows = batches(cols, named, "page_id long, url string, html string, payload_digest string").join(first, "payload_digest", "left")

    def write(it):
        done, size = [], 0
        for b in it:
            for i, url, html, code, ref in zip(*(b[x].to_pylist() for x in ("page_id", "url", "html", "payload_digest", "first"))):
                raw = (html or "").encode()
                again = ref is not None and ref != i
                h = {"WARC-Type": "revisit" if again else "response", "WARC-Record-ID": f"<urn:page:{i}>", "WARC-Date": DATE, "WARC-Target-URI": url or "", "WARC-Payload-Digest": f"sha1:{code}"}
                h |= {"WARC-Refers-To": f"<urn:page:{ref}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Payload-Length": str(len(raw))} if again else {"WARC-Block-Digest": f"sha1:{code}"}
                done.append(record(h, b"" if again else raw))
                size += len(raw)
                if size >= ARCHIVE:
                    yield {"archive": [b"".join(done)]}
                    done, size = [], 0
        if done:
            yield {"archive": [b"".join(done)]}

    return batches(rows.select("page_id", "url", "html", "payload_digest", "first"), write, "archive binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record and gap: kind, first, last (byte offsets), reason, and of records type, id, refers_to, uri, payload_bytes, payload_digest.

    Of a revisit, length and digest are of the full payload, from its headers.
    Null or empty archives give no row.
    """
    names = ("kind", "first", "last", "reason", "type", "id", "refers_to", "uri", "payload_bytes", "payload_digest")

    def run(it):
        for b in it:
            for data in b["archive"].to_pylist():
                rows = {k: [] for k in names}
                for kind, start, end, h, body, why in salvage(data or b""):
                    again = h.get("warc-type") == "revisit"
                    values = (kind, start, end, why or None, *((h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), int(h.get("x-payload-length", len(body))) if again else len(body), h.get("warc-payload-digest", "").removeprefix("sha1:") if again else digest(body)) if kind == "record" else (None,) * 6))
                    for k, v in zip(names, values):
                        rows[k].append(v)
                yield rows

    return batches(archives.select("archive"), run, "kind string, first long, last long, reason string, type string, id string, refers_to string, uri string, payload_bytes long, payload_digest string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: writes every page to archives in the shared folder, then reads them back with the salvage reader."""
    read = read_archives(keep(write_archives(table(spark, sf_dir, "pages")), "none")).where("kind = 'record'")
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return read.select(page("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", page("refers_to")).alias("refers_to"))



#: Base32 by hand: 40 hexadecimal digits to 160 bits to 32 letters.
ORACLE_SQL = """
WITH coded AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    array_to_string(list_transform(string_split(sha1(encode(coalesce(html, ''))), ''), lambda c: lpad(bin(strpos('123456789abcdef', c)), 4, '0')), '') AS bits FROM pages
), named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_reduce(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS INT), 1) AS INT) * CAST(2 ** (4 - j) AS INT)), lambda x, y: x + y) AS INT) + 1, 1)), '') AS payload_digest FROM coded
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM named)
"""
