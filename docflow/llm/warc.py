"""WARC archives: writing, reading, and reassembly of segmented records.

Writing. Every page is an HTTP response whose payload is framed by chunked transfer coding. Of pages with equal payloads
of at least REVISIT_BYTES bytes, the one with the smallest page_id is a response and the others are revisit records that
name it. A record block longer than SEGMENT_BYTES is cut into a first record and continuation records with
WARC-Segment-Number, WARC-Segment-Origin-ID and, on the last, WARC-Segment-Total-Length. Spark's text writer puts down
blocks of whole records (the two line ends behind a record are its line separator), so archives go to any store that
Spark can write; a file holds at most FILE_BLOCKS blocks of about BLOCK_BYTES and is compressed with gzip.

Reading. Compressed archives of any size are streamed by Spark's text reader, cut where a record's head may begin; the
pieces of a file come in order to one task, and those of one record are put together again by its stated length, so at
most one record is held. (Uncompressed archives, which a text reader would split inside records, come in by binaryFile
and so are bound to 2 GB each.) Continuation records are grouped by the id of their origin, ordered by segment number, and
streamed: framing is decoded and digests are kept as state, so no reassembled record is held whole. A record counts as
valid if its segments are all there, their total length is the stated one, the framing ends as it must, and the payload
has the stated digest (md5, sha1, sha256 or sha512, in hex or base32; other digests aren't tested).

Malformed records (no or an odd length, no id, an odd segment number, an end before the stated length, bytes between
records) are left out, and reading goes on at the next record; malformed() lists them by file.

How the work is dealt: only (page_id, digest) rows are compared for copies, with counts summed map-side, so a hot payload
is one row a task; pages are shuffled once, by page_id.

Nulls and odd rows: a null html is the empty payload. A null url is written as "urn:page:" and the id. A null page_id
never is the original of others; such pages are responses. Rows that repeat a page_id each get a record of their own;
the one with the smallest id's payload stays a response for each of its rows. Further columns, of whatever name, are left
aside; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, table, write_read

REVISIT_BYTES = 100
SEGMENT_BYTES = 16384
CHUNK_BYTES = 4096
BLOCK_BYTES = 1 << 20
FILE_BLOCKS = 32
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer coding of a payload."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


class Dechunker:
    """Takes a chunked body in pieces of any size and gives its payload in pieces."""

    def __init__(self):
        self.left, self.line, self.done, self.bad = 0, b"", False, False
        self.state = "size"  # size, data, gap (the line end behind data), trailer

    def feed(self, data: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(data) and not (self.done or self.bad):
            if self.state == "data":
                piece = data[at : at + self.left]
                at += len(piece)
                self.left -= len(piece)
                if not self.left:
                    self.state = "gap"
                yield piece
                continue
            end = data.find(b"\n", at)
            self.line += data[at : end + 1] if end >= 0 else data[at:]
            at = end + 1 if end >= 0 else len(data)
            if end < 0:
                self.bad = len(self.line) > 8192
                continue
            line, self.line = self.line.strip(), b""
            if self.state == "size":
                if not re.fullmatch(rb"[0-9a-fA-F]+[ \t]*(;.*)?", line):
                    self.bad = True
                    return
                self.left = int(re.match(rb"[0-9a-fA-F]+", line)[0], 16)
                self.state = "data" if self.left else "trailer"
            elif self.state == "gap":
                self.bad, self.state = bool(line), "size"
            elif not line:  # the empty line behind the trailer
                self.done = True


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the two line ends behind it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def record_id(name: str) -> str:
    return f"<urn:page:{name}>"


def page_records(row_id: str, url: str, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page."""
    own = record_id(row_id)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        more = [("WARC-Refers-To", record_id(str(refers_to))), ("WARC-Profile", PROFILE), ("Content-Type", "application/http;msgtype=response")]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *more], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response")]
    yield record(first + [("WARC-Segment-Number", "1")] * (len(parts) > 1), parts[0])
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{row_id}:segment-{n}")), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        yield record(more + [("WARC-Segment-Total-Length", str(len(block)))] * (n == len(parts)), part)


def originals(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) for the pages that revisit another. pages: (page_id, html). The digests that repeat are written out, so adaptive execution can split the rows of a hot payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.where("page_id is not null").select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= REVISIT_BYTES).select("page_id", "digest")
    first = write_read(known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "payloads")
    return known.join(first.hint("merge"), "digest").where("page_id <> first").groupBy("page_id", "digest").agg(F.min("first").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes an archive of pages (page_id, url, html) under path."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("payload"), F.sha2(html, 256).alias("digest"))
    again = originals(pages.select("page_id", "html")).withColumnRenamed("page_id", "_id").withColumnRenamed("digest", "_digest")
    met = rows.join(again.hint("merge"), (rows.page_id == again["_id"]) & (rows.digest == again["_digest"]), "left").sortWithinPartitions("page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial, before, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns)), strict=True):
                name = "" if page_id is None else str(page_id)
                # rows come sorted by page_id: the first of a page has the plain name, which revisits refer to
                own = f"{name}:row-{task}-{serial}" if page_id in (None, before) else name
                before = page_id
                for one in page_records(own, _plain(url, name), payload.as_py(), digest, refers_to, segment_bytes):
                    held.append(one)
                    size += len(one)
                    if size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], names=["value"])
                        held, size = [], 0
                serial += 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], names=["value"])

    blocks = met.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "value binary")
    blocks.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", FILE_BLOCKS).option("compression", "gzip").text(path)


def _plain(url: str | None, name: str) -> str:
    """A URL in one header line: white space and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{name}"


#: Where a record's head may begin. No end of it is a beginning of it, so a reader can't miss one at the edge of its buffer.
START = b"\nWARC/"
#: A record that states more is malformed.
MOST_BYTES = 1 << 30


def _head(data: bytes) -> tuple[dict[str, str], int, int] | str | None:
    """Headers by lower-cased name, and where the block starts and ends; what is wrong; or None if the head isn't whole."""
    end = data.find(END)
    if end < 0:
        return None if len(data) < 1 << 20 else "no end of the head"
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,12}", length) or int(length) > MOST_BYTES:
        return f"length {length[:40]!r}"
    if not headers.get("warc-record-id"):
        return "no id"
    if not re.fullmatch("[0-9]{1,9}", headers.get("warc-segment-number", "0")) or not re.fullmatch("[0-9]{1,18}", headers.get("warc-segment-total-length", "0")):
        return "segment number"
    return headers, end + len(END), end + len(END) + int(length)


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes] | str]:
    """(headers, block) of each record of an archive, or what is wrong with it. pieces: the archive cut at every START, each without it."""
    held: list[bytes] = []  # of the record that is open
    size = need = 0  # its bytes so far and, once its head is read, in all

    def closed(last: bool) -> Iterator[tuple[dict[str, str], bytes] | str]:
        nonlocal size, need
        while held:
            data = b"WARC/" + START.join(held)
            size, need = len(data), 0
            found = _head(data)
            if found is None or (not isinstance(found, str) and found[2] > size):
                if not last:
                    need = found[2] if found else 0
                    return
                found = "the archive ends inside the record"
            if isinstance(found, str):
                yield found
                del held[0]  # what follows may begin a record
                continue
            headers, start, stop = found
            yield headers, data[start:stop]
            if data[stop:].strip(b"\r\n"):
                yield "bytes behind the record"
            held.clear()

    for n, piece in enumerate(pieces):
        if not n:
            piece = piece.lstrip(b"\r\n")
            if not piece.startswith(b"WARC/"):
                if piece.strip():
                    yield "bytes before the first record"
                continue
            piece = piece[5:]
        size += len(piece) + len(START)
        held.append(piece)
        if size - 1 >= need:
            yield from closed(False)
    yield from closed(True)


class Reader:
    """State of one response while its segments go by. stated: the digest that its payload should have, as algorithm:hex."""

    def __init__(self, stated: str | None = None):
        self.head, self.dechunk, self.length, self.payload, self.digest, self.next, self.total = b"", None, 0, 0, sha256(), 1, None
        self.algorithm, _, self.hex = (stated or "").partition(":")
        self.other = hashlib.new(self.algorithm) if self.algorithm not in ("", "sha256") else None
        self.bad = False

    def feed(self, number: int, total: int | None, block: bytes) -> Iterator[bytes]:
        """One segment; gives pieces of the payload."""
        self.bad |= number != self.next
        self.next, self.total = number + 1, total if total is not None else self.total
        self.length += len(block)
        if self.dechunk is None:
            self.head += block
            end = self.head.find(END)
            if end < 0:
                return
            head, block, self.head = self.head[:end], self.head[end + len(END) :], b""
            self.dechunk = Dechunker() if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else False
        for piece in self.dechunk.feed(block) if self.dechunk else [block]:
            self.payload += len(piece)
            self.digest.update(piece)
            if self.other:
                self.other.update(piece)
            yield piece

    def valid(self) -> bool:
        whole = self.dechunk.done and not self.dechunk.bad if self.dechunk else self.dechunk is False
        right = not self.algorithm or (self.other or self.digest).hexdigest() == self.hex
        return bool(not self.bad and whole and (self.total is None or self.total == self.length) and right)


#: Bytes of the digests that are tested.
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def digest_of(value: str | None) -> str | None:
    """A digest header's value as algorithm:lower-case hex; base32 is read too. None for what can't be tested."""
    name, _, text = (value or "").partition(":")
    name = name.lower().replace("-", "")
    n = DIGESTS.get(name, -1)
    if re.fullmatch(r"[0-9a-fA-F]+", text) and len(text) == 2 * n:
        return f"{name}:{text.lower()}"
    if re.fullmatch(r"[A-Za-z2-7]+=*", text):
        try:
            raw = base64.b32decode(text.rstrip("=").upper() + "=" * (-len(text.rstrip("=")) % 8))
        except ValueError:
            return None
        return f"{name}:{raw.hex()}" if len(raw) == n else None
    return None


SEGMENTS = "origin string, number int, total long, kind string, url string, digest string, refers_to string, block binary"
MALFORMED = "malformed"


def segments(spark, path: str) -> DataFrame:
    """One row for each response, revisit and continuation record of all archives under path, and one of kind MALFORMED (url: the file, digest: what is wrong) for each that can't be read."""
    packed = spark.read.option("pathGlobFilter", "*.gz").schema("value string").option("lineSep", START.decode()).text(path)
    packed = packed.select(F.col("_metadata.file_path").alias("file"), F.lit(False).alias("whole"), F.col("value").cast("binary").alias("content"))
    flat = spark.read.format("binaryFile").option("pathGlobFilter", "*[!z]").load(path).select(F.col("path").alias("file"), F.lit(True).alias("whole"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        rows = ((f, w, c.as_py()) for b in batches for f, w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True))
        done, size = [], 0
        for file, own in groupby(rows, key=lambda r: r[0]):
            _, whole, content = next(own)
            if whole:
                content = gzip.decompress(content) if content.startswith(b"\x1f\x8b") else content
                pieces = iter(content.split(START))
            else:
                pieces = chain([content], (c for _, _, c in own))
            for found in records(pieces):
                if isinstance(found, str):
                    done.append((None, 0, None, MALFORMED, file, found, None, None))
                    continue
                h, block = found
                kind = h.get("warc-type", "")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                total = h.get("warc-segment-total-length")
                done.append((h.get("warc-segment-origin-id", h["warc-record-id"]), int(h.get("warc-segment-number", 0)), int(total) if total else None, kind, h.get("warc-target-uri"), digest_of(h.get("warc-payload-digest")), h.get("warc-refers-to"), block))
                size += len(block)
                if size > BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                    done, size = [], 0
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    return packed.unionByName(flat).mapInArrow(run, SEGMENTS)


def malformed(spark, path: str) -> DataFrame:
    """(file, reason) for each record under path that can't be read."""
    return segments(spark, path).where(F.col("kind") == MALFORMED).select(F.col("url").alias("file"), F.col("digest").alias("reason"))


RECORDS = "origin string, kind string, url string, refers_to string, payload_bytes long, payload_digest string, valid boolean"


def reassembled(rows: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Records from segments that are sorted by origin and number; with the payload itself if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * keep_payload
        names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * keep_payload
        origin, first, reader, pieces = None, None, None, []

        def closed() -> tuple:
            kind, url, digest, refers_to, length = first
            if kind == "revisit":
                return (origin, kind, url, refers_to, length, digest and digest.partition(":")[2], digest is not None, *[None] * keep_payload)
            ok = kind == "response" and reader.valid() and (reader.next == 1 or reader.next == 2 or reader.total is not None)
            return (origin, kind, url, refers_to, reader.payload, reader.digest.hexdigest(), ok, *[b"".join(pieces)] * keep_payload)

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            done = []
            for o, number, total, kind, url, digest, refers_to, block in zip(*(c.to_pylist() if i != 7 else c for i, c in enumerate(batch.columns)), strict=True):
                if first is None or o != origin:
                    if first:
                        done.append(closed())
                    origin, reader, pieces = o, Reader(digest), []
                    length = None
                    if kind == "revisit":
                        m = re.search(rb"(?im)^content-length:\s*(\d+)", block.as_py())
                        length = int(m[1]) if m else None
                    first = (kind, url, digest, refers_to, length)
                if kind != "revisit":
                    for piece in reader.feed(max(number, 1), total, block.as_py()):
                        if keep_payload:
                            pieces.append(piece)
            if done:
                yield out(done)
        if first:
            yield out([closed()])

    return rows.mapInArrow(run, RECORDS + ", payload binary" * keep_payload)


def read_archives(spark, path: str, keep_payload: bool = False) -> DataFrame:
    """The records of all archives under path. Whole records are read where they lie; only segmented ones are shuffled."""
    rows = segments(spark, path).where(F.col("kind") != MALFORMED)
    whole = reassembled(rows.where("number = 0"), keep_payload)
    cut = rows.where("number > 0").repartition("origin").sortWithinPartitions("origin", "number")
    return whole.unionByName(reassembled(cut, keep_payload))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)", 1).try_cast("long")
    return read_archives(spark, path).select(number("origin").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"), "valid")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS o FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN o <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o <> page_id THEN o END AS refers_to, true AS valid FROM f
"""
