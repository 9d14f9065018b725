"""WARC archives: written with segments and revisits, read back and reassembled.

`write` makes real archive files (gzip members of whole files) in the shared
folder.  A page is an HTTP response in chunked transfer framing; a block over
the segment limit is cut into a first record and continuation records.  `read`
parses the files, groups the segments of an origin identifier, orders them by
segment number, verifies the total length and decodes the chunk framing.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import scratch

SEGMENT = 16_384  #: bytes of a record's block
RECORDS_PER_FILE = 1_024
CHUNK = 4_096
REVISIT_FROM = 100  #: payloads of fewer bytes are always stored
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n"
_BLOCK_END = b"\r\n\r\n"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Decodes chunked transfer framing; chunk extensions and trailers are allowed."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record_id(page: int | None, segment: int = 1, row: str = "0") -> str:
    """An identifier of a page's row; a null page has the identifier of no page."""
    low = "none" if page is None else f"{page & (1 << 64) - 1:016x}"
    return f"<urn:page:{low}:{row}:{segment}>"


def page_of(identifier: str) -> int | None:
    found = re.fullmatch(r"<urn:page:([0-9a-f]{16}):[0-9a-f]+:\d+>", identifier)
    if not found:
        return None
    n = int(found[1], 16)
    return n - (1 << 64) if n >> 63 else n


def _record(fields: dict, block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def records(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, sole: bool, segment: int = SEGMENT):
    """The records of one page, each without the blank lines that end it.

    Each row has identifiers of its own.  That of a row to which revisits refer
    follows from page and digest if it is the `sole` row with both; if several
    rows have both, revisits name page and digest, and no record.
    """
    base = {"WARC-Target-URI": _uri(url), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Payload-Length": len(payload)}
    row = digest if sole and not revisit else uuid.uuid4().hex
    mine = record_id(page, row=row)
    if revisit:
        yield _record({"WARC-Type": "revisit", "WARC-Record-ID": mine, **base, "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, row=digest) if sole else None, "WARC-Refers-To-Page": refers_to, "Content-Type": "application/http;msgtype=response"}, HTTP + b"\r\n")
        return
    block = HTTP + b"\r\n" + chunked(payload)
    kind = {"WARC-Type": "response", "WARC-Record-ID": mine, **base, "Content-Type": "application/http;msgtype=response"}
    if len(block) <= segment:
        yield _record(kind, block)
        return
    last = -(-len(block) // segment)
    for k in range(1, last + 1):
        part = block[(k - 1) * segment : k * segment]
        total = len(block) if k == last else None
        if k == 1:
            yield _record(kind | {"WARC-Segment-Number": 1}, part)
        else:
            yield _record({"WARC-Type": "continuation", "WARC-Record-ID": record_id(page, k, row), "WARC-Date": base["WARC-Date"], "WARC-Segment-Number": k, "WARC-Segment-Origin-ID": mine, "WARC-Segment-Total-Length": total}, part)


def parse(archive: bytes):
    """(header fields with lower-case names, block) of each record."""
    at = 0
    while at < len(archive):
        end = archive.index(_BLOCK_END, at)
        lines = archive[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC record begins here")
        fields = {}
        for line in lines[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode()] = v.strip().decode()
        n = int(fields["content-length"])
        start = end + 4
        if archive[start + n : start + n + 4] != _BLOCK_END:
            raise ValueError("a record does not end where its length says")
        yield fields, archive[start : start + n]
        at = start + n + 4


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with their digest, the page that a revisit refers to, and whether one row alone holds that page with this digest.

    The first page of a digest is found by partial sums before the shuffle, and
    only that small side is hashed; a digest shared by a third of all pages is
    a skewed partition of the large side, which adaptive execution splits.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    each = base.where(F.octet_length("payload") >= REVISIT_FROM).groupBy(F.col("digest").alias("of"), "page_id").agg(F.count("*").alias("rows"))
    first = each.groupBy("of").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "rows"))).alias("least"), F.sum("rows").alias("n"))
    first = first.select("of", F.col("least.page_id").alias("first"), (F.col("least.rows") == 1).alias("sole"), "n")
    joined = base.join(first.where("n > 1").hint("shuffle_hash"), F.col("digest") == F.col("of"), "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= REVISIT_FROM)
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"), other.alias("revisit"), F.coalesce("sole", F.lit(False)).alias("sole"))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT) -> str:
    """Writes the archives and returns their folder.

    Null html is an empty payload; a null url leaves out its field; control
    characters in a url are percent-encoded.  Of rows that share the smallest
    page_id all are stored.  Rows with a null page_id are kept, and refer to
    the smallest known page of their payload, if there is one.
    """

    def go(batches):
        for batch in batches:
            out, held = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit", "sole")), strict=True):
                for r in records(*row, segment=segment):
                    out.append(r)
                    held += len(r)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    folder = scratch(pages.sparkSession, "warc")
    made = plan(pages, id_col, url_col, html_col).mapInArrow(go, "record binary")
    # The text sink writes the bytes of each row and then the separator: the blank lines that end a record.
    made.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)
    return folder


_PARSED = "origin string, number int, total long, type string, refers_to long, digest string, declared long, bytes long, block binary"


def _parsed(batches):
    for batch in batches:
        for content in batch.column("content"):
            out = []
            for f, block in parse(gzip.decompress(content.as_py())):
                number = int(f.get("warc-segment-number", 0))
                kind = f["warc-type"]
                digest, size = (f.get("warc-payload-digest") or "").removeprefix("sha256:"), f.get("warc-payload-length")
                if not number:  # whole: only its digest has to travel
                    payload = dechunked(block.partition(_BLOCK_END)[2]) if kind == "response" else None
                    if payload is not None:
                        digest, size, block = hashlib.sha256(payload).hexdigest(), len(payload), None
                    else:
                        block = None
                out.append((f.get("warc-segment-origin-id") or f["warc-record-id"], number, f.get("warc-segment-total-length"), kind, f.get("warc-refers-to-page"), digest, size, block))
            origin, number, total, kind, refers, digest, size, block = zip(*out, strict=True) if out else [()] * 8
            integers = lambda x: pa.array([None if v is None else int(v) for v in x], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(origin, pa.string()), pa.array(number, pa.int32()), integers(total), pa.array(kind, pa.string()), integers(refers), pa.array(digest, pa.string()), integers(size), pa.array([len(b or b"") for b in block], pa.int64()), pa.array(block, pa.binary())],
                ["origin", "number", "total", "type", "refers_to", "digest", "declared", "bytes", "block"],
            )


def reassemble(segments: list[dict]) -> tuple[dict, bytes, bool]:
    """(first segment, payload, complete) of the segments of one origin."""
    segments = sorted(segments, key=lambda s: s["number"])
    block = b"".join(s["block"] for s in segments)
    whole = [s["number"] for s in segments] == list(range(1, len(segments) + 1)) and segments[-1]["total"] == len(block)
    return segments[0], dechunked(block.partition(_BLOCK_END)[2]) if whole else block, whole


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per archived page: digests of its payload, its type, and whether all segments were there.

    A segmented page is whole if its numbers run from 1 without gap and the
    last one's total length is the length of all blocks; else `complete` is
    false and the digest is that of the bytes that are there.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    parsed = files.mapInArrow(_parsed, _PARSED)
    grouped = parsed.groupBy("origin", F.when(F.col("number") == 0, F.monotonically_increasing_id()).alias("own")).agg(F.collect_list(F.struct("number", "total", "type", "refers_to", "digest", "declared", "bytes", "block")).alias("segments"))

    def go(batches):
        for batch in batches:
            out = []
            for origin, segments in zip(batch.column("origin").to_pylist(), batch.column("segments").to_pylist(), strict=True):
                s, whole = segments[0], True
                if s["number"]:
                    s, payload, whole = reassemble(segments)
                    s |= {"declared": len(payload), "digest": hashlib.sha256(payload).hexdigest()}
                out.append((page_of(origin), s["declared"], s["digest"], s["type"], s["refers_to"], len(segments), whole))
            columns = zip(*out, strict=True) if out else [()] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", "complete"])

    return grouped.select("origin", "segments").mapInArrow(go, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments int, complete boolean")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives the pages and reads the archives back.

    An empty table gives an empty one; repeated rows give a record each.
    """
    return read(pages.sparkSession, write(pages, id_col, url_col, html_col))


__all__ = ["chunked", "dechunked", "parse", "plan", "read", "reassemble", "records", "round_trip", "write"]
