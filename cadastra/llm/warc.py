"""WARC: pages are written as segmented WARC records and put together again on reading.

Writing: a payload is framed as a chunked HTTP response; a block above SEGMENT bytes becomes a first segment and `continuation`
records that name it in WARC-Segment-Origin-ID. A page whose payload another page holds as a `response` becomes a
`revisit` record without a block. Archives are the text sink's gzip files with WARC's own record end as line
separator, of about FILE bytes and MOST records of one segment at most, so that a file is small enough to be read as one row.

Reading: files are parsed record by record by Content-Length; only the records of segmented pages are shuffled, by origin
identifier. Their segments are ordered by number, the total length is verified, and the chunked framing is decoded.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import cut, new_path

SEGMENT, CHUNK = 32768, 8192
#: Bytes of an archive file on average, and the records of one at least and at most (a record is a segment and its head at most).
FILE, LEAST, MOST = 16_000_000, 256, 2048
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def pieces(data: bytes, most: int) -> Iterator[bytes]:
    """data in parts of at most `most` bytes, none of which begins inside a UTF-8 character."""
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, most: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in pieces(payload, most)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk's length doesn't hold")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.md5(f"{page_id} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _head(kind: str, own: str, page_id: int | None, url: str | None, length: int, *more: str) -> bytes:
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", "WARC-Date: 2024-01-01T00:00:00Z", *([f"WARC-Target-URI: {uri}"] if uri else []), *([f"WARC-Page-ID: {page_id}"] if page_id is not None else []), *more, f"Content-Length: {length}"]
    return ("\r\n".join(lines) + END).encode()


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The page's WARC records without their ends."""
    digest = base32_sha1(payload)
    own, said = record_id(page_id, digest), f"WARC-Payload-Digest: sha1:{digest}"
    if refers_to is not None:
        yield _head("revisit", own, page_id, url, 0, said, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}")
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        yield _head("response", own, page_id, url, len(block), said, "Content-Type: application/http; msgtype=response") + block
        return
    parts = list(pieces(block, segment))
    yield _head("response", own, page_id, url, len(parts[0]), said, "Content-Type: application/http; msgtype=response", "WARC-Segment-Number: 1") + parts[0]
    for k, x in enumerate(parts[1:], 2):
        part_id = record_id(page_id, f"{digest} {k}")
        total = [f"WARC-Segment-Total-Length: {len(block)}"] if k == len(parts) else []
        yield _head("continuation", part_id, page_id, url, len(x), f"WARC-Segment-Origin-ID: {own}", f"WARC-Segment-Number: {k}", *total) + x


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, held = [], 0
        for page, url, html, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            for x in page_records(page, url, html or b"", refers):
                out.append(x)
                held += len(x)
            if held > 8_000_000:
                yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
                out, held = [], 0
        yield pa.record_batch([pa.array(out, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write the pages' records under path. Of pages with equal payloads of at least `least` bytes the largest page_id is the response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("_sha", F.unhex(F.sha1("html")))
    mean = rows.agg(F.avg(F.least(F.octet_length("html"), F.lit(SEGMENT)))).first()[0] or 0
    known = rows.filter(F.octet_length("html") >= least).select("page_id", "_sha")
    top = known.groupBy("_sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).filter("_n > 1")
    again = known.join(top, "_sha").filter("page_id < refers_to or page_id is null and refers_to is not null").select("page_id", "_sha", "refers_to").distinct()
    # Written first, so that Spark knows its size: it is broadcast where it is small, and else joined by a shuffle.
    again = cut(again, "warc-revisits").withColumnsRenamed({"page_id": "_page", "_sha": "_digest"})
    out = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_sha") == F.col("_digest")), "left").select("page_id", "url", "html", "refers_to")
    records = out.mapInArrow(_write, "record binary").select(F.col("record").cast("string"))
    records.write.option("maxRecordsPerFile", min(MOST, max(LEAST, int(FILE // (mean + 500))))).text(path, lineSep=END, compression="gzip")


RECORD = "kind string, id string, page_id long, origin string, number int, total long, refers_to string, digest string, block binary"


def unpacked(data: bytes, step: int = 1 << 16) -> bytes:
    """An archive's bytes: of gzip files all members one after the other, of others as they are. ValueError where a member is cut off."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            out.append(member.decompress(data[at : at + step]))
            at = min(at + step, len(data)) - len(member.unused_data)
    return b"".join(out)


def payload_of(block: bytes) -> bytes:
    """The payload of a response's block: what follows its HTTP head, with the framing taken off where the head says so; all of a block without a head."""
    if not block.startswith(b"HTTP/"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    fields = (x.partition(b":") for x in head.lower().split(b"\r\n")[1:])
    framed = any(k.strip() == b"transfer-encoding" and v.strip().endswith(b"chunked") for k, _, v in fields)
    return dechunked(body) if framed else body


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive, as in RECORD; ValueError where the archive is cut off."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record's length doesn't hold")
        at = end + 8 + n
        long = lambda k: int(head[k]) if k in head else None  # noqa: E731, B023
        own, digest = head["warc-record-id"], head.get("warc-payload-digest", "")
        yield head["warc-type"], own, long("warc-page-id"), head.get("warc-segment-origin-id", own), long("warc-segment-number"), long("warc-segment-total-length"), head.get("warc-refers-to"), digest[5:].upper() if digest.lower().startswith("sha1:") else "", block


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    for b in batches:
        for x in b.column(0):
            rows, held = [], 0
            for r in parse(unpacked(x.as_py())):
                rows.append(r)
                held += len(r[-1])
                if held > 8_000_000:
                    yield _batch(rows, names, kinds)
                    rows, held = [], 0
            yield _batch(rows, names, kinds)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, page_id, copies, digest and block, the last a list of segments in order, to the verified payload's size and digest."""
    for b in batches:
        rows = []
        for own, page, copies, total, digest, parts in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            block = b"".join(parts)
            if total is not None and len(block) != total:
                raise ValueError(f"{own}: segments have {len(block)} bytes of {total}")
            payload = payload_of(block)
            made = base32_sha1(payload)
            if digest and made != digest:
                raise ValueError(f"{own}: the payload doesn't have the digest that the record names")
            rows.append((own, page, copies, len(payload), made))
        yield _batch(rows, ["id", "page_id", "copies", "payload_bytes", "payload_digest"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page under path: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Segments of one page are grouped by origin identifier; a segment that is there more than once, since its page was,
    counts once in the payload and each time as a page. Broken lengths, framing or digests raise an error. Archives may be others than
    write_archives makes: gzip files with any number of members or plain ones, bodies without chunks, records without a page number (null) or
    with digests of another kind (not checked), revisits of records that aren't there (null sizes and digests).
    """
    records = cut(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, RECORD), "warc-records")
    whole = records.filter("kind = 'response' and number is null").select("id", "page_id", F.lit(1).cast("long").alias("copies"), F.lit(None).cast("long").alias("total"), "digest", F.array("block").alias("parts"))
    parts = records.filter("number is not null").groupBy("origin", "number").agg(F.count("*").alias("n"), F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("block").alias("block"))
    parts = parts.groupBy("origin").agg(F.max("page_id").alias("page_id"), F.min("n").alias("copies"), F.max("total").alias("total"), F.max("digest").alias("digest"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("p"))
    parts = parts.select(F.col("origin").alias("id"), "page_id", "copies", "total", "digest", F.transform("p", lambda x: x["block"]).alias("parts"))
    found = whole.unionByName(parts).mapInArrow(_payloads, "id string, page_id long, copies long, payload_bytes long, payload_digest string")
    found = cut(found, "warc-responses")
    repeated = found.filter("copies > 1").select(*found.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    responses = found.filter("copies = 1").unionByName(repeated.select(*found.columns))
    responses = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    ids = found.groupBy("id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    again = records.filter("kind = 'revisit'").select("page_id", F.col("refers_to").alias("id"))
    again = again.join(ids, "id", "left").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return responses.unionByName(again)


def warc_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back; see read_archives.

    Null html is an empty payload, which is deduplicated as any other. A null page_id counts as smaller than any; pages without
    one whose payload no numbered page has are all responses. Payloads of any length are written in segments. Rows that repeat page_id and payload get the same
    kind of record each. An empty table gives an empty result; columns besides page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least)
    return read_archives(spark, path)
