"""WARC archives: a de-duplicating writer and a salvage reader (operator 5).

Writing. Every page becomes one WARC/1.1 record. Of pages with equal payloads
(at least ``min_revisit_bytes`` long) the one with the largest id is a
``response``; the others are ``revisit`` records that refer to it and carry
the digest, not the payload. A two-plane Bloom filter over the payload digests
picks the pages that may repeat, so only their (digest, id) pairs shuffle and
the html never does. Spark's text writer appends the blank lines that end a
record, so archives go to any file system that Spark writes.

Reading. Archives are plain, one gzip member, or a gzip member a record. Every
record's framing and SHA-1 digests are checked. After a failed check the reader
searches for the next valid gzip member or version line, goes on there, and
logs the bytes between as a quarantined gap with its reason.

Defined cases: null html is an empty payload (empty payloads equal one
another); null urls and ids leave their header out, and a null id never becomes
the response of a group that has another; repeated rows of the largest id are
responses, all of them; line breaks in urls are percent-encoded; an empty table
gives no records; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.bloom import filter_bits, may_contain, repeated_plane
from quarry.llm.common import prepare, stash
from quarry.session import scratch_path

CRLF = "\r\n"
END = "\r\n\r\n"
ARCHIVE_BYTES = 48 << 20                 # payload bytes an archive holds, about
MAX_FILTER_BYTES = 64 << 20
MIN_REVISIT_BYTES = 0
INFLATE_STEP = 1 << 20
RECORD_DATE = "1970-01-01T00:00:00Z"     # the tables hold no fetch time

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
NO_ID = "<urn:uuid:00000000-0000-0000-0000-000000000000>"
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
BASE32HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 SHA-1: 5 hex digits are 20 bits, or 4 base32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32HEX, BASE32)


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def header(name: str, value: Column) -> Column:
    """``name: value`` line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def planned_records(pages: DataFrame, id_col: str, url_col: str, html_col: str,
                    min_revisit_bytes: int) -> tuple[DataFrame, int, int]:
    """(page_id, url, html, digest, refers_to) with refers_to set for revisits;
    the row count and the payload bytes."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    base = base.withColumn("digest", sha1_base32(F.col("html")))
    key = F.conv(F.substring(F.sha1("digest"), 1, 15), 16, 10).cast("bigint")
    narrow = stash(base.select("page_id", "digest", key.alias("key"), F.octet_length("html").cast("bigint").alias("bytes")),
                   "warc-digests")
    rows, size = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bits = filter_bits(rows, MAX_FILTER_BYTES)
    plane = repeated_plane(narrow, "key", bits)

    maybe = (narrow.filter(F.col("bytes") >= min_revisit_bytes)
             .filter(may_contain(narrow, "key", plane, bits)))
    largest = maybe.groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    tested = base.withColumn("key", key)
    tested = tested.withColumn("maybe", may_contain(tested, "key", plane, bits)
                               & (F.octet_length("html") >= min_revisit_bytes))
    alone = tested.filter(~F.col("maybe")).withColumn("refers_to", F.lit(None).cast("bigint"))
    # Only rows that may repeat meet the groups; a unique one refers to itself there.
    shared = tested.filter("maybe").join(largest, "digest")
    out = alone.unionByName(shared).withColumn(
        "refers_to", F.when(~F.equal_null("refers_to", "page_id"), F.col("refers_to")))
    return out.select("page_id", "url", "html", "digest", "refers_to"), rows, size


def record_text() -> Column:
    """One whole record but for the closing blank lines."""
    revisit = F.col("refers_to").isNotNull()
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    block = F.concat(F.lit(HTTP_HEAD), F.octet_length("html").cast("string"), F.lit(END), payload)
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", F.coalesce(record_id(F.col("page_id")), F.lit(NO_ID))),
        header("WARC-Date", F.lit(RECORD_DATE)),
        header("WARC-Target-URI", url),
        header("X-Page-ID", F.col("page_id")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        header("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF))
    return F.concat(head, header("WARC-Block-Digest", F.concat(F.lit("sha1:"), sha1_base32(block))),
                    header("Content-Length", F.octet_length(block)), F.lit(CRLF), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES,
                   compression: str = "gzip") -> None:
    """Write the archives of ``pages`` under ``path``; a file ends after about ``archive_bytes`` of payload."""
    prepare(pages.sparkSession)
    records, rows, size = planned_records(pages, id_col, url_col, html_col, min_revisit_bytes)
    each = max(1, archive_bytes * rows // max(1, size))
    (records.select(record_text().alias("value")).write.option("lineSep", END)
     .option("compression", compression).option("maxRecordsPerFile", int(min(each, 2**31))).text(path))


# --- reading ---------------------------------------------------------------

def sha1_of(data) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def members(raw: bytes) -> Iterator[tuple[int, int, bytes, str]]:
    """(start, end, data, fault) for every gzip member; a plain file is one member.

    A broken member yields what could be inflated before the fault; the search
    for the next member starts behind its first byte, and a candidate counts
    only if its first bytes inflate."""
    size = len(raw)
    if VERSION.match(raw):
        yield 0, size, raw, ""
        return
    pos = 0
    while pos < size:
        if raw[pos:pos + 3] != GZIP_MAGIC:
            nxt = next_member(raw, pos + 1)
            # Plain records between members are readable as they are.
            yield pos, nxt, raw[pos:nxt], ""
            pos = nxt
            continue
        engine, out, at, fault = zlib.decompressobj(31), [], pos, ""
        try:
            while at < size and not engine.eof:
                out.append(engine.decompress(raw[at:at + INFLATE_STEP]))
                at += INFLATE_STEP
            if not engine.eof:
                fault = "truncated member"
        except zlib.error as e:
            fault = f"bad member: {e}"
        if fault:
            end = next_member(raw, pos + 1)
        else:
            end = min(at, size) - len(engine.unused_data)
        yield pos, end, b"".join(out), fault
        pos = end


def next_member(raw: bytes, pos: int) -> int:
    while (pos := raw.find(GZIP_MAGIC, pos)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(raw[pos:pos + 4096], 64):
                return pos
        except zlib.error:
            pass
        pos += 1
    return len(raw)


def next_version(data: bytes, pos: int) -> int:
    """Start of the next version line that begins a line, or the end."""
    while (m := VERSION.search(data, pos)) is not None:
        if m.start() == 0 or data[m.start() - 1:m.start()] == b"\n":
            return m.start()
        pos = m.start() + 1
    return len(data)


def parse_record(data: bytes, pos: int) -> tuple[dict, int, int] | str:
    """(headers, block start, block end) of a record that passes all checks, or the reason it does not."""
    line = VERSION.match(data, pos)
    if not line:
        return "no version line"
    stop = data.find(b"\r\n\r\n", line.end() - 2)
    if stop < 0:
        return "headers do not end"
    head = {}
    for item in data[line.end():stop].split(b"\r\n"):
        name, colon, value = item.partition(b":")
        if not colon:
            return "bad header line"
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdecimal():
        return "no content length"
    start, end = stop + 4, stop + 4 + int(head["content-length"])
    if end > len(data):
        return "truncated record"
    if data[end:end + 4] != b"\r\n\r\n":
        return "record does not end in a blank line"
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_of(memoryview(data)[start:end]):
        return "block digest differs"
    return head, start, end


def read_bytes(raw: bytes) -> Iterator[tuple]:
    """('record', offset, end, headers, block) and ('gap', offset, end, reason, None).

    Offsets are into the file for gzip members and plain files; records of a
    member that holds several have their offset in the inflated member added."""
    for first, last, data, fault in members(raw):
        pos, gap, why = 0, None, ""
        while pos < len(data):
            found = parse_record(data, pos)
            if isinstance(found, str):
                if gap is None:
                    gap, why = pos, found
                pos = next_version(data, pos + 1)
                continue
            if gap is not None:
                yield "gap", first + gap, first + pos, why, None
                gap = None
            head, start, end = found
            yield "record", first + pos, first + end + 4, head, data[start:end]
            pos = end + 4
        if gap is not None:
            yield "gap", first + gap, first + len(data), why, None
        if fault:
            yield "gap", first, last, fault, None


READ_SCHEMA = ("status string, path string, start bigint, end bigint, reason string, record_type string, "
               "record_id string, refers_to_id string, url string, page_id bigint, payload_digest string, "
               "payload_bytes bigint, payload binary")


def read_row(path: str, item: tuple, with_payload: bool) -> tuple:
    kind, start, end, head, block = item
    if kind == "gap":
        return (kind, path, start, end, head, *[None] * 8)
    body = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
    payload = block[body:]
    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = head.get("warc-type") == "revisit"
    digest = said if revisit else sha1_of(payload)
    if not revisit and said and said != digest:
        return ("gap", path, start, end, "payload digest differs", *[None] * 8)
    page = head.get("x-page-id")
    return (kind, path, start, end, None, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-refers-to"),
            head.get("warc-target-uri"), int(page) if page else None, digest, None if revisit else len(payload),
            payload if with_payload and not revisit else None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (``status``) of every archive under ``path`` (READ_SCHEMA)."""
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in READ_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1)):
                name, raw, rows, held = name.as_py(), raw.as_py(), [], 0
                for item in read_bytes(raw):
                    rows.append(read_row(name, item, with_payload))
                    held += len(rows[-1][-1] or b"") + 300
                    if held > 16 << 20:
                        yield emit(rows)
                        rows, held = [], 0
                if rows:
                    yield emit(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, READ_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the full payload's size, and revisits with the page they refer to."""
    records = records.filter("status = 'record'")
    answers = (records.filter("record_type = 'response'").groupBy("record_id")
               .agg(F.max("page_id").alias("to_page"), F.max("payload_bytes").alias("to_bytes")))
    plain = records.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("bigint"))
    again = (records.filter("record_type = 'revisit'")
             .join(answers.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
             .withColumn("payload_bytes", F.col("to_bytes")).withColumnRenamed("to_page", "refers_to").drop("to_bytes"))
    return plain.unionByName(again)


def quarantined(records: DataFrame) -> DataFrame:
    return records.filter("status = 'gap'").select("path", "start", "end", "reason")


def round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the archives of ``pages`` to a scratch folder and read them back."""
    spark = pages.sparkSession
    prepare(spark)
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes=min_revisit_bytes)
    records = stash(read_archives(spark, path, with_payload=False).drop("payload"), "warc-records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
