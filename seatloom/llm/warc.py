"""Operator 3, WARC: write archives with revisit and continuation records, read them back, reassemble segments.

Archives are written by Spark's text writer, one record a line with the record end as line
separator, so they land in any file system that Spark knows and only committed tasks leave files.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, map_arrow, materialize, work_path

RECORD_END = "\r\n\r\n"
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_FILE = 1000
REVISIT_LEAST_BYTES = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_LINE_BREAKS = re.compile(r"[\r\n]+")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in HTTP/1.1 chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(data: bytes) -> bytes:
    """The payload of chunked transfer framing, chunk extensions and trailers ignored. ValueError if it is broken."""
    parts, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line without end")
        size = int(data[at:end].split(b";")[0].strip() or b"?", 16)
        if size == 0:
            return b"".join(parts)
        part = data[end + 2 : end + 2 + size]
        if len(part) < size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk shorter than its size line says")
        parts.append(part)
        at = end + 4 + size


def _record(kind: str, record_id: str, block: bytes, **fields: object) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", **{k.replace("_", "-"): v for k, v in fields.items() if v is not None}, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def page_records(pages: DataFrame) -> DataFrame:
    """Decide each page's record: (page_id, url, payload, payload_bytes, payload_digest, refers_to).

    pages: page_id, url, html. Of pages with equal payloads of at least 100 bytes, refers_to is the
    smallest page_id for the others, else null. A page without an id is one of the others; where no
    page of a payload has an id, none can be referred to and refers_to is null for all. Rows that
    repeat the smallest page_id with the same payload are that same page: all are responses. The first
    page of a payload is found by a minimum with partial sums, and the join back reads digests only,
    so a payload that very many pages share costs one small row each.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    keys = rows.where(F.col("payload_bytes") >= REVISIT_LEAST_BYTES).select("page_id", "payload_digest")
    firsts = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select(F.col("payload_digest").alias("d"), "first_id")
    # Only the pages that revisit are named by this join: few rows meet the payloads afterwards.
    revisits = keys.join(firsts, keys.payload_digest == firsts.d).where("not page_id <=> first_id").select(F.col("page_id").alias("p"), "d", "first_id").distinct()
    return rows.join(revisits, rows.page_id.eqNullSafe(revisits.p) & (rows.payload_digest == revisits.d), "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.col("first_id").alias("refers_to"))


def write_archives(records: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write page_records() as gzipped WARC files at path.

    A response's block is an HTTP head and the payload in chunked framing. A block longer than
    segment_bytes is cut: the response is segment 1, the rest are continuation records that name it
    in WARC-Segment-Origin-ID, the last one with WARC-Segment-Total-Length. A revisit record has the
    HTTP head alone. No record exceeds segment_bytes by more than its head, and a file has at most
    RECORDS_PER_FILE records, which bounds what a reader holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for page, url, payload, size, digest, first in zip(*(batch.column(i) for i in range(6)), strict=True):
                page, url, payload, digest, first = page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), first.as_py()
                n += 1
                name = f"urn:page:{page}:{task}-{n}"
                fields = {"WARC_Date": "1970-01-01T00:00:00Z", "WARC_Target_URI": _LINE_BREAKS.sub("", url) if url is not None else None, "WARC_Payload_Digest": f"sha256:{digest}", "Content_Type": "application/http; msgtype=response"}
                if first is not None:
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size.as_py()
                    out = [_record("revisit", name, head, **fields, WARC_Profile=REVISIT_PROFILE, WARC_Refers_To=f"<urn:page:{first}>")]
                else:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
                    if len(block) <= segment_bytes:
                        out = [_record("response", name, block, **fields)]
                    else:
                        out = [_record("response", name, block[:segment_bytes], **fields, WARC_Segment_Number=1)]
                        starts = range(segment_bytes, len(block), segment_bytes)
                        for k, at in enumerate(starts, 2):
                            total = len(block) if k == len(starts) + 1 else None
                            out.append(_record("continuation", f"{name}:{k}", block[at : at + segment_bytes], WARC_Date=fields["WARC_Date"], WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        give_back()

    lines = records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one WARC file: headers with lower-case names, and the block. ValueError if it is cut off."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in data[at:end].decode().split("\r\n")[1:]))
        start, size = end + 4, int(head["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        yield head, data[start : start + size]
        at = start + size + 4


RECORD_SCHEMA = "origin string, segment int, total long, kind string, digest string, refers_to string, block binary"


def decode_capture(kind: str, digest: str | None, block: bytes | None, complete: bool) -> tuple[bytes | None, int | None, str | None, bool]:
    """(payload, payload_bytes, payload_digest, intact) of an HTTP block, as http_payloads() says."""
    head, _, body = (block or b"").partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    if kind == "revisit":
        size = fields.get(b"content-length", b"")
        return None, int(size) if size.isdigit() else None, digest, complete and size.isdigit()
    try:
        payload = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    except ValueError:
        complete = False
    if not complete:
        return None, None, None, False
    found = hashlib.sha256(payload).hexdigest()
    return payload, len(payload), found, digest in (None, found)


def _read(spark: SparkSession, path: str, schema: str, shape: Callable[[tuple], tuple]) -> DataFrame:
    """A row of schema for each WARC record below path, made by shape from its RECORD_SCHEMA row. A worker holds one file at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow, strict=True)], schema=arrow)
        for batch in batches:
            for file in batch.column(0):
                rows, size = [], 0
                for head, block in parse_records(gzip.decompress(file.as_py())):
                    strip = lambda k, head=head: head[k].strip("<>") if k in head else None
                    number = lambda k, head=head: int(head[k]) if k in head else None
                    record = (strip("warc-segment-origin-id") or strip("warc-record-id"), number("warc-segment-number"), number("warc-segment-total-length"), head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha256:") or None, strip("warc-refers-to"), block)
                    rows.append(shape(record))
                    size += len(block)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)
                rows = block = record = None
                give_back()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, struct)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record below path, segmented or not: origin, segment, total, kind, digest, refers_to, block."""
    return _read(spark, path, RECORD_SCHEMA, lambda record: record)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per capture below path: origin, kind, refers_to, payload_bytes, payload_digest, intact.

    Archives are read once: records that are a whole capture are decoded as they are parsed, and only
    segments travel with their blocks, to be reassembled.
    """

    def shape(record: tuple) -> tuple:
        origin, segment, total, kind, digest, refers_to, block = record
        return (*record, None, None, None) if segment is not None else (origin, None, None, kind, digest, refers_to, None, *decode_capture(kind, digest, block, True)[1:])

    mixed = materialize(_read(spark, path, f"{RECORD_SCHEMA}, payload_bytes long, payload_digest string, intact boolean", shape), "records")
    columns = ("origin", "kind", "refers_to", "payload_bytes", "payload_digest", "intact")
    joined = http_payloads(reassemble(mixed.where("segment is not null"))).select(*columns)
    return mixed.where("segment is null").select(*columns).unionByName(joined)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole blocks from segments: (origin, kind, digest, refers_to, block, complete).

    Segments are grouped by origin identifier and put in order of segment number, a repeated segment
    counting once. complete is false where a number is missing or the joined length isn't the total
    length that the last segment states. Records without a segment number pass through unshuffled.
    A group is one capture, so its size is bounded by the largest page.
    """
    whole = records.where("segment is null").select("origin", "kind", "digest", "refers_to", "block", F.lit(True).alias("complete"))
    parts = records.where("segment is not null").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", F.col("block").cast("string").alias("block")))).alias("s"),
        F.max("total").alias("total"), F.max(F.when(F.col("segment") == 1, F.col("kind"))).alias("kind"), F.max("digest").alias("digest"), F.max("refers_to").alias("refers_to"))
    once = F.expr("filter(s, (x, i) -> i = 0 or x.segment <> s[i - 1].segment)")
    joined = parts.withColumn("s", once).select("origin", "kind", "digest", "refers_to", F.expr("array_join(s.block, '')").cast("binary").alias("block"), "total", F.expr("s.segment = sequence(1, size(s))").alias("dense"))
    return whole.unionByName(joined.select("origin", "kind", "digest", "refers_to", "block", F.coalesce(F.col("dense") & (F.octet_length("block") == F.col("total")), F.lit(False)).alias("complete")))


def http_payloads(blocks: DataFrame) -> DataFrame:
    """Payloads of HTTP blocks: (origin, kind, refers_to, payload, payload_bytes, payload_digest, intact).

    Chunked framing is decoded. A revisit has no payload of its own: its length and digest are those
    its record states. intact is false for an incomplete block, broken framing, or a payload whose
    SHA-256 isn't the recorded one; such a payload is null.
    """

    def make():
        def run(part: pa.RecordBatch) -> dict:
            rows = [decode_capture(*row) for row in zip(*(part.column(i).to_pylist() for i in (1, 3, 4, 5)), strict=True)]
            names = ("payload", "payload_bytes", "payload_digest", "intact")
            return {"origin": part.column(0), "kind": part.column(1), "refers_to": part.column(2)} | dict(zip(names, map(list, zip(*rows)), strict=True))

        return run

    return map_arrow(blocks.select("origin", "kind", "refers_to", "digest", "block", "complete"), make, "origin string, kind string, refers_to string, payload binary, payload_bytes long, payload_digest string, intact boolean")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Give each revisit the length and digest of the response that it refers to.

    captures: page_id, kind, refers_to, payload_bytes, payload_digest, intact, of responses as read and
    of revisits as their records state. A revisit is intact if a whole response of that page has the
    digest and length that its record states; else both are null. Rows are small, and the responses
    are written, so that the revisits of one page can be split among tasks.
    """
    whole = captures.where("kind = 'response' and intact").select(F.col("page_id").alias("origin_page"), F.col("payload_digest").alias("origin_digest"), F.col("payload_bytes").alias("origin_bytes")).distinct()
    whole = materialize(whole, "responses")
    found = captures.join(whole, (captures.kind == "revisit") & (captures.refers_to == whole.origin_page) & (captures.payload_digest == whole.origin_digest), "left")
    own = F.col("kind") != "revisit"
    agreed = F.coalesce(F.col("intact") & (F.col("payload_bytes") == F.col("origin_bytes")), F.lit(False))
    return found.withColumns({"payload_bytes": F.when(own, F.col("payload_bytes")).when(agreed, F.col("origin_bytes")), "payload_digest": F.when(own, F.col("payload_digest")).when(agreed, F.col("origin_digest")), "intact": F.when(own, F.col("intact")).otherwise(agreed)}).drop("origin_page", "origin_digest", "origin_bytes")


def roundtrip(pages: DataFrame) -> DataFrame:
    """Write pages as WARC, read them back: (page_id, kind, refers_to, payload_bytes, payload_digest, intact) of every page.

    Ids come from the records' identifiers, a null one as null. Revisits are resolved.
    """
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_archives(page_records(pages), path)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)", 1)
    cast = lambda c: F.when(number(c) != "", number(c).cast("long"))
    read = read_captures(spark, path)
    return resolve_revisits(materialize(read.select(cast("origin").alias("page_id"), "kind", cast("refers_to").alias("refers_to"), "payload_bytes", "payload_digest", "intact"), "captures"))
