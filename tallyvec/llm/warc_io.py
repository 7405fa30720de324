"""WARC 1.1 archives: one transaction (request, response or revisit, metadata) a page.

Records are built with SQL functions and written by Spark's text writer, whose line separator is the
blank lines that end a record, so the files are .warc.gz files (one gzip member a file: the text writer
can't end a member between records) in whatever store the shared folder is in.  They are read back as
streams by the text reader with the same separator and cut by Content-Length, so a task holds a record
or an Arrow batch at a time, not an archive; digests are verified.  Records of one transaction meet
again through WARC-Concurrent-To, and revisits find the response's page and payload length through
WARC-Refers-To.

Of pages with equal payloads the one with the largest page_id is the response (rows that repeat it
are responses as well), the others revisit it; null html is an empty payload; a null page_id counts
as smallest, and among null ones only all are responses; a null url gives no target; rows that repeat
come back as often.  An empty table gives an empty result.  Other columns aren't looked at.  Very
large pages take memory in proportion to their size.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, shared_dir, stage_table

RECORDS_PER_FILE = 2000
#: Bytes of payload in a batch of records.
BATCH = 4 << 20
CRLF = "\r\n"
#: Fixed values of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Base32 of the SHA-1 of a binary column: five hexadecimal digits make four base32 digits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV32, BASE32)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines, empty line and block; headers whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit(f"{CRLF}{name}: "), value) for name, value in headers]
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, *[F.coalesce(x, F.lit("")) for x in lines],
        F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block,
    )


def with_first_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html and what the records need: digest, length, record_type, refers_to.

    Where page ids of a digest repeat, copy tells its rows apart and head_copy is the copy of the one that is referred to.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("length"), F.monotonically_increasing_id().alias("row"))
    # sizes and digests are counted before any row moves; the join's large groups are dealt anew by AQE
    per_page = rows.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    heads = per_page.groupBy("digest").agg(F.max(F.struct("page_id", "first")).alias("top"), F.sum("n").alias("group_rows"), (F.max("n") > 1).alias("repeats"))
    heads = heads.select("digest", F.col("top.page_id").alias("head"), "group_rows", "repeats", F.when(F.col("repeats"), F.col("top.first")).alias("head_copy"))
    joined = rows.join(heads.withColumnRenamed("digest", "head_digest"), F.col("digest") == F.col("head_digest")).drop("head_digest").withColumn("copy", F.when(F.col("repeats"), F.col("row"))).drop("row", "repeats")
    is_head = F.col("head").isNull() | F.coalesce(F.col("page_id") == F.col("head"), F.lit(False))
    return joined.withColumn("record_type", F.when(is_head, "response").otherwise("revisit")).withColumn("refers_to", F.when(~is_head, F.col("head")))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    rows = with_first_captures(pages)
    when = F.lit(date)
    url = F.regexp_replace(F.trim("url"), r"[\s\x00-\x1f]+", "%20")
    target = F.when(F.length(url) > 0, url)
    own, asked, about = (_urn(F.lit(kind), F.col("page_id"), F.col("digest"), F.col("copy")) for kind in ("capture", "request", "metadata"))
    sha1 = F.concat(F.lit("sha1:"), F.col("digest"))
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    route = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asking = F.concat(F.lit("GET "), F.when(route == "", F.lit("/")).otherwise(route), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("length").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("record_type") == "revisit"
    request = _record("request", [("WARC-Record-ID", asked), ("WARC-Date", when), ("WARC-Target-URI", target), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))], asking)
    response = _record(F.col("record_type"), [
        ("WARC-Record-ID", own), ("WARC-Date", when), ("WARC-Target-URI", target), ("WARC-Payload-Digest", sha1),
        ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))), ("WARC-Refers-To", F.when(revisit, _urn(F.lit("capture"), F.col("refers_to"), F.col("digest"), F.col("head_copy")))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    ], F.when(revisit, head).otherwise(F.concat(head, F.col("html"))))
    notes = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record("metadata", [("WARC-Record-ID", about), ("WARC-Date", when), ("WARC-Target-URI", target), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], notes)
    text = F.concat_ws(CRLF + CRLF, request, response, metadata)
    rows.select(text.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORD = "kind string, record_id string, concurrent_to string, target string, digest string, refers_to string, page_id bigint, length bigint, payload binary"


def split_records(segments):
    """(headers, block) of each record of a stream that comes in pieces between blank lines; headers have lower-case names.

    A piece may end inside a block that has blank lines itself, or begin with line ends that such a
    block left: what counts is Content-Length.
    """
    held, size, need, headers = [], 0, None, None

    def header(data: bytes):
        lines = data.decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    for segment in segments:
        if headers is None:
            segment = segment.lstrip(b"\r\n")
            if not segment:
                continue
            headers = header(segment)
            need, held, size = int(headers["content-length"]), [], 0
            continue
        held += [segment, b"\r\n\r\n"]
        size += len(segment) + 4
        if size >= need:
            data = b"".join(held)
            if data[need:].strip(b"\r\n"):
                raise ValueError(f"{headers.get('warc-record-id')} is longer than it says")
            yield headers, data[:need]
            headers = None
    if headers is not None:
        data = b"".join(held)
        if len(data) < need:
            raise ValueError(f"{headers.get('warc-record-id')} is cut short")
        yield headers, data[:need]


def _row(h: dict, block: bytes, keep_payload: bool) -> tuple:
    kind, payload, digest, length, page = h["warc-type"], None, None, None, None
    if kind in ("response", "revisit"):
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload of {h['warc-record-id']} doesn't match its digest")
            length = len(payload)
    elif kind == "metadata":
        d = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if ": " in x)
        page = int(d["pageId"]) if d.get("pageId") else None
    return kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-target-uri"), digest, h.get("warc-refers-to"), page, length, payload if keep_payload else None


def read_records(spark, path: str, keep_payload: bool = True) -> DataFrame:
    """A row a record; payloads that don't match their digest are errors."""
    schema = pa.schema([*[(n, pa.string()) for n in ("kind", "record_id", "concurrent_to", "target", "digest", "refers_to")], ("page_id", pa.int64()), ("length", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        rows, size = [], 0
        for h, block in split_records(x for b in batches for x in b.column(0).cast(pa.binary()).to_pylist()):
            rows.append(_row(h, block, keep_payload))
            size += len(block) if keep_payload else 100
            if size > BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # compressed files aren't split, and a task reads its files one after the other
    return spark.read.option("lineSep", CRLF + CRLF).option("pathGlobFilter", "part-*").text(path).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its request, response (or revisit) and metadata, joined through concurrent-to.

    A record that names no other is its own capture; each page row has record ids of its own.
    """
    body = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    kind = F.col("kind")
    groups = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id")).groupBy("capture_id")
    pick = lambda test: F.max(F.when(test, body))
    return groups.agg(pick(kind == "request").alias("request"), pick(kind.isin("response", "revisit")).alias("response"), pick(kind == "metadata").alias("metadata"))


def resolve(captures: DataFrame) -> DataFrame:
    """captures (a written table) with page_id, payload_length and refers_to, the page of the response that a revisit names.

    A revisit whose response is in no archive has neither length nor page.
    """
    response = F.col("response.kind") == "response"
    own = captures.withColumn("page_id", F.col("metadata.page_id"))
    heads = own.filter(response).select(F.col("response.record_id").alias("__head"), F.col("page_id").alias("refers_to"), F.col("response.length").alias("payload_length"))
    whole = own.filter(response).withColumns({"refers_to": F.lit(None).cast("bigint"), "payload_length": F.col("response.length")})
    again = own.filter(~F.coalesce(response, F.lit(False))).join(heads, F.col("response.refers_to") == F.col("__head"), "left").drop("__head")
    return whole.unionByName(again)


def round_trip(pages: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Write archives of pages into the shared folder, read them back, assemble the captures and resolve the revisits."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/tallyvec/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    with batch_rows(spark, 10_000):
        captures = stage_table(assemble(read_records(spark, path, keep_payload)), "captures")
    return resolve(captures)
