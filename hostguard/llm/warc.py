"""Web archives: pages to records, records to files, and files back to one nested row per capture.

A capture is three records: the request, the response (or a revisit, if an earlier record has the same payload) and
its metadata. Request and metadata name the response's id in ``WARC-Concurrent-To``.

Files are written and read by Spark's text source, so any store that Spark reaches will do. A record ends with two
line ends, which the writer puts there as its line separator; the reader separates at the two line ends before the next
``WARC/1.1``. A payload may hold that very string, so pieces are joined again until the declared ``Content-Length``
is reached: one file is read by one task in order, holding one record at a time.

Payloads are the pages' texts in UTF-8, a null page is empty. Of equal payloads of at least ``least_bytes`` the row
with the smallest page_id is the response and the others revisit it; shorter ones are all responses. Digests are
grouped with partial minima, so a payload that a third of all pages share costs one row per task.

Edge cases: rows that share a page_id are separate captures; of equal payloads under one page_id the first row is the
response. A null page_id is written without its header and comes last among equals. A null url is an empty target.
An empty table writes an empty archive, which reads as no captures. A record that the end of its file cuts off is read
as one of type ``truncated`` with what there is of its block; the records before it stay. An HTTP head may be of any
length; a block without a blank line is all head. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostguard.llm.common import in_tasks, small
from hostguard.session import Scratch

VERSION = "WARC/1.1"
LINE = "\r\n"
ENDING = LINE * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# The type given to a record that the end of its file cuts off.
TRUNCATED = "truncated"

HEADERS = {
    "record_id": "WARC-Record-ID",
    "type": "WARC-Type",
    "date": "WARC-Date",
    "target": "WARC-Target-URI",
    "concurrent_to": "WARC-Concurrent-To",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
RECORD = ", ".join(f"{name} string" for name in HEADERS) + ", block binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five bytes at a time are eight digits to the base 32, given other names."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(row: Column, kind: str) -> Column:
    """A URN made from the row number, so that a task that runs again writes the same records."""
    digest = F.md5(F.concat_ws(":", F.lit(kind), row).cast("binary"))
    cut = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """One record as text; a header whose value is null is left out."""
    lines = [F.lit(VERSION)]
    for name, value in headers:
        lines.append(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(LINE, *lines), F.lit(ENDING), block)


def write_archives(pages: DataFrame, path: str, scratch: Scratch, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the captures of ``pages`` (page_id, url, html) to gzip files below ``path``, one per task."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]+", "%0A").alias("url"),
        html.alias("html"),
        base32_sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).cast("bigint").alias("size"),
    )
    rows = scratch.keep(rows)
    order = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row")
    equal = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    # Only payloads that occur twice are looked up, and only (row, first row) is shuffled for them, never a payload.
    shared = scratch.keep(equal.filter("n > 1").select("digest", F.col("first.row").alias("first_row")))
    copies = rows.select("row", "digest", "size").filter(F.col("size") >= least_bytes).join(small(shared), "digest")
    copies = scratch.keep(copies.filter("row <> first_row").select(F.col("row").alias("copy"), "first_row"))
    planned = rows.join(small(copies), F.col("row") == F.col("copy"), "left")

    revisit = F.col("first_row").isNotNull()
    own = record_id(F.col("row"), "response")
    path_part = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), path_part, F.lit(" HTTP/1.1" + LINE + "Host: "), host, F.lit(ENDING))
    answer = F.concat(
        F.lit("HTTP/1.1 200 OK" + LINE + "Content-Type: text/html; charset=utf-8" + LINE + "Content-Length: "),
        F.col("size").cast("string"),
        F.lit(ENDING),
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    fields = F.concat_ws(LINE, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.lit("softwareInfo: hostguard"))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    records = F.array(
        _record(
            [("WARC-Type", "request"), ("WARC-Record-ID", record_id(F.col("row"), "request")), *common]
            + [("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")],
            asked,
        ),
        _record(
            [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", own), *common]
            + [("WARC-Refers-To", F.when(revisit, record_id(F.col("first_row"), "response")))]
            + [("WARC-Profile", F.when(revisit, F.lit(f"{PROFILE}")))]
            + [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
            + [("Content-Type", "application/http; msgtype=response")],
            answer,
        ),
        _record(
            [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(F.col("row"), "metadata")), *common]
            + [("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")],
            fields,
        ),
    )
    texts = planned.select(F.explode(records).alias("value"))
    texts.write.option("lineSep", ENDING).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    scratch.drop(rows, shared, copies)


def _headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank continues the field before."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split(LINE):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Whole records from the pieces of one or more files in order."""
    between = (ENDING + VERSION + LINE).encode()
    file, held, wanted = None, [], 0
    fields: dict[str, str] = {}

    def whole() -> tuple[dict[str, str], bytes]:
        block = between.join(held)
        if len(block) < wanted:
            return {**fields, "warc-type": TRUNCATED}, block
        return fields, block[:wanted]

    size = 0
    for name, piece in pieces:
        if held and name == file and size < wanted:
            held.append(piece)
            size += len(between) + len(piece)
            continue
        if held:
            yield whole()
        file = name
        head, _, block = piece.removeprefix((VERSION + LINE).encode()).partition(ENDING.encode())
        fields = _headers(head)
        held, size, wanted = [block], len(block), int(fields.get("content-length", 0))
    if held:
        yield whole()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, pa.string()) for name in HEADERS] + [("block", pa.binary())])

    def pieces() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            yield from ((f.as_py(), p.as_py()) for f, p in zip(batch.column(0), batch.column(1)))

    rows: list[tuple] = []
    size = 0
    for fields, block in _records(pieces()):
        rows.append((*[fields.get(h.lower()) for h in HEADERS.values()], block))
        size += len(block)
        if size > 4 << 20 or len(rows) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record below ``path``: header fields and the block. Files are gzip, which Spark does not split."""
    source = spark.read.option("lineSep", ENDING + VERSION + LINE).schema("value string").text(path)
    pieces = source.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return in_tasks(pieces, _parse, RECORD)


def with_payload(records: DataFrame) -> DataFrame:
    """The block of a response or revisit cut at the end of its HTTP head: ``http`` text and ``payload`` bytes.

    Of other records ``http`` is the whole block, as text.
    """
    answered = F.col("type").isin("response", "revisit")
    head = F.when(answered, F.substring_index(F.col("block").cast("string"), ENDING, 1))
    cut = records.withColumn("http", F.coalesce(head, F.col("block").cast("string")))
    payload = F.substring(F.col("block"), F.octet_length("http") + len(ENDING) + 1, F.octet_length("block"))
    return cut.withColumn("payload", F.when(answered, payload)).drop("block")


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``id``, and the records ``response`` (or revisit), ``request`` and ``metadata`` nested.

    A request or metadata record belongs to the record that it is concurrent to. Without a response such records
    form a capture of their own, with ``response`` null. Whatever columns ``records`` has are nested.
    """
    whole = F.struct(*[F.col(c) for c in records.columns])
    answer = F.col("type").isin("response", "revisit")
    keyed = records.select(
        F.when(answer, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")).alias("id"),
        F.when(answer, whole).alias("response"),
        F.when(F.col("type") == "request", whole).alias("request"),
        F.when(F.col("type") == "metadata", whole).alias("metadata"),
    )
    return keyed.groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("response", "request", "metadata")])
