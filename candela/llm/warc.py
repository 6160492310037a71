"""WARC transaction assembly: request, response and metadata records joined to captures.

Records of a transaction name each other by WARC-Concurrent-To. Identifiers alone are joined to find the response
that each other record belongs to, directly, through any number of records between (metadata of a request), or because the response
names its request. Then the records, with their blocks, are grouped once by that response: one shuffle of the blocks.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: concurrent_to has all identifiers that the record names, with a space between.
RECORDS = "record_id string, warc_type string, concurrent_to string, target_uri string, warc_date string, content_type string, block binary"
_COLUMNS = [c.split()[0] for c in RECORDS.split(", ")]
#: Types of records that a capture is about.
CAPTURES = ("response", "resource", "revisit")


def _parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one uncompressed WARC stream. What stands where a record should begin is a record without headers, in blocks of up to about 1 MB, and so is what follows a header without a length."""
    lost = bytearray()

    def record(head: dict[str, str], block: bytes) -> dict:
        return {
            "record_id": head.get("warc-record-id"), "warc_type": head.get("warc-type"), "concurrent_to": head.get("warc-concurrent-to"), "target_uri": head.get("warc-target-uri"),
            "warc_date": head.get("warc-date"), "content_type": head.get("content-type"), "block": block,
        }

    while line := stream.readline(1 << 20):
        if not line.startswith(b"WARC/"):
            lost += line
            if not lost.strip():
                lost.clear()
            if len(lost) > 1 << 20:
                yield record({}, bytes(lost))
                lost.clear()
            continue
        if lost:
            yield record({}, bytes(lost))
            lost.clear()
        head: dict[str, str] = {}
        while (line := stream.readline(1 << 20)).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            # the one header that may repeat
            head[name] = f"{head[name]} {value}" if name == "warc-concurrent-to" and name in head else value
        size = head.get("content-length", "")
        yield record(head, stream.read(int(size)) if size.isdecimal() and len(size) < 16 else b"")
    if lost:
        yield record({}, bytes(lost))


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of WARC files (plain or .gz), one task a file; files are read as streams, never whole.

    A record without one of the headers has null there; blocks are bytes as they are. What is no record comes without headers (see _parse), which assemble leaves out; a
    broken .gz ends its file with such a record, whose block says why.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = shared.file_system(path)
                with system.open_input_stream(at, compression=None) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)
                    rows: list[dict] = []
                    size = 0
                    for r in _unbroken(_parse(stream)):
                        rows.append(r)
                        size += len(r["block"])
                        if len(rows) == 1000 or size > 16_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([(c, pa.binary() if c == "block" else pa.string()) for c in _COLUMNS])
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, len(paths))).mapInArrow(read, RECORDS)


def _unbroken(records: Iterator[dict]) -> Iterator[dict]:
    try:
        yield from records
    except (EOFError, OSError, zlib.error) as e:
        if isinstance(e, OSError) and not isinstance(e, gzip.BadGzipFile):
            raise
        yield dict.fromkeys(_COLUMNS) | {"block": f"broken: {e}".encode()}


def records_of_pages(pages: DataFrame) -> DataFrame:
    """The request, response and metadata records that a crawl of the pages would have written.

    Metadata refers to its request, which refers to the response. Null url or html: a null target and an empty block.
    """

    def rid(kind: str) -> F.Column:
        h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(pages["page_id"].cast("string"), F.lit("")), F.coalesce(pages["url"], F.lit(""))))
        return F.concat(F.lit("<urn:uuid:"), h, F.lit(">"))

    url, html = pages["url"], F.coalesce(pages["html"], F.lit(""))
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/]*(.*)$", 1), F.lit("")), F.lit("/"))
    host = F.coalesce(F.regexp_extract(url, r"^[a-z]+://([^/]*)", 1), F.lit(""))
    date = F.lit("2024-01-01T00:00:00Z")

    def record(kind: str, to: str | None, content: str, block: F.Column) -> F.Column:
        return F.struct(
            rid(kind).alias("record_id"), F.lit(kind).alias("warc_type"), (rid(to) if to else F.lit(None).cast("string")).alias("concurrent_to"),
            url.alias("target_uri"), date.alias("warc_date"), F.lit(content).alias("content_type"), block.cast("binary").alias("block"),
        )

    all_three = F.array(
        record("response", None, "application/http; msgtype=response", F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), html)),
        record("request", "response", "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce(path, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))),
        record("metadata", "request", "application/warc-fields", F.concat(F.lit("html-length: "), F.length(html).cast("string"), F.lit("\r\n"))),
    )
    return pages.select(F.explode(all_three).alias("r")).select("r.*")


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, target_uri, warc_date, http_status, response, requests, metadata.

    response is a struct (record_id, warc_date, content_type, http_head, payload), the payload as bytes; requests and metadata are arrays of such, by record_id.
    Records repeated as they are count once; of different records with one response identifier the least (date, block) is taken.
    A record whose response is missing forms a capture of its own with null response, under the identifier it refers to, or its own.
    Records without identifier and reference, and types other than request, metadata and those of CAPTURES, are left out. Extra columns are ignored.
    """
    r = records.select(*[records[c] for c in _COLUMNS]).where("coalesce(record_id, concurrent_to) is not null")
    ids = r.select("record_id", "warc_type", F.explode_outer(F.split("concurrent_to", " +")).alias("concurrent_to"))
    first = F.split("concurrent_to", " +")[0]
    main = F.col("warc_type").isin(*CAPTURES)
    roots = ids.where(main).where("record_id is not null").select(F.col("record_id").alias("root")).distinct()
    other = ids.where(F.col("warc_type").isin("request", "metadata")).where("record_id is not null")
    up = other.where("concurrent_to is not null").select(F.col("record_id").alias("child"), F.col("concurrent_to").alias("parent"))
    down = ids.where(main).where("concurrent_to is not null and record_id is not null").select(F.col("concurrent_to").alias("child"), F.col("record_id").alias("parent"))
    edges = up.unionByName(down).where("child <> parent").distinct()
    # nearest first: each round adds the records that name one found before, so it ends with the longest chain
    edges = shared.written(edges, "edges")
    new = found = shared.written(edges.join(roots, edges["parent"] == roots["root"]).groupBy("child").agg(F.min("root").alias("root")), "found")
    while not new.isEmpty():
        step = edges.join(new.select(F.col("child").alias("parent"), "root"), "parent").join(found.select("child"), "child", "left_anti")
        new = shared.written(step.groupBy("child").agg(F.min("root").alias("root")), "found")
        found = found.unionByName(new)
    mains = r.where(main).select(F.coalesce(F.col("record_id"), first).alias("capture_id"), "*")
    rest = r.where(F.col("warc_type").isin("request", "metadata")).join(found, F.col("record_id") == F.col("child"), "left").select(F.coalesce(F.col("root"), first, F.col("record_id")).alias("capture_id"), *_COLUMNS)
    body = F.struct(
        "record_id", "warc_date", "content_type",
        F.expr("if(cut > 0, make_valid_utf8(cast(substring(block, 1, cut - 1) as string)), null)").alias("http_head"), F.expr("if(cut > 0, substring(block, cut + 4), block)").alias("payload"),
    )
    # in Latin-1 a character is a byte
    end = F.expr("if(startswith(content_type, 'application/http'), locate('\\r\\n\\r\\n', decode(block, 'ISO-8859-1')), 0)")
    all_ = mains.unionByName(rest).withColumn("cut", end).select("capture_id", "target_uri", "warc_date", F.when(main, "response").otherwise(F.col("warc_type")).alias("part"), body.alias("body"))
    key = F.struct("warc_date", "body")
    grouped = all_.groupBy("capture_id").agg(
        F.coalesce(F.min(F.when(F.col("part") == "response", F.col("target_uri"))), F.min("target_uri")).alias("target_uri"), F.min("warc_date").alias("warc_date"),
        F.array_min(F.collect_set(F.when(F.col("part") == "response", key))).alias("best"),
        F.array_sort(F.collect_set(F.when(F.col("part") == "request", F.col("body")))).alias("requests"), F.array_sort(F.collect_set(F.when(F.col("part") == "metadata", F.col("body")))).alias("metadata"),
    )
    status = F.expr("try_cast(regexp_extract(best.body.http_head, '^HTTP/[0-9.]+ ([0-9]+)', 1) as int)")
    return grouped.select("capture_id", "target_uri", "warc_date", status.alias("http_status"), F.col("best.body").alias("response"), "requests", "metadata")


def op5_warc_assembly(spark, sf_dir: str) -> DataFrame:
    return assemble(records_of_pages(shared.table(spark, sf_dir, "pages")))


def warc_captures_flat(spark, sf_dir: str) -> DataFrame:
    """The same captures with their nested fields as plain columns, for SQL."""
    return op5_warc_assembly(spark, sf_dir).select(
        "capture_id", "target_uri", "http_status", F.md5("response.payload").alias("payload_md5"), F.length(F.col("response.payload").cast("string")).cast("bigint").alias("payload_chars"),
        F.size("requests").cast("bigint").alias("n_requests"), F.col("requests")[0]["http_head"].alias("request_head"), F.size("metadata").cast("bigint").alias("n_metadata"), F.col("metadata")[0]["payload"].cast("string").alias("metadata_payload"),
    )


_FLAT = """
SELECT '<urn:uuid:' || md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) || '>' AS capture_id, url AS target_uri, 200 AS http_status,
       md5(coalesce(html, '')) AS payload_md5, length(coalesce(html, ''))::BIGINT AS payload_chars, 1::BIGINT AS n_requests,
       'GET ' || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1), ''), '/') || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: ' || coalesce(regexp_extract(url, '^[a-z]+://([^/]*)', 1), '') AS request_head,
       1::BIGINT AS n_metadata, 'html-length: ' || length(coalesce(html, '')) || chr(13) || chr(10) AS metadata_payload
FROM (SELECT DISTINCT * FROM pages)
"""
QUERIES = {"op5_warc_assembly": op5_warc_assembly, "warc_captures_flat": warc_captures_flat}
SQL = {"warc_captures_flat": _FLAT}
