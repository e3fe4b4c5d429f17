"""WARC archives: index first, then coalesced reads.

Writing puts one gzip member per record and notes file, offset, length, URL, digest
and type of each in an index table.  Reading plans on the index alone: the selected
records are sorted by file and offset, neighbours are merged into ranges of at most
MAX_RANGE bytes with gaps of at most MAX_GAP, and each range is one read.

Of the pages with equal payloads the one with the smallest id is a response, the rest
are revisits that carry its digest and no payload.  Digests are grouped with map-side
combine, and only pages of groups with copies are joined back, by page and digest, so a
payload that a third of all pages share is spread like any other, and rows that share a
page id but not a payload are told apart.

A task writes a file under a name of its own attempt; the index names the files that
count.  Defined results: a null or empty payload is a payload of 0 bytes; payloads
under `min_bytes` are always responses; rows that repeat a page id are records of
their own; a null id or URL is an empty header; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import file_system, saved, shared_dir

MIN_BYTES = 0
MAX_GAP, MAX_RANGE = 64 << 10, 8 << 20
_INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, digest string, type string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """One record: a response with its payload, or a revisit that names the digest and the record it repeats."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').translate({10: None, 13: None})}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


def _payload_hash():
    return F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))


def first_copies(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, d, first): for each page id and hash of a payload that another page repeats, the smallest page with it."""
    keyed = pages.select("id", _payload_hash().alias("d"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")).where(f"size >= {int(min_bytes)}")
    groups = keyed.groupBy("d").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    return keyed.join(groups, "d").where("id != first").select("id", "d", "first").distinct()


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, root: str | None = None) -> DataFrame:
    """Writes every page and returns the index (saved, one row for each record)."""
    spark = pages.sparkSession
    root = root or shared_dir(spark, "warc")
    fs, path = file_system(root)
    fs.create_dir(path, recursive=True)
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    copies = saved(first_copies(rows, min_bytes), "copies")
    # One row of copies for an id and a payload, so every page keeps its number of rows.
    marked = rows.withColumn("d", _payload_hash()).join(copies, ["id", "d"], "left").select("id", "url", "html", F.col("first").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, at = f"{root}/part-{uuid.uuid4().hex}.warc.gz", None, 0
        index = []
        for batch in batches:
            found = []
            for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                digest = payload_digest(payload)
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                raw = packer.compress(record(page, url, payload, digest, first, len(payload))) + packer.flush()
                if out is None:
                    files, to = file_system(uri)
                    out = files.open_output_stream(to, compression=None)
                out.write(raw)
                found.append((uri, at, len(raw), page, url, digest, "response" if first is None else "revisit"))
                at += len(raw)
            columns = list(zip(*found, strict=True)) or [[]] * 7
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            index.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "offset", "length", "page_id", "url", "digest", "type"]))
        if out is not None:
            out.close()  # an index row is told only once its record is in the file
        yield from index

    return saved(marked.mapInArrow(run, _INDEX), "warc-index")


def ranges(index: DataFrame, max_gap: int = MAX_GAP, max_range: int = MAX_RANGE) -> DataFrame:
    """(file, start, records): the selected records as merged byte ranges.

    Within a file, records are sorted by offset; a range ends at a gap of more than
    max_gap, and where a multiple of max_range lies between two records.
    """
    by = W.partitionBy("file").orderBy("offset")
    gap = F.coalesce(F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by), F.lit(0))
    cut = index.select("file", "offset", "length", (gap > max_gap).cast("int").alias("apart"), F.floor(F.col("offset") / max_range).alias("cell")).withColumn("gap", F.sum("apart").over(by))
    return cut.groupBy("file", "gap", "cell").agg(F.min("offset").alias("start"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records")).select("file", "start", "records")


def read(index: DataFrame) -> DataFrame:
    """(page_id, url, type, refers_to, payload_bytes, payload_digest, payload) of the records that `index` selects.

    Size and digest of a response are taken from the payload that was read and must
    agree with its headers; those of a revisit are the headers'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles: dict[str, object] = {}
        for batch in batches:
            for uri, start, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri not in handles:
                    handles = {uri: (lambda s: s[0].open_input_file(s[1]))(file_system(uri))}
                last = records[-1]
                raw = handles[uri].read_at(last["offset"] + last["length"] - start, start)
                found = []
                for r in records:
                    headers, body = parse(gzip.decompress(raw[r["offset"] - start : r["offset"] - start + r["length"]]))
                    kind, size, digest = headers["warc-type"], int(headers["warc-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(body) != size or payload_digest(body) != digest):
                        raise ValueError("a payload does not match its headers")
                    number = lambda x: int(x) if x else None
                    found.append((number(headers["warc-record-id"][10:-1]), headers["warc-target-uri"], kind, number(headers.get("warc-refers-to", "")[10:-1]), size, digest, body if kind == "response" else None))
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["page_id", "url", "type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    schema = "page_id bigint, url string, type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    return ranges(index).mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, **columns: str) -> DataFrame:
    """Writes all pages, reads all records back: one row for each page."""
    return read(write(pages, **columns)).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
