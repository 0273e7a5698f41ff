"""WARC files: responses made from pages, and the metadata and plain-text conversion records derived from them.

Each record is a gzip member of its own, so that it can be read by its offset. Tasks pack members into files of a
bounded number of bytes, which Spark's own text writer copies: a row is a file, and what the writer puts behind it is
an empty gzip member. Files thus go to any store, and a task that is run again replaces its own.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.html_pass import read_page
from spanloom.llm.store import scratch_path
from spanloom.llm.words import pieces

END = "\r\n\r\n"
#: Compressed bytes at which a file is closed; a longer record stays whole.
FILE_BYTES = 32 << 20
#: Bytes of records, or of a file being unpacked, that are handed on at once.
STEP_BYTES = 4 << 20
#: A gzip member of nothing, and the encoding in which its bytes are characters.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003030000000000" + "00000000")
BYTE_CHARSET = "ISO-8859-1"
#: zlib's window for gzip members, and the level they are packed with.
GZIP, LEVEL = 31, 1


def digest(data: bytes) -> str:
    """A labelled SHA-1 in base 32, as WARC headers hold it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A record's identifier, the same whenever it is made from the same parts."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts, default=str))}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the empty lines at its end. Headers without a value are left out; line ends in values become spaces."""
    lines = [f"{k}: {' '.join(v.split())}" for k, v in headers if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block


def inflated(data: bytes | memoryview) -> Iterator[bytes]:
    """The content of a gzipped file of any number of members, in pieces of bounded size."""
    view, member = memoryview(data), zlib.decompressobj(GZIP)
    for at in range(0, len(view), 1 << 16):
        piece = bytes(view[at : at + (1 << 16)])
        while piece:
            out = member.decompress(piece, STEP_BYTES)
            if out:
                yield out
            if member.eof:
                piece, member = member.unused_data, zlib.decompressobj(GZIP)
            else:
                piece = member.unconsumed_tail


def parse_records(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of each record of a file that comes in pieces. Values of a repeated header are joined by commas."""
    held, parts = bytearray(), iter(parts)

    def more() -> bool:
        part = next(parts, None)
        held.extend(part or b"")
        return part is not None

    while held or more():
        searched = 0
        while (stop := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more():
                raise ValueError("a record's header is cut off")
        version, *lines = held[:stop].decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:20]!r}")
        headers: dict[str, str] = {}
        for line in lines:
            name, _, value = line.partition(":")
            headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
        end = stop + 4 + int(headers["Content-Length"])
        while len(held) < end + len(END):
            if not more():
                raise ValueError("a record is cut off")
        yield headers, bytes(held[stop + 4 : end])
        del held[: end + len(END)]


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)], payload


def response_record(page_id: int | None, url: str | None, html: str | None, date: str) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url)), ("WARC-Date", date), ("WARC-Target-URI", url), ("X-Page-Id", None if page_id is None else str(page_id))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(http))]
    return record(headers, http)


def by_name(headers: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """Headers by name; a name that is repeated has the list of its values."""
    found: dict[str, list[str]] = {}
    for name, value in headers:
        found.setdefault(name, []).append(value)
    return {name: values[0] if len(values) == 1 else values for name, values in found.items()}


def derive(headers: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """The metadata record and the conversion record of a response; both refer to it and keep its digests."""
    status, http, payload = http_parts(block)
    plain, title, links = read_page(payload.decode("utf-8", "replace"))
    source = headers["WARC-Record-ID"]
    kept = [("WARC-Date", headers.get("WARC-Date")), ("WARC-Target-URI", headers.get("WARC-Target-URI")), ("WARC-Refers-To", source), ("X-Page-Id", headers.get("X-Page-Id"))]
    kept += [("X-Source-Payload-Digest", headers.get("WARC-Payload-Digest")), ("X-Source-Block-Digest", headers.get("WARC-Block-Digest"))]
    envelope = {
        "Envelope": {
            "Format": "WARC",
            "WARC-Header-Metadata": headers,
            "Payload-Metadata": {"HTTP-Response-Metadata": {"Response-Message": {"Status-Line": status}, "Headers": by_name(http), "HTML-Metadata": {"Head": {"Title": title}, "Links": links}}},
        }
    }
    meta = json.dumps(envelope, ensure_ascii=False).encode("utf-8", "surrogatepass")
    text = plain.encode("utf-8", "surrogatepass")
    first = [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", source)), *kept, ("Content-Type", "application/json"), ("WARC-Block-Digest", digest(meta))]
    second = [("WARC-Type", "conversion"), ("WARC-Record-ID", record_id("conversion", source)), *kept, ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(text))]
    return record(first, meta), record(second, text)


def packed(records: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """Files of a bounded number of bytes, a row each, of records as gzip members."""
    held: list[bytes] = []
    size = 0
    for one in records:
        held.append(zlib.compress(one + END.encode(), LEVEL, GZIP))
        size += len(held[-1])
        if size >= FILE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])


def batched(records: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of bytes of records."""
    held: list[bytes] = []
    size = 0
    for one in records:
        held.append(one)
        size += len(one)
        if size >= STEP_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])


def _write(rows: DataFrame, records: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]], path: str) -> None:
    files = rows.mapInArrow(lambda batches: packed(records(batches)), "file binary").select(F.col("file").cast("string"))
    ending = EMPTY_MEMBER.decode(BYTE_CHARSET)
    files.write.option("maxRecordsPerFile", 1).option("encoding", BYTE_CHARSET).option("lineSep", ending).option("compression", "none").text(path)


def write(records: DataFrame, path: str) -> None:
    """Write a table of one binary column ``record`` as WARC files; null records are left out, no row gives no file of records."""
    _write(records.select("record"), lambda batches: (r for batch in batches for r in batch.column(0).to_pylist() if r is not None), path)


def _responses(date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]]:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for part, html in pieces(batch, "html", STEP_BYTES):
                for page_id, url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), html.to_pylist(), strict=True):
                    yield response_record(page_id, url, page, date)

    return made


DATE = "2024-01-01T00:00:00Z"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record for each row of pages (page_id, url, html). Null html is an empty payload; a null url or
    page_id leaves its header out. Rows that repeat give records of equal identifiers. Other columns are not kept.
    An empty table gives no record; a page of any length is one record."""
    made = _responses(date)
    return pages.select("page_id", "url", "html").mapInArrow(lambda batches: batched(made(batches)), "record binary")


def write_responses(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write the ``responses`` of pages as WARC files in one pass."""
    _write(pages.select("page_id", "url", "html"), _responses(date), path)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for content in batch.column(0):
            for headers, block in parse_records(inflated(content.as_buffer())):
                if headers.get("WARC-Type") == "response":
                    yield from derive(headers, block)


def derivatives(spark, path: str) -> DataFrame:
    """The metadata and conversion records of all responses in a folder of WARC files; other records are passed over.

    Files may hold a member for each record or one for all. No record, no derivative; a page is read in one linear
    pass, whatever its length and however broken; equal responses give equal derivatives.
    """
    return _files(spark, path).mapInArrow(lambda batches: batched(_derived(batches)), "record binary")


def write_derivatives(spark, path: str, to: str) -> None:
    """Write the ``derivatives`` of a folder of WARC files as WARC files in one pass."""
    _write(_files(spark, path), _derived, to)


def read(spark, path: str) -> DataFrame:
    """One row for each record of a folder of WARC files: its type, identifier, what it refers to, URI, all headers, block.

    Files come whole, each to one task; Spark refuses one beyond 2 GB, as it does a record, and those written here close at 32 MB.
    """
    named = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "block_digest": "WARC-Block-Digest"}

    def table(some: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
        columns = [pa.array([h.get(v) for h, _ in some], pa.string()) for v in named.values()]
        maps = pa.array([list(h.items()) for h, _ in some], pa.map_(pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([*columns, maps, pa.array([b for _, b in some], pa.binary())], [*named, "headers", "block"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[tuple[dict[str, str], bytes]] = []
                size = 0
                for one in parse_records(inflated(content.as_buffer())):
                    held.append(one)
                    size += len(one[1])
                    if size >= STEP_BYTES or len(held) == 1000:
                        yield table(held)
                        held, size = [], 0
                if held:
                    yield table(held)

    return _files(spark, path).mapInArrow(rows, ", ".join(f"{k} string" for k in named) + ", headers map<string,string>, block binary")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Write ``pages`` as responses, derive, write and read back: one row for each derived record.

    page_id, type, record_id, refers_to, target_uri, source_digest (of the source's payload), block_digest,
    n_bytes, title and n_links (metadata), text (conversion).
    """
    source, derived = scratch_path(spark, "warc"), scratch_path(spark, "warc-derived")
    write_responses(spark.read.parquet(f"{sf_dir}/pages.parquet"), source)
    write_derivatives(spark, source, derived)
    found = read(spark, derived)
    meta = F.when(F.col("type") == "metadata", F.col("block").cast("string"))
    html = F.get_json_object(meta, "$.Envelope.Payload-Metadata.HTTP-Response-Metadata.HTML-Metadata")
    return found.select(
        F.col("headers")["X-Page-Id"].cast("long").alias("page_id"),
        "type",
        "record_id",
        "refers_to",
        "target_uri",
        F.col("headers")["X-Source-Payload-Digest"].alias("source_digest"),
        "block_digest",
        F.length("block").cast("long").alias("n_bytes"),
        F.get_json_object(html, "$.Head.Title").alias("title"),
        F.json_array_length(F.get_json_object(html, "$.Links")).cast("long").alias("n_links"),
        F.when(F.col("type") == "conversion", F.col("block").cast("string")).alias("text"),
    )
