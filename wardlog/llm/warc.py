"""WARC archives in Zstandard form: written and read back by Spark (operator 8).

An archive starts with a skippable frame that holds the dictionary, then has one frame per record.
Spark's text sink writes the frames as rows; its line separator is an empty skippable frame, which
every Zstandard reader passes over, so the files are plain archives on any file system Spark can write
to. A task closes an archive after a fixed number of rows (the sink's maxRecordsPerFile) and fills up
with empty rows if it has become large before; the next archive starts with the dictionary again.

Reading takes whole files (their size is bounded by writing), loads the dictionary, decodes record by
record and checks versions, headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlog.llm.common import checkpointed, query, shared_folder, table

ARCHIVE_ROWS = 8_000             # rows of an archive, its dictionary and fillers included
ARCHIVE_BYTES = 64 << 20         # compressed bytes after which an archive is filled up
DICTIONARY_BYTES = 16 << 10
DICTIONARY_PAGES = 256           # pages the dictionary is trained on
BROADCAST_GROUPS = 500_000       # payloads with copies that may be sent to every task
LEVEL = 3
DATE = "2024-01-31T00:00:00Z"

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("latin-1")   # an empty skippable frame, ASCII only
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SQL = ("page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, "
              "refers_to bigint, payload binary, error string")


def _line(name: str, value: str) -> str:
    """A header line; control characters in a value are percent-encoded."""
    return f"{name}: {''.join(f'%{ord(c):02X}' if c < ' ' else c for c in value)}\r\n"


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with the payload, or a revisit with the HTTP header alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = _line("WARC-Type", "revisit" if revisit else "response") + _line("WARC-Record-ID", _id(page_id))
    head += _line("WARC-Date", DATE) + (_line("WARC-Target-URI", url) if url is not None else "")
    head += _line("WARC-Payload-Digest", f"sha1:{digest}")
    head += _line("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())
    if revisit:
        head += _line("WARC-Profile", REVISIT_PROFILE) + _line("WARC-Refers-To", _id(refers_to))
    head += _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", str(len(block)))
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _number(text: str) -> int | None:
    inner = text.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def parse(data: bytes) -> dict:
    """The fields of one record; raises ValueError if it is not as it should be."""
    def need(holds: bool, what: str) -> None:
        if not holds:
            raise ValueError(what)

    need(data.startswith(b"WARC/1."), "no WARC version")
    head, found, rest = data.partition(b"\r\n\r\n")
    need(bool(found), "no end of the header")
    fields = _fields(head)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        need(name in fields, f"no {name}")
    size = int(fields["content-length"])
    need(len(rest) == size + 4, "the block is not as long as its header says")
    need(rest.endswith(b"\r\n\r\n"), "no end of the record")
    block, kind = rest[:size], fields["warc-type"]
    need(kind in ("response", "revisit"), f"unexpected type {kind}")
    sha1 = lambda raw: "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
    need(fields.get("warc-block-digest", sha1(block)) == sha1(block), "wrong block digest")
    http, found, payload = block.partition(b"\r\n\r\n")
    need(bool(found) and http.startswith(b"HTTP/"), "no HTTP header")
    length = int(_fields(http).get("content-length", len(payload)))
    if kind == "response":
        need(length == len(payload), "the payload is not as long as its header says")
        need(fields.get("warc-payload-digest", sha1(payload)) == sha1(payload), "wrong payload digest")
    else:
        need("warc-refers-to" in fields and "warc-payload-digest" in fields, "a revisit without its original")
    return {"page_id": _number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload_bytes": length, "payload_digest": fields.get("warc-payload-digest", sha1(payload)).removeprefix("sha1:"),
            "refers_to": _number(fields["warc-refers-to"]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None, "error": None}


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def records_of(content: bytes, chunk: int = 1 << 14):
    """Decompressed records of one archive, in order; ValueError where frames are broken."""
    at, dictionary = 0, None
    while at < len(content):
        if len(content) - at < 8:
            raise ValueError("broken frame")
        magic, size = struct.unpack_from("<II", content, at)
        if magic in SKIPPABLE:
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise ValueError("the dictionary is not the first frame")
                raw = content[8:8 + size]
                if raw[:4] == b"\x28\xb5\x2f\xfd":      # a dictionary may be compressed itself
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                dictionary = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
            continue
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts = []
        try:
            while not decoder.eof and at < len(content):
                part = content[at:at + chunk]
                parts.append(decoder.decompress(part))
                at += len(part) - len(decoder.unused_data)
        except zstandard.ZstdError as error:
            raise ValueError(f"broken frame: {error}") from error
        if not decoder.eof:
            raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def train_dictionary(pages: DataFrame) -> bytes | None:
    """From the first DICTIONARY_PAGES pages; None (no dictionary) where they are too few or too small."""
    samples = [bytes(r[0]) for r in pages.where("length(html) > 0").select(
        F.col("html").cast("binary")).limit(DICTIONARY_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 15 else None
    except zstandard.ZstdError:
        return None


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record per row of `pages` (page_id, url, html) as archives below `path`.

    The payload is the html in UTF-8; null is an empty one. Of equal payloads of `least_bytes` or more, rows
    of the smallest page_id are responses and the others revisits of it. A null page_id is larger than any
    other; equal payloads that have none are all responses. A null url is left out of the record. Other
    columns are ignored; an empty table gives no archive.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.cast("binary").alias("payload"), F.sha1(html.cast("binary")).alias("digest"))
    groups = checkpointed(rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    dictionary = train_dictionary(pages)
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    marked = rows.join(groups, "digest", "left").select("page_id", "url", "payload", "first")

    def frames(batches):
        leading = [dictionary_frame(dictionary)] if dictionary else []
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        rows, size = 0, 0
        for batch in batches:
            out = []
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                if size > ARCHIVE_BYTES and rows % ARCHIVE_ROWS:
                    fill = -rows % ARCHIVE_ROWS
                    out += [b""] * fill
                    rows += fill
                if rows % ARCHIVE_ROWS == 0:
                    out += leading
                    rows, size = rows + len(leading), 0
                revisit = first is not None and page_id != first
                out.append(compressor.compress(record(page_id, url, payload, first, revisit)))
                rows, size = rows + 1, size + len(out[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    (marked.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", ARCHIVE_ROWS).text(path))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below `path`; `error` says what is wrong with a record.

    A record that cannot be decoded ends its archive; one that is not valid is a row with `error` and
    nulls. Files without a leading dictionary are read without one.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                        ("payload", pa.binary()), ("error", pa.string())])

    def rows_of(content: bytes):
        try:
            for data in records_of(content):
                try:
                    row = parse(data)
                    yield row if payloads else row | {"payload": None}
                except ValueError as error:
                    yield {"error": str(error)}
        except ValueError as error:
            yield {"error": str(error)}

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for row in rows_of(content.as_py()):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SQL)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive `pages` in the shared folder and read the records back, without their payloads."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes)
    return read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


@query("op8_zstd_warc")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))
