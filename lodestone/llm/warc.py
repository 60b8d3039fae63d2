"""WARC archives under Zstandard: one frame per record, the dictionary in a leading skippable frame.

write_archives() stores HTTP responses as archives of bounded size, the rows (archive, content) of a shared table. Records
of equal payload become one response (that of the least id) and revisits of it. read_archives() takes any DataFrame
with a binary column content, so .warc.zst files read as binaryFile do too. It walks an archive frame by frame and
yields one row a record, with an error where the frame, the header, a length or the digest doesn't hold; a
broken frame ends its archive, as the next one can't be found.

A null html is an empty payload, a null url an empty address. Repeated ids give repeated records. Ids are numbers; a row
without one is always a response, of no name. Other columns aren't read, whatever their names; an empty table gives no archive. Of equal payloads
the least id is the response, in every row that has it. A very long payload is one record, whose archive then ends with it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

#: Bytes of payload after which an archive is closed; records and bytes that its dictionary is trained on, the dictionary's size.
ARCHIVE_BYTES, TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 4 << 20, 128, 1 << 20, 16 << 10
LEVEL, SALTS = 6, 16
#: Fixed values of the formats.
SKIPPABLE, FRAME, VERSION = 0x184D2A5D, 0xFD2FB528, b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "archive string, offset long, record_id string, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(id: int | None) -> str:
    return f"<urn:page:{id}>" if id is not None else "<urn:page:none>"


def _line(value: str) -> str:
    """A header value: line ends can't stand in it."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def build(id: int | None, url: str, date: str, payload: bytes, code: str, first: int | None) -> bytes:
    """A response record, or a revisit of the record `first`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_name(id)), ("WARC-Target-URI", _line(url)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{code}")]
    if first is not None:
        headers += [("WARC-Refers-To", record_name(first)), ("WARC-Profile", PROFILE)]
    block = http + payload if first is None else http
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple:
    """(id, type, url, date, payload bytes, digest, refers-to, payload) of a record; ValueError if it doesn't hold."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    try:
        kind, size = fields["warc-type"], int(fields["content-length"])
    except (KeyError, ValueError):
        raise ValueError("a field is missing") from None
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("wrong length")
    known, payload, declared = fields.get("warc-payload-digest", "").removeprefix("sha1:"), None, None
    if kind in ("response", "revisit"):
        http, mark, body = rest[:size].partition(b"\r\n\r\n")
        sizes = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
        if not mark or not http.startswith(b"HTTP/") or len(sizes) != 1:
            raise ValueError("no HTTP header")
        declared = sizes[0]
        if kind == "response":
            payload = body
            if len(body) != declared or digest(body) != known:
                raise ValueError("the payload differs from its digest or length")
        elif body or "warc-refers-to" not in fields:
            raise ValueError("a revisit without reference or with a payload")
    url = fields.get("warc-target-uri", "")
    return fields.get("warc-record-id"), kind, url, fields.get("warc-date"), declared, known or None, fields.get("warc-refers-to"), payload


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary (itself compressed) in a skippable frame, then a frame a record."""
    sample, size = [], 0
    for r in records[:TRAIN_RECORDS]:
        if size < TRAIN_BYTES:
            sample.append(r[: TRAIN_BYTES // 8])
            size += len(sample[-1])
    try:
        words = zstd.train_dictionary(DICTIONARY_BYTES, sample).as_bytes() if len(sample) >= 16 else b""
    except zstd.ZstdError:
        words = b""
    if not words:  # too little to train on: plain content serves as well
        words = b"".join(sample)[:DICTIONARY_BYTES].ljust(8, b" ")
    squeezed = zstd.ZstdCompressor(level=LEVEL).compress(words)
    coder = zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(words), write_checksum=True, write_content_size=True)
    return b"".join([SKIPPABLE.to_bytes(4, "little"), len(squeezed).to_bytes(4, "little"), squeezed, *map(coder.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at `at` ends, by its header and block headers; ValueError if it is cut off or none."""
    if at + 5 > len(data) or int.from_bytes(data[at : at + 4], "little") != FRAME:
        raise ValueError("no frame")
    head = zstd.get_frame_parameters(bytes(data[at : at + 18]))
    at += zstd.frame_header_size(bytes(data[at : at + 18]))
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * head.has_checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def unpack(content: memoryview) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, error) of each frame of an archive."""
    at, words = 0, b""
    if len(content) >= 8 and int.from_bytes(content[:4], "little") == SKIPPABLE:
        at = 8 + int.from_bytes(content[4:8], "little")
        words = bytes(content[8:at])
        if words[:4] == FRAME.to_bytes(4, "little"):
            words = zstd.ZstdDecompressor().decompress(words)
    decoder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(words)) if words else zstd.ZstdDecompressor()
    while at < len(content):
        try:
            end = frame_end(content, at)
        except (ValueError, zstd.ZstdError) as e:
            yield at, None, str(e)
            return
        try:
            with decoder.stream_reader(content[at:end]) as reader:
                record = reader.read()
            yield at, record, None
        except zstd.ZstdError as e:
            yield at, None, str(e)
        at = end


def read_archives(archives: DataFrame, content: str = "content", name: str = "archive") -> DataFrame:
    """One row a record of the archives, as RECORD has it."""
    schema = [tuple(x.split()) for x in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    layout = pa.schema([(n, kinds[k]) for n, k in schema])

    def rows(title: str, data: memoryview) -> Iterator[tuple]:
        for at, record, error in unpack(data):
            try:
                if error:
                    raise ValueError(error)
                yield (title, at, *parse(record), None)
            except ValueError as e:
                yield (title, at, *[None] * 8, str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for title, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = list(rows(title, memoryview(data.as_buffer() or b"")))
                for at in range(0, len(out), 1000):
                    columns = zip(*out[at : at + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, layout, strict=True)], schema=layout)

    return archives.filter(F.col(content).isNotNull()).select(F.col(name).cast("string").alias("archive"), F.col(content).alias("content")).mapInArrow(run, RECORD)


def first_of(pages: DataFrame, least: int) -> DataFrame:
    """pages (id, url, payload, code) with first: for payloads found more than once, the least id."""
    # one payload may be that of most rows: partial sums meet once, and what they tell goes back over salts
    again = pages.filter((F.length("payload") >= least) & F.col("id").isNotNull()).groupBy("code").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    told = again.select(F.col("code").alias("known"), "first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("part"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    return pages.join(told, (F.col("code") == F.col("known")) & (salt == F.col("part")), "left").drop("known", "part")


def write_archives(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The archives (archive, content) of a record per row of pages."""
    slim = pages.select(F.col(id).cast("long").alias("id"), F.coalesce(url, F.lit("")).alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    slim = slim.withColumn("code", F.unhex(F.sha1("payload")))
    placed = first_of(slim, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([pack(records)], pa.binary())], ["archive", "content"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "url", "payload", "first")]
            for page, address, payload, first in zip(*columns, strict=True):
                page, payload, first = page.as_py(), payload.as_py(), first.as_py()
                if page is None or first == page:
                    first = None
                records.append(build(page, address.as_py(), date, payload, digest(payload), first))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield full()
                    records, size = [], 0
        if records:
            yield full()

    return shared_table(placed.select("id", "url", "payload", "first").mapInArrow(run, "archive string, content binary"), "warc", compression="none")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    records = read_archives(write_archives(pages))
    broken = F.raise_error(F.concat(F.lit("broken record: "), F.col("error")))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    checked = records.withColumn("record_type", F.when(F.col("error").isNotNull(), broken).otherwise(F.col("record_type")))
    return checked.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
