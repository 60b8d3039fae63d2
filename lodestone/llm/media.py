"""Media columns: content-addressed payloads in tar shards.

Each task packs the media of its rows into tar archives of bounded size, named by the SHA-256 of their content; the archives are
rows of shared tables (shard, index, tar). A row's column carries digest, shard, offset and length, and every digest is stored
once over all shards: texts that may occur again, by a table of SEEN bits of fixed size, go through one shuffle that leaves one of
each; all others are packed where they are read. A fuller table only sends more texts that way.

An archive's index has each member's place and its first HEADER bytes, in a column of their own. Metadata columns come from
reads of that range of the files alone; the tar column is read only to verify or use whole members. Media are WAV files: mono, eight
bits a sample, 8,000 samples a second.

A null text counts as empty; ids may be null or repeated, rows stay as many as they are. Other columns aren't read, whatever their
names. An empty table gives no rows and no archives. A very long text is one member of its archive, which then
is as long as that. Equal texts have one stored form, and equal values.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

UNIT, RATE, HEADER, TAR_BLOCK, SHARD_BYTES = 576, 8000, 44, 512, 2 << 20
#: Of the tables of archives, whose cells are large: bytes that a writer holds before it goes on to the next row group.
GROUP_BYTES = 16 << 20
STORED_AS = {"compression": "zstd", "parquet.block.size": str(GROUP_BYTES)}
TAIL = 32
#: Bits of the table of texts that may occur again; parts over which the rows of such a text are dealt.
SEEN, SALTS = 1 << 24, 16
#: Kinds of packed rows: of a text stored here, of one that may occur again, an archive.
STORED, AGAIN, ARCHIVE = 0, 1, 2
INDEX = "array<struct<digest:binary,offset:bigint,length:bigint,head:binary>>"
PACKED = f"kind int, doc_id long, n_bytes long, digest binary, shard string, offset long, length long, text string, index {INDEX}, tar binary"
LAYOUT = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("text", pa.string())]
    + [("index", pa.list_(pa.struct([("digest", pa.binary()), ("offset", pa.int64()), ("length", pa.int64()), ("head", pa.binary())]))), ("tar", pa.binary())]
)


def payload_of(text: bytes) -> bytes:
    """text with bytes 255 up to a positive multiple of UNIT."""
    size = max(1, -(-len(text) // UNIT)) * UNIT
    return text + b"\xff" * (size - len(text))


def wav(samples: bytes) -> bytes:
    header = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return header + samples + b"\0" * (len(samples) % 2)


def wav_header(head: bytes) -> dict:
    """Fields of a WAV file from its first HEADER bytes."""
    riff, size, wave, fmt, _, codec, channels, rate, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", head[:HEADER])
    if (riff, wave, fmt, data) != (b"RIFF", b"WAVE", b"fmt ", b"data") or codec != 1:
        raise ValueError("not a PCM file")
    return {"channels": channels, "rate": rate, "bits": bits, "samples": n // max(1, channels * bits // 8), "data_bytes": n, "file_bytes": size + 8}


class Shard:
    """A tar archive in memory; add() gives a member's place, close() the archive."""

    def __init__(self):
        self.name, self.at, self.parts, self.places, self.index = uuid.uuid4().hex, 0, [], {}, []

    def add(self, digest: bytes, content: bytes) -> tuple[int, int]:
        if digest not in self.places:
            info = tarfile.TarInfo(f"{digest.hex()}.wav")
            info.size = len(content)
            pad = -len(content) % TAR_BLOCK
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.parts += [head, content, b"\0" * pad]
            self.places[digest] = place = (self.at + len(head), len(content))
            self.index.append((digest, *place, content[:HEADER]))
            self.at += len(head) + len(content) + pad
        return self.places[digest]

    def close(self) -> bytes:
        return b"".join([*self.parts, b"\0" * (2 * TAR_BLOCK)])


def _seen_again(keys: DataFrame) -> np.ndarray:
    """A table of SEEN bits: those of keys (key long) that occur more than once."""
    again = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.pmod("key", F.lit(SEEN)).alias("bit"))
    words = again.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    told, table = words.toArrow(), np.zeros(SEEN // 64, np.int64)  # SEEN / 64 rows at most
    table[told.column("word").to_numpy()] = told.column("bits").to_numpy()
    return table.view(np.uint8)


def _packer(batches: Iterator[pa.RecordBatch], again: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Packed rows of batches (doc_id, text, key); all texts are stored where again is None."""
    shard, rows = Shard(), []

    def full(last: bool) -> pa.RecordBatch:
        told = [*rows, (ARCHIVE, None, None, None, shard.name, None, None, None, [dict(zip(("digest", "offset", "length", "head"), x, strict=True)) for x in shard.index], shard.close())] if last else rows
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*told, strict=True), LAYOUT, strict=True)], schema=LAYOUT)

    waiting = 0
    for batch in batches:
        bits = batch.column("key").to_numpy() % SEEN
        known = np.zeros(len(bits), bool) if again is None else (again[bits >> 3] >> (bits & 7) & 1).astype(bool)
        for doc, t, twice in zip(batch.column("doc_id").to_pylist(), batch.column("text"), known.tolist(), strict=True):
            text = t.as_py() or ""
            data = text.encode()
            content = wav(payload_of(data))
            digest = hashlib.sha256(content).digest()
            if twice:
                rows.append((AGAIN, doc, len(data), digest, None, None, None, text, None, None))
                waiting += len(data)
            else:
                rows.append((STORED, doc, len(data), digest, shard.name, *shard.add(digest, content), None, None, None))
            if shard.at >= SHARD_BYTES or waiting >= SHARD_BYTES:
                yield full(shard.at > 0)
                if shard.at:
                    shard = Shard()
                rows, waiting = [], 0
    if rows:
        yield full(shard.at > 0)


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, shards): doc_id, n_bytes, digest, shard, offset, length, again of each row of docs; shard, index, tar, again of each archive.

    again: the text may occur more than once; such texts have archives of their own.
    """
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.withColumn("key", F.xxhash64("text"))
    seen = slim.sparkSession.sparkContext.broadcast(_seen_again(slim.select("key")))
    told = shared_table(slim.mapInArrow(lambda batches: _packer(batches, seen.value), PACKED), "media", **STORED_AS)
    # one text of each digest that may occur again
    once = told.filter(F.col("kind") == AGAIN).groupBy("digest").agg(F.first("text").alias("text"))
    once = once.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("key"))
    more = shared_table(once.mapInArrow(lambda batches: _packer(batches, None), PACKED), "media-again", **STORED_AS)
    own = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
    stored = told.filter(F.col("kind") == STORED).select(*own, F.lit(False).alias("again"))
    places = more.filter(F.col("kind") == STORED).select(F.col("digest").alias("_digest"), "shard", "offset", "length")
    repeated = dealt(told.filter(F.col("kind") == AGAIN).select("doc_id", "n_bytes", "digest"), places, "_digest")
    rows = stored.unionByName(repeated.select(*own, F.lit(True).alias("again")))
    archives = [df.filter(F.col("kind") == ARCHIVE).select("shard", "index", "tar", F.lit(again).alias("again")) for df, again in ((told, False), (more, True))]
    return rows, archives[0].unionAll(archives[1])


def dealt(rows: DataFrame, known: DataFrame, digest: str) -> DataFrame:
    """rows joined with the one row of known of their digest, over SALTS parts: one digest may be that of most rows."""
    parts = known.withColumn("_part", F.explode(F.array(*map(F.lit, range(SALTS)))))
    part = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", part).join(parts, (F.col("digest") == F.col(digest)) & (F.col("_salt") == F.col("_part"))).drop("_salt", "_part", digest)


def members(tar: bytes) -> Iterator[tuple[str, int, int]]:
    """(name, offset, length) of an archive's members, by their headers alone."""
    at = 0
    while at + TAR_BLOCK <= len(tar) and bytes(tar[at : at + TAR_BLOCK]).strip(b"\0"):
        info = tarfile.TarInfo.frombuf(bytes(tar[at : at + TAR_BLOCK]), "utf-8", "strict")
        yield info.name, at + TAR_BLOCK, info.size
        at += TAR_BLOCK + info.size + -info.size % TAR_BLOCK


def _read(shards: DataFrame, schema: str, row: Callable[[memoryview, int, int], tuple]) -> DataFrame:
    """One row a member: digest, shard, offset and what row(tar, offset, length) gives."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, tar in zip(batch.column("shard").to_pylist(), batch.column("tar"), strict=True):
                view = memoryview(tar.as_buffer())
                out = [(bytes.fromhex(name.partition(".")[0]), shard, at, *row(view, at, n)) for name, at, n in members(view)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names)

    return shards.mapInArrow(run, schema)


def metadata(shards: DataFrame) -> DataFrame:
    """Metadata columns of every member, from the header range alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [wav_header(x) for x in batch.column("head").to_pylist()]
            told = [pa.array([h[n] for h in heads], pa.int64()) for n in ("file_bytes", "channels", "rate", "bits", "samples")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *told], ["digest", "media_bytes", "channels", "rate", "bits", "samples"])

    members_ = shards.select(F.inline("index")).select("digest", "head")
    return members_.mapInArrow(run, "digest binary, media_bytes long, channels long, rate long, bits long, samples long")


def feature(samples: np.ndarray) -> str:
    """Mean, spread and crossings of the middle line, in whole numbers."""
    n, values = len(samples), samples.astype(np.int64)
    total, squares = int(values.sum()), int((values * values).sum())
    above = samples >= 128
    crossings = int((above[1:] != above[:-1]).sum())
    return f"mean={total * 1000 // n};var={(squares * n - total * total) // (n * n)};zc={crossings}"


def contents(shards: DataFrame) -> DataFrame:
    """Digests and features of every member, from its stored bytes."""

    def row(tar: memoryview, at: int, n: int) -> tuple:
        stored = bytes(tar[at : at + n])
        header = wav_header(stored)
        payload = stored[HEADER : HEADER + header["data_bytes"]]
        return (
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-TAIL:]),
            hashlib.sha256(stored).hexdigest(),
            feature(np.frombuffer(payload, np.uint8)),
        )

    return _read(shards, "digest binary, shard string, offset long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string", row)


def with_members(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """rows with the metadata of their media, from headers, and what their stored bytes give."""
    slim = rows.select("doc_id", "n_bytes", "digest", "again")
    out = []
    for again in (False, True):
        part = shards.filter(F.col("again") == again)
        told = contents(part.select("shard", "tar")).drop("shard", "offset").join(metadata(part), "digest").withColumnRenamed("digest", "_digest")
        own = slim.filter(F.col("again") == again)
        out.append(dealt(own, told, "_digest") if again else own.join(told, F.col("digest") == F.col("_digest")).drop("_digest"))
    return out[0].unionByName(out[1])


def op7_media(spark, sf_dir: str) -> DataFrame:
    out = with_members(*pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    head = F.concat_ws("/", F.lit("wav"), "rate", "channels", "bits")
    told = F.concat(head, F.lit(";ms="), F.floor(F.col("samples") * 1000 / F.col("rate")).cast("string"), F.lit(";"), "feature")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", told.alias("feature"))
