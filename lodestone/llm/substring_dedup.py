"""Substring dedup: seed and extend over winnowed anchors.

A window is `length` consecutive words of one document. Every window elects one anchor, the run of `seed` words in it
whose hash is least (leftmost on ties); the choice depends on the window's words alone, so equal windows elect equal
anchors and a repeat of `length` words always shares one. The windows that elect one anchor occurrence are
consecutive; together they are its segment, the anchor extended both ways as far as it was elected.

1. Documents meet on anchors. Where all segments of an anchor are equal, they are maximal repeats as they stand.
2. Where segments differ (the edges of repeats, chance matches of the seed), each anchor is extended only by single
   windows, which are compared in their turn.
3. Windows that start in an earlier document too are merged per document; their union is the maximal repeats.

Identity is by two independent 64-bit hashes (anchor and segment or window). Common anchors, found in a sample of
documents, are salted; the sample decides how rows are dealt out, never which are compared.

Null texts have no words. A null id is neither earlier nor later than any other, so that row stays whole; rows of one
id never remove words from each other. Extra columns are kept, whatever their names. An empty table gives no rows. A very long text is worked on as a
whole by the task that reads it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import field, fresh, shared_table
from .hashing import U, Slice, mix, slices

LENGTH, SEED = 13, 5
#: One document in SAMPLE is read for common anchors: those in COMMON of them, MOST_COMMON at most, are salted.
SAMPLE, COMMON, MOST_COMMON, SALTS = 32, 16, 16_384, 16
OPEN, REMOVE, MIXED, KEEP = 0, 1, 2, 3


def _elect(words: Slice, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: the word it starts at, the word its anchor starts at, the anchor's hash."""
    starts = words.window_starts(length)
    if not len(starts):
        return starts, starts, np.zeros(0, U)
    grams = words.grams(seed)
    best, offset = grams[starts], np.zeros(len(starts), np.int64)
    for j in range(1, length - seed + 1):
        other = grams[starts + j]
        less = other < best
        best[less], offset[less] = other[less], j
    return starts, starts + offset, best


def _segments(words: Slice, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each elected anchor: its document in the slice, the anchor's hash, the segment's hash."""
    starts, anchors, codes = _elect(words, length, seed)
    if not len(starts):
        return starts, codes, codes
    first = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    last = np.append(first[1:], len(anchors)) - 1
    begin, stop = starts[first], starts[last] + length
    inside = (anchors[first] - begin).astype(U)
    return words.doc[begin], codes[first], mix(words.spans(begin, stop) + inside)


def _owned(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(code ^ mix(doc.astype(U) + U(1)))


def _listed(lists: pa.Array, row: int, stop: int) -> np.ndarray:
    """The values of a list column between two rows, each tied to its document in the slice."""
    part = lists.slice(row, stop - row)
    values = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(part).to_pylist()], np.int64)
    return _owned(np.repeat(np.arange(stop - row), sizes), values)


def _found(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, stop, words in slices(batch.column("text")):
                doc, anchor, segment = _segments(words, length, seed)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)), pa.array(ids[row:stop][doc])], ["anchor", "segment", "doc_id"])

    return run


def _windows(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("anchors")
            for row, stop, words in slices(batch.column("text")):
                starts, _, codes = _elect(words, length, seed)
                if not len(starts):
                    continue
                doc = words.doc[starts]
                at = np.flatnonzero(np.isin(_owned(doc, codes), _listed(lists, row, stop)))
                window = words.spans(starts[at], starts[at] + length)
                yield pa.RecordBatch.from_arrays([pa.array(codes[at].view(np.int64)), pa.array(window.view(np.int64)), pa.array(ids[row:stop][doc[at]])], ["anchor", "window", "doc_id"])

    return run


def _covered(words: Slice, length: int, seed: int, anchors: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each word: whether a removed window covers it."""
    starts, _, codes = _elect(words, length, seed)
    edge = np.zeros(len(words) + 1, np.int64)
    if len(starts) and (len(anchors) or len(windows)):
        doc = words.doc[starts]
        hit = np.isin(_owned(doc, codes), anchors)
        if len(windows):
            hit |= np.isin(_owned(doc, words.spans(starts, starts + length)), windows)
        np.add.at(edge, starts[hit], 1)
        np.add.at(edge, starts[hit] + length, -1)
    return np.cumsum(edge)[:-1] > 0


def _kept_text(data: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray, lo: int, hi: int) -> bytes:
    """The document data[lo:hi] without the removed words and the white space that followed each."""
    out, at = [], lo
    for i in np.flatnonzero(gone):
        out.append(data[at : start[i]])
        at = start[i + 1] if i + 1 < len(start) else hi
    out.append(data[at:hi])
    return b"".join(out)


def _result(length: int, seed: int, digest: bool, text: str, names: list[str], hidden: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, lists = batch.column(batch.schema.get_field_index(text)), [batch.column(batch.schema.get_field_index(x)) for x in hidden]
            for row, stop, words in slices(column):
                gone = _covered(words, length, seed, _listed(lists[0], row, stop), _listed(lists[1], row, stop))
                data, removed = words.data.tobytes(), np.concatenate([[0], np.cumsum(gone)])
                n_words, n_removed = np.diff(words.first), np.diff(removed[words.first])
                texts = []
                for d in range(stop - row):
                    a, b = words.first[d], words.first[d + 1]
                    lo, hi = int(words.offsets[d]), int(words.offsets[d + 1])
                    if digest:
                        if n_removed[d]:
                            keep = a + np.flatnonzero(~gone[a:b])
                            kept = b" ".join([data[i:j] for i, j in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)])
                        else:
                            kept = b" ".join(data[lo:hi].split())
                        texts.append(hashlib.sha256(kept).hexdigest())
                    else:
                        texts.append(_kept_text(data, words.start[a:b], words.end[a:b], gone[a:b], lo, hi).decode() if n_removed[d] else column[row + d].as_py())
                part = batch.slice(row, stop - row)
                arrays = [pa.array(texts, pa.string()) if n == text else part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "n_words", "n_removed"])

    return run


def common_anchors(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> list[int]:
    """Anchors that many documents share, MOST_COMMON at most, from one document in SAMPLE."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(_found(length, seed), "anchor long, segment long, doc_id long").groupBy("anchor").agg(F.count("*").alias("n"))
    return [r.anchor for r in counts.filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "anchor").limit(MOST_COMMON).collect()]


def _salted(rows: DataFrame, common: list[int]) -> DataFrame:
    hot = F.col("anchor").isin(common) if len(common) <= 8 else F.expr(f"anchor in ({', '.join(map(str, common))})")
    return rows.withColumn("salt", F.when(hot, 1 + F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")) if common else rows.withColumn("salt", F.lit(0))


def _judged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, segment, doc_id, salt) that repeat over documents, with their status: REMOVE or MIXED.

    A salted part settles all of its rows but those of its first document; these alone meet the other parts.
    """
    over = Window.partitionBy(*keys, "salt")
    stats = {"first": F.min("doc_id"), "last": F.max("doc_id"), "low": F.min("segment"), "high": F.max("segment")}
    told = rows.select("*", *(f.over(over).alias(n) for n, f in stats.items())).filter((F.col("salt") > 0) | (F.col("first") < F.col("last")))
    mixed, later = F.col("low") != F.col("high"), F.col("doc_id") > F.col("first")
    open_ = (F.col("salt") > 0) & ~later
    told = told.withColumn("status", F.when(open_, OPEN).when(mixed, MIXED).when(later, REMOVE).otherwise(KEEP)).filter(F.col("status") != KEEP)
    told = shared_table(told.select(*keys, "doc_id", "status", *(F.when(open_, F.col(n)).alias(n) for n in ("last", "low", "high"))), "repeats")
    hot = told.filter(F.col("status") == OPEN)
    whole = {"first": F.min("doc_id"), "last": F.max("last"), "low": F.min("low"), "high": F.max("high")}
    whole = hot.groupBy(*keys).agg(*(f.alias(n) for n, f in whole.items())).filter(F.col("first") < F.col("last"))
    hot = hot.select(*keys, "doc_id").join(whole, keys)
    hot = hot.select(*keys, "doc_id", F.when(mixed, MIXED).when(later, REMOVE).otherwise(KEEP).alias("status"))
    return told.filter(F.col("status") != OPEN).select(*keys, "doc_id", "status").unionAll(hot.filter(F.col("status") != KEEP))


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, digest: bool = False) -> DataFrame:
    """docs with every word cut out that is covered by a window found in a document of smaller id too, n_words, n_removed.

    With digest, text is instead the SHA-256 of the kept words joined by single spaces.
    """
    if not 0 < seed <= length:
        raise ValueError("seed must be between 1 and length")
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col(id).isNotNull() & F.col(text).isNotNull())
    common = common_anchors(slim, length, seed)
    found = slim.mapInArrow(_found(length, seed), "anchor long, segment long, doc_id long")
    judged = _judged(_salted(found, common), ["anchor"])
    whole = judged.filter(F.col("status") == REMOVE).select("doc_id", "anchor", F.lit(None).cast("long").alias("window"))
    mixed = judged.filter(F.col("status") == MIXED).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    windows = slim.join(mixed, "doc_id").mapInArrow(_windows(length, seed), "anchor long, window long, doc_id long")
    windows = _judged(_salted(windows, common).withColumn("segment", F.lit(0).cast("long")), ["anchor", "window"])
    gone = whole.unionAll(windows.select("doc_id", F.lit(None).cast("long").alias("anchor"), "window"))
    key, anchors, window = fresh(docs, "_gone_id", "_gone_anchors", "_gone_windows")
    gone = gone.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("anchor").alias(anchors), F.collect_set("window").alias(window))
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == text else f for f in docs.schema if f.name in kept] + field("n_words long, n_removed long").fields)
    joined = docs.select(*kept).join(gone, docs[id] == F.col(key), "left").drop(key)
    return joined.mapInArrow(_result(length, seed, digest, text, kept, (anchors, window)), schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs, digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("text").alias("kept_sha256"))
