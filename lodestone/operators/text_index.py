"""A stored inverted index: BM25 top-k from posting blocks whose bounds tell which of them can matter.

Documents are counted once, when they come. Postings of up to BLOCK documents of a task are one row a term: ids, frequencies and lengths as arrays, and their
greatest frequency and least length, which bound every score in the block. A block is a range of places in the stored table of documents. Rows lie in folders by bucket of the term, so a search reads the buckets of its terms, and no text.

A search takes three steps: bounds by query and block of documents; scores of the LEAD blocks of greatest bound, whose k-th best is a floor; scores of those
other blocks whose bound reaches the floor. Blocks meet up to QUERY_BLOCK queries in a task, which hands on k rows a query. The result is that of scoring everything.

A change is a segment: documents that come, and marks for those that go or come anew. What the terms of a gone document counted is taken off from its stored
terms, and its mark names its block; so frequencies and lengths are those of live documents at any time, as if the index had been built anew; merge() writes live documents into one segment. Hot terms lie in
many rows, and the writer deals them over tasks by block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodestone.functions.text import terms
from lodestone.sources.store import Manifest

from .retrieval import B, K1, PLACES, QUERY_BLOCK, top_k

#: Documents and postings of a block at most; blocks scored first; asked terms up to this number are broadcast.
BLOCK, POSTINGS, LEAD, FEW = 512, 1 << 18, 4, 200_000
#: Documents that a writing task takes of a bucket of terms, about.
WRITTEN = 1 << 20
#: Scores are rounded to PLACES digits, so a floor may lie above what it was made of by this much.
NEAR = 10.0**-PLACES

DOCUMENT = "tenant string, length int, terms array<string>, tfs array<int>, place long"
POSTINGS_OF = "tenant string, term string, block long, most int, least int, ids array<{id}>, tfs array<int>, lengths array<int>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tenant, length, distinct terms, their frequencies) of rows (id, tenant, terms)."""
    for batch in batches:
        column = batch.column("terms")
        lengths = np.asarray(pc.list_value_length(column))
        coded = column.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        key, tfs = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + coded.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(key // size, np.arange(len(lengths) + 1)).astype(np.int32))
        found = coded.dictionary.take(pa.array(key % size))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("tenant"), pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(ends, found), pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32)))], ["id", "tenant", "length", "terms", "tfs"]
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a tenant and term of every block of documents (id, tenant, length, terms, tfs, block), or of a part of one that has very many terms."""
    for batch in batches:
        total = np.cumsum(np.asarray(pc.list_value_length(batch.column("terms"))))
        block = batch.column("block").to_numpy()
        at = 0
        while at < batch.num_rows:
            same = at + int(np.argmin(np.append(block[at:], -1) == block[at]))
            end = max(at + 1, min(same, int(np.searchsorted(total, (total[at - 1] if at else 0) + POSTINGS, "right"))))
            part, number = batch.slice(at, end - at), block[at]
            at = end
            listed = part.column("terms")
            counts = np.asarray(pc.list_value_length(listed))
            doc = np.repeat(np.arange(len(counts)), counts)
            if not len(doc):
                continue
            term, tenant = listed.flatten().dictionary_encode(), part.column("tenant").dictionary_encode()
            size = len(term.dictionary)
            key = tenant.indices.to_numpy()[doc].astype(np.int64) * size + term.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key, doc, tfs = key[order], doc[order], part.column("tfs").flatten().to_numpy()[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = pa.array(np.append(starts, len(key)).astype(np.int32))
            lengths = part.column("length").to_numpy()[doc]
            lists = [pa.ListArray.from_arrays(ends, x) for x in (part.column("id").take(pa.array(doc)), pa.array(tfs), pa.array(lengths))]
            names = [tenant.dictionary.take(pa.array(key[starts] // size)), term.dictionary.take(pa.array(key[starts] % size))]
            most, least = np.maximum.reduceat(tfs, starts), np.minimum.reduceat(lengths, starts)
            yield pa.RecordBatch.from_arrays([*names, pa.array(np.full(len(starts), number, np.int64)), pa.array(most), pa.array(least), *lists], ["tenant", "term", "block", "most", "least", "ids", "tfs", "lengths"])


def _scored(k: int | None, k1: float, b: float, kind: pa.DataType):
    """Of a block's posting rows, the queries that ask for it and its gone documents: (qid, id, score), the k best of each query or all."""

    def run(postings: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], kind), "score": pa.array([], pa.float64())})
        gone = asked.column("gone").drop_null()
        asked = asked.filter(pc.is_valid(asked.column("qid")))
        if not postings.num_rows or not asked.num_rows:
            return empty
        postings = postings.combine_chunks()
        lists = {c: postings.column(c).chunk(0) for c in ("ids", "tfs", "lengths")}
        ids, place = np.unique(lists["ids"].flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        live = ~np.isin(ids, gone.to_numpy())
        tf, length = (lists[c].flatten().to_numpy().astype(float) for c in ("tfs", "lengths"))
        ends = np.asarray(lists["ids"].offsets) - lists["ids"].offsets[0].as_py()
        rows: dict[tuple, list[int]] = {}
        for r, name in enumerate(zip(postings.column("tenant").to_pylist(), postings.column("term").to_pylist(), strict=True)):
            rows.setdefault(name, []).append(r)
        qids, query = np.unique(asked.column("qid").to_numpy(), return_inverse=True)
        scores = np.zeros((len(qids), len(ids)))
        idf, mean = (asked.column(c).to_numpy() for c in ("idf", "mean"))
        for j, name in enumerate(zip(asked.column("tenant").to_pylist(), asked.column("term").to_pylist(), strict=True)):
            for r in rows.get(name, ()):
                at = slice(ends[r], ends[r + 1])
                scores[query[j], place[at]] += idf[j] * tf[at] / (tf[at] + k1 * (1 - b + b * length[at] / mean[j]))
        scores = np.where(live[None, :] & (scores > 0), np.round(scores, PLACES), -np.inf)
        n = len(ids) if k is None else min(k, len(ids))
        least = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
        row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        found = scores[row, column]
        order = np.lexsort((column, -found, row))
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < n]
        return pa.table({"qid": qids[row[order]], "id": pa.array(ids[column[order]], kind), "score": found[order]})

    return run


class TextIndex:
    """An index below a shared folder. buckets: folders of terms, and of documents; a change reads and writes those that it touches.

    Documents are (id, text) and may have a tenant; so may queries (qid, text), which then meet documents of their tenant alone. Of rows with one id in a change the longest stays.
    """

    def __init__(self, spark: SparkSession, root: str, id_type: str = "long", buckets: int = 16, k1: float = K1, b: float = B):
        self.spark, self.root, self.buckets, self.k1, self.b = spark, root, buckets, k1, b
        self.schemas = {
            "documents": f"id {id_type}, {DOCUMENT}, bucket int, segment int",
            "postings": POSTINGS_OF.format(id=id_type) + ", bucket int, segment int",
            "counts": "tenant string, term string, df long, bucket int, segment int",
            "sizes": "tenant string, n long, total long, segment int",
            "gone": f"id {id_type}, block long, of int, segment int",
        }
        self.manifest = Manifest(spark, root, "segment int, docs long, gone long")

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _segments(self) -> list:
        return self.manifest.read(self.manifest.latest())

    def _table(self, name: str, segments: list | None = None) -> DataFrame:
        """Rows of a table of these segments, all of the current version unless named."""
        schema = T._parse_datatype_string(self.schemas[name])
        paths = [f"{self.root}/{name}/segment={s.segment}" for s in (self._segments() if segments is None else segments)]
        return self.spark.read.option("basePath", f"{self.root}/{name}").schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, name: str, segment: int, df: DataFrame) -> None:
        out = df.write.mode("overwrite")
        (out.partitionBy("bucket") if "bucket" in df.columns else out).parquet(f"{self.root}/{name}/segment={segment}")

    def _kept(self, df: DataFrame) -> DataFrame:
        """df written below the index, and read again."""
        path = f"{self.root}/scratch/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def _block() -> Column:
        return F.floor(F.col("place") / BLOCK).alias("block")

    def _gone(self, segments: list) -> DataFrame | None:
        """(id, block, of): the documents of each segment that are gone. None without any."""
        marked = [s for s in segments if s.gone]
        return self._table("gone", marked).drop("segment") if marked else None

    def _live(self, documents: DataFrame, segments: list) -> DataFrame:
        gone = self._gone(segments)
        if gone is None:
            return documents
        gone = gone.select(F.col("id").alias("_id"), "of")
        return documents.join(gone, (F.col("id") == F.col("_id")) & (F.col("segment") == F.col("of")), "left_anti")

    def _add(self, segment: int, forward: DataFrame, dead: DataFrame | None) -> int:
        """Writes the documents of a segment, their postings, and what they and the dead add to frequencies and sizes."""
        # rows of a block lie together in a file
        self._write("documents", segment, forward.drop("place").withColumn("place", F.monotonically_increasing_id()))
        stored = self.spark.read.schema(T._parse_datatype_string(self.schemas["documents"].removesuffix(", segment int"))).parquet(f"{self.root}/documents/segment={segment}")
        count = stored.count()
        made = stored.drop("bucket").withColumn("block", self._block()).drop("place").mapInArrow(_blocks, self.schemas["postings"].removesuffix(", bucket int, segment int")).withColumn("bucket", self._bucket("term"))
        spread = F.pmod(F.xxhash64("block"), F.lit(1 + count // WRITTEN))
        self._write("postings", segment, made.repartition(self.buckets * (1 + count // WRITTEN), "bucket", spread).sortWithinPartitions("bucket", "tenant", "term", "block"))
        both = stored.select("tenant", "length", "terms", F.lit(1).alias("sign"))
        if dead is not None:
            both = both.unionByName(dead.select("tenant", "length", "terms", F.lit(-1).alias("sign")))
        df = both.select("tenant", "sign", F.explode("terms").alias("term")).groupBy("tenant", "term").agg(F.sum("sign").alias("df"))
        self._write("counts", segment, df.filter("df <> 0").withColumn("bucket", self._bucket("term")).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "tenant", "term"))
        sizes = both.groupBy("tenant").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("length")).cast("long").alias("total"))
        self._write("sizes", segment, sizes.select("tenant", F.col("n").cast("long").alias("n"), "total").coalesce(1))
        return count

    def change(self, docs: DataFrame | None = None, gone: DataFrame | None = None, text: str = "text") -> int:
        """Adds documents, those of known ids in place of the old ones, and takes away the ids in gone; returns the new version."""
        segments, segment = self._segments(), self.manifest.latest() + 1
        if docs is None:
            docs = self.spark.createDataFrame([], f"{self.schemas['documents'].split(',')[0]}, tenant string, {text} string")
        tenant = F.coalesce(F.col("tenant").cast("string"), F.lit("")) if "tenant" in docs.columns else F.lit("")
        cut = docs.filter("id IS NOT NULL").select("id", tenant.alias("tenant"), terms(F.col(text)).alias("terms"))
        counted = cut.mapInArrow(_counted, self.schemas["documents"].removesuffix(", place long, bucket int, segment int")).withColumn("bucket", self._bucket("id"))
        forward = counted.repartition(self.buckets, "bucket")
        ids = docs.select("id").filter("id IS NOT NULL")
        if not ids.groupBy("id").count().filter("count > 1").isEmpty():
            forward = forward.groupBy("bucket", "id").agg(F.max(F.struct("length", "tenant", "terms", "tfs")).alias("d")).select("id", "d.tenant", "d.length", "d.terms", "d.tfs", "bucket")
        dead = None
        if segments:
            ids = self._kept((ids if gone is None else ids.unionAll(gone.select("id"))).distinct().withColumn("bucket", self._bucket("id")))
            touched = [r.bucket for r in ids.select("bucket").distinct().collect()]
            old = self._table("documents", [s for s in segments if s.docs]).filter(F.col("bucket").isin(touched))
            dead = self._kept(self._live(old, segments).join(ids.select("id"), "id", "left_semi").drop("bucket"))
            self._write("gone", segment, dead.select("id", self._block(), F.col("segment").alias("of")))
        count = self._add(segment, forward, dead)
        marks = dead.count() if dead is not None else 0
        self.manifest.commit(segment, [*((s.segment, s.docs, s.gone) for s in segments), (segment, count, marks)])
        return segment

    def merge(self) -> int:
        """Writes the live documents into one segment, from their stored terms; returns the new version."""
        segments, segment = self._segments(), self.manifest.latest() + 1
        live = self._live(self._table("documents", [s for s in segments if s.docs]), segments)
        count = self._add(segment, live.drop("segment").repartition(self.buckets, "bucket"), None)
        self.manifest.commit(segment, [(segment, count, 0)])
        return segment

    def asked(self, queries: DataFrame, text: str = "text") -> tuple[DataFrame, list[int], bool]:
        """((qid, tenant, term, idf, mean), buckets of the terms, whether it is small): the terms of queries that some document has."""
        tenant = F.coalesce(F.col("tenant").cast("string"), F.lit("")) if "tenant" in queries.columns else F.lit("")
        wanted = queries.select("qid", tenant.alias("tenant"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
        wanted = self._kept(wanted.withColumn("bucket", self._bucket("term")))
        per = wanted.groupBy("bucket").agg(F.count("*").alias("n")).collect()  # a row a bucket
        buckets, few = [r.bucket for r in per], sum(r.n for r in per) <= FEW
        segments = self._segments()
        known = self._table("counts", segments).filter(F.col("bucket").isin(buckets)).groupBy("tenant", "term").agg(F.sum("df").alias("df")).filter("df > 0")
        sizes = self._table("sizes", segments).groupBy("tenant").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
        idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
        asked = (F.broadcast(wanted) if few else wanted).join(known, ["tenant", "term"]).join(sizes, "tenant")
        return self._kept(asked.select("qid", "tenant", "term", idf, "mean")), buckets, few

    def part(self, tf: str, length: str) -> Column:
        """What a term adds to a score."""
        return F.col("idf") * F.col(tf) / (F.col(tf) + self.k1 * (1 - self.b + self.b * F.col(length) / F.col("mean")))

    def bounds(self, asked: DataFrame, buckets: list[int], few: bool) -> DataFrame:
        """(qid, segment, block, bound): what a document of a block can score at most."""
        rows = self._postings(buckets).select("tenant", "term", "segment", "block", "most", "least")
        met = rows.join(F.broadcast(asked) if few else asked, ["tenant", "term"])
        return met.groupBy("qid", "segment", "block").agg(F.sum(self.part("most", "least")).alias("bound"))

    def _postings(self, buckets: list[int]) -> DataFrame:
        return self._table("postings", [s for s in self._segments() if s.docs]).filter(F.col("bucket").isin(buckets))

    def scores(self, asked: DataFrame, buckets: list[int], few: bool, blocks: DataFrame, k: int | None = None) -> DataFrame:
        """(qid, id, score) of the live documents in the blocks (qid, segment, block): the k best of each query and block, or all."""
        segments = self._segments()
        q_parts = max(1, -(-asked.select("qid").distinct().count() // QUERY_BLOCK))
        part = F.pmod(F.xxhash64("qid"), F.lit(q_parts)).cast("int").alias("part")
        every = F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("part")
        keys = ["segment", "block", "part"]
        wanted, here = asked.select("tenant", "term").distinct(), blocks.select("segment", "block").distinct()
        if sum(1 + s.docs // BLOCK for s in segments) <= FEW:
            here = F.broadcast(here)
        rows = self._postings(buckets).join(F.broadcast(wanted) if few else wanted, ["tenant", "term"], "left_semi").join(here, ["segment", "block"], "left_semi")
        left = rows.select("segment", "block", "tenant", "term", "ids", "tfs", "lengths", every)
        id_type = T._parse_datatype_string(self.schemas["gone"])["id"].dataType
        right = blocks.join(F.broadcast(asked) if few else asked, "qid").select("segment", "block", part, "qid", "tenant", "term", "idf", "mean", F.lit(None).cast(id_type).alias("gone"))
        gone = self._gone(segments)
        if gone is not None:
            none = [F.lit(None).cast(t).alias(c) for c, t in (("qid", "long"), ("tenant", "string"), ("term", "string"), ("idf", "double"), ("mean", "double"))]
            right = right.unionByName(gone.select(F.col("of").alias("segment"), "block", every, *none, F.col("id").alias("gone")).join(here, ["segment", "block"], "left_semi"))
        score = _scored(k, self.k1, self.b, to_arrow_type(id_type))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, f"qid long, id {id_type.simpleString()}, score double")

    def survivors(self, bounds: DataFrame, lead: DataFrame, k: int) -> DataFrame:
        """Blocks outside of the lead that can hold one of the k best: their bound reaches the k-th best score of the lead."""
        floor = lead.filter(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
        rest = bounds.filter(F.col("nth") > LEAD).join(floor, "qid", "left")
        return rest.filter(F.col("bound") >= F.coalesce(F.col("floor"), F.lit(0.0)) - NEAR).select("qid", "segment", "block")

    def topk(self, queries: DataFrame, k: int = 20, text: str = "text", keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(qid, id, score, rank): the k best live documents of each query; equal scores in order of ids.

        keep: takes rows (qid, id, score) and leaves those that a filter lets pass; it holds before the k are chosen.
        """
        asked, buckets, few = self.asked(queries, text)
        score = lambda blocks: self.scores(asked, buckets, few, blocks, k) if keep is None else keep(self.scores(asked, buckets, few, blocks))
        order = Window.partitionBy("qid").orderBy(F.desc("bound"), "segment", "block")
        ranked = self._kept(self.bounds(asked, buckets, few).withColumn("nth", F.row_number().over(order)))
        lead = self._kept(top_k(score(ranked.filter(F.col("nth") <= LEAD).select("qid", "segment", "block")), k))
        return top_k(lead.drop("rank").unionByName(score(self.survivors(ranked, lead, k))), k)


def best_fields(indexes: Mapping[str, TextIndex], boosts: Mapping[str, float], queries: DataFrame, k: int = 20, more: DataFrame | None = None) -> DataFrame:
    """The k best documents by the best of their fields, each an index of its own, times its boost; more are scores (qid, id, score) of other fields, boosted already.

    A document among the k best is among the k best of its best field: whatever is before it there is before it here. So k of each field are enough.
    """
    every = more.select("qid", "id", "score") if more is not None else None
    for name, index in indexes.items():
        one = index.topk(queries, k).select("qid", "id", F.round(F.col("score") * boosts[name], PLACES).alias("score"))
        every = one if every is None else every.unionByName(one)
    return top_k(every.groupBy("qid", "id").agg(F.max("score").alias("score")), k)
