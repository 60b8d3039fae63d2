"""A stored vector index: coarse k-means lists in folders, probing, exact scores of what is probed, and exact search by bounds.

Lists are fitted on at most SAMPLE vectors, and every vector is put into the list of its nearest centroid. A search takes for each query the `probes` lists of nearest
centroids, reads their folders alone, and scores their vectors exactly; long lists are dealt over tasks by their size. Where exact results are asked for, a second pass takes those other lists that
can still hold one of the k best: no vector of a list scores above q.c + |q| r, r being the list's radius around its centroid c. How many lists that spares depends on how far the vectors cluster;
calibrate() finds the fewest probes that reach a recall against brute force.

A change is a segment, as in the text index: vectors that come, and marks for ids that go or come anew. Filters such as a domain hold inside of the search.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.store import Manifest

from .retrieval import QUERY_BLOCK, VECTOR_BLOCK, _block_scores, dense_topk, top_k

#: Vectors that lists are fitted on, at most; turns of fitting; queries that recall is measured with, at most.
SAMPLE, TURNS, MEASURED = 20_000, 8, 512
#: Marks up to this number are broadcast.
FEW = 200_000


def fit(vectors: np.ndarray, lists: int, turns: int = TURNS, seed: int = 0) -> np.ndarray:
    """Centroids of a sample: at most `lists`, each the mean of the vectors nearest to it."""
    if not len(vectors):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    distinct = np.unique(vectors, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:lists]].astype(float)
    for _ in range(turns):
        near = nearest(vectors, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, vectors)
        count = np.bincount(near, minlength=len(centroids))[:, None]
        centroids = np.where(count > 0, sums / np.maximum(count, 1), centroids)
    return centroids


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the n nearest centroids of each row, nearest first."""
    return np.argsort(_squares(x, centroids), axis=1, kind="stable")[:, :n]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vector")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class VectorIndex:
    """An index of (id, vector) and further columns below a shared folder; all vectors have one length, null vectors are left out."""

    def __init__(self, spark: SparkSession, root: str, schema: str = "id long, vector array<float>", lists: int = 64):
        self.spark, self.root, self.lists = spark, root, lists
        self.columns = T._parse_datatype_string(schema).names
        self.schemas = {"vectors": f"{schema}, list int, segment int", "sizes": "list int, n long, radius double, segment int", "gone": "id long, segment int", "centroids": "list int, vector array<double>"}
        self.manifest = Manifest(spark, root, "segment int, rows long, gone long")

    def _segments(self) -> list:
        return self.manifest.read(self.manifest.latest())

    def _table(self, name: str, segments: list) -> DataFrame:
        schema = T._parse_datatype_string(self.schemas[name])
        paths = [f"{self.root}/{name}/segment={s.segment}" for s in segments]
        return self.spark.read.option("basePath", f"{self.root}/{name}").schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _kept(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/scratch/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.schema(self.schemas["centroids"]).parquet(f"{self.root}/centroids").orderBy("list").collect()  # a row a list
        return np.array([r.vector for r in rows], float)

    def _fit(self, rows: DataFrame) -> None:
        size = rows.count()
        part = rows.select("vector").sample(min(1.0, 1.2 * SAMPLE / max(1, size)), 7).limit(SAMPLE) if size > SAMPLE else rows.select("vector")
        made = fit(np.array([r.vector for r in part.collect()], float), self.lists)
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(made)], self.schemas["centroids"]).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centroids")

    def _live(self, rows: DataFrame, segments: list) -> DataFrame:
        marked = [s for s in segments if s.gone]
        if not marked:
            return rows
        gone = self._table("gone", marked).groupBy("id").agg(F.max("segment").alias("before")).withColumnRenamed("id", "_id")
        gone = F.broadcast(gone) if sum(s.gone for s in marked) <= FEW else gone
        return rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("before")), "left_anti")

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Adds vectors, those of known ids in place of the old ones, and takes away the ids in gone; returns the new version. The first change fits the lists. Ids are unique in rows."""
        segments, segment = self._segments(), self.manifest.latest() + 1
        if rows is None:
            rows = self.spark.createDataFrame([], T._parse_datatype_string(self.schemas["vectors"])).drop("list", "segment")
        rows = rows.filter("id IS NOT NULL AND vector IS NOT NULL").select(*self.columns)
        if not any(s.rows for s in segments):
            self._fit(rows)
        centroids = self.centroids()

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch)
                    near = nearest(x, centroids, 1)[:, 0]
                    away = np.sqrt(np.square(x - centroids[near]).sum(1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away)], [*batch.schema.names, "list", "away"])

        schema = self.schemas["vectors"].removesuffix(", segment int") + ", away double"
        placed = self._kept(rows.mapInArrow(listed, schema) if len(centroids) else self.spark.createDataFrame([], schema))
        sizes = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/sizes/segment={segment}")
        count = placed.count()
        spread = F.pmod(F.xxhash64("id"), F.lit(1 + count // (VECTOR_BLOCK * self.lists * 16)))
        placed.drop("away").repartition("list", spread).write.mode("overwrite").partitionBy("list").parquet(f"{self.root}/vectors/segment={segment}")
        marks = 0
        if segments:
            ids = rows.select("id") if gone is None else rows.select("id").unionAll(gone.select("id").filter("id IS NOT NULL"))
            ids.distinct().write.mode("overwrite").parquet(f"{self.root}/gone/segment={segment}")
            marks = self.spark.read.schema("id long").parquet(f"{self.root}/gone/segment={segment}").count()
        self.manifest.commit(segment, [*((s.segment, s.rows, s.gone) for s in segments), (segment, count, marks)])
        return segment

    def _ranked(self, queries: DataFrame, centroids: np.ndarray, radius: np.ndarray, names: list[str]) -> DataFrame:
        """(qid, list, place, bound) and names: every list of a query by nearness, and what its vectors score at most."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, n = _matrix(batch), len(centroids)
                order = nearest(x, centroids, n)
                most = x @ centroids.T + np.sqrt((x * x).sum(1))[:, None] * radius[None, :]
                taken = pa.array(np.repeat(np.arange(len(x)), n))
                columns = [batch.column(c).take(taken) for c in ("qid", *names)]
                places = np.tile(np.arange(n, dtype=np.int32), len(x))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(order.ravel().astype(np.int32)), pa.array(places), pa.array(np.take_along_axis(most, order, 1).ravel())], ["qid", *names, "list", "place", "bound"])

        kinds = "".join(f"{c} {queries.schema[c].dataType.simpleString()}, " for c in names)
        return queries.mapInArrow(run, f"qid long, {kinds}list int, place int, bound double")

    def _scored(self, queries: DataFrame, chosen: DataFrame, k: int, other: bool, within: str | None, segments: list, sizes: dict[int, int]) -> DataFrame:
        """(qid, id, score): the k best of the chosen (qid, list), by blocks of lists and queries."""
        names = [within] if within else []
        lists = [r.list for r in chosen.select("list").distinct().collect()]  # bounded by the number of lists
        parts = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for l in lists for x in (l, max(1, -(-sizes.get(l, 0) // VECTOR_BLOCK))))), F.col("list")), F.lit(1)) if lists else F.lit(1)
        q_parts = max(1, -(-queries.count() // QUERY_BLOCK))
        stored = self._live(self._table("vectors", [s for s in segments if s.rows]).filter(F.col("list").isin(lists)), segments)
        left = stored.select("id", F.col("vector").cast("array<double>").alias("vector"), *names, "list", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("q_part"))
        right = chosen.select("qid", "list").join(queries.select("qid", F.col("vector").cast("array<double>").alias("vector"), *names), "qid")
        right = right.select("qid", "vector", *names, "list", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.pmod(F.xxhash64("qid"), F.lit(q_parts)).cast("int").alias("q_part"))
        if within:
            left, right = left.filter(F.col(within).isNotNull()), right.filter(F.col(within).isNotNull())
        keys = ["list", "part", "q_part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_scores(k, other, within), "qid long, id long, score double")

    def search(self, queries: DataFrame, k: int = 20, probes: int = 8, other: bool = False, within: str | None = None, exact: bool = False) -> DataFrame:
        """(qid, id, score, rank): the k vectors of greatest dot product with each query (qid, vector), among the probed lists; exact: among all.

        other: a query doesn't find the vector of its own id. within: a column of both that must be the same.
        """
        segments, queries = self._segments(), queries.filter("vector IS NOT NULL")
        if not any(s.rows for s in segments):
            return self.spark.createDataFrame([], "qid long, id long, score double, rank int")
        centroids = self.centroids()
        found = {r.list: (r.n, r.radius) for r in self._table("sizes", segments).groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()}  # a row a list
        radius = np.array([found.get(c, (0, 0.0))[1] for c in range(len(centroids))])
        sizes = {c: n for c, (n, _) in found.items()}
        ranked = self._kept(self._ranked(queries.select("qid", "vector"), centroids, radius, []))
        first = self._kept(top_k(self._scored(queries, ranked.filter(F.col("place") < probes), k, other, within, segments, sizes), k))
        if not exact:
            return first
        floor = first.filter(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
        rest = ranked.filter(F.col("place") >= probes).join(floor, "qid", "left").filter(F.coalesce(F.col("bound") >= F.col("floor") - 1e-6, F.lit(True)))
        more = self._scored(queries, rest.select("qid", "list"), k, other, within, segments, sizes)
        return top_k(first.drop("rank").unionByName(more), k)

    def recall(self, queries: DataFrame, k: int, probes: int, other: bool = False) -> float:
        """The share of the k best that a search finds; a tie at the k-th score counts as found."""
        vectors = self._live(self._table("vectors", [s for s in self._segments() if s.rows]), self._segments()).select("id", F.col("vector").cast("array<double>").alias("vector"))
        best = dense_topk(queries.select("qid", F.col("vector").cast("array<double>").alias("vector")), vectors, k, other)
        per = best.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        got = self.search(queries, k, probes, other).join(per, "qid").filter(F.col("score") >= F.col("least"))
        return got.count() / max(1, best.count())

    def calibrate(self, queries: DataFrame, k: int = 20, least: float = 0.9, other: bool = False) -> int:
        """The fewest probes, by doubling, that reach a recall on at most MEASURED of the queries."""
        part, probes = self._kept(queries.limit(MEASURED)), 1
        while probes < self.lists and self.recall(part, k, probes, other) < least:
            probes *= 2
        return min(probes, self.lists)
