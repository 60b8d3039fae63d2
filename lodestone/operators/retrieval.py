"""Search for batches of queries: exact vector top-k, BM25, fusion, merges and filters.

All queries of a batch are rows of one DataFrame keyed by qid. Ranks order by score, then by id, so results are the same on every run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import term_count, terms

K1, B, RRF_K = 1.2, 0.75, 60
#: Vectors and queries that meet in one task.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 1024
LOW_QUALITY = 0.45
PLACES = 6


def top_k(scored: DataFrame, k: int, id: str = "id", score: str = "score") -> DataFrame:
    """The k best rows of each qid, with their rank."""
    order = Window.partitionBy("qid").orderBy(F.desc(score), F.asc(id))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block_scores(k: int, other: bool, within: str | None):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, qids = vectors.column("id").to_numpy(), queries.column("qid").to_numpy()
        empty = pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(ids) or not len(qids):
            return empty
        matrix = lambda t: t.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(t.num_rows, -1)
        scores = np.round(matrix(queries) @ matrix(vectors).T, PLACES)
        if other:
            scores[qids[:, None] == ids[None, :]] = -np.inf
        if within:
            label = lambda t: t.column(within).to_numpy()
            scores[label(queries)[:, None] != label(vectors)[None, :]] = -np.inf
        # all that reach the k-th score, ties with it too; of them k stay by id
        n = min(k, len(ids))
        least = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
        row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        found, named = scores[row, column], ids[column]
        order = np.lexsort((named, -found, row))
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[place < n]
        return pa.table({"qid": qids[row[order]], "id": named[order], "score": found[order]})

    return run


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 20, other: bool = False, within: str | None = None) -> DataFrame:
    """(qid, id, score, rank): the k vectors (id, vector) of greatest dot product with each query (qid, vector).

    Exact, by blocks: every block of vectors meets every block of queries in a task of its own, which hands on k rows a
    query. other: a query doesn't find the vector of its own id. within: a column of both
    that must be the same, such as a domain; the k are those of it, and null is the same as nothing. All vectors have one length; null vectors are left out.
    """
    vectors, queries = vectors.filter(F.col("vector").isNotNull()), queries.filter(F.col("vector").isNotNull())
    names = [within] if within else []
    if within:
        vectors, queries = vectors.filter(F.col(within).isNotNull()), queries.filter(F.col(within).isNotNull())
    parts, q_parts = (max(1, -(-df.count() // size)) for df, size in ((vectors, VECTOR_BLOCK), (queries, QUERY_BLOCK)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = F.col("vector").alias("vector")  # queries may come from the vectors
    left = vectors.select("id", own, *names, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), spread(q_parts).alias("q_part"))
    right = queries.select("qid", own, *names, spread(parts).alias("part"), F.pmod(F.xxhash64("qid"), F.lit(q_parts)).cast("int").alias("q_part"))
    met = left.groupBy("part", "q_part").cogroup(right.groupBy("part", "q_part"))
    return top_k(met.applyInArrow(_block_scores(k, other, within), "qid long, id long, score double"), k)


#: Documents that have a common query term are scored over this many parts of it.
TERM_PARTS = 8


def bm25_scores(queries: DataFrame, docs: DataFrame, text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, score): BM25 of docs (id, text) for queries (qid, text), for pairs that share a term.

    Where both have a column tenant, queries meet documents of their tenant alone, and sizes and frequencies are those of it.
    """
    own = ["tenant"] if "tenant" in docs.columns and "tenant" in queries.columns else []
    wanted = queries.select("qid", *own, F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    sizes = docs.groupBy(*own).agg(F.count("*").alias("n"), F.avg(term_count(F.col(text))).alias("mean"))
    # terms are cut out of a text once; only those of queries go on
    # the length is known before terms become rows, which then don't carry the whole array
    listed = docs.select("id", *own, term_count(F.col(text)).alias("length"), terms(F.col(text)).alias("terms")).select("id", *own, "length", F.explode("terms").alias("term"))
    postings = listed.join(wanted.select(*own, "term").distinct(), [*own, "term"], "left_semi").groupBy(*own, "term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    known = postings.groupBy(*own, "term").agg(F.count("*").alias("df"))
    if own:
        idf = known.join(sizes, own)
    else:
        idf = known.withColumn("one", F.lit(1)).join(F.broadcast(sizes.withColumn("one", F.lit(1))), "one")  # one row of sizes
    idf = idf.select(*own, "term", "mean", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    # a term of many documents is dealt over parts; queries go to all of them
    asked = wanted.join(idf, [*own, "term"]).withColumn("part", F.explode(F.array(*map(F.lit, range(TERM_PARTS)))))
    held = postings.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(TERM_PARTS)).cast("int"))
    return asked.join(held, [*own, "term", "part"]).groupBy("qid", "id").agg(F.round(F.sum(part), PLACES).alias("score"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 20, text: str = "text") -> DataFrame:
    return top_k(bm25_scores(queries, docs, text), k)


def keyword_scores(queries: DataFrame, docs: DataFrame, field: str) -> DataFrame:
    """(qid, id, score): BM25 of keyword fields, whose values (one or an array) count as whole terms: a query must equal one."""
    own = ["tenant"] if "tenant" in docs.columns and "tenant" in queries.columns else []
    values = F.col(field) if docs.schema[field].dataType.simpleString().startswith("array") else F.array(F.col(field))
    listed = docs.select("id", *own, F.explode(F.array_distinct(values)).alias("term"))
    wanted = queries.select("qid", *own, F.col("text").alias("term"))
    sizes = docs.groupBy(*own).agg(F.count("*").alias("n"))
    known = listed.join(wanted.select(*own, "term").distinct(), [*own, "term"], "left_semi").groupBy(*own, "term").agg(F.count("*").alias("df"))
    idf = known.join(sizes, own) if own else known.join(F.broadcast(sizes), F.lit(True))  # one row of sizes
    # a keyword is one term of norm 1, so its frequency part is constant
    idf = idf.select(*own, "term", F.round(F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) / (1 + K1), PLACES).alias("score"))
    return wanted.join(idf, [*own, "term"]).join(listed, [*own, "term"]).select("qid", "id", "score")


#: Boosts of the fields of chunks and of documents; of chunks the last three are keyword fields.
CHUNK_FIELDS = {"content": 3.0, "embedding_text": 2.0, "title": 2.0, "heading_path": 1.0}
CHUNK_KEYWORDS = {"keywords": 2.0, "tags": 1.0, "languages": 1.0}
DOCUMENT_FIELDS = {"title": 3.0, "content": 1.0}


def best_fields(queries: DataFrame, docs: DataFrame, boosts: Mapping[str, float], k: int = 20, keywords: Mapping[str, float] | None = None) -> DataFrame:
    """The k best documents by the best of their fields, each field's BM25 times its boost; keywords are fields of whole terms."""
    own = ["tenant"] if "tenant" in docs.columns else []
    every = None
    for name, boost in [*boosts.items(), *(keywords or {}).items()]:
        if keywords and name in keywords:
            one = keyword_scores(queries, docs, name)
        else:
            one = bm25_scores(queries, docs.select("id", *own, F.col(name).alias("text")))
        one = one.withColumn("score", F.round(F.col("score") * boost, PLACES))
        every = one if every is None else every.unionByName(one)
    return top_k(every.groupBy("qid", "id").agg(F.max("score").alias("score")), k)


def bm25_filtered(queries: DataFrame, docs: DataFrame, k: int = 20, text: str = "text", keep: Column | None = None) -> DataFrame:
    """bm25_topk of queries (qid, text, tenant) over the documents of their tenant, of which `keep` says who counts; both before scoring."""
    if "tenant" not in queries.columns or "tenant" not in docs.columns:
        raise ValueError("a search needs a tenant")
    return top_k(bm25_scores(queries, docs if keep is None else docs.filter(keep), text), k)


def neighbours(queries: DataFrame, vectors: DataFrame, k: int = 4, least: float = 0.5, other_domain: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k nearest of `least` or more that are of another page (and domain) than the query's own vector.

    The search takes four times as many and k stay, as the pages are looked at afterwards.
    """
    found = dense_topk(queries.select("qid", "vector"), vectors.select("id", "vector"), 4 * k, other=True).drop("rank")
    own = queries.select("qid", F.col("page").alias("_page"), F.col("domain").alias("_domain"))
    told = found.filter(F.col("score") >= least).join(vectors.select("id", "page", "domain"), "id").join(own, "qid")
    told = told.filter(~F.col("page").eqNullSafe(F.col("_page")))
    return top_k((told.filter(~F.col("domain").eqNullSafe(F.col("_domain"))) if other_domain else told).select("qid", "id", "score"), k)


def rrf(lists: DataFrame, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of lists (qid, source, id, rank, score): qid, id, score, source_scores, rank.

    Ties follow the order in which sources and ranks name the item first.
    """
    merged = lists.groupBy("qid", "id").agg(
        F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"),
        F.min(F.struct("source_order", "rank")).alias("first"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", F.col("score").alias("value"))))).alias("source_scores"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "id")
    out = merged.withColumn("rank", F.row_number().over(order)).drop("first")
    return out if limit is None else out.filter(F.col("rank") <= limit)


def named(ranked: DataFrame, source: str, order: int) -> DataFrame:
    return ranked.select("qid", "id", "rank", "score", F.lit(source).alias("source"), F.lit(order).alias("source_order"))


def hybrid(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, limit: int = 20) -> DataFrame:
    """dense and sparse (qid, id, rank, score) fused; without sparse rows the dense order stands."""
    return rrf(named(dense, "dense", 0).unionByName(named(sparse, "bm25", 1)), k, limit)


def merge_hits(first: DataFrame, second: DataFrame) -> DataFrame:
    """Hits of both lists once each, with their greatest score."""
    return first.select("qid", "id", "score").unionByName(second.select("qid", "id", "score")).groupBy("qid", "id").agg(F.max("score").alias("score"))


def ladder_filter(domain: Column | None = None, version: Column | None = None, pinned: Column | None = None, excluded: Column | None = None) -> Column:
    """Must have this domain and version and one of the pinned keys, must not have an excluded key; empty filters pass.

    The columns domain, version and doc_key are those of the row; a row without key is never excluded.
    """
    out = F.lit(True)
    for name, value in (("domain", domain), ("version", version)):
        if value is not None:
            out = out & ((F.coalesce(value, F.lit("")) == "") | F.coalesce(F.col(name) == value, F.lit(False)))
    key = F.coalesce(F.col("doc_key"), F.lit(""))
    if pinned is not None:
        out = out & ((F.size(pinned) == 0) | F.array_contains(pinned, key))
    if excluded is not None:
        out = out & ~F.array_contains(excluded, key)
    return out


def low_quality(queries: DataFrame, hits: DataFrame, least: float = LOW_QUALITY) -> DataFrame:
    """(qid, low): whether a query has no hit or none of a score of at least `least`."""
    best = hits.groupBy("qid").agg(F.max("score").alias("best"))
    return queries.select("qid").join(best, "qid", "left").select("qid", F.coalesce(F.col("best") < least, F.lit(True)).alias("low"))


def domain_mode(queries: DataFrame, vectors: DataFrame, mode: str, k: int, domain: str = "domain", other: bool = False, least: float = LOW_QUALITY) -> DataFrame:
    """dense_topk of queries and vectors, which have a domain, by mode: hard, soft, or hybrid.

    hard searches the domain alone; soft searches all; hybrid searches the domain, and all where that is of low quality.
    """
    if mode == "soft":
        return dense_topk(queries, vectors, k, other)
    inside = dense_topk(queries, vectors, k, other, domain)
    if mode == "hard":
        return inside
    if mode != "hybrid":
        raise ValueError(f"unknown mode {mode}")
    low = low_quality(queries, inside, least).filter("low").select("qid")
    extra = dense_topk(queries.join(low, "qid", "left_semi"), vectors, k, other)
    return top_k(merge_hits(inside, extra), k)


LETTERS, EMBEDDED = 32, 100
FIRST = re.compile(r"\b\w")


def letter_counts(texts: list[str], size: int = LETTERS) -> np.ndarray:
    """The default embedder, without a model: terms counted by their first letter, normed to length 1."""
    counts = np.stack([np.bincount(np.array([ord(c) % size for c in FIRST.findall(t)], np.int64), minlength=size) for t in texts]).astype(float)
    return counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-300)


def embed(rows: DataFrame, id: str, text: str = "text", model: Callable[[list[str]], np.ndarray] = letter_counts) -> DataFrame:
    """(id, vector) of each row: model turns EMBEDDED lower-cased texts at a time into a matrix; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, EMBEDDED):
                part = batch.slice(at, EMBEDDED)
                made = np.asarray(model(part.column(1).to_pylist()), float)
                ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], ["id", "vector"])

    slim = rows.select(F.col(id).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, vector array<double>")


def rerank(hits: DataFrame, model: Column | None = None, ready: Column | None = None) -> DataFrame:
    """hits (qid, id, score) with raw, ranking and rank: by the reranker's score, or in search order where it isn't ready.

    model is the score of a pair, ready whether the reranker answered for the query; after a fallback both scores are zero.
    """
    ok = F.lit(model is not None) if ready is None else ready
    raw = F.when(ok, F.coalesce(model if model is not None else F.lit(0.0), F.lit(0.0))).otherwise(0.0)
    out = hits.withColumn("fallback", ~ok).withColumn("raw", raw).withColumn("ranking", F.col("raw"))
    order = Window.partitionBy("qid").orderBy(F.desc("ranking"), F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order))


def pool_size(top_k: int, final: int, least: int = 50) -> tuple[int, int]:
    """How many hits a search asks for, and how many of each source fusion takes."""
    wide = max(top_k, final)
    return wide, max(least, wide)


def expanded(k: int) -> int:
    """The k of a search that is made wider."""
    return 2 * k
