"""Queries over search: vectors, BM25, fusion, filters, boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators import evidence, metrics, retrieval, text_index

from .inputs import RETRIEVED, retrieved, table, written_once

K, TOP = 20, 10


def _vectors(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The query set (every 20th id) and all vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return v.filter(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), "vector", F.col("label").alias("qlabel")), v


def _dense(spark, sf_dir: str, k: int = K) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    return retrieval.dense_topk(q.select("qid", "vector"), v.select("id", "vector"), k, other=True)


SCORES = """q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 20 = 0),
hits AS (SELECT q.qid, e.vec_id AS id, round(list_inner_product(q.v, e.embedding::DOUBLE[]), 6) AS score, e.label = q.label AS matches FROM q, embeddings e WHERE e.vec_id <> q.qid)"""
DENSE = SCORES + """,
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hits QUALIFY rank <= 20)"""


def dense_topk(spark, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("qid", "id", "score", "rank")


def _texts(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return q, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def title() -> Column:
    return F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)


#: Fields of documents that have an index.
FIELDS = {"text": lambda: F.col("text"), "title": title, "embedding_text": lambda: F.concat_ws(" ", "lang", title()), "lang": lambda: F.col("lang")}


def text_index_of(spark, sf_dir: str, field: str = "text") -> text_index.TextIndex:
    """The stored index of a field of the documents, which the queries over them share."""

    def make(root: str) -> text_index.TextIndex:
        out = text_index.TextIndex(spark, root)
        out.change(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), FIELDS[field]().alias("text")))
        return out

    return written_once(spark, sf_dir, f"text-index-{field}", ("documents",), make)


BM25 = r"""wanted AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS term FROM benchmark),
split AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+') AS terms FROM documents),
sizes AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM split),
listed AS (SELECT id, len(terms) AS length, unnest(terms) AS term FROM split),
postings AS (SELECT term, id, length, count(*) AS tf FROM listed WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
idf AS (SELECT term, mean, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, sizes GROUP BY term, mean, n),
matched AS (SELECT qid, id, round(sum(idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM wanted JOIN idf USING (term) JOIN postings USING (term) GROUP BY qid, id),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM matched QUALIFY rank <= 20)"""
LETTERS = r""",
counted AS (SELECT 'd' AS kind, id, unicode(term) % 32 AS dim, count(*) AS n FROM listed GROUP BY ALL
  UNION ALL SELECT 'q', item_id, unicode(term) % 32, count(*) FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS term FROM benchmark) GROUP BY ALL),
norms AS (SELECT kind, id, sqrt(sum(n * n)) AS norm FROM counted GROUP BY ALL),
unit AS (SELECT kind, id, dim, n / norm AS w FROM counted JOIN norms USING (kind, id)),
near AS (SELECT b.item_id AS qid, d.doc_id AS id, round(coalesce(s, 0), 6) AS score FROM benchmark b CROSS JOIN documents d
  LEFT JOIN (SELECT q.id AS qid, d.id, sum(q.w * d.w) AS s FROM unit q JOIN unit d ON q.kind = 'q' AND d.kind = 'd' AND q.dim = d.dim GROUP BY ALL) x ON x.qid = b.item_id AND x.id = d.doc_id),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 20),
lists AS (SELECT qid, id, rank, 0 AS place FROM dense UNION ALL SELECT qid, id, rank, 1 FROM bm25),
fused AS (SELECT qid, id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score, min((place, rank)) AS first FROM lists GROUP BY qid, id),
hybrid AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS rank FROM fused QUALIFY rank <= 20)"""


def bm25_topk(spark, sf_dir: str) -> DataFrame:
    return text_index_of(spark, sf_dir).topk(_texts(spark, sf_dir)[0], K)


def best_fields(spark, sf_dir: str) -> DataFrame:
    boosts = {"title": 3.0, "text": 1.0}
    return text_index.best_fields({f: text_index_of(spark, sf_dir, f) for f in boosts}, boosts, _texts(spark, sf_dir)[0], K)


def _both(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, d = _texts(spark, sf_dir)
    near = retrieval.dense_topk(retrieval.embed(q, "qid").withColumnRenamed("id", "qid"), retrieval.embed(d, "id"), K)
    return near, text_index_of(spark, sf_dir).topk(q, K)


def hybrid_search(spark, sf_dir: str) -> DataFrame:
    return retrieval.hybrid(*_both(spark, sf_dir), limit=K).select("qid", "id", "score", "rank")


def rrf_sources(spark, sf_dir: str) -> DataFrame:
    """The provider scores that stand behind each fused hit."""
    out = retrieval.hybrid(*_both(spark, sf_dir), limit=K)
    return out.select("qid", "id", F.col("source_scores")["dense"].alias("dense"), F.col("source_scores")["bm25"].alias("bm25"))


def hit_merge_max(spark, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    hits = _dense(spark, sf_dir).join(v.select("id", "label"), "id").join(q.select("qid", "qlabel"), "qid")
    inside = hits.filter(F.col("label") == F.col("qlabel"))
    return retrieval.merge_hits(hits, inside.withColumn("score", F.round(F.col("score") + 0.01, 6)))


def _labelled(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, v = _vectors(spark, sf_dir)
    return q.withColumnRenamed("qlabel", "label"), v


def _mode(mode: str):
    def query(spark, sf_dir: str) -> DataFrame:
        return retrieval.domain_mode(*_labelled(spark, sf_dir), mode, TOP, "label", other=True).select("qid", "id", "score", "rank")

    return query


#: Modes in SQL: the best of the domain, and of all where the domain's best is low.
INSIDE = SCORES + """,
inside AS (SELECT * FROM hits WHERE matches QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 10),
low AS (SELECT qid FROM q LEFT JOIN inside USING (qid) GROUP BY qid HAVING coalesce(max(score) < 0.45, true)),
every AS (SELECT * FROM hits WHERE qid IN (SELECT qid FROM low) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 10),
pool AS ({})
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pool QUALIFY rank <= 10"""


def ladder_filter(spark, sf_dir: str) -> DataFrame:
    rows = retrieved(spark, sf_dir).withColumn("domain", F.col("site"))
    none = F.array().cast("array<string>")
    pinned = F.when(F.col("qid") % 3 == 0, F.array(F.lit("apache:doc0"), F.lit("kubernetes:doc1"))).otherwise(none)
    excluded = F.when(F.col("qid") % 3 == 1, F.array(F.lit("apache:doc1"))).otherwise(none)
    wanted = F.when(F.col("qid") % 5 == 0, "apache").otherwise("")
    return rows.filter(retrieval.ladder_filter(wanted, F.lit(None).cast("string"), pinned, excluded)).select("qid", "chunk_id")


def _boosts(spark, sf_dir: str) -> DataFrame:
    rows = evidence.annotated(retrieved(spark, sf_dir), ("apache", "kubernetes"))
    wanted = F.when(F.col("qid") % 2 == 0, F.array(F.lit("apache"), F.lit("prometheus"))).otherwise(F.array(F.lit("kubernetes")))
    return rows.select("qid", "chunk_id", "raw", "recency", scoring.domain_boost(F.col("site"), wanted).alias("domain"), "fit")


def ranking_boosts(spark, sf_dir: str) -> DataFrame:
    rows = _boosts(spark, sf_dir)
    total = scoring.boosted(F.col("raw"), F.col("recency"), F.col("domain"), F.col("fit"), F.lit(1.0))
    best = retrieval.top_k(rows.withColumn("score", F.round(total, 6)), 8, "chunk_id")
    return best.select("qid", "chunk_id", "score", "rank")


def domain_boost(spark, sf_dir: str) -> DataFrame:
    return _boosts(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), F.round(F.sum("raw"), 6).alias("raw"))


def recency_boost(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    factor = scoring.recency(F.col("ts"), F.to_timestamp(F.lit("2024-01-20 12:00:00")), 7)
    return e.select(F.col("event_id").alias("id"), F.round(factor, 9).alias("factor"))


def similar_labels(spark, sf_dir: str) -> DataFrame:
    """Neighbours of at least 0.3 within the query's label: more like this."""
    near = retrieval.dense_topk(*_labelled(spark, sf_dir), TOP, other=True, within="label")
    return near.filter(F.col("score") >= 0.3).select("qid", "id", "score", "rank")


def _judged(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ranked neighbours and the relevant ones: those of the query's label."""
    q, v = _vectors(spark, sf_dir)
    relevant = v.select("id", "label").join(q.select("qid", "qlabel"), F.col("label") == F.col("qlabel")).filter(F.col("id") != F.col("qid"))
    return _dense(spark, sf_dir), relevant.select("qid", "id")


def retrieval_metrics(spark, sf_dir: str) -> DataFrame:
    return metrics.macro(metrics.retrieval_metrics(*_judged(spark, sf_dir), 10))


def retrieval_per_query(spark, sf_dir: str) -> DataFrame:
    out = metrics.retrieval_metrics(*_judged(spark, sf_dir), 5)
    return out.select("qid", *(F.round(c, 6).alias(c) for c in ("hit", "rr", "recall", "ndcg")))


JUDGED = DENSE + """,
relevant AS (SELECT q.qid, e.vec_id AS id FROM embeddings e JOIN q USING (label) WHERE e.vec_id <> q.qid),
need AS (SELECT qid, count(*) AS n FROM relevant GROUP BY qid),
found AS (SELECT qid, min(rank) AS first, count(*) AS hits, sum(1 / log2(rank + 1.0)) AS gain FROM dense JOIN relevant USING (qid, id) WHERE rank <= {k} GROUP BY qid),
each AS (SELECT qid, (first IS NOT NULL)::INT::DOUBLE AS hit, coalesce(1 / first, 0) AS rr, coalesce(hits / n, 0) AS recall,
  coalesce(gain / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1.0))), 0) AS ndcg FROM need LEFT JOIN found USING (qid))"""

QUERIES = {
    "dense_topk": dense_topk,
    "bm25_topk": bm25_topk,
    "bm25_best_fields": best_fields,
    "hybrid_search": hybrid_search,
    "rrf_fusion": rrf_sources,
    "hit_merge_max": hit_merge_max,
    "domain_mode_hard": _mode("hard"),
    "domain_mode_soft": _mode("soft"),
    "domain_mode_hybrid": _mode("hybrid"),
    "ladder_filter": ladder_filter,
    "ranking_boosts": ranking_boosts,
    "domain_boost": domain_boost,
    "recency_boost": recency_boost,
    "similar_labels": similar_labels,
    "retrieval_metrics": retrieval_metrics,
    "retrieval_per_query": retrieval_per_query,
}

_FIELD = r"""split_{f} AS (SELECT doc_id AS id, regexp_extract_all(lower({text}), '[\pL\pN_]+') AS terms FROM documents),
sizes_{f} AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM split_{f}),
postings_{f} AS (SELECT term, id, length, count(*) AS tf FROM (SELECT id, len(terms) AS length, unnest(terms) AS term FROM split_{f}) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
idf_{f} AS (SELECT term, mean, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings_{f}, sizes_{f} GROUP BY term, mean, n),
matched_{f} AS (SELECT qid, id, round({boost} * round(sum(idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6), 6) AS score FROM wanted JOIN idf_{f} USING (term) JOIN postings_{f} USING (term) GROUP BY qid, id)"""
_BOOSTS = f"""WITH {RETRIEVED},
boosts AS (SELECT qid, chunk_id, raw, recency, fit, CASE WHEN qid % 2 = 0 THEN CASE site WHEN 'apache' THEN 0.1 WHEN 'prometheus' THEN 0.05 ELSE 0 END ELSE CASE site WHEN 'kubernetes' THEN 0.1 ELSE 0 END END::DOUBLE AS domain FROM annotated)"""

SQL = {
    "dense_topk": f"WITH {DENSE} SELECT qid, id, score, rank FROM dense",
    "bm25_topk": f"WITH {BM25} SELECT qid, id, score, rank FROM bm25",
    "bm25_best_fields": r"WITH wanted AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS term FROM benchmark), "
    + _FIELD.format(f="a", text="split_part(coalesce(text, ''), chr(10), 1)", boost="3.0::DOUBLE")
    + ", "
    + _FIELD.format(f="b", text="coalesce(text, '')", boost="1.0::DOUBLE")
    + ", best AS (SELECT qid, id, max(score) AS score FROM (SELECT * FROM matched_a UNION ALL SELECT * FROM matched_b) GROUP BY qid, id) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM best QUALIFY rank <= 20",
    "hybrid_search": f"WITH {BM25}{LETTERS} SELECT qid, id, score, rank FROM hybrid",
    "rrf_fusion": f"WITH {BM25}{LETTERS} SELECT h.qid, h.id, d.score AS dense, b.score AS bm25 FROM hybrid h LEFT JOIN dense d USING (qid, id) LEFT JOIN bm25 b USING (qid, id)",
    "hit_merge_max": f"WITH {DENSE} SELECT qid, id, max(CASE WHEN matches THEN round(score + 0.01, 6) ELSE score END) AS score FROM dense GROUP BY qid, id",
    "domain_mode_hard": "WITH " + INSIDE.format("SELECT qid, id, score FROM inside"),
    "domain_mode_soft": "WITH " + INSIDE.format("SELECT qid, id, score FROM hits"),
    "domain_mode_hybrid": "WITH " + INSIDE.format("SELECT qid, id, score FROM inside UNION SELECT qid, id, score FROM every"),
    "ladder_filter": f"""WITH {RETRIEVED} SELECT qid, chunk_id FROM docs WHERE (qid % 5 <> 0 OR site = 'apache')
      AND (qid % 3 <> 0 OR doc_key IN ('apache:doc0', 'kubernetes:doc1')) AND NOT (qid % 3 = 1 AND doc_key = 'apache:doc1')""",
    "ranking_boosts": f"""{_BOOSTS}, total AS (SELECT qid, chunk_id, round(raw + 0.1 * recency + domain + 0.1 * fit + 0.05, 6) AS score FROM boosts)
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM total QUALIFY rank <= 8""",
    "domain_boost": f"{_BOOSTS} SELECT domain, count(*) AS n, round(sum(raw), 6) AS raw FROM boosts GROUP BY domain",
    "recency_boost": "SELECT event_id AS id, round(pow(0.5, greatest(floor((epoch(TIMESTAMP '2024-01-20 12:00:00')::BIGINT - floor(epoch(ts))::BIGINT) / 86400.0), 0) / 7.0), 9) AS factor FROM events",
    "similar_labels": f"WITH {SCORES} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hits WHERE matches AND score >= 0.3 QUALIFY rank <= 10",
    "retrieval_metrics": "WITH " + JUDGED.format(k=10) + " SELECT count(*) AS n, round(avg(hit), 6) AS hit, round(avg(rr), 6) AS rr, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM each",
    "retrieval_per_query": "WITH " + JUDGED.format(k=5) + " SELECT qid, round(hit, 6) AS hit, round(rr, 6) AS rr, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM each",
}
