"""Queries over evaluation: search modes, paired comparisons, cohorts, summaries, caches, filters of vectors and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import answer, scoring
from lodestone.operators import ledger, metrics, retrieval, text_index

from .inputs import LABELS, table
from .search import BM25, LETTERS, SCORES, TOP, _texts, _vectors, text_index_of

K = 20


def _dense(spark, sf_dir: str, k: int) -> DataFrame:
    q, d = _texts(spark, sf_dir)
    return retrieval.dense_topk(retrieval.embed(q, "qid").withColumnRenamed("id", "qid"), retrieval.embed(d, "id"), k)


def _modes(spark, sf_dir: str) -> dict[str, DataFrame]:
    """Ranked hits of every mode; the reranker here is the length of a text, and isn't ready for some queries."""
    q, d = _texts(spark, sf_dir)
    wide, pool = retrieval.pool_size(K, TOP, K)
    dense, sparse = _dense(spark, sf_dir, pool), text_index_of(spark, sf_dir).topk(q, pool)
    fused = retrieval.hybrid(dense, sparse, limit=wide)
    hits = fused.join(d.select("id", F.length(F.coalesce("text", F.lit(""))).alias("length")), "id")
    reranked = retrieval.rerank(hits.select("qid", "id", "score", "length"), F.col("length").cast("double"), F.col("qid") % 7 != 0)
    return {"dense": dense, "sparse": sparse, "hybrid": fused, "rerank": reranked}


def eval_modes(spark, sf_dir: str) -> DataFrame:
    """The first ten of each query and mode, as they are pooled for judging."""
    out = None
    for mode, hits in _modes(spark, sf_dir).items():
        one = hits.filter(F.col("rank") <= TOP).select(F.lit(mode).alias("mode"), "qid", "rank", "id")
        out = one if out is None else out.unionByName(one)
    return out


def rerank_fallback(spark, sf_dir: str) -> DataFrame:
    return _modes(spark, sf_dir)["rerank"].select("qid", "id", "raw", "ranking", "rank", "fallback")


def paired_ab(spark, sf_dir: str) -> DataFrame:
    """Both arms of a comparison over one base of hits: they differ in the boost of the domain alone."""
    q, v = _vectors(spark, sf_dir)
    base = retrieval.dense_topk(q.select("qid", "vector"), v.select("id", "vector"), K, other=True).drop("rank")
    base = base.join(v.select("id", "label"), "id").join(q.select("qid", "qlabel"), "qid")
    own, next_ = F.col("qlabel"), (F.col("qlabel") + 1) % 10
    out = None
    for arm, wanted in (("a", F.array(own)), ("b", F.array(next_, own))):
        boosted = base.withColumn("score", F.round(F.col("score") + scoring.domain_boost(F.col("label"), wanted), 6))
        one = retrieval.top_k(boosted, 5).select(F.lit(arm).alias("arm"), "qid", "id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def _pairs(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    groups = F.array_compact(F.array(F.when(k % 2 == 0, "router_multi").otherwise("router_single"), F.when(k < 0, "noise")))
    return o.select(k.alias("qid"), ((k % 10) / 10.0).alias("recall_a"), ((k % 9) / 9.0).alias("recall_b"), ((k % 7) / 7.0).alias("ndcg_a"), ((k % 6) / 6.0).alias("ndcg_b"), groups.alias("groups"))


def success_criteria(spark, sf_dir: str) -> DataFrame:
    return metrics.success_criteria(_pairs(spark, sf_dir))


def movers(spark, sf_dir: str) -> DataFrame:
    return metrics.movers(_pairs(spark, sf_dir), ["recall", "ndcg"])


def block_rates(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.when(k % 3 == 0, "n").otherwise("q"), k.cast("string")).alias("qid"), (k % 4 < 2).alias("answerable"), F.when(k % 5 != 0, k % 2 == 1).alias("blocked"))
    return metrics.block_rates(rows)


def _runs(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("answerable", "partially_answerable", "not_enough_evidence"))), (i % 3 + 1).cast("int"))
    return e.select((i % 500).alias("prompt_tokens"), (i % 90).alias("completion_tokens"), (i % 4).alias("llm_calls"), (F.round(F.col("value"), 2)).alias("latency_s"), status.alias("status"), (i % 10 == 0).alias("fallback"))


def generation_summary(spark, sf_dir: str) -> DataFrame:
    return metrics.generation_summary(_runs(spark, sf_dir))


def _golden(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    names = F.array(*map(F.lit, LABELS))
    pick = lambda n: F.element_at(names, (n % 5 + 1).cast("int"))
    gold = F.when(i % 3 == 0, F.array(pick(u), pick(u + 1))).when(i % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(u)))
    return e.select(i.alias("qid"), gold.alias("gold"), F.when(i % 6 != 0, pick(u + i % 2)).alias("domain"), (i % 9 != 0).alias("explicit"))


def excluded_domains(spark, sf_dir: str) -> DataFrame:
    return metrics.excluded_domains(_golden(spark, sf_dir)).select("qid", F.round("excluded_ratio", 6).alias("excluded_ratio"))


def golden_join(spark, sf_dir: str) -> DataFrame:
    """Explicitly labelled questions with the predictions that are in the cache."""
    cache = table(spark, sf_dir, "events").filter(F.col("event_id") % 4 != 0).select(F.col("event_id").alias("qid"), F.col("event_type").alias("predicted"))
    return _golden(spark, sf_dir).filter("explicit").join(cache, "qid").select("qid", "predicted", F.array_join("gold", ",").alias("gold"))


def gold_domains(spark, sf_dir: str) -> DataFrame:
    """The domains of wanted chunks, some of which are gone or have none."""
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk_id")).distinct()
    live = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 7 != 0).select(F.col("p_partkey").alias("chunk_id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("domain"))
    return ledger.looked_up(ids, live)


def survival_rate(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"))
    ids = F.transform(F.sequence(F.lit(0), (F.col("qid") % 3).cast("int")), lambda i: F.col("qid") + i * 4000)
    live = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return metrics.survival_rate(ledger.liveness(o.withColumn("ids", ids), live))


def predicted_answerable(spark, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_quantity") / 50).alias("score"))
    return metrics.predicted_answerable(hits, least=3)


KEY = ["sha", "model", "prompt"]


def _cache(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    now = c.select(k.alias("qid"), F.sha2("c_name", 256).alias("sha"), F.lit("m2").alias("model"), F.lit("p1").alias("prompt"))
    old = now.filter(F.col("qid") % 5 != 0).withColumn("model", F.when(F.col("qid") % 3 == 0, "m1").otherwise("m2")).withColumn("prompt", F.when(F.col("qid") % 7 != 0, "p1"))
    return old, now


def cache_freshness(spark, sf_dir: str) -> DataFrame:
    return metrics.fresh(*_cache(spark, sf_dir), KEY).select("qid", "fresh")


def cache_missing(spark, sf_dir: str) -> DataFrame:
    old, now = _cache(spark, sf_dir)
    return now.join(old, "qid", "left_anti").select("qid")


def evaluable(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    found = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    return d.select("doc_id", answer.evaluable(F.col("text"), found).alias("evaluable"))


def label_agreement(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pairs = e.select(F.col("event_type").alias("rule"), F.when(F.col("event_id") % 10 != 0, F.element_at(F.array(*map(F.lit, LABELS)), (F.col("user_id") % 5 + 1).cast("int"))).alias("told"))
    told = pairs.withColumn("rule", F.element_at(F.array(*map(F.lit, LABELS)), (F.length("rule") % 5 + 1).cast("int")))
    return ledger.agreement(told, "rule", "told")


def distinct_pages(spark, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("page")).agg(F.min("l_linenumber").alias("rank"))
    return metrics.distinct_pages(ranked)


def mean_of_known(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value"))
    return e.groupBy("event_type").agg(F.round(metrics.mean_of_known(v), 6).alias("mean"))


def sampled(spark, sf_dir: str) -> DataFrame:
    """How many rows of each group a sample of five takes."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    return ledger.sample_per_group(p, "name", "id", 5, 7).groupBy("name").agg(F.count("*").alias("n"))


def bm25_filtered(spark, sf_dir: str) -> DataFrame:
    """BM25 over the documents of a query's tenant alone, in English alone."""
    q, d = _texts(spark, sf_dir)
    q, d = q.withColumn("tenant", F.col("qid") % 3), d.withColumn("tenant", F.col("id") % 3)
    return retrieval.bm25_filtered(q, d, 10, keep=F.col("lang") == "en").select("qid", "id", "score", "rank")


def bm25_chunks(spark, sf_dir: str) -> DataFrame:
    """All fields of chunks, keyword fields among them; queries are words of texts and whole sources."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("source").alias("keywords"), F.array("lang").alias("tags"), F.array().cast("array<string>").alias("languages"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 4 == 0, "en").otherwise(F.substring_index("text", " ", 3)).alias("text"))
    words = None
    for name, boost in retrieval.CHUNK_KEYWORDS.items():
        one = retrieval.keyword_scores(q, d, name).select("qid", "id", F.round(F.col("score") * boost, retrieval.PLACES).alias("score"))
        words = one if words is None else words.unionByName(one)
    fields = {"content": "text", "embedding_text": "embedding_text", "title": "title", "heading_path": "lang"}
    indexes = {name: text_index_of(spark, sf_dir, field) for name, field in fields.items()}
    return text_index.best_fields(indexes, retrieval.CHUNK_FIELDS, q, 10, words).select("qid", "id", "score", "rank")


def bm25_documents(spark, sf_dir: str) -> DataFrame:
    indexes = {"title": text_index_of(spark, sf_dir, "title"), "content": text_index_of(spark, sf_dir)}
    return text_index.best_fields(indexes, retrieval.DOCUMENT_FIELDS, _texts(spark, sf_dir)[0], 10).select("qid", "id", "score", "rank")


def neighbours(spark, sf_dir: str) -> DataFrame:
    """The nearest vectors of other pages (ten ids a page) and other labels."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.floor(F.col("vec_id") / 10).alias("page"), F.col("label").alias("domain"))
    q = v.filter(F.col("id") % 20 == 0).withColumnRenamed("id", "qid")
    return retrieval.neighbours(q, v, least=0.1, other_domain=True).select("qid", "id", "score", "rank")


QUERIES = {f.__name__: f for f in (eval_modes, rerank_fallback, paired_ab, success_criteria, movers, block_rates, generation_summary, excluded_domains, golden_join, gold_domains, survival_rate, predicted_answerable)}
QUERIES |= {f.__name__: f for f in (cache_freshness, cache_missing, evaluable, label_agreement, distinct_pages, mean_of_known, sampled, bm25_filtered, bm25_chunks, bm25_documents, neighbours)}

_MODES = f"""WITH {BM25}{LETTERS}, hits AS (SELECT qid, h.id, score, rank AS place, CASE WHEN qid % 7 <> 0 THEN length(coalesce(text, '')) ELSE 0 END::DOUBLE AS raw FROM hybrid h JOIN documents ON doc_id = h.id),
  reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, score DESC, id) AS rank FROM hits)"""
_NAMES = "['incident', 'manual', 'api_reference', 'meeting_note', 'planning']"
_GOLDEN = f"""WITH golden AS (SELECT event_id AS qid, event_type, CASE WHEN event_id % 3 = 0 THEN [{_NAMES}[user_id % 5 + 1], {_NAMES}[(user_id + 1) % 5 + 1]] WHEN event_id % 8 = 0 THEN [] ELSE [{_NAMES}[user_id % 5 + 1]] END AS gold,
  CASE WHEN event_id % 6 <> 0 THEN {_NAMES}[(user_id + event_id % 2) % 5 + 1] END AS domain FROM events)"""
_PAIRS = """pairs AS (SELECT o_orderkey AS qid, (o_orderkey % 10) / 10.0::DOUBLE AS ra, (o_orderkey % 9) / 9.0::DOUBLE AS rb, (o_orderkey % 7) / 7.0::DOUBLE AS na, (o_orderkey % 6) / 6.0::DOUBLE AS nb FROM orders)"""
_CACHE = """WITH c AS (SELECT c_custkey AS qid FROM customer), o AS (SELECT qid FROM c WHERE qid % 5 <> 0)"""
_SCORED = r"""split_{f} AS (SELECT id, tenant, regexp_extract_all(lower({f}), '[\pL\pN_]+') AS terms FROM docs), sizes_{f} AS (SELECT tenant, count(*) AS n, avg(len(terms)) AS mean FROM split_{f} GROUP BY tenant),
  postings_{f} AS (SELECT tenant, term, id, length, count(*) AS tf FROM (SELECT tenant, id, len(terms) AS length, unnest(terms) AS term FROM split_{f}) GROUP BY ALL),
  idf_{f} AS (SELECT p.tenant, term, mean, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings_{f} p JOIN sizes_{f} USING (tenant) GROUP BY p.tenant, term, mean, n),
  matched_{f} AS (SELECT qid, id, round({boost}::DOUBLE * round(sum(idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6), 6) AS score FROM wanted w JOIN idf_{f} USING (tenant, term) JOIN postings_{f} USING (tenant, term) GROUP BY qid, id)"""
_WANTED = r"wanted AS (SELECT DISTINCT qid, tenant, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS term FROM q)"
_KEYWORD = "matched_{f} AS (SELECT qid, id, round({boost}::DOUBLE * round(ln(1 + (n - df + 0.5) / (df + 0.5)) / 2.2, 6), 6) AS score FROM q JOIN (SELECT {f} AS text, count(*) AS df FROM docs GROUP BY 1) USING (text) JOIN docs ON docs.{f} = q.text, (SELECT count(*) AS n FROM docs))"


def _best(*names: str) -> str:
    return f"best AS (SELECT qid, id, max(score) AS score FROM ({' UNION ALL '.join(f'SELECT * FROM matched_{n}' for n in names)}) GROUP BY qid, id) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM best QUALIFY rank <= 10"


SQL = {
    "eval_modes": f"""{_MODES} SELECT 'dense' AS mode, qid, rank, id FROM dense WHERE rank <= 10 UNION ALL SELECT 'sparse', qid, rank, id FROM bm25 WHERE rank <= 10 UNION ALL SELECT 'hybrid', qid, rank, id FROM hybrid WHERE rank <= 10
      UNION ALL SELECT 'rerank', qid, rank, id FROM reranked WHERE rank <= 10""",
    "rerank_fallback": f"{_MODES} SELECT qid, id, raw, raw AS ranking, rank, qid % 7 = 0 AS fallback FROM reranked",
    "paired_ab": f"""WITH {SCORES}, base AS (SELECT hits.qid, id, score, e.label AS own, q.label AS ql FROM hits JOIN q ON q.qid = hits.qid JOIN embeddings e ON e.vec_id = id QUALIFY row_number() OVER (PARTITION BY hits.qid ORDER BY score DESC, id) <= 20),
      arms AS (SELECT 'a' AS arm, qid, id, round(score + CASE WHEN own = ql THEN 0.1 ELSE 0 END, 6) AS score FROM base UNION ALL SELECT 'b', qid, id, round(score + CASE WHEN own = (ql + 1) % 10 THEN 0.1 WHEN own = ql THEN 0.05 ELSE 0 END, 6) FROM base)
      SELECT arm, qid, id, row_number() OVER (PARTITION BY arm, qid ORDER BY score DESC, id) AS rank FROM arms QUALIFY rank <= 5""",
    "success_criteria": f"""WITH {_PAIRS}, d AS (SELECT avg(rb) - avg(ra) AS r, avg(nb) - avg(na) AS n, avg(rb) FILTER (WHERE qid % 2 = 0) - avg(ra) FILTER (WHERE qid % 2 = 0) AS m, avg(rb) FILTER (WHERE qid % 2 = 1) - avg(ra) FILTER (WHERE qid % 2 = 1) AS s FROM pairs)
      SELECT 'overall_recall_no_drop' AS criterion, CASE WHEN r >= 0 THEN 'passes' ELSE 'fails' END AS verdict, round(r, 4) AS delta FROM d UNION ALL SELECT 'overall_ndcg_drop_within_2pp', CASE WHEN n >= -0.02 THEN 'passes' ELSE 'fails' END, round(n, 4) FROM d
      UNION ALL SELECT 'multi_recall_improved', CASE WHEN m > 0 THEN 'passes' ELSE 'fails' END, round(m, 4) FROM d UNION ALL SELECT 'single_recall_no_worsen', CASE WHEN s >= 0 THEN 'passes' ELSE 'fails' END, round(s, 4) FROM d
      UNION ALL SELECT 'noise_recall_no_drop', 'N/A', NULL UNION ALL SELECT 'noise_ndcg_within_2pp', 'N/A', NULL""",
    "movers": f"""WITH {_PAIRS}, long AS (SELECT qid, 'recall' AS metric, round(rb - ra, 4) AS delta FROM pairs UNION ALL SELECT qid, 'ndcg', round(nb - na, 4) FROM pairs), k AS (SELECT *, CASE WHEN delta > 0 THEN 'improved' ELSE 'worsened' END AS kind FROM long WHERE delta <> 0)
      SELECT metric, kind, row_number() OVER (PARTITION BY metric, kind ORDER BY abs(delta) DESC, qid) AS place, qid, delta FROM k""",
    "block_rates": """WITH r AS (SELECT o_orderkey % 3 = 0 AS near, o_orderkey % 4 < 2 AS ok, o_orderkey % 2 = 1 AS blocked FROM orders WHERE o_orderkey % 5 <> 0),
      c AS (SELECT CASE WHEN ok THEN 'answerable_false_block' WHEN near THEN 'near_miss' ELSE 'out_of_scope' END AS cohort, blocked FROM r UNION ALL SELECT 'total', blocked FROM r WHERE NOT ok)
      SELECT cohort, count(*) FILTER (WHERE blocked) AS blocked, count(*) AS n, round(count(*) FILTER (WHERE blocked) / count(*)::DOUBLE, 4) AS rate FROM c GROUP BY cohort""",
    "generation_summary": """WITH r AS (SELECT event_id % 500 AS p, event_id % 90 AS c, event_id % 4 AS l, round(value, 2) AS s, event_id AS i FROM events), v AS (SELECT list(s ORDER BY s) AS v, count(*) AS n FROM r)
      SELECT count(*) AS n, round(avg(p), 1) AS avg_prompt_tokens, round(avg(c), 1) AS avg_completion_tokens, round(avg(l), 2) AS avg_llm_calls, sum(p + c)::BIGINT AS total_tokens, round(count(*) FILTER (WHERE i % 3 = 0) / count(*)::DOUBLE, 4) AS answerable_rate,
        round(count(*) FILTER (WHERE i % 3 = 2) / count(*)::DOUBLE, 4) AS not_enough_rate, count(*) FILTER (WHERE i % 10 = 0) AS n_fallback, round(count(*) FILTER (WHERE i % 10 <> 0) / count(*)::DOUBLE, 4) AS rerank_fired,
        (SELECT round(v[greatest(1, least(n, round_even(0.5::DOUBLE * n + 0.5, 0)::BIGINT))], 3) FROM v) AS latency_p50, (SELECT round(v[greatest(1, least(n, round_even(0.95::DOUBLE * n + 0.5, 0)::BIGINT))], 3) FROM v) AS latency_p95 FROM r""",
    "excluded_domains": f"{_GOLDEN} SELECT qid, round(CASE WHEN domain IS NULL OR len(gold) = 0 THEN 0 ELSE len(list_filter(gold, lambda d: d <> domain)) / len(gold)::DOUBLE END, 6) AS excluded_ratio FROM golden",
    "golden_join": f"{_GOLDEN} SELECT qid, event_type AS predicted, array_to_string(gold, ',') AS gold FROM golden WHERE qid % 9 <> 0 AND qid % 4 <> 0",
    "gold_domains": "SELECT DISTINCT l_partkey AS chunk_id, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN p_type ELSE '<unknown>' END AS domain FROM lineitem LEFT JOIN part ON p_partkey = l_partkey",
    "survival_rate": """WITH w AS (SELECT o_orderkey + i * 4000 AS id FROM orders, range(3) r(i) WHERE i <= o_orderkey % 3), a AS (SELECT count(*) AS wanted, count(*) FILTER (WHERE id IN (SELECT l_orderkey FROM lineitem)) AS alive FROM w)
      SELECT wanted, alive, round(alive / wanted::DOUBLE, 4) AS rate FROM a""",
    "predicted_answerable": "SELECT l_orderkey AS qid, count(*) >= 3 AND max(l_quantity / 50) >= 0.5229 AS predicted FROM lineitem GROUP BY 1",
    "cache_freshness": f"{_CACHE} SELECT c.qid, coalesce(o.qid % 3 <> 0 AND o.qid % 7 <> 0, false) AS fresh FROM c LEFT JOIN o USING (qid)",
    "cache_missing": f"{_CACHE} SELECT qid FROM c WHERE qid NOT IN (SELECT qid FROM o)",
    "evaluable": r"SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+', '', 'g') <> '' AND doc_id % 3 <> 0 AS evaluable FROM documents",
    "label_agreement": f"""WITH p AS (SELECT {_NAMES}[length(event_type) % 5 + 1] AS a, {_NAMES}[user_id % 5 + 1] AS b FROM events WHERE event_id % 10 <> 0), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL)
      SELECT 'agreement' AS kind, NULL AS a, NULL AS b, coalesce(sum(n) FILTER (WHERE a = b), 0)::BIGINT AS n, round(coalesce(sum(n) FILTER (WHERE a = b), 0) / sum(n)::DOUBLE, 6) AS rate FROM c
      UNION ALL (SELECT 'move', a, b, n, NULL FROM c WHERE a <> b ORDER BY n DESC, a, b LIMIT 12)""",
    "distinct_pages": "WITH r AS (SELECT l_orderkey AS qid, l_partkey AS page, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) SELECT qid, page, row_number() OVER (PARTITION BY qid ORDER BY first, page) AS rank FROM r",
    "mean_of_known": "SELECT event_type, round(avg(value) FILTER (WHERE event_id % 3 <> 0 AND event_id % 5 <> 0), 6) AS mean FROM events GROUP BY event_type",
    "sampled": "SELECT p_type AS name, least(5, count(*)) AS n FROM part GROUP BY 1",
    "bm25_filtered": "WITH q AS (SELECT item_id AS qid, item_id % 3 AS tenant, text FROM benchmark), docs AS (SELECT doc_id AS id, doc_id % 3 AS tenant, coalesce(text, '') AS text FROM documents WHERE lang = 'en'), " + _WANTED + ", " + _SCORED.format(f="text", boost="1.0") + ", " + _best("text"),
    "bm25_chunks": "WITH q AS (SELECT item_id AS qid, 0 AS tenant, CASE WHEN item_id % 4 = 0 THEN 'en' ELSE array_to_string(string_split(text, ' ')[1:3], ' ') END AS text FROM benchmark), base AS (SELECT doc_id AS id, 0 AS tenant, coalesce(text, '') AS content, split_part(coalesce(text, ''), chr(10), 1) AS title, lang, source FROM documents), "
    "docs AS (SELECT *, lang || ' ' || title AS embedding_text, lang AS heading_path FROM base), "
    + _WANTED
    + ", "
    + ", ".join(_SCORED.format(f=f, boost=b) for f, b in retrieval.CHUNK_FIELDS.items())
    + ", "
    + _KEYWORD.format(f="source", boost="2.0")
    + ", "
    + _KEYWORD.format(f="lang", boost="1.0")
    + ", "
    + _best(*retrieval.CHUNK_FIELDS, "source", "lang"),
    "bm25_documents": "WITH q AS (SELECT item_id AS qid, 0 AS tenant, text FROM benchmark), docs AS (SELECT doc_id AS id, 0 AS tenant, coalesce(text, '') AS content, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents), "
    + _WANTED
    + ", "
    + ", ".join(_SCORED.format(f=f, boost=b) for f, b in retrieval.DOCUMENT_FIELDS.items())
    + ", "
    + _best(*retrieval.DOCUMENT_FIELDS),
    "neighbours": f"""WITH {SCORES}, near AS (SELECT qid, id, score, matches FROM hits QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 16)
      SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM near WHERE score >= 0.1 AND id // 10 <> qid // 10 AND NOT matches QUALIFY rank <= 4""",
}
