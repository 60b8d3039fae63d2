"""Stand-ins: what the queries read, made from the star schema, events, documents and embeddings.

Every stand-in has a DataFrame form and the same in SQL (a list of common table expressions).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import evidence

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see. Where none is named, a local master gets a temporary one, and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='lodestone-')}/{name}-{uuid.uuid4().hex}"


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Of the files below paths: their number, and their names, sizes and times summed up."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([*paths])  # contents aren't read
    n, told = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{n} {told}"


#: What this application has written for several queries, by kind, files and application.
_written: dict[tuple[str, str, str], object] = {}


def written_once(spark: SparkSession, sf_dir: str, kind: str, tables: tuple[str, ...], make: Callable[[str], object]):
    """What make(root) has written to the shared folder from these tables; made anew where their files have changed."""
    key = (kind, fingerprint(spark, *(f"{sf_dir}/{t}.parquet" for t in tables)), spark.sparkContext.applicationId)
    if key not in _written:
        _written[key] = make(shared_folder(spark, kind))
    return _written[key]


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation an event."""
    e = table(spark, sf_dir, "events")
    tokens = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    bucket = F.when(kind == "error", "failure").when(kind == "signup", "requery").otherwise("success")
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 4).alias("tenant"),
        "user_id",
        "event_type",
        bucket.alias("bucket"),
        F.col("value").alias("duration_ms"),
        tokens.alias("tokens"),
        (tokens * 0.015).alias("cost"),
        (F.col("value") / (F.col("value") + 50)).alias("trust"),
        (F.col("event_id") % 3 == 0).alias("fallback"),
        F.col("ts").alias("created_at"),
    )


OBSERVATIONS = """observations AS (
  SELECT event_id AS id, user_id % 4 AS tenant, user_id, event_type,
    CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'requery' ELSE 'success' END AS bucket,
    value AS duration_ms, regexp_extract(props, '"k": (\\d+)', 1)::BIGINT AS tokens, regexp_extract(props, '"k": (\\d+)', 1)::BIGINT * 0.015::DOUBLE AS cost,
    value / (value + 50) AS trust, event_id % 3 = 0 AS fallback, ts AS created_at
  FROM events)"""


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as what a search has retrieved: the order is the query, a line a document of some version."""
    line = table(spark, sf_dir, "lineitem")
    p, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    site = F.element_at(F.array(*map(F.lit, ("apache", "kubernetes", "prometheus", ""))), (p % 4 + 1).cast("int"))
    version = F.when(p % 11 == 0, "").otherwise(F.concat(F.lit("1."), (p % 5).cast("string")))
    docs = line.select(
        o.alias("qid"),
        F.concat(o.cast("string"), F.lit("_"), n.cast("string"), F.lit("_"), p.cast("string")).alias("chunk_id"),
        p.alias("page_id"),
        F.when(p % 13 == 0, "").otherwise(F.concat(site, F.lit(":doc"), (F.col("l_suppkey") % 2).cast("string"))).alias("doc_key"),
        site.alias("site"),
        version.alias("version"),
        version.isin("1.0", "1.1").alias("is_eol"),
        (F.col("l_quantity") / 50).alias("raw"),
        F.col("l_discount").alias("score"),
        F.concat(F.lit("h"), (p % 7).cast("string")).alias("hash"),
        F.repeat(F.lit("[MASKED_TOKEN] "), (n % 3).cast("int")).alias("snippet"),
        F.pow(F.lit(0.5), (p % 400) / 180.0).alias("recency"),
    )
    none = F.array().cast("array<string>")
    targets = F.when(F.col("qid") % 4 == 1, F.array(F.lit("1.2"))).when(F.col("qid") % 4 == 2, F.array(F.lit("1.1"), F.lit("v1.4"))).otherwise(none)
    return evidence.with_lineage(docs, evidence.lineages(docs)).withColumn("targets", targets)


RETRIEVED = """docs AS (
  SELECT l_orderkey AS qid, l_orderkey || '_' || l_linenumber || '_' || l_partkey AS chunk_id, l_partkey AS page_id,
    CASE WHEN l_partkey % 13 = 0 THEN '' ELSE ['apache', 'kubernetes', 'prometheus', ''][l_partkey % 4 + 1] || ':doc' || (l_suppkey % 2) END AS doc_key,
    ['apache', 'kubernetes', 'prometheus', ''][l_partkey % 4 + 1] AS site,
    CASE WHEN l_partkey % 11 = 0 THEN '' ELSE '1.' || (l_partkey % 5) END AS version,
    l_partkey % 11 <> 0 AND l_partkey % 5 IN (0, 1) AS is_eol,
    l_quantity / 50 AS raw, l_discount AS score, 'h' || (l_partkey % 7) AS hash, l_linenumber % 3 AS masks, pow(0.5, (l_partkey % 400) / 180.0::DOUBLE) AS recency,
    CASE l_orderkey % 4 WHEN 1 THEN ['1.2'] WHEN 2 THEN ['1.1', '1.4'] ELSE [] END AS targets
  FROM lineitem),
lineage AS (SELECT doc_key, list(DISTINCT version ORDER BY version) AS versions FROM docs WHERE doc_key <> '' AND version <> '' GROUP BY doc_key),
fitted AS (
  SELECT d.*, coalesce(versions, []) AS versions, CASE WHEN d.doc_key <> '' THEN d.doc_key ELSE 'page:' || page_id END AS group_key
  FROM docs d LEFT JOIN lineage USING (doc_key)),
currency AS (
  SELECT *, CASE WHEN version = '' OR len(versions) = 0 THEN 0.5 WHEN len(versions) = 1 THEN CASE WHEN site IN ('apache', 'kubernetes') THEN 0.7 ELSE 1.0 END
      WHEN list_position(versions, version) > 0 THEN list_position(versions, version)::DOUBLE / len(versions) ELSE 0.5 END AS base,
    list_position(versions, version) AS place
  FROM fitted),
annotated AS (
  SELECT *, CASE WHEN is_eol THEN least(base, 0.3) ELSE base END::DOUBLE AS raw_currency,
    CASE WHEN len(targets) = 0 THEN CASE WHEN is_eol THEN least(base, 0.3) ELSE base END WHEN version = '' THEN 0.5 WHEN list_contains(targets, version) THEN 1.0 WHEN len(versions) = 0 THEN 0.5
      WHEN place > 0 AND (list_contains(targets, CASE WHEN place > 1 THEN versions[place - 1] END) OR list_contains(targets, versions[place + 1])) THEN 0.5 ELSE 0.0 END::DOUBLE AS fit
  FROM currency),
scored AS (SELECT *, 0.8 * fit + 0.2 AS evidence FROM annotated),
ordered AS (
  SELECT *, CASE WHEN len(targets) >= 2 AND list_contains(targets, version) THEN 1 ELSE 0 END AS wanted,
    row_number() OVER (PARTITION BY qid, group_key ORDER BY fit DESC, CASE WHEN len(targets) > 0 THEN raw_currency ELSE 0 END DESC, recency DESC, chunk_id, raw DESC) AS best,
    row_number() OVER (PARTITION BY qid, group_key, version ORDER BY fit DESC, CASE WHEN len(targets) > 0 THEN raw_currency ELSE 0 END DESC, recency DESC, chunk_id, raw DESC) AS of_version
  FROM scored),
collapsed AS (SELECT *, CASE WHEN max(wanted) OVER (PARTITION BY qid, group_key) > 0 THEN of_version <= wanted ELSE best = 1 END AS survives FROM ordered),
survivors AS (SELECT * FROM collapsed WHERE survives),
asked AS (SELECT o_orderkey AS qid, CASE o_orderkey % 4 WHEN 1 THEN ['1.2'] WHEN 2 THEN ['1.1', '1.4'] ELSE [] END AS targets FROM orders),
per AS (
  SELECT qid, count(*) AS documents, count(DISTINCT group_key) FILTER (WHERE raw >= 0.5229) AS good_topics, list(DISTINCT version) AS found,
    list(raw ORDER BY raw DESC) AS tops, 1 - count(DISTINCT hash) / count(hash)::DOUBLE AS hash_dup,
    1 - count(DISTINCT group_key) FILTER (WHERE NOT (len(targets) >= 2 AND list_contains(targets, version)))
      / nullif(count(DISTINCT (group_key, version)) FILTER (WHERE NOT (len(targets) >= 2 AND list_contains(targets, version))), 0)::DOUBLE AS sibling_dup,
    avg(evidence) AS evidence_mean, avg(fit) AS fit_mean, max(recency) AS recency, least(1.0, sum(masks) / 5.0::DOUBLE) AS sensitivity, bool_and(is_eol) AS deprecated
  FROM survivors GROUP BY qid),
states AS (
  SELECT a.qid, a.targets, coalesce(documents, 0) AS documents, coalesce(good_topics, 0) AS good_topics, coalesce(evidence_mean, 0) AS evidence_mean, coalesce(fit_mean, 0) AS fit_mean,
    coalesce(recency, 0) AS recency, coalesce(sensitivity, 0) AS sensitivity, coalesce(deprecated, false) AS deprecated,
    coalesce(len(a.targets) < 2 AND tops[1] >= 0.9 AND (len(tops) = 1 OR round(tops[1] - tops[2], 9) >= 0.2), false) AS waiver,
    list_filter(a.targets, lambda t: len(a.targets) >= 2 AND NOT list_contains(coalesce(found, []), t)) AS missing,
    greatest(coalesce(hash_dup, 0), coalesce(sibling_dup, 0)) AS duplication
  FROM asked a LEFT JOIN per USING (qid)),
covered AS (
  SELECT *, CASE WHEN documents = 0 THEN 0 WHEN len(targets) >= 2 THEN (len(targets) - len(missing))::DOUBLE / len(targets) WHEN waiver THEN 1 ELSE least(1.0, good_topics / 2.0::DOUBLE) END::DOUBLE AS coverage
  FROM states),
totals AS (SELECT *, CASE WHEN documents = 0 THEN 0 ELSE greatest(0, least(1, 0.5 * evidence_mean + 0.3 * coverage + 0.2 * (1 - duplication))) END::DOUBLE AS overall FROM covered),
topics AS (SELECT qid, site, version, group_key, max(raw) AS top FROM survivors WHERE site <> '' GROUP BY ALL),
tiers AS (SELECT qid, list(top ORDER BY top DESC) AS tops FROM topics GROUP BY qid, site, version),
conflicts AS (SELECT qid, bool_or(coalesce(tops[2] >= 0.5229 AND round(tops[1] - tops[2], 9) < 0.005, false)) AS conflicting FROM tiers GROUP BY qid)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, targets) of every query, with documents or not."""
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"))
    none = F.array().cast("array<string>")
    return q.withColumn("targets", F.when(F.col("qid") % 4 == 1, F.array(F.lit("1.2"))).when(F.col("qid") % 4 == 2, F.array(F.lit("1.1"), F.lit("v1.4"))).otherwise(none))


def graph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents of a knowledge graph: brands are sources, types domains, words of the name keywords."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("page_id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 17 == 0, "").otherwise(F.col("p_brand")).alias("source"),
        F.col("p_type").alias("domain"),
        F.concat(F.lit("1."), (F.col("p_partkey") % 5).cast("string")).alias("version"),
        F.concat(F.col("p_name"), F.lit("#"), F.floor(F.col("p_partkey") / 20).cast("string")).alias("doc_key"),
        F.concat(F.split("p_name", " "), F.array(F.concat(F.lit("size "), F.col("p_size").cast("string")), F.concat(F.lit("lot "), F.floor(F.col("p_partkey") / 3).cast("string")))).alias("keywords"),
        F.col("p_partkey").alias("place"),
    )


GRAPH = """docs AS (
  SELECT 'p' || p_partkey AS page_id, p_name AS title, CASE WHEN p_partkey % 17 = 0 THEN '기타' ELSE p_brand END AS source, p_type AS domain,
    p_name || '#' || (p_partkey // 20) AS doc_key, list_distinct(string_split(p_name, ' ') || ['size ' || p_size, 'lot ' || (p_partkey // 3)]) AS keywords, p_partkey AS place
  FROM part),
words AS (SELECT page_id, domain, place, unnest(keywords) AS concept FROM docs),
concepts AS (SELECT concept, count(*) AS n, count(DISTINCT domain) AS domains FROM words GROUP BY concept HAVING count(*) >= 2)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as router predictions: gold and predicted labels, and a confidence that is sometimes missing."""
    e = table(spark, sf_dir, "events")
    names = F.array(*map(F.lit, LABELS))
    pick = lambda n: F.element_at(names, (n % 5 + 1).cast("int"))
    i, u = F.col("event_id"), F.col("user_id")
    gold = F.when(i % 3 == 0, F.array(pick(u), pick(u + 1))).otherwise(F.array(pick(u)))
    pred = F.when(i % 7 == 0, F.array().cast("array<string>")).when(i % 4 == 0, F.array(pick(u), pick(u + 2))).when(i % 5 == 0, F.array(pick(u + 1))).otherwise(F.array(pick(u)))
    confidence = F.when(i % 11 != 0, (i % 101) / 100.0)
    return e.select(i.alias("qid"), gold.alias("gold"), pred.alias("pred"), confidence.alias("confidence")).withColumn("correct", F.get("gold", F.lit(0)).eqNullSafe(F.get("pred", F.lit(0))))


LABELS = ("incident", "manual", "api_reference", "meeting_note", "planning")
PREDICTIONS = """predictions AS (
  SELECT event_id AS qid, names, CASE WHEN event_id % 3 = 0 THEN [names[user_id % 5 + 1], names[(user_id + 1) % 5 + 1]] ELSE [names[user_id % 5 + 1]] END AS gold,
    CASE WHEN event_id % 7 = 0 THEN [] WHEN event_id % 4 = 0 THEN [names[user_id % 5 + 1], names[(user_id + 2) % 5 + 1]] WHEN event_id % 5 = 0 THEN [names[(user_id + 1) % 5 + 1]] ELSE [names[user_id % 5 + 1]] END AS pred,
    CASE WHEN event_id % 11 <> 0 THEN (event_id % 101) / 100.0::DOUBLE END AS confidence
  FROM events, (SELECT ['incident', 'manual', 'api_reference', 'meeting_note', 'planning'] AS names))"""
