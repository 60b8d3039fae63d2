"""Queries over stored indexes and keyed tables: searches after changes, old versions, buckets that a change has rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import text_index, vector_index
from lodestone.sources import ordered_scan
from lodestone.sources.store import KeyedTable

from .inputs import shared_folder, table, written_once
from .search import DENSE, K, _texts, _vectors


def index_changes(spark, sf_dir: str) -> DataFrame:
    """BM25 after a tenth of the documents was replaced and a tenth deleted, from the segments as they are."""
    queries, docs = _texts(spark, sf_dir)
    index = text_index.TextIndex(spark, shared_folder(spark, "text-index"))
    index.change(docs.select("id", "text"))
    index.change(docs.filter("id % 10 = 3").select("id", F.concat(F.lit("changed apache kubernetes "), F.coalesce("text", F.lit(""))).alias("text")), docs.filter("id % 10 = 7").select("id"))
    return index.topk(queries, K)


def index_merged(spark, sf_dir: str) -> DataFrame:
    """The same after the segments were merged, with the documents of one language alone let through."""
    queries, docs = _texts(spark, sf_dir)
    index = text_index.TextIndex(spark, shared_folder(spark, "text-index"))
    index.change(docs.filter("id % 2 = 0").select("id", "text"))
    index.change(docs.filter("id % 2 = 1").select("id", "text"), docs.filter("id % 10 = 8").select("id"))
    index.merge()
    german = docs.filter("lang = 'de'").select("id")
    return index.topk(queries, K, keep=lambda rows: rows.join(german, "id", "left_semi"))


def _index(spark, sf_dir: str) -> vector_index.VectorIndex:
    """The stored index of the vectors, which the queries over them share."""

    def make(root: str) -> vector_index.VectorIndex:
        out = vector_index.VectorIndex(spark, root, "id long, vector array<float>, label int")
        out.change(_vectors(spark, sf_dir)[1])
        return out

    return written_once(spark, sf_dir, "vector-index", ("embeddings",), make)


def vectors_exact(spark, sf_dir: str) -> DataFrame:
    """The nearest vectors by probing, and by those other lists that can hold one of them."""
    return _index(spark, sf_dir).search(_vectors(spark, sf_dir)[0], K, probes=8, other=True, exact=True)


def vectors_probed(spark, sf_dir: str) -> DataFrame:
    """The nearest vectors among as many lists as a recall of 0.9 takes."""
    index, queries = _index(spark, sf_dir), _vectors(spark, sf_dir)[0]
    return index.search(queries, K, index.calibrate(queries, K, 0.9, other=True), other=True)


def vectors_changed(spark, sf_dir: str) -> DataFrame:
    """The nearest of the same label after vectors came, were replaced and deleted."""
    queries, rows = _vectors(spark, sf_dir)
    index = vector_index.VectorIndex(spark, shared_folder(spark, "vector-index"), "id long, vector array<float>, label int", lists=16)
    index.change(rows.filter("id % 2 = 0"))
    index.change(rows.filter("id % 2 = 1 OR id % 10 = 4").withColumn("vector", F.when(F.col("id") % 10 == 4, F.reverse("vector")).otherwise(F.col("vector"))), rows.filter("id % 10 = 6").select("id"))
    return index.search(queries.withColumnRenamed("qlabel", "label"), K, probes=2, other=True, within="label", exact=True)


ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


def _orders(spark, sf_dir: str) -> KeyedTable:
    """Orders by key, of which every hundredth was changed, and some were deleted and added afterwards."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    out = KeyedTable(spark, shared_folder(spark, "orders"), ORDER, ["o_orderkey"])
    out.change(rows)
    changed = rows.filter("o_orderkey % 100 = 1").withColumn("o_orderstatus", F.lit("X"))
    out.change(changed.unionByName(changed.withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000)), rows.filter("o_orderkey % 100 = 2").select("o_orderkey"))
    return out


def keyed_current(spark, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).read()


def keyed_before(spark, sf_dir: str) -> DataFrame:
    """What a reader of the version before the change sees."""
    return _orders(spark, sf_dir).read(1)


def keyed_rewritten(spark, sf_dir: str) -> DataFrame:
    """Buckets of the version of a change of ten keys: those rewritten are those of its keys, all others are held from before."""
    t = _orders(spark, sf_dir)
    ten = t.read().orderBy("o_orderkey").limit(10)
    before = t.manifest.read(t.manifest.latest())
    touched = ten.select(t.bucket().alias("bucket")).distinct()
    after = t.change(ten.withColumn("o_orderstatus", F.lit("Y")))
    held = spark.createDataFrame(sorted(after.items()), "bucket int, held int").join(touched.withColumn("touched", F.lit(True)), "bucket", "left")
    now = t.read().withColumn("bucket", t.bucket()).join(held, "bucket")
    was = spark.createDataFrame([(r.bucket, r.held) for r in before], "bucket int, was int")
    told = now.join(was, "bucket").select(F.when(F.coalesce("touched", F.lit(False)), F.col("held") > F.col("was")).otherwise(F.col("held") == F.col("was")).alias("right"), (F.col("o_orderstatus") == "Y").alias("new"))
    return told.groupBy("right", "new").agg(F.count("*").alias("n"))


def scan_resumed(spark, sf_dir: str) -> DataFrame:
    """A deep scan of the documents in order of source and id, stopped after every quarter and gone on with at the last key."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    scan = ordered_scan.OrderedScan.written(d, ["source", "doc_id"], shared_folder(spark, "scan"), rows=200)
    many, last, out = -(-scan.rows() // 4), None, None
    for step in range(5):
        part = scan.after(last, many)
        last = scan.last_key(part) or last
        part = part.withColumn("step", F.lit(step))
        out = part if out is None else out.unionAll(part)
    return out


QUERIES = {
    "index_changes": index_changes,
    "index_merged": index_merged,
    "vectors_exact": vectors_exact,
    "vectors_probed": vectors_probed,
    "vectors_changed": vectors_changed,
    "keyed_current": keyed_current,
    "keyed_before": keyed_before,
    "keyed_rewritten": keyed_rewritten,
    "scan_resumed": scan_resumed,
}

_BM25 = r"""wanted AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS term FROM benchmark),
split AS (SELECT id, lang, regexp_extract_all(lower(text), '[\pL\pN_]+') AS terms FROM now),
sizes AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM split),
postings AS (SELECT term, id, lang, length, count(*) AS tf FROM (SELECT id, lang, len(terms) AS length, unnest(terms) AS term FROM split) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
idf AS (SELECT term, mean, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, sizes GROUP BY term, mean, n),
matched AS (SELECT qid, id, lang, round(sum(idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM wanted JOIN idf USING (term) JOIN postings USING (term) GROUP BY qid, id, lang)"""
_HELD = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice FROM orders"
_CURRENT = """current AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 100 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice::DOUBLE AS o_totalprice FROM orders WHERE o_orderkey % 100 <> 2
  UNION ALL SELECT o_orderkey + 100000000, o_custkey, 'X', o_totalprice::DOUBLE FROM orders WHERE o_orderkey % 100 = 1)"""

SQL = {
    "index_changes": f"""WITH now AS (SELECT doc_id AS id, lang, CASE WHEN doc_id % 10 = 3 THEN 'changed apache kubernetes ' ELSE '' END || coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <> 7), {_BM25}
      SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM matched QUALIFY rank <= 20""",
    "index_merged": f"""WITH now AS (SELECT doc_id AS id, lang, coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <> 8), {_BM25}
      SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM matched WHERE lang = 'de' QUALIFY rank <= 20""",
    "vectors_exact": f"WITH {DENSE} SELECT qid, id, score, rank FROM dense",
    "vectors_changed": """WITH now AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 4 THEN list_reverse(embedding) ELSE embedding END::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 10 <> 6),
      hits AS (SELECT e.vec_id AS qid, n.id, round(list_inner_product(e.embedding::DOUBLE[], n.v), 6) AS score FROM embeddings e JOIN now n ON n.label = e.label AND n.id <> e.vec_id WHERE e.vec_id % 20 = 0)
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hits QUALIFY rank <= 20""",
    "keyed_current": f"WITH {_CURRENT} SELECT * FROM current",
    "keyed_before": _HELD,
    "scan_resumed": "SELECT source, doc_id, ((row_number() OVER (ORDER BY source, doc_id) - 1) // ceil((SELECT count(*) FROM documents) / 4.0)::BIGINT)::INT AS step FROM documents",
    "keyed_rewritten": f'WITH {_CURRENT}, n AS (SELECT count(*) AS rows FROM current) SELECT true AS "right", false AS new, rows - least(rows, 10) AS n FROM n WHERE rows > 10 UNION ALL SELECT true, true, least(rows, 10) FROM n',
}
