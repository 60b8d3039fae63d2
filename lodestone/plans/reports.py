"""Queries over usage, classifier quality, comparisons, ledgers and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators import graph, ledger, metrics, monitoring

from .inputs import GRAPH, LABELS, OBSERVATIONS, PREDICTIONS, as_of, graph_rows, observations, predictions, table

DAYS = 30
#: The same bounds in SQL.
IN_WINDOW = "created_at >= TIMESTAMP '2024-01-31' - INTERVAL {d} DAY AND created_at <= TIMESTAMP '2024-01-31'"


def monitoring_overview(spark, sf_dir: str) -> DataFrame:
    return monitoring.overview(observations(spark, sf_dir), as_of(), DAYS)


def bucket_breakdown(spark, sf_dir: str) -> DataFrame:
    return monitoring.by_bucket(observations(spark, sf_dir))


def tenant_top3(spark, sf_dir: str) -> DataFrame:
    return monitoring.top_tenants(observations(spark, sf_dir), 3)


def _series(make, days: int = DAYS):
    def query(spark, sf_dir: str) -> DataFrame:
        return monitoring.series(observations(spark, sf_dir), as_of(), days, make())

    return query


SERIES = """SELECT r.i::INT AS point, coalesce(value, 0)::DOUBLE AS value FROM range({n}) r(i) LEFT JOIN (
  SELECT least(floor((floor(epoch(created_at)) - epoch(TIMESTAMP '2024-01-31') + {d} * 86400) * {n} / ({d} * 86400.0)), {n} - 1)::INT AS point, round({agg}, 6) AS value
  FROM observations WHERE """ + IN_WINDOW + """ GROUP BY 1) s ON s.point = r.i"""


def period_delta(spark, sf_dir: str) -> DataFrame:
    return monitoring.period_delta(observations(spark, sf_dir), as_of(), 15)


def alerts(spark, sf_dir: str) -> DataFrame:
    return monitoring.alerts(observations(spark, sf_dir), F.to_timestamp(F.lit("2024-01-20 00:00:00")))


def dominant_event(spark, sf_dir: str) -> DataFrame:
    return monitoring.dominant(observations(spark, sf_dir), "event_type", ["tenant"])


def gauge_lines(spark, sf_dir: str) -> DataFrame:
    counts = observations(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    return monitoring.gauges(counts, "queue_depth", "stream", "event_type", "n")


def percentiles(spark, sf_dir: str) -> DataFrame:
    """The three definitions of a percentile side by side, of values counted first."""
    return metrics.percentiles(observations(spark, sf_dir), "tenant", "duration_ms", 0.9)


def cost_formats(spark, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    cost = scoring.cost(F.when(F.col("id") % 2 == 0, "small").otherwise("large"), F.col("tokens"), F.col("tokens") * 2)
    return rows.groupBy("tenant").agg(F.round(F.sum(cost), 2).alias("cost"), F.sum("tokens").alias("tokens")).select("tenant", "cost", scoring.tokens_text(F.col("tokens")).alias("told"))


# classifiers


def confusion(spark, sf_dir: str) -> DataFrame:
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


def router_prf(spark, sf_dir: str) -> DataFrame:
    return metrics.multi_label(predictions(spark, sf_dir))


def label_prf(spark, sf_dir: str) -> DataFrame:
    return metrics.per_label(predictions(spark, sf_dir), LABELS)


def label_macro(spark, sf_dir: str) -> DataFrame:
    return metrics.label_macro(metrics.per_label(predictions(spark, sf_dir), LABELS))


def secondary_rates(spark, sf_dir: str) -> DataFrame:
    return metrics.secondary_rates(predictions(spark, sf_dir))


def confidence_bins(spark, sf_dir: str) -> DataFrame:
    return metrics.confidence_bins(predictions(spark, sf_dir))


def ece(spark, sf_dir: str) -> DataFrame:
    return metrics.calibration_error(predictions(spark, sf_dir))


def _pairs(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(((k % 10) / 10.0).alias("hit_a"), (((k + k % 3) % 10) / 10.0).alias("hit_b"), ((k % 7) / 7.0).alias("ndcg_a"), ((k % 6) / 6.0).alias("ndcg_b"), F.array("o_orderpriority", "o_orderstatus").alias("groups"))


def ab_delta(spark, sf_dir: str) -> DataFrame:
    return metrics.ab_means(_pairs(spark, sf_dir), None, ["hit", "ndcg"])


def ab_groups(spark, sf_dir: str) -> DataFrame:
    return metrics.ab_means(_pairs(spark, sf_dir), "groups", ["hit", "ndcg"])


def ab_moved(spark, sf_dir: str) -> DataFrame:
    return metrics.moved(_pairs(spark, sf_dir), ["hit", "ndcg"])


def threshold_sweep(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("score"), ((F.col("l_partkey") % 50) < F.col("l_quantity")).alias("positive"))
    return metrics.threshold_sweep(rows)


def gate(spark, sf_dir: str) -> DataFrame:
    means = metrics.ab_means(_pairs(spark, sf_dir), None, ["hit", "ndcg"])
    base = means.select("metric", F.round(F.col("a") + F.when(F.col("metric") == "hit", 0.5).otherwise(0.0), 6).alias("base"))
    return metrics.regressions(means.select("metric", F.col("b").alias("value"), "n"), base.join(means.select("metric", "n"), "metric"))


# ledgers


def _assets(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    names = ("deleting", "report_failed", "published", "progress", "cancelled", "queued")
    o = o.select("o_orderkey", k.alias("transcription"), (k % 5).alias("tenant"), F.element_at(F.array(*map(F.lit, names)), (k % 6 + 1).cast("int")).alias("workflow"))
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 6).alias("quantity"))
    r = r.filter(F.col("lines") > 2).withColumn("report", F.when(F.col("lines") > 5, "published").when(F.col("lines") > 4, "publishing").otherwise("draft"))
    # every seventh report is one of another tenant
    l = F.col("l_orderkey")
    r = r.select(l.alias("transcription"), F.when(l % 7 == 0, (l + 1) % 5).otherwise(l % 5).alias("tenant"), "quantity", "report")
    return ledger.with_reports(o, r).withColumn("status", ledger.asset_status(F.col("workflow"), F.col("report")))


def asset_status_counts(spark, sf_dir: str) -> DataFrame:
    return ledger.status_counts(_assets(spark, sf_dir))


def asset_list(spark, sf_dir: str) -> DataFrame:
    return _assets(spark, sf_dir).filter("status = 'draft'").orderBy(F.desc("o_orderkey")).limit(50).select("o_orderkey", "status", "quantity")


ASSETS = """assets AS (
  SELECT o_orderkey, quantity, CASE WHEN workflow = 'deleting' THEN 'deleting' WHEN workflow IN ('report_failed', 'cancelled') THEN 'failed'
    WHEN report = 'published' OR workflow = 'published' THEN 'completed' WHEN report = 'publishing' THEN 'processing' WHEN report IS NOT NULL THEN 'draft' ELSE 'processing' END AS status
  FROM (SELECT o_orderkey, ['deleting', 'report_failed', 'published', 'progress', 'cancelled', 'queued'][o_orderkey % 6 + 1] AS workflow FROM orders) o
  LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 6) AS quantity, CASE WHEN count(*) > 5 THEN 'published' WHEN count(*) > 4 THEN 'publishing' ELSE 'draft' END AS report FROM lineitem GROUP BY l_orderkey HAVING count(*) > 2) r ON l_orderkey = o_orderkey AND l_orderkey % 7 <> 0)"""


def tenant_audit_union(spark, sf_dir: str) -> DataFrame:
    one = lambda name, col: table(spark, sf_dir, name).select((F.col(col) % 10).alias("tenant"))
    return ledger.tenant_audit({"orders": one("orders", "o_custkey"), "customer": one("customer", "c_nationkey"), "events": one("events", "user_id")}, F.lit(3))


def _ledger(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("page_id"), F.sha2("c_name", 256).alias("hash"), F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit("run"), (F.col("c_custkey") % 2).cast("string"))).alias("run_id"))
    old = rows.filter(F.col("page_id") % 5 != 0).withColumn("hash", F.when(F.col("page_id") % 4 == 0, "old").otherwise(F.col("hash")))
    return rows, old


def change_detect(spark, sf_dir: str) -> DataFrame:
    return ledger.changed(*_ledger(spark, sf_dir)).select("page_id", "changed")


def registry_upsert(spark, sf_dir: str) -> DataFrame:
    new, old = _ledger(spark, sf_dir)
    return ledger.upsert(old, new.filter(F.col("page_id") % 3 == 0), ["page_id"]).select("page_id", "hash")


def stale_anti_join(spark, sf_dir: str) -> DataFrame:
    rows, _ = _ledger(spark, sf_dir)
    gone = rows.filter(ledger.stale(rows, "run1")).select("page_id")
    return rows.join(gone, "page_id", "left_anti").select("page_id", "run_id")


def snapshot_rotate(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("version"))
    return ledger.snapshots(o, ["page_id"]).select("page_id", "version", "slot")


def ingest_run_summary(spark, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("run_id"), (F.col("l_returnflag") == "R").alias("changed"), ((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == 1)).alias("failed"))
    return ledger.run_summary(line)


def last_writer(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ledger.latest(e, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


def qrels_status(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"))
    ids = F.when(F.col("qid") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), (F.col("qid") % 3).cast("int")), lambda i: F.col("qid") + i * 4000))
    live = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return ledger.liveness(o.withColumn("ids", ids), live).select("qid", "status", "alive")


def dangling_keys(spark, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return ledger.unmatched(a, table(spark, sf_dir, "events").select(F.col("user_id").alias("key")), "key")


def majority_vote(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ledger.majority(e, "user_id", "event_type", "event_id").select("user_id", "event_type", "votes")


def label_shift(spark, sf_dir: str) -> DataFrame:
    """How rule votes and given labels differ: counts of each pair."""
    e = table(spark, sf_dir, "events")
    rules = ledger.majority(e, "user_id", "event_type", "event_id").select("user_id", F.col("event_type").alias("rule"))
    given = ledger.latest(e, ["user_id"], F.desc("event_id")).select("user_id", F.col("event_type").alias("given"))
    return rules.join(given, "user_id").groupBy("rule", "given").agg(F.count("*").alias("n"))


def drift_check(spark, sf_dir: str) -> DataFrame:
    """Customers whose set of order statuses differs from those of their lines."""
    o = table(spark, sf_dir, "orders")
    joined = o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    sets = joined.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("a"), F.array_sort(F.collect_set("l_linestatus")).alias("b"))
    return sets.select("o_custkey", (F.col("a") != F.col("b")).alias("drifted"), F.size(F.array_intersect("a", "b")).alias("shared"))


def quota_sample(spark, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n"))
    return ledger.quota(counts, 50, 4)


# graph


def _graph(spark, sf_dir: str) -> DataFrame:
    return graph.documents(graph_rows(spark, sf_dir), "place")


def graph_nodes(spark, sf_dir: str) -> DataFrame:
    return graph.nodes(_graph(spark, sf_dir))


def graph_edges(spark, sf_dir: str) -> DataFrame:
    return graph.edges(_graph(spark, sf_dir))


def version_pairs(spark, sf_dir: str) -> DataFrame:
    return graph.version_pairs(_graph(spark, sf_dir))


def concept_degree(spark, sf_dir: str) -> DataFrame:
    return graph.concepts(_graph(spark, sf_dir), 2)


def cross_domain_links(spark, sf_dir: str) -> DataFrame:
    return graph.cross_domain_links(_graph(spark, sf_dir))


def graph_report(spark, sf_dir: str) -> DataFrame:
    return graph.report(_graph(spark, sf_dir))


def graph_hierarchy(spark, sf_dir: str) -> DataFrame:
    return graph.hierarchy(_graph(spark, sf_dir))


QUERIES = {
    "monitoring_overview": monitoring_overview,
    "bucket_breakdown": bucket_breakdown,
    "tenant_top3": tenant_top3,
    "series_sum": _series(lambda: F.sum("cost")),
    "series_avg": _series(lambda: F.avg("duration_ms"), 7),
    "series_p95": _series(lambda: F.percentile("duration_ms", 0.95), 15),
    "series_rate": _series(lambda: scoring.rate(F.count_if(F.col("bucket") == "failure"), F.count("*")), 90),
} | {f.__name__: f for f in (period_delta, alerts, dominant_event, gauge_lines, percentiles, cost_formats)}
QUERIES |= {f.__name__: f for f in (confusion, router_prf, label_prf, label_macro, secondary_rates, confidence_bins, ece, ab_delta, ab_groups, ab_moved, threshold_sweep, gate)}
QUERIES |= {f.__name__: f for f in (asset_status_counts, asset_list, tenant_audit_union, change_detect, registry_upsert, stale_anti_join, snapshot_rotate, ingest_run_summary, last_writer)}
QUERIES |= {f.__name__: f for f in (qrels_status, dangling_keys, majority_vote, label_shift, drift_check, quota_sample)}
QUERIES |= {f.__name__: f for f in (graph_nodes, graph_edges, version_pairs, concept_degree, cross_domain_links, graph_report, graph_hierarchy)}

_PRF = "round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"
_RATES = ", ".join(f"round(coalesce(100.0::DOUBLE * count(*) FILTER (WHERE bucket = '{b}') / nullif(count(*), 0), 0), 6) AS {b}_rate" for b in monitoring.BUCKETS)
_LABELLED = f"""WITH {PREDICTIONS}, pairs AS (SELECT label, list_contains(gold, label) AS g, list_contains(pred, label) AS p FROM predictions, (SELECT unnest(['incident', 'manual', 'api_reference', 'meeting_note', 'planning']) AS label)),
  counts AS (SELECT label, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM pairs GROUP BY label),
  each AS (SELECT label, {_PRF}, tp + fn AS support FROM counts)"""
_BINS = f"""WITH {PREDICTIONS}, used AS (SELECT confidence, (gold[1] IS NOT DISTINCT FROM pred[1])::INT::DOUBLE AS correct, (confidence >= 0.5)::INT + (confidence >= 0.7)::INT + (confidence >= 0.9)::INT AS bin FROM predictions WHERE confidence IS NOT NULL),
  bins AS (SELECT r.i::INT AS bin, count(confidence) AS n, round(coalesce(avg(correct), 0), 6) AS accuracy, round(coalesce(avg(confidence), 0), 6) AS mean_confidence FROM range(4) r(i) LEFT JOIN used ON bin = r.i GROUP BY r.i)"""
_PAIRS = """WITH pairs AS (SELECT (o_orderkey % 10) / 10.0::DOUBLE AS hit_a, ((o_orderkey + o_orderkey % 3) % 10) / 10.0::DOUBLE AS hit_b, (o_orderkey % 7) / 7.0::DOUBLE AS ndcg_a, (o_orderkey % 6) / 6.0::DOUBLE AS ndcg_b, [o_orderpriority, o_orderstatus] AS groups FROM orders),
  long AS (SELECT groups, 'hit' AS metric, hit_a AS a, hit_b AS b FROM pairs UNION ALL SELECT groups, 'ndcg', ndcg_a, ndcg_b FROM pairs),
  means AS (SELECT 'all' AS "group", metric, count(*) AS n, round(avg(a), 6) AS a, round(avg(b), 6) AS b, round(avg(b) - avg(a), 6) AS delta FROM long GROUP BY metric)"""
_LEDGER = """WITH rows AS (SELECT c_custkey AS page_id, sha256(c_name) AS hash, CASE WHEN c_custkey % 9 <> 0 THEN 'run' || (c_custkey % 2) END AS run_id FROM customer),
  old AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'old' ELSE hash END AS hash FROM rows WHERE page_id % 5 <> 0)"""
_VOTES = "votes AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id), event_type) = 1)"


def _points(agg: str, days: int) -> str:
    return f"WITH {OBSERVATIONS} " + SERIES.format(d=days, n=monitoring.POINTS[days], agg=agg)


SQL = {
    "monitoring_overview": f"""WITH {OBSERVATIONS} SELECT count(*) AS requests, coalesce(sum(tokens), 0)::BIGINT AS tokens, round(coalesce(sum(cost), 0), 6) AS cost, round(coalesce(avg(duration_ms), 0), 6) AS avg_ms,
      round(coalesce(quantile_cont(duration_ms, 0.5), 0), 6) AS p50_ms, round(coalesce(quantile_cont(duration_ms, 0.95), 0), 6) AS p95_ms, {_RATES} FROM observations WHERE {IN_WINDOW.format(d=30)}""",
    "bucket_breakdown": f"WITH {OBSERVATIONS} SELECT bucket, count(*) AS requests, round(avg(duration_ms), 6) AS avg_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost FROM observations GROUP BY bucket",
    "tenant_top3": f"WITH {OBSERVATIONS} SELECT tenant, count(*) AS requests, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost FROM observations GROUP BY tenant ORDER BY round(sum(cost), 6) DESC, min(created_at), tenant LIMIT 3",
    "series_sum": _points("sum(cost)", 30),
    "series_avg": _points("avg(duration_ms)", 7),
    "series_p95": _points("quantile_cont(duration_ms, 0.95)", 15),
    "series_rate": _points("100.0::DOUBLE * count(*) FILTER (WHERE bucket = 'failure') / count(*)", 90),
    "period_delta": f"""WITH {OBSERVATIONS}, told AS (SELECT *, created_at >= TIMESTAMP '2024-01-16' AND created_at <= TIMESTAMP '2024-01-31' AS now, created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-16' AS old FROM observations)
      SELECT count(*) FILTER (WHERE now) AS requests, count(*) FILTER (WHERE old) AS requests_before, round(sum(cost) FILTER (WHERE now), 6) AS cost, round(sum(cost) FILTER (WHERE old), 6) AS cost_before,
      round(100.0::DOUBLE * (count(*) FILTER (WHERE now) - count(*) FILTER (WHERE old)) / count(*) FILTER (WHERE old), 6) AS requests_delta FROM told""",
    "alerts": f"""WITH {OBSERVATIONS}, live AS (SELECT *, created_at > TIMESTAMP '2024-01-19 23:00:00' AS hour, created_at > TIMESTAMP '2024-01-19' AS day FROM observations WHERE created_at <= TIMESTAMP '2024-01-20'),
      told AS (SELECT round(coalesce(sum(cost) FILTER (WHERE hour), 0), 6) AS c, round(coalesce(avg(trust) FILTER (WHERE day), 0), 6) AS t, round(coalesce(avg(fallback::INT) FILTER (WHERE day), 0), 6) AS f FROM live)
      SELECT 'cost' AS alert, c AS value, c > 5.0 AS fires FROM told UNION ALL SELECT 'trust', t, t > 0 AND t < 0.6 FROM told UNION ALL SELECT 'fallback', f, f > 0.3 FROM told""",
    "dominant_event": f"WITH {OBSERVATIONS} SELECT tenant, event_type, count(*) AS n FROM observations GROUP BY tenant, event_type QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY count(*) DESC, min(created_at), event_type) = 1",
    "gauge_lines": "SELECT 'queue_depth{stream=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type",
    "percentiles": f"""WITH {OBSERVATIONS}, v AS (SELECT tenant, list(duration_ms ORDER BY duration_ms) AS v, round(quantile_cont(duration_ms, 0.9), 6) AS linear FROM observations GROUP BY tenant)
      SELECT tenant, linear, v[round_even(0.9::DOUBLE * (len(v) - 1), 0)::INT + 1] AS nearest, v[greatest(1, least(len(v), round_even(0.9::DOUBLE * len(v) + 0.5, 0)::INT))] AS upper FROM v""",
    "cost_formats": f"""WITH {OBSERVATIONS}, c AS (SELECT tenant, sum(round_even(CASE WHEN id % 2 = 0 THEN tokens * 0.15e-6 + tokens * 2 * 0.6e-6 ELSE tokens * 2.5e-6 + tokens * 2 * 10e-6 END, 6)) AS cost, sum(tokens) AS n FROM observations GROUP BY tenant)
      SELECT tenant, round(cost, 2) AS cost, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 1000 THEN printf('%.1fK', n / 1e3) ELSE n::VARCHAR END AS told FROM c""",
    "confusion": f"""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels)
      SELECT *, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, {_PRF} FROM c""",
    "router_prf": f"""WITH {PREDICTIONS}, c AS (SELECT count(*) AS n, sum(len(list_intersect(gold, pred))) AS tp, sum(len(pred) - len(list_intersect(pred, gold))) AS fp, sum(len(gold) - len(list_intersect(gold, pred))) AS fn,
      count(*) FILTER (WHERE gold[1] = pred[1]) AS a, count(*) FILTER (WHERE gold = pred) AS o, count(*) FILTER (WHERE list_sort(gold) = list_sort(pred)) AS s FROM predictions)
      SELECT n, {_PRF}, round(a / n::DOUBLE, 6) AS primary_accuracy, round(o / n::DOUBLE, 6) AS exact_ordered, round(s / n::DOUBLE, 6) AS exact_set FROM c""",
    "label_prf": f"{_LABELLED} SELECT * FROM each",
    "label_macro": f"{_LABELLED} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM each",
    "secondary_rates": f"""WITH {PREDICTIONS} SELECT round(sum(len(list_filter(pred[2:], lambda d: list_contains(gold, d)))) / nullif(sum(len(pred[2:])), 0)::DOUBLE, 6) AS secondary_precision,
      round(count(*) FILTER (WHERE len(pred) >= 2 AND NOT list_contains(gold, pred[2])) / nullif(count(*) FILTER (WHERE len(pred) >= 2), 0)::DOUBLE, 6) AS over_rate,
      round(count(*) FILTER (WHERE len(gold) >= 2 AND NOT list_contains(pred, gold[2])) / nullif(count(*) FILTER (WHERE len(gold) >= 2), 0)::DOUBLE, 6) AS under_rate FROM predictions""",
    "confidence_bins": f"{_BINS} SELECT * FROM bins",
    "ece": f"{_BINS}, raw AS (SELECT bin, count(*) AS n, avg(correct) AS a, avg(confidence) AS c FROM used GROUP BY bin) SELECT sum(n)::BIGINT AS used, (SELECT count(*) FROM predictions WHERE confidence IS NULL) AS excluded, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM raw",
    "ab_delta": f"{_PAIRS} SELECT * FROM means",
    "ab_groups": f'{_PAIRS} SELECT g AS "group", metric, count(*) AS n, round(avg(a), 6) AS a, round(avg(b), 6) AS b, round(avg(b) - avg(a), 6) AS delta FROM (SELECT unnest(groups) AS g, metric, a, b FROM long) GROUP BY ALL',
    "ab_moved": f"{_PAIRS} SELECT metric, count(*) FILTER (WHERE b - a > 0) AS improved, count(*) FILTER (WHERE b - a < 0) AS worsened FROM long GROUP BY metric",
    "threshold_sweep": """WITH r AS (SELECT l_quantity / 50 AS score, (l_partkey % 50) < l_quantity AS positive FROM lineitem), s AS (SELECT DISTINCT score, lag(score) OVER (ORDER BY score) AS lower FROM (SELECT DISTINCT score FROM r)),
      c AS (SELECT s.score, s.lower, count(*) FILTER (WHERE positive) AS tp, count(*) FILTER (WHERE NOT positive) AS fp FROM s JOIN r ON r.score >= s.score GROUP BY ALL), t AS (SELECT count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS n FROM r)
      SELECT round(CASE WHEN lower IS NULL THEN score - 1e-6 ELSE (score + lower) / 2 END, 6) AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / p::DOUBLE, 6) AS recall, round(tp / p::DOUBLE - fp / n::DOUBLE, 6) AS youden FROM c, t ORDER BY youden DESC, precision DESC, threshold LIMIT 1""",
    "gate": f"{_PAIRS} SELECT metric, b AS value, round(a + CASE WHEN metric = 'hit' THEN 0.5 ELSE 0 END, 6) AS base, b < round(a + CASE WHEN metric = 'hit' THEN 0.5 ELSE 0 END, 6) - 0.02 AS fails FROM means",
    "asset_status_counts": f"WITH {ASSETS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("processing", "draft", "completed", "failed", "deleting")) + " FROM assets",
    "asset_list": f"WITH {ASSETS} SELECT o_orderkey, status, quantity FROM assets WHERE status = 'draft' ORDER BY o_orderkey DESC LIMIT 50",
    "tenant_audit_union": """SELECT table_name, count(*) AS rows, count(*) FILTER (WHERE tenant <> 3) AS "foreign" FROM (SELECT 'orders' AS table_name, o_custkey % 10 AS tenant FROM orders UNION ALL SELECT 'customer', c_nationkey % 10 FROM customer UNION ALL SELECT 'events', user_id % 10 FROM events) GROUP BY table_name""",
    "change_detect": f"{_LEDGER} SELECT r.page_id, o.page_id IS NULL OR r.hash IS DISTINCT FROM o.hash AS changed FROM rows r LEFT JOIN old o USING (page_id)",
    "registry_upsert": f"{_LEDGER} SELECT page_id, hash FROM old WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, hash FROM rows WHERE page_id % 3 = 0",
    "stale_anti_join": f"{_LEDGER} SELECT page_id, run_id FROM rows WHERE coalesce(run_id = 'run1', true)",
    "snapshot_rotate": "SELECT o_custkey AS page_id, o_orderkey AS version, CASE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) WHEN 1 THEN 'current' ELSE 'previous' END AS slot FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 2",
    "ingest_run_summary": """WITH c AS (SELECT l_orderkey % 200 AS run_id, count(*) AS pages, count(*) FILTER (WHERE l_returnflag = 'R') AS changed, count(*) FILTER (WHERE l_orderkey % 3 = 0 AND l_linenumber = 1) AS failed FROM lineitem GROUP BY 1)
      SELECT *, CASE WHEN failed = 0 THEN 'completed' WHEN failed = pages THEN 'failed' ELSE 'partial' END AS status FROM c""",
    "last_writer": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "qrels_status": """WITH w AS (SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE list_transform(range(0, o_orderkey % 3 + 1), lambda i: o_orderkey + i * 4000) END AS ids FROM orders),
      a AS (SELECT qid, count(*) AS alive FROM (SELECT qid, unnest(ids) AS id FROM w) WHERE id IN (SELECT l_orderkey FROM lineitem) GROUP BY qid)
      SELECT qid, CASE WHEN len(ids) = 0 THEN 'empty' WHEN coalesce(alive, 0) = len(ids) THEN 'intact' WHEN coalesce(alive, 0) = 0 THEN 'missing' ELSE 'partial' END AS status, coalesce(alive, 0) AS alive FROM w LEFT JOIN a USING (qid)""",
    "dangling_keys": "SELECT DISTINCT 'left' AS side, o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT DISTINCT 'right', user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)",
    "majority_vote": f"WITH {_VOTES} SELECT * FROM votes",
    "label_shift": f"WITH {_VOTES}, g AS (SELECT user_id, max_by(event_type, event_id) AS given FROM events GROUP BY user_id) SELECT event_type AS rule, given, count(*) AS n FROM votes JOIN g USING (user_id) GROUP BY ALL",
    "drift_check": """WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS a, list_sort(list(DISTINCT l_linestatus)) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey)
      SELECT o_custkey, a <> b AS drifted, len(list_intersect(a, b)) AS shared FROM s""",
    "quota_sample": """WITH c AS (SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1), e AS (SELECT *, greatest(0, 50 - 4 * count(*) OVER ()) * n / sum(n) OVER ()::DOUBLE AS exact, greatest(0, 50 - 4 * count(*) OVER ()) AS room FROM c),
      p AS (SELECT *, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, name DESC) AS place, room - sum(floor(exact)) OVER () AS rest FROM e)
      SELECT name, n, (4 + floor(exact) + (place <= rest)::INT)::BIGINT AS quota FROM p""",
    "graph_nodes": f"""WITH {GRAPH} SELECT 'src::' || source AS id, source AS label, 'source' AS type, count(*) AS count FROM docs GROUP BY source UNION ALL SELECT 'dom::' || domain, domain, 'domain', count(*) FROM docs GROUP BY domain
      UNION ALL SELECT 'concept::' || concept, concept, 'concept', n FROM concepts UNION ALL SELECT 'doc::' || page_id, title, 'document', 1 FROM docs""",
    "graph_edges": f"""WITH {GRAPH} SELECT 'doc::' || page_id AS source, 'src::' || source AS target, 'FROM_SOURCE' AS rel FROM docs UNION ALL SELECT 'doc::' || page_id, 'dom::' || domain, 'BELONGS_TO' FROM docs
      UNION ALL SELECT 'doc::' || page_id, 'concept::' || concept, 'MENTIONS' FROM words JOIN concepts USING (concept) UNION ALL SELECT 'doc::' || a.page_id, 'doc::' || b.page_id, 'VERSION_OF' FROM docs a JOIN docs b ON a.doc_key = b.doc_key AND a.place < b.place""",
    "version_pairs": f"WITH {GRAPH} SELECT 'doc::' || a.page_id AS source, 'doc::' || b.page_id AS target FROM docs a JOIN docs b ON a.doc_key = b.doc_key AND a.place < b.place",
    "concept_degree": f"WITH {GRAPH} SELECT concept, n FROM concepts",
    "cross_domain_links": f"""WITH {GRAPH}, f AS (SELECT concept, domain, min_by(page_id, place) AS page FROM words JOIN concepts c USING (concept) GROUP BY concept, domain),
      l AS (SELECT concept, page AS source, lead(page) OVER (PARTITION BY concept ORDER BY domain) AS target FROM f) SELECT * FROM l WHERE target IS NOT NULL""",
    "graph_report": f"""WITH {GRAPH}, l AS (SELECT page_id, count(*) AS links FROM words JOIN concepts USING (concept) GROUP BY page_id),
      a AS (SELECT count(*) AS documents, count(*) FILTER (WHERE links IS NULL) AS isolated, round(avg(coalesce(links, 0)), 6) AS mean_links FROM docs LEFT JOIN l USING (page_id)),
      b AS (SELECT count(*) AS concepts, round(avg((domains > 1)::INT), 6) AS cross_domain, round(avg(n), 6) AS mean_degree, max(n) AS top_degree FROM concepts) SELECT *, round(top_degree * 100.0::DOUBLE / documents, 6) AS hairball FROM a, b""",
    "graph_hierarchy": f"""WITH {GRAPH} SELECT DISTINCT 'root' AS source, 'src::' || source AS target, 'CONTAINS' AS rel FROM docs UNION ALL SELECT DISTINCT 'src::' || source, 'folder::' || source || '/' || domain, 'CONTAINS' FROM docs
      UNION ALL SELECT 'folder::' || source || '/' || domain, 'doc::' || page_id, 'CONTAINS' FROM docs""",
}
