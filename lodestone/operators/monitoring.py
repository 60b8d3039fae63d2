"""Usage and latency over observations: id, tenant, bucket (success, requery, failure), duration_ms, tokens, cost, created_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scoring import rate

# Days of a window and its number of points.
POINTS = {1: 6, 7: 6, 15: 5, 30: 5, 90: 6, 180: 6, 365: 6}
BUCKETS = ("success", "requery", "failure")
COST_LIMIT, TRUST_LIMIT, FALLBACK_LIMIT = 5.0, 0.6, 0.3


def _count(name: str) -> Column:
    return F.count_if(F.col("bucket") == name)


def aggregates() -> list[Column]:
    """What an overview says of a set of observations; zero of none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = F.count("*")
    return [
        n.alias("requests"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.round(zero(F.sum("cost")), 6).alias("cost"),
        F.round(zero(F.avg("duration_ms")), 6).alias("avg_ms"),
        F.round(zero(F.percentile("duration_ms", 0.5)), 6).alias("p50_ms"),
        F.round(zero(F.percentile("duration_ms", 0.95)), 6).alias("p95_ms"),
        *(F.round(rate(_count(b), n), 6).alias(f"{b}_rate") for b in BUCKETS),
    ]


def in_window(as_of: Column, days: int, before: int = 0) -> Column:
    """created_at in the window that ends `before` windows ahead of as_of; the last one includes its end."""
    end = as_of - F.make_dt_interval(F.lit(days * before))
    begin = end - F.make_dt_interval(F.lit(days))
    return (F.col("created_at") >= begin) & ((F.col("created_at") <= end) if not before else (F.col("created_at") < end))


def overview(rows: DataFrame, as_of: Column, days: int) -> DataFrame:
    return rows.filter(in_window(as_of, days)).agg(*aggregates())


def by_bucket(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(
        F.count("*").alias("requests"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.round(F.percentile("duration_ms", 0.95), 6).alias("p95_ms"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost")
    )


def by_tenant(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.min("created_at").alias("first_seen"))


def top_tenants(rows: DataFrame, n: int) -> DataFrame:
    """The n tenants of greatest cost; ties go to the one seen first."""
    return by_tenant(rows).orderBy(F.desc("cost"), "first_seen", "tenant").limit(n).drop("first_seen")


def point(as_of: Column, days: int) -> Column:
    """The number of the point of a window that created_at falls on; times outside count to the nearest one."""
    total, n = days * 86400, POINTS[days]
    elapsed = F.greatest(F.lit(0), F.least(F.lit(total), F.unix_timestamp("created_at") - F.unix_timestamp(as_of) + total))
    return F.least(F.floor(elapsed * n / total), F.lit(n - 1)).cast("int")


def series(rows: DataFrame, as_of: Column, days: int, value: Column, empty: float = 0.0) -> DataFrame:
    """(point, value) of every point of the window, `empty` where there are no rows. value is an aggregate."""
    told = rows.filter(in_window(as_of, days)).groupBy(point(as_of, days).alias("point")).agg(F.round(value, 6).alias("value"))
    spine = rows.sparkSession.range(POINTS[days]).select(F.col("id").cast("int").alias("point"))
    return spine.join(told, "point", "left").select("point", F.coalesce("value", F.lit(empty)).alias("value"))


def period_delta(rows: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Requests and cost of the window and of the one before, in one pass, with the change in per cent."""
    now, old = in_window(as_of, days), in_window(as_of, days, 1)
    out = rows.agg(
        F.count_if(now).alias("requests"),
        F.count_if(old).alias("requests_before"),
        F.round(F.coalesce(F.sum(F.when(now, F.col("cost"))), F.lit(0.0)), 6).alias("cost"),
        F.round(F.coalesce(F.sum(F.when(old, F.col("cost"))), F.lit(0.0)), 6).alias("cost_before"),
    )
    return out.withColumn("requests_delta", F.round(rate(F.col("requests") - F.col("requests_before"), F.col("requests_before")), 6))


def alerts(rows: DataFrame, as_of: Column, trust: str = "trust", fallback: str = "fallback") -> DataFrame:
    """(alert, value, fires): cost of the last hour, mean trust and reranker fallbacks of the last day."""
    hour = F.col("created_at") > as_of - F.expr("INTERVAL 1 HOUR")
    day = F.col("created_at") > as_of - F.expr("INTERVAL 1 DAY")
    live = rows.filter(F.col("created_at") <= as_of).agg(
        F.round(F.coalesce(F.sum(F.when(hour, F.col("cost"))), F.lit(0.0)), 6).alias("cost"),
        F.round(F.coalesce(F.avg(F.when(day, F.col(trust))), F.lit(0.0)), 6).alias("trust"),
        F.round(F.coalesce(F.avg(F.when(day, F.col(fallback).cast("double"))), F.lit(0.0)), 6).alias("fallback"),
    )
    fires = {"cost": F.col("cost") > COST_LIMIT, "trust": (F.col("trust") > 0) & (F.col("trust") < TRUST_LIMIT), "fallback": F.col("fallback") > FALLBACK_LIMIT}
    told = F.array(*(F.struct(F.lit(n).alias("alert"), F.col(n).alias("value"), f.alias("fires")) for n, f in fires.items()))
    return live.select(F.inline(told))


def dominant(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The most frequent key of each group; ties go to the one that comes first in time."""
    counts = rows.groupBy(*by, key).agg(F.count("*").alias("n"), F.min("created_at").alias("first_seen"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "first_seen", key)
    return counts.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "first_seen")


def gauges(rows: DataFrame, name: str, label: str, column: str, value: str) -> DataFrame:
    """Lines of the text exposition format, one a row, in order of label."""
    return rows.select(F.format_string(f'{name}{{{label}="%s"}} %s', F.col(column).cast("string"), F.col(value).cast("string")).alias("line")).orderBy("line")


def queue_depths(jobs: DataFrame, outbox: DataFrame, now: Column) -> DataFrame:
    """(queue, depth): jobs that wait or are in work, and rows of the outbox that are due."""
    a = jobs.agg(F.count_if(F.col("status") == "queued").alias("report_jobs_queued"), F.count_if(F.col("status") == "processing").alias("report_jobs_processing"))
    b = outbox.agg(F.count_if(F.col("published_at").isNull() & (F.col("available_at") <= now)).alias("event_outbox_pending"))
    row = a.join(F.broadcast(b), F.lit(True))  # one row each
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("queue"), F.col(c).alias("depth")) for c in row.columns))))
