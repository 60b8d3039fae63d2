"""Tables of what is indexed: changes, upserts, snapshots, stale rows, audits and status counts.

Plain Parquet has no MERGE: an upsert is an anti join and a union, written to a new place by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAILED = ("transcription_failed", "correction_failed", "report_failed", "cancelled")


def changed(new: DataFrame, stored: DataFrame, key: Sequence[str] = ("page_id",)) -> DataFrame:
    """new (key, hash) with changed: no row is stored or its hash differs."""
    old = stored.select(*key, F.col("hash").alias("_stored"), F.lit(True).alias("_known"))
    out = new.join(old, list(key), "left")
    return out.withColumn("changed", F.col("_known").isNull() | ~F.col("hash").eqNullSafe(F.col("_stored"))).drop("_stored", "_known")


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """stored with the rows of new in place of those of the same key."""
    return stored.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def latest(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; last writers win with a descending order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def snapshots(rows: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """The newest row of each key as current and the one before as previous; older ones go."""
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    out = rows.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    return out.withColumn("slot", F.when(F.col("_n") == 1, "current").otherwise("previous")).drop("_n")


def stale(rows: DataFrame, run: Column | str) -> Column:
    """Rows of another run; a row without run isn't stale."""
    return F.col("run_id") != (F.lit(run) if isinstance(run, str) else run)


def run_summary(rows: DataFrame) -> DataFrame:
    """(run_id, status, pages, changed, failed): counters of index runs."""
    return rows.groupBy("run_id").agg(F.count("*").alias("pages"), F.count_if("changed").alias("changed"), F.count_if("failed").alias("failed")).withColumn(
        "status", F.when(F.col("failed") == 0, "completed").when(F.col("failed") == F.col("pages"), "failed").otherwise("partial")
    )


def asset_status(workflow: Column, report: Column) -> Column:
    """The status shown for a workflow and its report (null without one), first case first."""
    return (
        F.when(workflow == "deleting", "deleting")
        .when(workflow.isin(*FAILED), "failed")
        .when((report == "published") | (workflow == "published"), "completed")
        .when(report == "publishing", "processing")
        .when(report.isNotNull(), "draft")
        .otherwise("processing")
    )


def status_counts(rows: DataFrame, names: Sequence[str] = ("processing", "draft", "completed", "failed", "deleting")) -> DataFrame:
    """One row with the number of rows of each status and of all."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in names))


def tenant_audit(tables: dict[str, DataFrame], expected: Column) -> DataFrame:
    """(table_name, rows, foreign): rows of each table, and those of a tenant other than expected."""
    every = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("table_name"), "tenant")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("table_name").agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("tenant") != expected, F.lit(True))).alias("foreign"))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("right").alias("side"), key))


def liveness(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """(qid, status, n, alive) of wanted (qid, ids array): empty, intact, missing or partial by the ids that are in live (id)."""
    listed = wanted.select("qid", F.explode("ids").alias("id")).join(live.select("id").distinct().withColumn("_live", F.lit(1)), "id", "left")
    counts = listed.groupBy("qid").agg(F.count("_live").alias("alive"))
    out = wanted.select("qid", F.size("ids").alias("n")).join(counts, "qid", "left").withColumn("alive", F.coalesce("alive", F.lit(0)))
    status = F.when(F.col("n") <= 0, "empty").when(F.col("alive") == F.col("n"), "intact").when(F.col("alive") == 0, "missing").otherwise("partial")
    return out.withColumn("status", status)


def majority(rows: DataFrame, key: str, vote: str, order: str) -> DataFrame:
    """The most frequent vote of each key; ties go to the vote seen first."""
    counts = rows.groupBy(key, vote).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    return latest(counts, [key], F.desc("votes"), F.asc("_first"), F.asc(vote)).drop("_first")


def quota(counts: DataFrame, total: int, floor: int) -> DataFrame:
    """(name, n, quota): `floor` each, the rest by share of n; what rounding leaves goes to the largest remainders, then by name from the end."""
    rest = Window.partitionBy()
    room = F.greatest(F.lit(0), F.lit(total) - F.lit(floor) * F.count("*").over(rest))
    exact = F.coalesce(F.try_divide(room * F.col("n"), F.sum("n").over(rest)), F.lit(0.0))
    out = counts.withColumn("_exact", exact).withColumn("_room", room).withColumn("_whole", F.floor("_exact"))
    left = F.col("_room") - F.sum("_whole").over(rest)
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_whole"), 9)), F.desc("name")))
    out = out.withColumn("_left", left).withColumn("_place", place)
    return out.select("name", "n", (F.lit(floor) + F.col("_whole") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("quota"))


def sample_per_group(rows: DataFrame, group: str, id: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group, the same on every run."""
    return latest_k(rows, [group], k, F.xxhash64(F.lit(seed), F.col(id)), F.col(id))


def latest_k(rows: DataFrame, key: Sequence[str], k: int, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def owned(rows: DataFrame, tenant: Column, user: Column) -> DataFrame:
    """Rows of this tenant and user; a row without either is nobody's."""
    return rows.filter((F.col("tenant") == tenant) & (F.col("user_id") == user))


def with_owner(reports: DataFrame, workflows: DataFrame) -> DataFrame:
    """reports (workflow) with the tenant and user of their workflow; those of none go."""
    return reports.join(workflows.select("workflow", "tenant", "user_id"), "workflow")


def with_reports(workflows: DataFrame, reports: DataFrame) -> DataFrame:
    """workflows with the report of their transcription and tenant, null without one; a report of another tenant is nobody's."""
    return workflows.join(reports, ["transcription", "tenant"], "left")


def total(queries: DataFrame, answers: DataFrame, key: str = "qid") -> DataFrame:
    """queries joined with answers; the job fails if either side has a key that the other lacks."""
    lost = unmatched(queries, answers, key)
    checked = queries.join(answers, key, "left").unionByName(lost.select(key).withColumn("_lost", F.lit(True)), allowMissingColumns=True)
    fail = F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string")))
    return checked.withColumn(key, F.when(F.col("_lost"), fail.cast(queries.schema[key].dataType)).otherwise(F.col(key))).drop("_lost")


def index_documents(rows: DataFrame, tenant: Column, source: str | None = None) -> DataFrame:
    """Ledger rows as documents of the text index: those of the tenant and source that have a text, by tenant and page."""
    text = F.coalesce("cleaned", F.lit(""))
    kept = rows.filter((F.col("tenant") == tenant) & (F.trim(text) != ""))
    kept = kept if source is None else kept.filter(F.col("source") == source)
    return kept.select(F.concat_ws(":", "tenant", "page_id").alias("id"), "tenant", F.col("page_id").alias("doc_id"), "source", "title", F.coalesce("domain", F.lit("")).alias("domain"), text.alias("content"))


def payload(chunks: DataFrame, tenant: Column) -> DataFrame:
    """chunks as stored beside their vectors: without vector and embedding_text, with an id that follows from the chunk's, and the tenant."""
    return chunks.drop("vector", "embedding_text").withColumn("point", F.md5(F.col("chunk_id").cast("string"))).withColumn("tenant", tenant)


def batches(rows: DataFrame, id: str, size: int, error: Column | None = None) -> DataFrame:
    """rows with the number of their bulk request, about `size` rows each, by hash of the id; a row with an error fails the job."""
    n = max(1, -(-rows.count() // size))
    number = F.pmod(F.xxhash64(id), F.lit(n))
    if error is not None:
        number = F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("bulk request failed: "), error)).cast("long")).otherwise(number)
    return rows.withColumn("batch", number)


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row: chunks, pages, and a sum over their hashes that any change changes."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("page_id").alias("pages"), F.sum(F.xxhash64("chunk_id", "hash").cast("decimal(38,0)")).cast("string").alias("fingerprint"))


ACTIVE = ("queued", "running")


def active_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each tenant that is queued or running."""
    return latest(runs.filter(F.col("status").isin(*ACTIVE)), ["tenant"], F.desc("created_at"), F.desc("run_id"))


def claimed(runs: DataFrame) -> DataFrame:
    """runs with the oldest queued one running; one writer claims at a time, so nothing is locked."""
    first = runs.filter("status = 'queued'").agg(F.min_by("run_id", F.struct("created_at", "run_id")).alias("_next"))
    taken = F.col("run_id") == F.col("_next")
    out = runs.join(F.broadcast(first), F.lit(True), "left")  # one row
    return out.withColumn("stage", F.when(taken, "fetching").otherwise(F.col("stage"))).withColumn("status", F.when(taken, "running").otherwise(F.col("status"))).drop("_next")


def finished(runs: DataFrame, results: DataFrame) -> DataFrame:
    """runs with the results (run_id, indexed, failed, chunks, deleted, error) of those that ended; an error fails a run."""
    told = results.withColumnRenamed("run_id", "_run")
    out = runs.join(told, F.col("run_id") == F.col("_run"), "left")
    ended, bad = F.col("_run").isNotNull(), F.col("error").isNotNull()
    status = F.when(ended & bad, "failed").when(ended, "success").otherwise(F.col("status"))
    done = F.when(ended & ~bad, F.col("skipped") + F.col("indexed") + F.col("failed"))
    stage = F.when(ended, "completed").otherwise(F.col("stage"))
    return out.withColumn("status", status).withColumn("stage", stage).withColumn("processed", done).withColumn("error", F.substring("error", 1, 1000)).drop("_run")


# What a report job and the result that it is made of must agree in.
AGREE = ("transcription", "tenant", "raw_sha", "corrected_sha", "dictionary")


def integrity(jobs: DataFrame, results: DataFrame, key: str = "job") -> DataFrame:
    """(key, mismatch): the first part in which a job and its result differ, null if they agree in all."""
    told = results.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in AGREE))
    out = jobs.join(told, F.col(key) == F.col("_key"))
    return out.select(key, F.coalesce(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in AGREE)).alias("mismatch"))


def adjacent(chunks: DataFrame, span: int = 2, most: int = 1) -> DataFrame:
    """(page_id, number, chunks): runs of `span` chunks with indices one after the other, cut off from a page's begin on, `most` a page."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("chunk_index", "chunk_id")) - 1
    told = F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id")))
    rows = chunks.withColumn("_run", F.floor(place / span)).groupBy("page_id", "_run").agg(told.alias("t"), F.min("chunk_index").alias("_min"), F.max("chunk_index").alias("_max"), F.count_distinct("chunk_index").alias("_n"))
    rows = rows.filter((F.col("_n") == span) & (F.col("_max") - F.col("_min") == span - 1) & (F.size("t") == span))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("page_id").orderBy("_run"))).filter(F.col("number") <= most)
    return rows.select("page_id", "number", F.col("t.chunk_id").alias("chunks"))


def candidates(missing: DataFrame, live: DataFrame, length: int = 160) -> DataFrame:
    """(chunk_id, candidate, preview): for each missing chunk those of its page that are there; null where the page has none."""
    from lodestone.functions.text import page_of_any_chunk

    wanted = missing.select("chunk_id", page_of_any_chunk(F.col("chunk_id")).alias("_page"))
    told = live.select(F.col("chunk_id").alias("candidate"), F.substring(F.coalesce("content", F.lit("")), 1, length).alias("preview"), F.coalesce(F.col("page_id").cast("string"), page_of_any_chunk(F.col("chunk_id"))).alias("_live"))
    return wanted.join(told, F.col("_page") == F.col("_live"), "left").select("chunk_id", "candidate", "preview")


def looked_up(ids: DataFrame, live: DataFrame, name: str = "domain", unknown: str = "<unknown>") -> DataFrame:
    """ids (chunk_id) with a column of live (chunk_id); unknown where a chunk is gone or has none."""
    told = live.select(F.col("chunk_id").alias("_id"), F.col(name).alias("_value"))
    out = ids.join(told, F.col("chunk_id") == F.col("_id"), "left")
    return out.select(*ids.columns, F.when(F.coalesce("_value", F.lit("")) == "", unknown).otherwise(F.col("_value")).alias(name))


def agreement(pairs: DataFrame, a: str, b: str, top: int = 12) -> DataFrame:
    """(kind, a, b, n, rate) of two labellings, null ones left out: the rate of agreement, and the `top` most frequent moves."""
    known = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    same = known.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("n"), F.sum("n").alias("all"))
    none = F.lit(None).cast("string")
    rate = same.select(F.lit("agreement").alias("kind"), none.alias("a"), none.alias("b"), "n", F.round(F.try_divide(F.col("n").cast("double"), F.col("all")), 6).alias("rate"))
    moves = known.filter("a <> b").orderBy(F.desc("n"), "a", "b").limit(top)
    return rate.unionByName(moves.select(F.lit("move").alias("kind"), "a", "b", "n", F.lit(None).cast("double").alias("rate")))
